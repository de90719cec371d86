"""Reports and chart specifications, built on the driver from small summaries.

Charts come as plotly-JSON or Vega-Lite dictionaries, so neither library is needed; the seaborn backend draws with
matplotlib where that is installed.
"""

from __future__ import annotations

import base64
import html
import io
import json
from typing import Any

from pyspark.sql import DataFrame

BACKENDS = ("seaborn", "plotly", "altair")


def check_backend(backend: str) -> None:
    if backend not in BACKENDS:
        raise ValueError("backend is 'seaborn', 'plotly' or 'altair'")


class Report:
    """An HTML report; shows itself in notebooks."""

    def __init__(self, body: str):
        self.body = body

    def _repr_html_(self) -> str:
        return self.body

    def as_raw_html(self) -> str:
        return self.body

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as file:
            file.write(self.body)


class Panel:
    """What one pair of axes shows: a bar chart of rows (value None), bins that touch (kind 'bins') or a heatmap."""

    def __init__(self, kind: str, rows: list[dict[str, Any]], x: str, y: str, *, value: str | None = None, title: str = "", annotate: bool = False, label: str | None = None, line: list[tuple[float, float]] | None = None):
        self.kind, self.rows, self.x, self.y, self.value, self.title, self.annotate, self.label, self.line = kind, rows, x, y, value, title, annotate, label, line

    def matrix(self) -> tuple[list[str], list[str], list[list[float | None]]]:
        xs, ys = list(dict.fromkeys(r[self.x] for r in self.rows)), list(dict.fromkeys(r[self.y] for r in self.rows))
        cells = {(r[self.y], r[self.x]): r[self.value] for r in self.rows}
        return xs, ys, [[cells.get((b, a)) for a in xs] for b in ys]

    def labels(self) -> list[str]:
        return [str(r[self.label]) for r in self.rows] if self.label else []

    def plotly(self, number: int) -> dict[str, Any]:
        end = "" if number == 1 else str(number)
        axes = {"xaxis": f"x{end}", "yaxis": f"y{end}"}
        if self.kind == "heatmap":
            xs, ys, z = self.matrix()
            trace: dict[str, Any] = {"type": "heatmap", "x": xs, "y": ys, "z": z, "zmin": -1, "zmax": 1, "colorscale": "RdBu"} | axes
            if self.annotate:
                trace["text"], trace["texttemplate"] = [["" if v is None else f"{v:.2f}" for v in line] for line in z], "%{text}"
            return trace
        trace = {"type": "bar", "x": [r[self.x] for r in self.rows], "y": [r[self.y] for r in self.rows], "name": self.title} | axes
        if self.kind == "bins":
            trace |= {"width": [r["high"] - r["low"] for r in self.rows], "offset": 0}
        if self.label:
            trace |= {"text": self.labels(), "textposition": "outside"}
        return trace

    def vega(self) -> dict[str, Any]:
        values, title = {"data": {"values": self.rows}}, {"title": self.title} if self.title else {}
        if self.kind == "heatmap":
            encoding = {"x": {"field": self.x, "type": "nominal", "sort": None}, "y": {"field": self.y, "type": "nominal", "sort": None}}
            color = {"color": {"field": self.value, "type": "quantitative", "scale": {"scheme": "redblue", "domain": [-1, 1]}}}
            if not self.annotate:
                return values | title | {"mark": "rect", "encoding": encoding | color}
            return values | title | {"layer": [{"mark": "rect", "encoding": encoding | color}, {"mark": "text", "encoding": encoding | {"text": {"field": self.value, "format": ".2f"}}}]}
        if self.kind == "bins":
            return values | title | {"mark": "bar", "encoding": {"x": {"field": "low", "type": "quantitative", "bin": {"binned": True}}, "x2": {"field": "high"}, "y": {"field": self.y, "type": "quantitative"}}}
        encoding = {"x": {"field": self.x, "type": "nominal", "sort": None}, "y": {"field": self.y, "type": "quantitative"}}
        if self.label:
            return values | title | {"layer": [{"mark": "bar", "encoding": encoding}, {"mark": {"type": "text", "dy": -6}, "encoding": encoding | {"text": {"field": self.label, "type": "nominal"}}}]}
        return values | title | {"mark": "bar", "encoding": encoding}

    def draw(self, axes: Any) -> None:
        """On matplotlib axes."""
        if self.kind == "heatmap":
            xs, ys, z = self.matrix()
            axes.imshow([[float("nan") if v is None else v for v in line] for line in z], vmin=-1, vmax=1, cmap="RdBu")
            axes.set_xticks(range(len(xs)), xs)
            axes.set_yticks(range(len(ys)), ys)
            for i, line in enumerate(z if self.annotate else []):
                for j, v in enumerate(line):
                    if v is not None:
                        axes.text(j, i, f"{v:.2f}", ha="center", va="center")
        elif self.kind == "bins":
            axes.bar([r["low"] for r in self.rows], [r[self.y] for r in self.rows], width=[r["high"] - r["low"] for r in self.rows], align="edge")
            if self.line:
                axes.plot(*zip(*self.line, strict=True))
        else:
            bars = axes.bar([str(r[self.x]) for r in self.rows], [r[self.y] for r in self.rows])
            if self.label:
                axes.bar_label(bars, self.labels())
        axes.set_title(self.title)

    def svg(self, left: float, top: float, width: float, height: float) -> str:
        """Within a rectangle of an SVG drawing."""
        text = lambda x, y, t, size=10, more="": f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" text-anchor="middle" {more}>{html.escape(str(t))}</text>'
        out = [text(left + width / 2, top + 12, self.title, 12)]
        top, height = top + 18, height - 48
        if self.kind == "heatmap":
            xs, ys, z = self.matrix()
            w, h = width / max(len(xs), 1), height / max(len(ys), 1)
            for i, line in enumerate(z):
                for j, v in enumerate(line):
                    shade = 0 if v is None or v != v else int(200 * min(abs(v), 1))
                    color = "#eee" if v is None else f"rgb({255 - shade},{255 - shade},255)" if v > 0 else f"rgb(255,{255 - shade},{255 - shade})"
                    out.append(f'<rect x="{left + j * w:.1f}" y="{top + i * h:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{color}"><title>{html.escape(f"{ys[i]}, {xs[j]}: {v}")}</title></rect>')
                    if self.annotate and v is not None:
                        out.append(text(left + (j + 0.5) * w, top + (i + 0.5) * h, f"{v:.2f}"))
            out += [text(left + (j + 0.5) * w, top + height + 14, x) for j, x in enumerate(xs)]
            return "".join(out)
        most = max((r[self.y] or 0 for r in self.rows), default=0) or 1
        w = width / max(len(self.rows), 1)
        for i, r in enumerate(self.rows):
            h = height * 0.92 * (r[self.y] or 0) / most
            out.append(f'<rect x="{left + i * w:.1f}" y="{top + height - h:.1f}" width="{w * (1 if self.kind == "bins" else 0.8):.1f}" height="{h:.1f}" fill="#4c78a8"/>')
            out.append(text(left + (i + 0.4) * w, top + height + 14, f"{r[self.x]:.4g}" if isinstance(r[self.x], float) else r[self.x], 8))
            if self.label:
                out.append(text(left + (i + 0.4) * w, top + height - h - 3, r[self.label], 8))
        return "".join(out)


class Figure:
    """A chart of one or more panels: `spec` (plotly-JSON or Vega-Lite), the DataFrame it shows, and its backend."""

    def __init__(self, backend: str, panels: list[Panel], title: str, width: int | None, height: int | None, data: DataFrame | None = None):
        self.backend, self.panels, self.title, self.data = backend, panels, title, data
        self.width, self.height = width, height
        self.columns = 2 if len(panels) > 1 else 1
        size = {k: v for k, v in (("width", width), ("height", height)) if v}
        if backend == "altair":
            body = panels[0].vega() if len(panels) == 1 else {"concat": [p.vega() for p in panels], "columns": self.columns}
            self.spec = {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "title": title} | body | size
        else:
            layout: dict[str, Any] = {"title": {"text": title}} | size
            if len(panels) > 1:
                layout |= {"grid": {"rows": self.lines, "columns": self.columns, "pattern": "independent"}, "showlegend": False}
                layout["annotations"] = [{"text": p.title, "showarrow": False, "xref": "paper", "yref": "paper", "x": (i % 2 + 0.5) / 2, "y": 1 - (i // 2) / self.lines} for i, p in enumerate(panels)]
            self.spec = {"data": [p.plotly(i + 1) for i, p in enumerate(panels)], "layout": layout}

    @property
    def lines(self) -> int:
        return max(1, -(-len(self.panels) // self.columns))

    def to_json(self) -> str:
        return json.dumps(self.spec)

    def to_html(self) -> str:
        # inside <script>, JSON's own escapes keep a text from ending it; HTML's would be shown as they are
        data = self.to_json().replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
        if self.backend == "altair":
            return f'<div id="chart"></div><script src="https://cdn.jsdelivr.net/npm/vega-embed@6"></script><script>vegaEmbed("#chart", {data})</script>'
        return f'<div id="chart"></div><script src="https://cdn.plot.ly/plotly-2.35.2.min.js"></script><script>Plotly.newPlot("chart", {data})</script>'

    def to_svg(self) -> str:
        wide, high = self.width or 800, self.height or 400 * self.lines
        w, h = wide / self.columns, (high - 24) / self.lines
        body = "".join(p.svg(i % self.columns * w + 10, 24 + i // self.columns * h, w - 20, h) for i, p in enumerate(self.panels))
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{high}" font-family="sans-serif"><text x="{wide / 2}" y="16" font-size="14" text-anchor="middle">{html.escape(self.title)}</text>{body}</svg>'

    def draw(self) -> Any:
        """As a matplotlib figure."""
        return _drawn(self.panels, self.title, self.width, self.height)

    def save(self, path: str, scale: float = 1.0) -> None:
        """By the extension: the page, the specification, or an image (.svg; others are drawn by matplotlib)."""
        kind = str(path).rpartition(".")[2].lower()
        texts = {"html": self.to_html, "htm": self.to_html, "json": self.to_json, "svg": self.to_svg}
        if kind in texts:
            with open(path, "w", encoding="utf-8") as file:
                file.write(texts[kind]())
        elif kind in ("png", "pdf", "jpg", "jpeg"):
            self.draw().savefig(path, dpi=100 * scale)
        else:
            raise ValueError(f"charts are saved as html, json, svg, png, pdf or jpg, not {kind!r}")


def figure(backend: str, panels: Panel | list[Panel], *, title: str = "", width: int | None = None, height: int | None = None, data: DataFrame | None = None):
    """A chart of one or more panels."""
    check_backend(backend)
    panels = [panels] if isinstance(panels, Panel) else panels
    if backend == "seaborn":
        return _drawn(panels, title, width, height)
    return Figure(backend, panels, title, width, height, data)


def message(backend: str, text: str, width: int | None = None, height: int | None = None):
    """A figure that only says something."""
    return figure(backend, Panel("bar", [], "x", "y"), title=text, width=width, height=height)


def _drawn(panels: list[Panel], title: str, width: int | None, height: int | None):
    try:
        from matplotlib.figure import Figure as Drawing
    except ImportError as error:
        raise ImportError("drawing images and the seaborn backend need matplotlib") from error
    columns = 2 if len(panels) > 1 else 1
    lines = max(1, -(-len(panels) // columns))
    drawing = Drawing(figsize=((width or 800) / 100, (height or 600 * lines) / 100), dpi=100)
    for i, p in enumerate(panels):
        p.draw(drawing.add_subplot(lines, columns, i + 1))
    drawing.suptitle(title)
    return drawing


def format_number(v: Any, *, decimals: int = 2, sep_mark: str = ",", dec_mark: str = ".", compact: bool = False, pattern: str | None = None) -> str:
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    suffix = ""
    if compact:
        for limit, letter in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
            if abs(v) >= limit:
                v, suffix = v / limit, letter
                break
    text = f"{v:,d}" if isinstance(v, int) else f"{v:,.{decimals}f}"
    text = text.replace(",", "\0").replace(".", dec_mark).replace("\0", sep_mark) + suffix
    return pattern.replace("{x}", text) if pattern else text


def _bars(counts: list[int] | None) -> str:
    if not counts:
        return ""
    top, wide = max(max(counts), 1), 8
    parts = "".join(f'<rect x="{i * wide}" y="{30 - 30 * c / top:.1f}" width="{wide - 1}" height="{30 * c / top:.1f}"/>' for i, c in enumerate(counts))
    return f'<svg width="{wide * len(counts)}" height="30">{parts}</svg>'


# The spanners of the expanded report and their columns.
SPANNERS = {
    "Basic": ["Dtype", "Count", "null_count", "Pct_Missing", "Mean", "std", "Min", "Max"],
    "Quantiles": ["25%", "50%", "75%", "IQR"],
    "Distribution": ["skew", "Kurtosis", "MAD", "Distribution_Plot"],
    "Counts & Ratios": ["N_Unique", "N_Unique(approx)", "Uniqueness_Ratio", "N_Duplicates", "Pct_Duplicates", "N_Zero", "Pct_Zero", "Pct_Pos", "Pct_Neg"],
    "Outliers": ["N_Outliers", "Pct_Outliers"],
    "Statistical Tests": ["Normality_Test", "Uniformity_Test", "Opt_Dtype"],
    "Quality Assessment": ["Shakiness_Score", "Quality_Flag", "Usability_Flags", "Usability_Score", "Recommendation", "Correlation", "Correlation_Plot"],
}
_DIGITS = {"skew": 3, "Kurtosis": 3, "Uniqueness_Ratio": 4}


def memory_text(size: float | None) -> str:
    """A size in KB, MB or GB with one decimal."""
    if size is None:
        return "Unknown"
    mb = size / 1024**2
    return f"{size / 1024:.1f} KB" if mb < 1 else f"{mb:.1f} MB" if mb < 1000 else f"{mb / 1024:.1f} GB"


def _plan_bytes(df: DataFrame) -> float | None:
    try:
        return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # statistics are for show only
        return None


def profile_report(df: DataFrame, summary: DataFrame, *, rows: int, expanded: bool, title: str | None, elapsed_ms: float, corr_target: str | None, decimals: int, sep_mark: str, dec_mark: str, compact: bool, pattern: str | None) -> Report:
    lines = [r.asDict() for r in summary.collect()]
    names = summary.columns
    say = lambda v, d=decimals: format_number(v, decimals=d, sep_mark=sep_mark, dec_mark=dec_mark, compact=compact, pattern=pattern)
    title = title if title is not None else "🔬 Expanded Statistics" if expanded else "🔬 DataFrame X-ray"
    under = f"{rows:,} rows and {len(df.columns)} columns, {memory_text(_plan_bytes(df))}; profiled in {elapsed_ms:.0f} ms"
    if expanded:
        groups = {k: [c for c in v if c in names] for k, v in SPANNERS.items()}
        placed = {c for v in groups.values() for c in v} | {"Column"}
        groups["Quantiles"] = [c for c in names if c.endswith("%") and c not in placed] + groups["Quantiles"]
        groups = {k: v for k, v in groups.items() if v}
    else:
        groups = {"": [c for c in names if c != "Column"]}
    order = [c for v in groups.values() for c in v]
    head = "".join(f'<th colspan="{len(v)}">{html.escape(k)}</th>' for k, v in groups.items())
    body = []
    for line in lines:
        cells = []
        for c in order:
            v = line[c]
            digits = _DIGITS.get(c, 1 if expanded and c.startswith("Pct_") else decimals)
            cells.append(f"<td>{_bars(v) if c == 'Distribution_Plot' else html.escape(say(v, digits))}</td>")
        body.append(f"<tr><th>{html.escape(line['Column'])}</th>{''.join(cells)}</tr>")
    heads = "".join(f"<th>{html.escape(c)}</th>" for c in order)
    return Report(f"<table><caption><b>{html.escape(title)}</b><br>{html.escape(under)}</caption><thead><tr><th></th>{head}</tr><tr><th>Column</th>{heads}</tr></thead><tbody>{''.join(body)}</tbody></table>")


def save_fig(obj: Any, path: str, *, scale: float = 1.0) -> None:
    """Writes a chart or report: matplotlib by savefig at 300 dpi, plotly figures as HTML or image, others by save; scale is
    for images."""
    if isinstance(obj, Figure):
        obj.save(path, scale)
    elif hasattr(obj, "savefig"):
        obj.savefig(path, dpi=300)
    elif hasattr(obj, "write_html") and str(path).endswith("html"):
        obj.write_html(path)
    elif hasattr(obj, "write_image"):
        obj.write_image(path, scale=scale)
    else:
        obj.save(path)


def fig_to_base64_png(fig: Any) -> str:
    """A data URL of a matplotlib figure."""
    if not hasattr(fig, "savefig"):
        raise ValueError("a matplotlib figure is needed")
    out = io.BytesIO()
    fig.savefig(out, format="png")
    return "data:image/png;base64," + base64.b64encode(out.getvalue()).decode()
