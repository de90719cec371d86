"""`xray`: one row of statistics for each column.

A call runs a fixed number of Spark jobs whatever the number of columns: counts and moments, distinct counts, order
statistics (see `selection`), and one for histograms and outliers; expanded output adds deviations and tests (see `fits`).
Numeric columns are read in long form, as doubles, so the code that Spark generates stays small. Where doubles would not
tell a column's values apart (decimals of over 15 digits, whole numbers above 2 ** 53), its exact distance from its least
value is profiled instead, and distinct values and ranks are those of the type itself. Only the summary reaches the driver.

Where this differs from its model: booleans aren't numeric; nested columns give
counts; there is no `Std` beside `std`; `Correlation` is text; one row gives no z-score outliers and no error;
figures are rounded half up.
"""

from __future__ import annotations

import math
import time
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions
from ..functions.dtypes import included, is_float, is_integer, is_nested, is_numeric, is_string, name_of
from ..functions.stats import correlation, excess_kurtosis, greatest, quoted, skew
from . import fits, quality
from .distinct import distinct_counts
from .selection import Grid, by_number, cumulative, exact_ranks, long_form, nearest_rank, numbered_form, release, select_ranks, told_apart

#: Rows up to which distinct values are counted exactly.
EXACT_DISTINCT_ROWS = 300_000
#: Aggregates of a job over the columns as they are: with more, Spark leaves generated code.
FIELDS = 60


def percentile_label(p: float) -> str:
    return "50%" if p == 0.5 else f"{int(p * 100)}%"


def suggest_dtype(kind: T.DataType, stats: dict[str, Any], *, strict_int32: bool = False) -> str:
    """A storage type for a column, from its summary."""
    if not stats["valid"]:
        return name_of(kind)
    if stats.get("binary"):
        return "Bool"
    if is_integer(kind):
        low, high = stats["exact_min"], stats["exact_max"]
        for name, bits in (("Int8", 7), ("Int16", 15)):
            if low >= -(1 << bits) and high < 1 << bits:
                return name
        return "Int32" if low >= -(1 << 31) and (not strict_int32 or high < 1 << 31) else "Int64"
    if is_float(kind):
        return "Int64" if stats["integral"] else "Float32"
    if is_string(kind):
        return "Categorical" if stats["distinct"] / stats["rows"] < 0.5 else "String"
    return name_of(kind)


def _groupable(name: str, kind: T.DataType) -> Column:
    column = quoted(name)
    return F.to_json(column) if isinstance(kind, T.MapType | T.VariantType) else column


def _base(df: DataFrame, columns: list[str], kinds: dict[str, T.DataType], target: str | None, expanded: bool) -> dict[str, dict[str, Any]]:
    """Counts and moments: of all numeric columns in long form in one job, of the others in another."""
    numeric = [c for c in columns if is_numeric(kinds[c])]
    out: dict[str, dict[str, Any]] = {c: {} for c in columns}
    rows = 0
    counted = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        c, kind = quoted(name), kinds[name]
        if name not in numeric:
            counted.append(F.count(c).alias(f"{i}_valid"))
            if expanded and isinstance(kind, T.BooleanType):
                counted.append(F.lit(True).alias(f"{i}_binary"))
        elif expanded and is_integer(kind):  # as doubles, large ones would lose their last digits
            counted += [F.min(c).alias(f"{i}_exact_min"), F.max(c).alias(f"{i}_exact_max")]
    if len(counted) > 1 or not numeric:
        for at in range(1, max(len(counted), 2), FIELDS):
            row = df.agg(counted[0], *counted[at : at + FIELDS]).first().asDict()
            rows = row.pop("rows")
            for key, value in row.items():
                i, _, what = key.partition("_")
                out[columns[int(i)]][what] = value
    if numeric:
        v = F.col("v")
        aggregates = [F.count(F.lit(1)).alias("rows"), F.count(v).alias("valid"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), greatest(v).alias("max"), skew(v).alias("skew")]
        aggregates += [F.count_if(v == 0).alias("zero"), F.count_if(v > 0).alias("pos"), F.count_if(v < 0).alias("neg"), F.count_if(F.isnan(v)).alias("nan")]
        if target:
            aggregates.append(correlation(F.col("_target"), v).alias("corr"))
        if expanded:
            aggregates += [excess_kurtosis(v).alias("kurtosis"), F.stddev_pop(v).alias("pop"), F.bool_and(v.isin(0.0, 1.0)).alias("binary"), F.bool_and(F.when(~F.isnan(v), v == F.floor(v))).alias("integral")]
        others = [quoted(target).cast("double").alias("_target")] if target else []
        found = {r["i"]: r.asDict() for r in long_form(df, [quoted(c) for c in numeric], *others).groupBy("i").agg(*aggregates).collect()}
        none = dict.fromkeys(("mean", "std", "min", "max", "skew", "corr", "kurtosis", "pop", "binary", "integral")) | dict.fromkeys(("rows", "valid", "zero", "pos", "neg", "nan"), 0)
        for i, name in enumerate(numeric):
            out[name] |= none | found.get(i, {})
            rows = out[name]["rows"]
    for c in columns:
        out[c]["rows"] = rows
    return out


def _distinct(df: DataFrame, columns: list[str], kinds: dict[str, T.DataType], stats: dict[str, dict[str, Any]], rows: int, exact: bool, known: dict[str, int]) -> bool:
    """Fills in `distinct`, null being a value; True if approximate. known: counts without null that are exact anyway."""
    approximate = rows > EXACT_DISTINCT_ROWS and not exact
    if not columns:
        return approximate
    if approximate:
        # sketches of hashes take any type and, unlike registers of one aggregate, no generated code
        row = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(14))).alias(str(i)) for i, c in enumerate(_groupable(c, kinds[c]) for c in columns)]).first()
        counts = {c: row[i] for i, c in enumerate(columns)}
    else:
        open_ = [c for c in columns if c not in known]
        counts = known | distinct_counts(df, {c: kinds[c] for c in open_}, {c: stats[c]["valid"] for c in open_})
    for c in columns:
        stats[c]["distinct"] = counts[c] + (stats[c]["valid"] < rows)
    return approximate


def _bounds(method: str, s: dict[str, Any], quantile: dict[tuple[str, int], float], name: str, limits: list[float] | None) -> tuple[float, float] | None:
    n = s["valid"]
    if not n:
        return None
    if method == "zscore":
        if not s["std"] or math.isnan(s["std"]):
            return None
        return s["mean"] - 3 * s["std"], s["mean"] + 3 * s["std"]
    low, high = (quantile[name, nearest_rank(p, n)] for p in (limits if method == "percentile" else (0.25, 0.75)))
    if method == "percentile":
        return low, high
    return low - 1.5 * (high - low), high + 1.5 * (high - low)


def outlier(v: Column, bounds: tuple[float, float]) -> Column:
    """Strictly outside the bounds; NaN is above any bound but NaN."""
    return (v < F.lit(bounds[0])) | (v > F.lit(bounds[1]))


def _place(v: float, edges: list[float] | None, bounds: tuple[float, float] | None) -> tuple[int | None, int]:
    """A value's bin, as `_histograms_and_outliers` has it, and on which side it is outside."""
    guess = None
    if edges and edges[0] <= v <= edges[-1]:
        count = len(edges) - 1
        guess = min(math.floor((v - edges[0]) / ((edges[-1] - edges[0]) / count)), count - 1)
        guess = guess - 1 if v < edges[guess] else guess + 1 if v >= edges[guess + 1] and guess < count - 1 else guess
    return guess, (v > bounds[1]) - (v < bounds[0]) if bounds else 0


def _open_cells(grid: Grid, plans: dict[str, tuple[list[float] | None, tuple[float, float] | None]]) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """The cells of a grid whose values all lie in one bin, on one side of the bounds, and the others. Plans in its order."""
    whole, cut = [], []
    for cells, plan in zip(grid.cells, plans.values(), strict=False):
        for c in cells:
            (whole if _place(c["low"], *plan) == _place(c["high"], *plan) else cut).append(c)
    return whole, cut


def _histograms_and_outliers(rows: DataFrame | None, plans: dict[str, tuple[list[float] | None, tuple[float, float] | None]], whole: list[dict[str, Any]]) -> tuple[dict[str, list[int]], dict[str, int]]:
    """Counts by bin and of outliers, from rows (i, v, f) and cells that lie in one bin: of all columns in one job, that
    shuffles a few rows for each."""
    names = list(plans)
    bins: dict[str, list[int]] = {n: [0] * (len(e) - 1) for n, (e, _) in plans.items() if e}
    outside = dict.fromkeys(plans, 0)
    for c in whole:
        name = names[c["i"]]
        at, side = _place(c["low"], *plans[name])
        outside[name] += c["n"] * (side != 0)
        if at is not None:
            bins[name][at] += c["n"]
    if rows is not None and any(e or b for e, b in plans.values()):
        v = F.col("v")
        most = max((len(x) for x in bins.values()), default=1)
        # edges of all columns, those with fewer bins filled up with their last edge
        table = [[*(plans[n][0] or [math.nan]), *[(plans[n][0] or [math.nan])[-1]] * (most + 1 - len(plans[n][0] or [math.nan]))] for n in names]
        edge = lambda k: F.get(F.get(F.array(*[F.array(*map(F.lit, e)) for e in table]), F.col("i")), k)
        count = by_number([len(plans[n][0]) - 1 if plans[n][0] else None for n in names]).cast("int")
        low, high = (by_number([plans[n][0][j] if plans[n][0] else None for n in names]) for j in (0, -1))
        guess = F.least(F.floor((v - low) / ((high - low) / count)), count - 1).cast("int")
        # the quotient may be off by one where v is at an edge
        guess = F.when(v < edge(guess), guess - 1).when((v >= edge(guess + 1)) & (guess < count - 1), guess + 1).otherwise(guess)
        at = F.when(~F.isnan(v) & (v >= low) & (v <= high), guess)
        lower, upper = (by_number([plans[n][1][j] if plans[n][1] else None for n in names]) for j in (0, 1))
        for r in rows.where("v IS NOT NULL").groupBy("i", at.alias("b"), F.coalesce((v < lower) | (v > upper), F.lit(False)).alias("out")).agg(F.sum("f").alias("count")).collect():
            name = names[r["i"]]
            outside[name] += r["count"] * r["out"]
            if r["b"] is not None and name in bins:
                bins[name][r["b"]] += r["count"]
    return bins, outside


def fit_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, normal, uniform, anderson, chi_square): the statistics behind the tests of numeric columns, as `xray`
    computes them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    base = _base(df, columns, kinds, None, True)
    stats = [base[c] for c in columns]
    rows = long_form(df, [quoted(c) for c in columns])
    gaps, squares = fits.distances(Grid(rows, stats, fits.laws_of(stats))), fits.chi_squares(rows, stats)
    table = cumulative(df, {c: quoted(c) for c in columns})
    sums = fits.anderson(table, stats)
    release(table)
    out = [(c, *(gaps.get(i, {}).get(k) for k in fits.LAWS), sums.get(i), squares[i][0] if squares[i] else None) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(out, "column string, normal double, uniform double, anderson double, chi_square double").coalesce(1)


def _finite(s: dict[str, Any]) -> bool:
    return not s["nan"] and s["min"] is not None and math.isfinite(s["min"]) and math.isfinite(s["max"])


def _deviations(df: DataFrame, columns: list[str], gridded: list[str], grid: Grid | None, stats: dict[str, dict[str, Any]], quantile: dict[tuple[str, int], float]) -> None:
    """Fills in `mad`, the median distance from the median."""
    middle = {c: [(stats[c]["valid"] - 1) // 2, stats[c]["valid"] // 2] for c in columns}
    for c in columns:
        stats[c]["median"] = sum(quantile[c, r] for r in middle[c]) / 2
    other = [c for c in columns if c not in gridded]
    found: dict[tuple[str, int], float] = {}
    if grid:
        found = {(gridded[i], r): v for (i, r), v in grid.deviations([stats[c]["median"] for c in gridded], [middle[c] for c in gridded]).items()}
    if other:
        found |= select_ranks(df, {c: F.abs(quoted(c).cast("double") - F.lit(stats[c]["median"])) for c in other}, {c: stats[c]["valid"] for c in other}, {c: middle[c] for c in other})
    for c in columns:
        stats[c]["mad"] = sum(found[c, r] for r in middle[c]) / 2


def _laws(normality: str, uniformity: str) -> tuple[str, ...]:
    return tuple(law for law, used in (("normal", normality == "ks"), ("uniform", uniformity == "ks")) if used)


def _tests(df: DataFrame, columns: list[str], clean: list[str], grid: Grid | None, stats: dict[str, dict[str, Any]], normality: str, uniformity: str, shapiro_rows: int | None) -> None:
    """Fills in `normality` and `uniformity` texts of numeric columns with more than 3 values; clean: the finite ones, as in the grid."""
    tested = [c for c in columns if stats[c]["valid"] > 3]
    for c in tested:
        stats[c]["normality"] = stats[c]["uniformity"] = "N/A (not finite)"
    if not clean:
        return
    mine = [stats[c] for c in clean]
    rows = long_form(df, [quoted(c) for c in clean])
    # only P is shown
    gaps = fits.distances(grid, _laws(normality, uniformity), lambda i, _, low, high: distributions.kolmogorov_settled(low, high, mine[i]["valid"]))
    squares = fits.chi_squares(rows, mine) if uniformity == "chi2" else {}
    small = fits.shapiro(rows, mine, shapiro_rows) if normality == "shapiro" else {}
    sums: dict[int, float] = {}
    if normality == "anderson":
        table = cumulative(df, {c: quoted(c) for c in clean})
        sums = fits.anderson(table, mine)
        release(table)
    for i, c in enumerate(clean):
        s = stats[c]
        m = s["valid"]
        if m <= 3:
            continue
        say = lambda ok, yes, test, p=None: f"{'' if ok else 'NON-'}{yes} ({test}{'' if p is None else f', p={p:.3f}'})"
        constant = s["min"] == s["max"]
        if normality == "shapiro":
            if i not in small:
                s["normality"] = "N/A (sample too large)"
            else:
                s["normality"] = say(small[i][1] > 0.05, "NORMAL", "Shapiro-Wilk", small[i][1])
        elif normality == "anderson":
            square = float("inf") if constant else sums[i]
            s["normality"], s["anderson"] = say(square < distributions.anderson_limit(m), "NORMAL", "Anderson-Darling"), square
        else:
            p = 0.0 if constant else distributions.kolmogorov(gaps[i]["normal"], m)
            s["normality"] = say(p > 0.05, "NORMAL", "Kolmogorov-Smirnov", p)
        if m < 5:
            s["uniformity"] = "N/A (insufficient data)"
        elif uniformity == "ks":
            p = None if constant else distributions.kolmogorov(gaps[i]["uniform"], m)
            s["uniformity"] = "N/A (constant data)" if constant else say(p > 0.05, "UNIFORM", "KS", p)
        else:
            s["uniformity"] = "N/A (insufficient bins)"
            if squares.get(i) is not None:
                statistic, bins = squares[i]
                p = distributions.chi_square(statistic, bins - 1)
                s["uniformity"] = say(p > 0.05, "UNIFORM", "Chi-square", p)


def _shifted(df: DataFrame, wide: list[str], kinds: dict[str, T.DataType], stats: dict[str, dict[str, Any]], numeric: list[str], target: str | None, expanded: bool) -> DataFrame:
    """`df` with columns whose values doubles don't tell apart replaced by their distance from the least one, subtracted as
    they are. Their statistics are replaced by those of the distance; `base`, the least value, is what is to be added."""
    ends = df.agg(*[f(quoted(c)).alias(f"{n}{i}") for i, c in enumerate(wide) for n, f in (("low", F.min), ("high", F.max))]).first()
    distance: dict[str, Column] = {}
    for i, c in enumerate(wide):
        kind = kinds[c].simpleString() if isinstance(kinds[c], T.DecimalType) else "decimal(38,0)"
        v, low = quoted(c).cast(kind), F.lit(ends[f"low{i}"]).cast(kind)
        low_, high_ = Decimal(ends[f"low{i}"]), Decimal(ends[f"high{i}"])
        scale = kinds[c].scale if isinstance(kinds[c], T.DecimalType) else 0
        stats[c] |= {"base": low_, "top": high_, "far": (high_ - low_) * 10**scale >= 10**15}
        distance[c] = F.coalesce(F.try_subtract(v, low).cast("double"), v.cast("double") - low.cast("double")).alias(c)
    out = df.select([distance.get(f, quoted(f)) for f in df.columns])
    names = numeric if target in wide else wide  # the target's distance changes all correlations' last digits
    again = _base(out, names, {c: T.DoubleType() for c in names}, target, expanded)
    for c in names:
        kept = ("zero", "pos", "neg", "binary", "integral") if c in wide else [k for k in again[c] if k != "corr"]
        stats[c] |= {k: v for k, v in again[c].items() if k not in kept}
    return out


def _far_ranks(given: DataFrame, far: list[str], kinds: dict[str, T.DataType], stats: dict[str, dict[str, Any]], wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The ranks of distances that doubles don't tell apart either, from the values."""
    scale = {c: kinds[c].scale if isinstance(kinds[c], T.DecimalType) else 0 for c in far}
    exact = exact_ranks(given, scale, {c: (stats[c]["base"], stats[c]["top"]) for c in far}, {c: stats[c]["valid"] for c in far}, wanted)
    for (c, r), v in exact.items():
        stats[c].setdefault("exact", {})[r] = v
    return {(c, r): float(v - stats[c]["base"]) for (c, r), v in exact.items()}


def _moved(s: dict[str, Any], v: float | None, rank: int | None = None) -> float | None:
    """A place among a wide column's distances, as a place among its values."""
    if v is None or "base" not in s or not math.isfinite(v):
        return v
    if rank in s.get("exact", {}):
        return float(s["exact"][rank])
    return float(s["base"] + Decimal(repr(v)))


def xray(
    df: DataFrame,
    *,
    include: str | list[str] | None = None,
    great_tables: bool = True,
    expanded: bool = False,
    title: str | None = None,
    percentiles: list[float] | None = None,
    outlier_method: str = "iqr",
    outlier_bounds: list[float] | None = None,
    corr_target: str | None = None,
    normality_test: str = "shapiro",
    uniformity_test: str = "ks",
    missing_threshold: float = 0.3,
    constant_threshold: float = 0.99,
    skew_threshold: float = 2.0,
    kurtosis_threshold: float = 7.0,
    outlier_threshold: float = 0.05,
    shakiness_threshold: int = 2,
    model_usability: bool = False,
    distribution_plot: str = "histogram",
    decimals: int = 2,
    sep_mark: str = ",",
    dec_mark: str = ".",
    compact: bool = False,
    pattern: str | None = None,
    fix_skew: bool = False,
    strict_int32: bool = False,
    exact_distinct: bool = False,
    shapiro_rows: int | None = fits.SHAPIRO_ROWS,
):
    """A summary of each included column: a DataFrame with great_tables=False, else an HTML report.

    fix_skew lets the skewness term of the shakiness score count; strict_int32 makes the type suggestion check the
    upper bound of Int32 too; exact_distinct counts distinct values exactly at any size (else approximately above
    EXACT_DISTINCT_ROWS rows). All are off by default, as in the model. shapiro_rows is the number of values up to which
    the Shapiro-Wilk test is made, the model's by default; None sets no limit."""
    began = time.perf_counter()
    percentiles = [0.25, 0.5, 0.75] if percentiles is None else list(percentiles)
    if outlier_method not in ("iqr", "percentile", "zscore"):
        raise ValueError("outlier_method is 'iqr', 'percentile' or 'zscore'")
    if outlier_method == "percentile" and not outlier_bounds:
        raise ValueError("outlier_method='percentile' needs outlier_bounds")
    if outlier_bounds and len(outlier_bounds) != 2:
        raise ValueError("outlier_bounds is a list of two shares")
    if normality_test not in ("shapiro", "anderson", "ks"):
        raise ValueError("normality_test is 'shapiro', 'anderson' or 'ks'")
    if uniformity_test not in ("ks", "chi2"):
        raise ValueError("uniformity_test is 'ks' or 'chi2'")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if corr_target:
        if corr_target not in kinds:
            raise ValueError(f"no column {corr_target!r}")
        if not is_numeric(kinds[corr_target]):
            raise ValueError(f"{corr_target!r} isn't numeric")
    columns = included(df.schema, include)
    stats = _base(df, columns, kinds, corr_target, expanded) if columns else {}
    given = df
    numeric = [c for c in columns if is_numeric(kinds[c])]
    wide = [c for c in numeric if stats[c]["valid"] and not told_apart(kinds[c], stats[c]["min"], stats[c]["max"])]
    if wide:
        df = _shifted(df, wide, kinds, stats, numeric, corr_target, expanded)
    rows = stats[columns[0]]["rows"] if columns else 0
    live = [c for c in columns if is_numeric(kinds[c]) and stats[c]["valid"]]

    wanted: dict[str, list[int]] = {}
    for c in live:
        n = stats[c]["valid"]
        shares = [*percentiles, *(outlier_bounds if outlier_method == "percentile" else (0.25, 0.75) if outlier_method == "iqr" else ())]
        wanted[c] = [nearest_rank(p, n) for p in shares] + ([(n - 1) // 2, n // 2] if expanded else [])
    valid = {c: stats[c]["valid"] for c in live}
    finite = [c for c in live if _finite(stats[c])]
    grid, quantile = None, {}
    if finite:
        mine = [stats[c] for c in finite]
        laws = fits.laws_of(mine, _laws(normality_test, uniformity_test)) if expanded else {}
        grid = Grid(long_form(df, [quoted(c) for c in finite]), mine, laws, lambda numbers: numbered_form(df, {i: quoted(finite[i]) for i in numbers}))
        quantile = {(finite[i], r): v for (i, r), v in grid.ranks([sorted(set(wanted[c])) for c in finite]).items()}
    rest = [c for c in live if c not in finite]
    quantile |= select_ranks(df, {c: quoted(c) for c in rest}, valid, wanted)
    quantile |= _far_ranks(given, [c for c in live if stats[c].get("far")], kinds, stats, wanted)
    if expanded and live:
        _deviations(df, live, finite, grid, stats, quantile)
        _tests(df, live, finite, grid, stats, normality_test, uniformity_test, shapiro_rows)
    # where each cell has one value, they are the distinct ones
    known = {c: len(grid.cells[i]) for i, c in enumerate(finite) if c not in wide and all(x["low"] == x["high"] for x in grid.cells[i])}
    approximate = _distinct(given, columns, kinds, stats, rows, exact_distinct, known) if expanded else False
    plans = {}
    for c in live:
        s = stats[c]
        bins = min(12, max(5, int(math.sqrt(s["valid"]))))
        shown = distribution_plot == "histogram" and s["min"] is not None and s["max"] is not None and math.isfinite(s["max"] - s["min"])
        edges = fits.edges_of(s["min"], s["max"], bins) if shown and s["min"] < s["max"] else None
        s["histogram"] = None if edges else [s["valid"]] if shown and not s["nan"] else []
        plans[c] = (edges, _bounds(outlier_method, s, quantile, c, outlier_bounds))
    plans = {c: plans[c] for c in [*finite, *rest]}
    whole, cut = _open_cells(grid, plans) if grid else ([], [])
    parts = [grid.inside(cut)] if cut else []
    if rest:
        parts.append(long_form(df, [quoted(c) for c in rest], F.lit(1).cast("long").alias("f")).select((F.col("i") + len(finite)).alias("i"), "v", "f"))
    bins_of, outside = _histograms_and_outliers(reduce(DataFrame.unionByName, parts) if parts else None, plans, whole)
    for c in live:
        stats[c]["histogram"] = bins_of.get(c, stats[c]["histogram"])
        stats[c]["outliers"] = outside[c]

    labels = list(dict.fromkeys(map(percentile_label, percentiles)))
    summary = _summary(df, columns, kinds, stats, quantile, percentiles, labels, corr_target, expanded, approximate, strict_int32)
    limits = {"missing": missing_threshold, "constant": constant_threshold, "skew": skew_threshold, "kurtosis": kurtosis_threshold, "outlier": outlier_threshold}
    if expanded:
        distinct = "N_Unique(approx)" if approximate else "N_Unique"
        summary = quality.with_shakiness(summary, distinct, limits, shakiness_threshold, fix_skew=fix_skew)
        if model_usability:
            summary = quality.with_usability(summary, distinct, corr_target is not None)
    else:
        first = ["Column", "Dtype", "Count", "null_count", "Mean", "std", "Min", "25%", "50%", "75%", "Max", "IQR", "Pct_Missing", "N_Outliers", "skew", "Distribution_Plot"]
        if corr_target:
            first += ["Correlation", "Correlation_Plot"]
        summary = summary.select([quoted(c) for c in first if c in summary.columns])
    if not great_tables:
        return summary
    from ..plans.render import profile_report

    elapsed = 1000 * (time.perf_counter() - began)
    return profile_report(df, summary, rows=rows, expanded=expanded, title=title, elapsed_ms=elapsed, corr_target=corr_target, decimals=decimals, sep_mark=sep_mark, dec_mark=dec_mark, compact=compact, pattern=pattern)


def _summary(df, columns, kinds, stats, quantile, percentiles, labels, target, expanded, approximate, strict_int32) -> DataFrame:
    """The summary rows at full precision on the driver, rounded in Spark."""
    long, double, text = T.LongType(), T.DoubleType(), T.StringType()
    distinct = "N_Unique(approx)" if approximate else "N_Unique"
    fields: list[tuple[str, T.DataType, int | None]] = [("Column", text, None), ("Dtype", text, None), ("Count", long, None), ("null_count", long, None), ("Pct_Missing", double, 2)]
    if expanded:
        fields += [(distinct, long, None), ("Uniqueness_Ratio", double, 4), ("N_Duplicates", long, None), ("Pct_Duplicates", double, 2)]
    fields += [(label, double, 3) for label in labels]
    fields += [("Mean", double, 3), ("std", double, 3), ("Min", double, 3), ("Max", double, 3), ("IQR", double, 3)]
    if expanded:
        fields += [("N_Zero", long, None), ("Pct_Zero", double, 2), ("Pct_Pos", double, 2), ("Pct_Neg", double, 2)]
    fields += [("skew", double, 3), ("Distribution_Plot", T.ArrayType(long), None)]
    if expanded:
        fields += [("MAD", double, 3), ("Kurtosis", double, 3), ("Opt_Dtype", text, None), ("Normality_Test", text, None), ("Uniformity_Test", text, None)]
    fields += [("N_Outliers", long, None)]
    if expanded:
        fields += [("Pct_Outliers", double, 2)]
    if target:
        fields += [("Correlation", text, None), ("Correlation_Plot", double, 3)]
    out = []
    share = lambda a, b: 100.0 * a / b if b else 0.0
    for c in columns:
        s, kind = stats[c], kinds[c]
        n, valid = s["rows"], s["valid"]
        row: dict[str, Any] = {"Column": c, "Dtype": name_of(kind), "Count": valid, "null_count": n - valid, "Pct_Missing": share(n - valid, n)}
        if expanded:
            row |= {distinct: s["distinct"], "Uniqueness_Ratio": s["distinct"] / n if n else 0.0, "N_Duplicates": n - s["distinct"], "Pct_Duplicates": share(n - s["distinct"], n), "Opt_Dtype": suggest_dtype(kind, s, strict_int32=strict_int32)}
        if is_numeric(kind) and valid:
            for p in percentiles:
                rank = nearest_rank(p, valid)
                row[percentile_label(p)] = _moved(s, quantile[c, rank], rank)
            row |= {"Mean": _moved(s, s["mean"]), "std": s["std"], "Min": _moved(s, s["min"]) if s["min"] is not None else 0.0, "Max": float(s["top"]) if "top" in s else s["max"] if s["max"] is not None else 0.0, "skew": s["skew"], "Distribution_Plot": s["histogram"], "N_Outliers": s["outliers"], "Pct_Outliers": share(s["outliers"], valid)}
            if 0.25 in percentiles and 0.75 in percentiles:
                row["IQR"] = ("IQR",)
            row |= {"N_Zero": s["zero"], "Pct_Zero": share(s["zero"], valid), "Pct_Pos": share(s["pos"], valid), "Pct_Neg": share(s["neg"], valid)}
            if expanded:
                row |= {"MAD": s["mad"], "Kurtosis": s["kurtosis"], "Normality_Test": s.get("normality"), "Uniformity_Test": s.get("uniformity")}
            if target:
                r = s["corr"]
                row |= {"Correlation": "-", "Correlation_Plot": None} if c == target else {"Correlation": ("r", r), "Correlation_Plot": 0.0 if r is None else r}
        else:
            row |= {"Min": 0.0, "Max": 0.0, "N_Zero": 0, "Pct_Zero": 0.0, "Pct_Pos": 0.0, "Pct_Neg": 0.0, "Distribution_Plot": [], "N_Outliers": 0, "Pct_Outliers": 0.0}
            if expanded:
                row |= {"Normality_Test": "N/A (non-numeric)", "Uniformity_Test": "N/A (non-numeric)"}
        out.append(row)
    raw = [T.StructField("position", T.IntegerType()), *[T.StructField(name, kind) for name, kind, _ in fields], T.StructField("has_iqr", T.BooleanType()), T.StructField("r", double)]
    rows = []
    for i, row in enumerate(out):
        r = row.get("Correlation")
        has_iqr, pair = row.get("IQR") is not None, r if isinstance(r, tuple) else (None, None)
        rows.append((i, *[None if isinstance(row.get(name), tuple) else row.get(name) for name, _, _ in fields], has_iqr, pair[1]))
    frame = df.sparkSession.createDataFrame(rows, T.StructType(raw)).coalesce(1).sortWithinPartitions("position")
    columns_out = []
    for name, _, digits in fields:
        c = quoted(name)
        if name == "IQR":  # the difference of rounded quartiles
            c = F.when(F.col("has_iqr"), F.round(F.round(quoted("75%"), 3) - F.round(quoted("25%"), 3), 3)) if {"25%", "75%"} <= set(labels) else c
        elif name == "Correlation":
            c = F.coalesce(c, F.round("r", 3).cast("string"))
        elif digits is not None:
            c = F.round(c, digits) + 0.0  # no negative zeros
        columns_out.append(c.alias(name))
    return frame.select(columns_out)
