"""How far columns are from the normal and the uniform distribution, from rows (i, v): a value and its column's number.

`distances` finds Kolmogorov and Smirnov's statistic by branch and bound. The values' counts in a grid of cells bound
the distance inside each cell from both sides; only cells whose upper bound is above the best lower bound are looked into,
by a finer grid, and once few values are left in them, exactly. A column that follows its law so closely that its cells stay
open (whole numbers in a row are uniform to the last one) is compared value by value on the executors, each cell in order, so
what the driver holds doesn't grow with the rows. Where only a P of some digits is wanted, the search ends as soon as both
bounds give the same; open cells are then bounded by finer ones on the executors before any are put in order. `shapiro` has Shapiro and Wilk's W as aggregates over ranks. `chi_squares` counts in equal bins,
`anderson` sums over all ranks, so it alone needs a cumulative table."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions
from ..functions.stats import normal_cdf, normal_inverse
from .selection import CELLS, MOST_VALUES, Grid, by_number, release, row_ranks

#: Cells of a finer grid in all, about.
FINER = 20_000
#: Rows of a column's open cells, and of a cell, up to which cells are put in order rather than cut again.
MOST_SORTED = 1_000_000
#: Width of the cells that bound a distance on the executors, as a share of that which P depends on, 1 / sqrt(n).
NARROW = 1 / 8
SHAPIRO_ROWS = 5000
LAWS = ("normal", "uniform")
#: By how much a law's share may fall while v grows: the fit behind the normal law isn't quite monotone.
FALLS = {"normal": 2e-7, "uniform": 0.0}


def edges_of(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    return [low + step * i for i in range(bins)] + [high]


def _get(stats: list[dict[str, Any]], what: str) -> Column:
    return by_number([float(s[what] or 0.0) for s in stats])


def laws_of(stats: list[dict[str, Any]], laws: tuple[str, ...] = LAWS) -> dict[str, Callable[[Column], Column]]:
    """What a Grid has to keep for `distances`: the laws' shares below v, with the columns' mean and pop, and min and max."""
    low = _get(stats, "min")
    wide = by_number([(s["max"] - s["min"] if s["valid"] else 0.0) or 1.0 for s in stats])
    pop = by_number([s["pop"] or 1.0 for s in stats])
    # no condition around them: inside one, Spark would compute shared parts anew each time
    cdf = {"normal": lambda v: normal_cdf((v - _get(stats, "mean")) / pop), "uniform": lambda v: (v - low) / wide}
    return {law: cdf[law] for law in laws}


def distances(grid: Grid, laws: tuple[str, ...] = LAWS, settled: Callable[[int, str, float, float], bool] | None = None) -> dict[int, dict[str, float]]:
    """By number, the Kolmogorov-Smirnov distance from each law of the grid; constants are left out. With `settled`, which
    says of a number, a law and two bounds whether any distance between them will do, the lower bound where it says so."""
    stats = grid.stats
    live = [i for i, s in enumerate(stats) if s["valid"] and s["min"] < s["max"]]
    if not live or not laws:
        return {}
    best: dict[tuple[int, str], float] = {(i, law): 0.0 for i in live for law in laws}
    done: set[tuple[int, str]] = set()
    every = [c for i in live for c in grid.cells[i]]
    level: DataFrame | None = None  # the grid's own
    before: dict[int, float] = dict.fromkeys(live, math.inf)
    bounded = settled is None

    def still_open(cells: list[dict[str, Any]]) -> list[dict[str, Any]]:
        if settled:
            upper = dict(best)
            for c in cells:
                for law in laws:
                    upper[c["i"], law] = max(upper[c["i"], law], c[law])
            done.update((i, law) for (i, law), most in upper.items() if (i, law) not in done and settled(i, law, best[i, law], most))
        return [c for c in cells if any(c[law] > best[c["i"], law] and (c["i"], law) not in done for law in laws)]

    while True:
        for c in every:
            c["slot"] = c.get("slot", c["i"])
            n, below = stats[c["i"]]["valid"], c["below"]
            for law in laws:  # the last value of a cell has all of it at or below, the first one none of it below
                best[c["i"], law] = max(best[c["i"], law], (below + c["n"]) / n - c[f"most_{law}"], c[f"least_{law}"] - below / n)
                c[law] = max((below + c["n"]) / n - c[f"least_{law}"], c[f"most_{law}"] - below / n) + (FALLS[law] if c["low"] < c["high"] else 0.0)
        open_ = still_open(every)
        if not bounded and sum(c["n"] for c in open_) > MOST_SORTED:
            for k, found in _bounded(grid, level, open_, laws).items():
                for law in laws:
                    best[open_[k]["i"], law] = max(best[open_[k]["i"], law], found[f"least_{law}"])
                    open_[k][law] = min(open_[k][law], found[f"most_{law}"])
            open_, bounded = still_open(open_), True
        if not open_:
            break
        if sum(c["n"] for c in open_) <= MOST_VALUES:
            so_far = [c["below"] for c in open_]
            last = _inside(grid, level, open_).groupBy("next", "i", "v").agg(F.count(F.lit(1)).alias("n")).select("next", "v", "n", *[grid.extra[law](F.col("v")).alias(law) for law in laws])
            for r in sorted(last.collect(), key=lambda r: (r["next"], r["v"])):
                i, below = open_[r["next"]]["i"], so_far[r["next"]]
                so_far[r["next"]] += r["n"]
                for law in laws:
                    best[i, law] = max(best[i, law], (below + r["n"]) / stats[i]["valid"] - r[law], r[law] - below / stats[i]["valid"])
            break
        left = dict.fromkeys(live, 0)
        for c in open_:
            left[c["i"]] += c["n"]
        most = max(MOST_SORTED, sum(left.values()) // FINER)
        near = [c for c in open_ if c["n"] <= most and (left[c["i"]] <= MOST_SORTED or left[c["i"]] > before[c["i"]] / 2)]
        before = left
        if near:
            for i, found in _ordered(grid, level, near, laws).items():
                for law in laws:
                    best[i, law] = max(best[i, law], found[law])
            ordered = {id(c) for c in near}
            open_ = still_open([c for c in open_ if id(c) not in ordered])
            if not open_:
                break
        finer = max(4, min(CELLS, FINER // len(open_)))
        level = _inside(grid, level, open_).select("i", "v", F.col("next").alias("slot"), _cell(F.lit(finer)).alias("cell"))
        found = _ends(grid, level.groupBy("slot", "cell", "i").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), laws).collect()
        every, so_far = [], [c["below"] for c in open_]
        for r in sorted(found, key=lambda r: (r["slot"], r["cell"])):
            every.append(r.asDict() | {"below": so_far[r["slot"]]})
            so_far[r["slot"]] += r["n"]
    return {i: {law: best[i, law] for law in laws} for i in live}


def _cell(finer: Column) -> Column:
    """Which of so many cells of equal width between low and high v is in."""
    wide = F.when(F.col("low") < F.col("high"), F.col("high") - F.col("low")).otherwise(1.0)
    return F.least(F.floor((F.col("v") - F.col("low")) / wide * finer), finer - 1).cast("int")


def _ends(grid: Grid, cells: DataFrame, laws: tuple[str, ...]) -> DataFrame:
    """Cells with the laws' shares at their least and greatest value."""
    return cells.select("*", *[grid.extra[law](F.col(end)).alias(f"{name}_{law}") for law in laws for name, end in (("least", "low"), ("most", "high"))])


def _inside(grid: Grid, level: DataFrame | None, cells: list[dict[str, Any]]) -> DataFrame:
    """The rows of a level in some of its cells, `next` being the cell's place among them."""
    level = grid.rows_of(cells).withColumn("slot", F.col("i")) if level is None else level
    table = rows_of(grid, [(c["slot"], c["cell"], k, c["low"], c["high"]) for k, c in enumerate(cells)])
    return level.join(F.broadcast(table), ["slot", "cell"])  # at most the cells of a grid


def _starts(grid: Grid, cells: list[dict[str, Any]]) -> DataFrame:
    return F.broadcast(grid.rows.sparkSession.createDataFrame([(k, c["below"], float(grid.stats[c["i"]]["valid"])) for k, c in enumerate(cells)], "next int, below long, valid double"))


def _upto(order: str) -> Column:
    return F.sum("n").over(Window.partitionBy("next").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto")


def _bounded(grid: Grid, level: DataFrame | None, cells: list[dict[str, Any]], laws: tuple[str, ...]) -> dict[int, dict[str, float]]:
    """By place, least and greatest bounds of the distance inside some cells, by finer cells that stay on the executors: per
    column about sqrt(n) / NARROW of them, however many rows they have."""
    many = [0] * len(grid.stats)
    for c in cells:
        many[c["i"]] += 1
    finer = by_number([max(4.0, math.ceil(math.sqrt(s["valid"]) / NARROW / max(1, k))) for s, k in zip(grid.stats, many, strict=True)])
    parts = _inside(grid, level, cells).groupBy("next", "i", _cell(finer).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    placed = parts.select("next", "i", "n", "low", "high", _upto("part")).join(_starts(grid, cells), "next")
    # as columns first: inside the aggregates they would be too much code for one method
    each = _ends(grid, placed, laws).withColumns({"upto": (F.col("below") + F.col("upto")) / F.col("valid"), "under": (F.col("below") + F.col("upto") - F.col("n")) / F.col("valid")})
    bounds = []
    for law in laws:
        low, high = F.col(f"least_{law}"), F.col(f"most_{law}")
        fall = F.when(F.col("low") < F.col("high"), FALLS[law]).otherwise(0.0)
        bounds += [F.max(F.greatest(F.col("upto") - high, low - F.col("under"))).alias(f"least_{law}"), F.max(F.greatest(F.col("upto") - low, high - F.col("under")) + fall).alias(f"most_{law}")]
    return {r["next"]: r.asDict() for r in each.groupBy("next").agg(*bounds).collect()}  # a row for each cell


def _ordered(grid: Grid, level: DataFrame | None, cells: list[dict[str, Any]], laws: tuple[str, ...]) -> dict[int, dict[str, float]]:
    """By number, the greatest distance inside some cells, of which none has more rows than a task can put in order."""
    values = _inside(grid, level, cells).groupBy("next", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = values.select("next", "i", "v", "n", _upto("v")).join(_starts(grid, cells), "next")
    # as columns first: inside the aggregates they would be too much code for one method
    each = placed.select("i", (F.col("below") + F.col("upto")).alias("upto"), "n", "valid", *[grid.extra[law](F.col("v")).alias(law) for law in laws])
    over = [F.max(F.greatest(F.col("upto") / F.col("valid") - F.col(law), F.col(law) - (F.col("upto") - F.col("n")) / F.col("valid"))).alias(law) for law in laws]
    return {r["i"]: r.asDict() for r in each.groupBy("i").agg(*over).collect()}


def rows_of(grid: Grid, cells: list[tuple]) -> DataFrame:
    return grid.rows.sparkSession.createDataFrame(cells, "slot int, cell int, next int, low double, high double")


def anderson(table: DataFrame, stats: list[dict[str, Any]]) -> dict[int, float]:
    """By number, Anderson and Darling's square of the columns of a cumulative table; constants are left out. One job."""
    z = F.col("v") - _get(stats, "mean")
    log = lambda p: F.log(F.greatest(p, F.lit(1e-300)))
    # as columns first: inside the aggregates they would be too much code for one method
    each = table.where(_get(stats, "min") < _get(stats, "max")).select("i", "f", "below", _get(stats, "valid").alias("n"), log(normal_cdf(z / _get(stats, "std"))).alias("lo"), log(normal_cdf(-z / _get(stats, "std"))).alias("hi"))
    # sums of (2 i - 1) over the f equal ranks below + 1 .. below + f, and of those counted from above
    weighted = F.expr("f * (2 * below + f) * lo + f * (2 * n - 2 * below - f) * hi")
    return {r["i"]: r["a"] for r in each.groupBy("i").agg((-F.max("n") - F.sum(weighted) / F.max("n")).alias("a")).collect()}


def chi_squares(rows: DataFrame, stats: list[dict[str, Any]]) -> dict[int, tuple[float, int] | None]:
    """By number, the chi-square statistic of equal bins and their number; None where there are too few. One job for all."""
    counts: list[int | None] = []
    for s in stats:
        bins = min(10, int(math.sqrt(s["valid"])))
        counts.append(bins if bins >= 2 and s["valid"] / bins >= 5 else None)
    used = [i for i, k in enumerate(counts) if k]
    out: dict[int, tuple[float, int] | None] = dict.fromkeys(range(len(stats)))
    if not used:
        return out
    ends: list[tuple[float, float]] = []
    for s in stats:
        constant = s["min"] == s["max"]
        ends.append((s["min"] - 0.5, s["max"] + 0.5) if constant else (s["min"], s["max"]))
    table = F.array(*[F.array(*map(F.lit, edges_of(*ends[i], counts[i] or 1))) for i in range(len(stats))])
    edge = lambda k: F.get(F.get(table, F.col("i")), k)
    bins = by_number([float(k or 1) for k in counts])
    low, high = (by_number([e[k] for e in ends]) for k in (0, 1))
    v = F.col("v")
    guess = F.least(F.floor((v - low) / ((high - low) / bins)), bins - 1).cast("int")
    # the quotient may be off by one where v is at an edge
    guess = F.when(v < edge(guess), guess - 1).when((v >= edge(guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    seen: dict[int, list[int]] = {}
    for r in rows.where("v IS NOT NULL").where(F.col("i").isin(used)).groupBy("i", guess.alias("b")).agg(F.count(F.lit(1)).alias("f")).collect():  # a row for each bin
        seen.setdefault(r["i"], []).append(r["f"])
    for i in used:
        expected = stats[i]["valid"] / counts[i]
        out[i] = sum((f - expected) ** 2 / expected for f in seen[i]) + (counts[i] - len(seen[i])) * expected, counts[i]
    return out


def shapiro(rows: DataFrame, stats: list[dict[str, Any]], most: int | None = SHAPIRO_ROWS) -> dict[int, tuple[float, float]]:
    """By number, W and its P of the columns of 3 to `most` finite values (None: any number); others are left out.

    Expected normal scores are Columns of the rank (Blom's), so all sums behind W are aggregates. The ranks of columns of up to
    SHAPIRO_ROWS rows are a window, in one job for all; longer columns are range-partitioned."""
    used = [i for i, s in enumerate(stats) if 3 <= s["valid"] and (most is None or s["valid"] <= most)]
    out = {i: (1.0, 1.0) for i in used if stats[i]["min"] == stats[i]["max"]}
    if not (open_ := [i for i in used if i not in out]):
        return out
    rank, n, x = F.col("rank"), F.col("n"), F.col("x")
    long = [i for i in open_ if stats[i]["valid"] > SHAPIRO_ROWS]
    there = rows.where("v IS NOT NULL")
    few = there.where(F.col("i").isin([i for i in open_ if i not in long])).select("i", "v", F.row_number().over(Window.partitionBy("i").orderBy("v")).alias("rank"))
    many = row_ranks(there.where(F.col("i").isin(long)).select("i", "v")) if long else None
    placed = few if many is None else many if len(long) == len(open_) else few.unionByName(many)
    ranked = placed.select("i", (F.col("v") - _get(stats, "mean")).alias("x"), _get(stats, "valid").alias("n"), "rank")
    score = normal_inverse((rank - 0.375) / (n + 0.25))
    scored = ranked.select("i", "x", "n", "rank", F.when(2 * rank == n + 1, 0.0).otherwise(score).alias("m"))
    at = lambda c, k: F.max(F.when(rank == k, F.col(c)))
    sums = scored.groupBy("i").agg(
        F.sum(x * x).alias("squares"),
        F.sum(F.col("m") * F.col("m")).alias("square"),
        F.sum(F.col("m") * x).alias("weighted"),
        at("m", n).alias("last"),
        at("m", n - 1).alias("last_but_one"),
        (at("x", n) - at("x", F.lit(1))).alias("range"),
        (at("x", n - 1) - at("x", F.lit(2))).alias("inner"),
    )
    for r in sums.collect():
        n_ = stats[r["i"]]["valid"]
        ends, scale = distributions.shapiro_ends(n_, r["square"], r["last"], r["last_but_one"])
        spans, scores = (r["range"], r["inner"])[: len(ends)], (r["last"], r["last_but_one"])[: len(ends)]
        rest = (r["weighted"] - sum(m * d for m, d in zip(scores, spans, strict=True))) / scale if n_ > 3 else 0.0
        w = min(1.0, (sum(a * d for a, d in zip(ends, spans, strict=True)) + rest) ** 2 / r["squares"])
        out[r["i"]] = w, distributions.shapiro_probability(w, n_)
    if many is not None:
        release(many)
    return out
