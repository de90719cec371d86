"""Exact order statistics and cumulative counts without gathering a column anywhere.

Columns are read in long form, as pairs of a number and a value, so a job's code is small however many columns there are.

`select_ranks` brackets each wanted rank by an approximate percentile sketch (rank error under 1 / ACCURACY of the
rows), counts the values below the bracket and tabulates those inside: two more scans, and a shuffle of a few values.
A bracket with too many distinct values to collect is bracketed again inside itself.

`cumulative` gives, for each column and distinct value, its count and the count below it: values are range-partitioned,
each partition sums up on its own, and partition totals (one number each) are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Context, Decimal
from functools import reduce
from operator import or_
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dtypes import numeric_columns
from ..functions.stats import quoted

ACCURACY = 10_000
#: Most distinct values of a bracket that are sent to the driver.
MOST_VALUES = 50_000
#: Most distinct values of a column whose ranks are broadcast.
MOST_BROADCAST = 200_000
#: Most columns with more distinct values whose ranks are joined to the rows, a shuffle of the rows for each.
MOST_JOINED = 3


def nearest_rank(p: float, n: int) -> int:
    """The 0-based rank of the nearest quantile, halves up."""
    return min(n - 1, math.floor((n - 1) * p + 0.5))


def long_form(df: DataFrame, values: list[Column], *others: Column) -> DataFrame:
    """(i, v, others): each value of each expression, as a double, with the expression's number; nulls stay."""
    return df.select(*others, F.posexplode(F.array(*[v.cast("double") for v in values])).alias("i", "v"))


def numbered_form(df: DataFrame, values: dict[int, Column]) -> DataFrame:
    """(i, v) of expressions by their number, as in `long_form`."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), v.cast("double").alias("v")) for i, v in values.items()])))


def by_number(values: list[float | None]) -> Column:
    """The value for number i."""
    return F.get(F.array(*[F.lit(v).cast("double") for v in values]), F.col("i"))


@dataclass
class _Bracket:
    slot: int
    rank: int
    low: float
    high: float
    below: int = 0
    inside: int = 0


def _points(rank: int, n: int) -> tuple[float, float]:
    """The shares to bracket a rank by, on a grid, so that columns share most of them."""
    margin, grid = 2.0 / ACCURACY, 1e-4
    return max(0.0, math.floor((rank / n - margin) / grid) * grid), min(1.0, math.ceil(((rank + 1) / n + margin) / grid) * grid)


def select_ranks(df: DataFrame, values: dict[str, Column], counts: dict[str, int], ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values of 0-based ranks among the non-null values (NaN last) of each expression. counts: their numbers."""
    names = [c for c in values if ranks.get(c) and counts[c]]
    if not names:
        return {}
    long = long_form(df, [values[c] for c in names]).where("v IS NOT NULL")
    open_ = [_Bracket(i, r, 0.0, 0.0) for i, c in enumerate(names) for r in sorted(set(ranks[c]))]
    shares = sorted({p for b in open_ for p in _points(b.rank, counts[names[b.slot]])})
    sketch = {r["i"]: dict(zip(shares, r["q"], strict=True)) for r in long.groupBy("i").agg(F.percentile_approx("v", shares, ACCURACY).alias("q")).collect()}
    for b in open_:
        b.low, b.high = (sketch[b.slot][p] for p in _points(b.rank, counts[names[b.slot]]))
    found: dict[tuple[str, int], float] = {}
    at_once = True
    while open_:
        # the k-th open bracket of each column, as one pair of bounds by column
        waves: list[dict[int, _Bracket]] = []
        for b in open_:
            wave = next((w for w in waves if b.slot not in w), None)
            if wave is None:
                waves.append(wave := {})
            wave[b.slot] = b
        bounds = [[by_number([getattr(w[i], e) if i in w else None for i in range(len(names))]) for e in ("low", "high")] for w in waves]
        within = [(F.col("v") >= low) & (F.col("v") <= high) for low, high in bounds]
        if at_once and sum(counts[names[b.slot]] for b in open_) * (8 / ACCURACY + 2e-4) <= MOST_VALUES:
            # few rows are in the brackets: counts and values in one job
            nothing = F.lit(None).cast("array<bigint>").alias("below")
            below = long.groupBy("i").agg(F.array(*[F.count_if(F.col("v") < low) for low, _ in bounds]).alias("below")).select("i", F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("n"), "below")
            values_ = long.where(reduce(or_, within)).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).select("i", "v", "n", nothing)
            by, starts = {}, {}
            for r in below.unionByName(values_).collect():
                if r["below"] is not None:
                    starts[r["i"]] = r["below"]
                else:
                    by.setdefault(r["i"], []).append((r["v"], r["n"]))
            again = []
            for k, w in enumerate(waves):
                for i, b in w.items():
                    b.below = starts[i][k]
                    value = _at_rank(b, by.get(i, []))
                    if value is None:  # the sketch erred beyond its bound
                        again.append(_Bracket(b.slot, b.rank, float("-inf"), float("nan")))
                    else:
                        found[names[i], b.rank] = value
            open_, at_once = again, False
            continue
        exprs = [x for k, (low, _) in enumerate(bounds) for x in (F.count_if(F.col("v") < low).alias(f"below{k}"), F.count_if(within[k]).alias(f"inside{k}"))]
        for row in long.groupBy("i").agg(*exprs).collect():
            for k, w in enumerate(waves):
                if row["i"] in w:
                    w[row["i"]].below, w[row["i"]].inside = row[f"below{k}"], row[f"inside{k}"]
        small, wide, again = [], [], []
        for b in open_:
            if not b.below <= b.rank < b.below + b.inside:  # the sketch erred beyond its bound
                again.append(_Bracket(b.slot, b.rank, float("-inf"), float("nan")))
            elif b.low == b.high:
                found[names[b.slot], b.rank] = b.low
            else:
                (small if b.inside <= MOST_VALUES else wide).append(b)
        if wide:  # many rows may still be few values
            mine = [{i: b for i, b in w.items() if b in wide} for w in waves]
            exprs = []
            for k, w in enumerate(mine):
                if w:
                    inner = sorted({p for b in w.values() for p in _points(b.rank - b.below, b.inside)})
                    exprs += [F.approx_count_distinct(F.when(within[k], F.col("v"))).alias(f"d{k}"), F.percentile_approx(F.when(within[k], F.col("v")), inner, ACCURACY).alias(f"p{k}")]
            for row in long.groupBy("i").agg(*exprs).collect():
                for k, w in enumerate(mine):
                    if (b := w.get(row["i"])) is not None:
                        if row[f"d{k}"] <= MOST_VALUES:
                            small.append(b)
                        else:
                            inner = sorted({p for x in w.values() for p in _points(x.rank - x.below, x.inside)})
                            at = dict(zip(inner, row[f"p{k}"], strict=True))
                            again.append(_Bracket(b.slot, b.rank, *(at[p] for p in _points(b.rank - b.below, b.inside))))
        if small:
            ours = [by_number_of({i: b for i, b in w.items() if b in small}, len(names)) for w in waves]
            table = long.where(reduce(or_, [(F.col("v") >= low) & (F.col("v") <= high) for low, high in ours])).groupBy("i", "v").count().collect()
            by: dict[int, list[tuple[float, int]]] = {}
            for r in table:
                by.setdefault(r["i"], []).append((r["v"], r["count"]))
            for b in small:
                found[names[b.slot], b.rank] = _at_rank(b, by[b.slot])
        open_ = again
    return found


def _at_rank(b: _Bracket, values: list[tuple[float, int]]) -> float | None:
    """The value of the bracket's rank among values with their counts, of which it looks at those inside; None if it's outside."""
    seen = b.below
    order = lambda x: (math.isnan(x), 0.0 if math.isnan(x) else x)
    for v, n in sorted(values, key=lambda x: order(x[0])):
        if not order(b.low) <= order(v) <= order(b.high):
            continue
        seen += n
        if seen > b.rank:
            return v if b.below <= b.rank else None
    return None


def by_number_of(wave: dict[int, _Bracket], columns: int) -> tuple[Column, Column]:
    """The bounds of some columns' brackets; others have none, and nothing is within them."""
    return by_number([wave[i].low if i in wave else None for i in range(columns)]), by_number([wave[i].high if i in wave else None for i in range(columns)])


#: Cells of a column in a Grid at most, and of all columns.
CELLS, MOST_CELLS = 1024, 200_000


class Grid:
    """The values of finite columns counted in cells of equal width, with each cell's least and greatest value: one job that
    sends some hundred rows for each column. Ranks, and bounds of much else, follow from it but for a few cells' values.

    rows: (i, v), a value and its column's number; stats: valid, min and max of each. `extra`: functions that give further
    expressions of i and v, which are kept at the least and greatest v of each cell. `read`: gives the rows of some numbers
    only, so that columns without open cells aren't read again."""

    def __init__(self, rows: DataFrame, stats: list[dict[str, Any]], extra: dict[str, Callable[[Column], Column]] | None = None, read: Callable[[list[int]], DataFrame] | None = None):
        extra = extra or {}
        self.stats, self.extra, self.count = stats, extra, max(16, min(CELLS, MOST_CELLS // max(1, len(stats))))
        low, high = (by_number([float(s[e] or 0.0) for s in stats]) for e in ("min", "max"))
        v = F.col("v")
        cell = F.when(low < high, F.least(F.floor((v - low) / (high - low) * self.count), F.lit(self.count - 1))).otherwise(0).cast("int")
        self.plain, self.read, self.cell = rows.where("v IS NOT NULL").select("i", "v"), read, cell.alias("cell")
        self.rows = self.plain.select("i", "v", self.cell)
        found = self.rows.groupBy("i", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        ends = [x(F.col(end)).alias(f"{e}_{n}") for n, x in extra.items() for e, end in (("least", "low"), ("most", "high"))]
        self.cells: list[list[dict[str, Any]]] = [[] for _ in stats]
        for r in found.select("*", *ends).collect():
            self.cells[r["i"]].append(r.asDict())
        for found in self.cells:
            found.sort(key=lambda c: c["cell"])
            below = 0
            for c in found:
                c["below"] = below
                below += c["n"]

    def plain_of(self, cells: list[dict[str, Any]]) -> DataFrame:
        """(i, v) of the columns that have these cells."""
        return self.read(sorted({c["i"] for c in cells})).where("v IS NOT NULL") if self.read and cells else self.plain

    def rows_of(self, cells: list[dict[str, Any]]) -> DataFrame:
        """(i, v, cell) of the columns that have these cells."""
        return self.plain_of(cells).select("i", "v", self.cell)

    def inside(self, wanted: list[dict[str, Any]]) -> DataFrame:
        """(i, v, f) of some cells: their rows, or one row that stands for all where a cell has one value."""
        spark = self.rows.sparkSession
        one = [(c["i"], c["low"], c["n"]) for c in wanted if c["low"] == c["high"]]
        several = [c for c in wanted if c["low"] < c["high"]]
        table = F.broadcast(spark.createDataFrame([(c["i"], c["cell"]) for c in several], "i int, cell int"))  # at most all cells
        rows = self.rows_of(several).join(table, ["i", "cell"]).select("i", "v", F.lit(1).cast("long").alias("f"))
        return rows.unionByName(spark.createDataFrame(one, "i int, v double, f long")) if one else rows

    def values(self, wanted: list[dict[str, Any]]) -> dict[tuple[int, int], list[tuple[float, int]]] | None:
        """By number and cell, the sorted values of some cells with their counts; None if they are too many."""
        known = {(c["i"], c["cell"]): [(c["low"], c["n"])] for c in wanted if c["low"] == c["high"]}
        keys = sorted({(c["i"], c["cell"]) for c in wanted} - known.keys())
        if sum(c["n"] for c in wanted if c["low"] < c["high"]) > MOST_VALUES:
            return None
        if keys:
            table = F.broadcast(self.rows.sparkSession.createDataFrame(keys, "i int, cell int"))  # at most all cells
            for r in self.rows_of([c for c in wanted if c["low"] < c["high"]]).join(table, ["i", "cell"]).groupBy("i", "cell", "v").agg(F.count(F.lit(1)).alias("n")).collect():
                known.setdefault((r["i"], r["cell"]), []).append((r["v"], r["n"]))
        return {k: sorted(x) for k, x in known.items()}

    def ranks(self, ranks: list[list[int]]) -> dict[tuple[int, int], float]:
        """By number: the values of 0-based ranks."""
        at = {(i, r): next(c for c in self.cells[i] if c["below"] <= r < c["below"] + c["n"]) for i, wanted in enumerate(ranks) for r in wanted}
        values = self.values(list({id(c): c for c in at.values()}.values()))
        if values is None:
            one = self.plain_of([c for c in at.values() if c["low"] < c["high"]]).withColumn("f", F.lit(1))
            start: dict[int, tuple] = {}
            for (i, r), c in at.items():
                start.setdefault(id(c), (i, c["low"], c["high"], c["below"], c["n"], []))[5].append(r)
            return weighted_ranks(one, [(0.0, 0.0)] * len(ranks), [[] for _ in ranks], start=list(start.values()))
        return {(i, r): _nth(values[i, c["cell"]], r - c["below"]) for (i, r), c in at.items()}

    def deviations(self, middles: list[float], ranks: list[list[int]]) -> dict[tuple[int, int], float]:
        """By number: the values of 0-based ranks of the distances from a column's middle. The cells on both sides of the
        middle that hold a distance between the bounds of the rank's are looked into at once."""
        wanted: list[dict[str, Any]] = []
        before: list[int] = []
        for i, (middle, mine) in enumerate(zip(middles, ranks, strict=True)):
            spans = [(0.0 if c["low"] <= middle <= c["high"] else min(abs(c["low"] - middle), abs(c["high"] - middle)), max(abs(c["low"] - middle), abs(c["high"] - middle)), c) for c in self.cells[i]]
            # a rank's distance is between those it had if all distances of a cell were its least, or its greatest
            least = _nth(sorted((near, c["n"]) for near, _, c in spans), min(mine)) if mine else 0.0
            most = _nth(sorted((far, c["n"]) for _, far, c in spans), max(mine)) if mine else 0.0
            before.append(sum(c["n"] for _, far, c in spans if far < least))
            wanted += [c for near, far, c in spans if near <= most and far >= least] if mine else []
        values = self.values(wanted)
        if values is None:
            away = self.inside(wanted).select("i", F.abs(F.col("v") - by_number(middles)).alias("v"), "f")
            start = []
            for i, mine in enumerate(ranks):
                if spans := [(abs(c["low"] - middles[i]), abs(c["high"] - middles[i]), c["low"] <= middles[i] <= c["high"], c["n"]) for c in wanted if c["i"] == i]:
                    start.append((i, min(0.0 if around else min(a, b) for a, b, around, _ in spans), max(max(a, b) for a, b, _, _ in spans), before[i], sum(n for *_, n in spans), sorted(set(mine))))
            return weighted_ranks(away, [(0.0, 0.0)] * len(ranks), [[] for _ in ranks], start=start)
        out: dict[tuple[int, int], float] = {}
        for i, mine in enumerate(ranks):
            every = sorted((abs(v - middles[i]), n) for (j, _), x in values.items() if j == i for v, n in x)
            out |= {(i, r): _nth(every, r - before[i]) for r in mine}
        return out


def _nth(values: list[tuple[float, int]], rank: int) -> float:
    for v, n in values:
        rank -= n
        if rank < 0:
            return v
    raise ValueError("a rank beyond the values")


def exact_ranks(df: DataFrame, scales: dict[str, int], ends: dict[str, tuple], counts: dict[str, int], ranks: dict[str, list[int]]) -> dict[tuple[str, int], Decimal]:
    """The values of 0-based ranks of whole and decimal columns as they are, however many digits they have. scales: the digits
    after the point of each; ends: the least and greatest value."""
    found: dict[tuple[str, int], Decimal] = {}
    for scale in sorted(set(scales.values())):
        names = [c for c, s in scales.items() if s == scale]
        kind = f"decimal(38,{scale})"
        long = df.select(F.posexplode(F.array(*[quoted(c).cast(kind) for c in names])).alias("i", "v")).where("v IS NOT NULL")
        got = weighted_ranks(long.withColumn("f", F.lit(1)), [tuple(map(Decimal, ends[c])) for c in names], [ranks[c] for c in names], [counts[c] for c in names], kind)
        found |= {(names[i], r): v for (i, r), v in got.items()}
    return found


def told_apart(kind: T.DataType, low: Any, high: Any) -> bool:
    """Doubles of this type's values from low to high are as distinct and in the same order: below 2 ** 53 for whole numbers,
    15 digits for decimals."""
    most = max(abs(low), abs(high))
    if isinstance(kind, T.DecimalType):
        return most * 10**kind.scale < 10**15
    return not isinstance(kind, T.LongType) or most < 1 << 53


def native(kind: T.DataType, v: float | Decimal) -> Any:
    """A value of doubles that were told apart, in the column's own type."""
    if isinstance(kind, T.DecimalType):
        return (v if isinstance(v, Decimal) else Decimal(repr(v))).quantize(Decimal(1).scaleb(-kind.scale), context=Context(prec=76))
    return float(v) if isinstance(kind, T.FloatType | T.DoubleType) else int(v)


def quantiles(df: DataFrame, columns: list[str] | None = None, shares: tuple[float, ...] | list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(share, columns...): the nearest-rank quantiles of numeric columns, exact and in their own types."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = numeric_columns(df.schema, columns)
    rows = []
    if names:
        row = df.agg(*[f(quoted(c)).alias(f"{n}{i}") for i, c in enumerate(names) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
        ends = {c: (row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(names) if row[f"n{i}"]}
        counts = {c: row[f"n{i}"] for i, c in enumerate(names)}
        ranks = {c: sorted({nearest_rank(p, counts[c]) for p in shares}) for c in ends}
        far = [c for c in ends if not told_apart(kinds[c], *ends[c])]
        found: dict[tuple[str, int], Any] = dict(select_ranks(df, {c: quoted(c) for c in ends if c not in far}, counts, ranks))
        found |= exact_ranks(df, {c: kinds[c].scale if isinstance(kinds[c], T.DecimalType) else 0 for c in far}, ends, counts, ranks)
        rows = [(float(p), *(native(kinds[c], found[c, nearest_rank(p, counts[c])]) if c in ends else None for c in names)) for p in shares]
    schema = T.StructType([T.StructField("share", T.DoubleType()), *[T.StructField(c, kinds[c]) for c in names]])
    return df.sparkSession.createDataFrame(rows, schema).coalesce(1)


def cumulative(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(i, v, f, below): each distinct non-null value of each expression (by number) as a double, its count, and how many
    values are below it. Persisted parts are let go with `release`."""
    table = long_form(df, list(values.values())).where("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("f"))
    table = table.persist()  # range partitioning reads it twice
    parts = table.repartitionByRange("i", "v").withColumn("part", F.spark_partition_id()).persist()
    running = parts.withColumn("own", F.sum("f").over(Window.partitionBy("part", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)))
    totals = parts.groupBy("part", "i").agg(F.sum("f").alias("t")).collect()  # a few rows for each partition
    table.unpersist()
    offsets, so_far = [], {}
    for r in sorted(totals, key=lambda r: (r["i"], r["part"])):
        offsets.append((r["part"], r["i"], so_far.get(r["i"], 0)))
        so_far[r["i"]] = so_far.get(r["i"], 0) + r["t"]
    before = df.sparkSession.createDataFrame(offsets, "part int, i int, offset long")
    joined = running.join(F.broadcast(before) if len(offsets) <= MOST_VALUES else before, ["part", "i"])
    out = joined.select("i", "v", "f", (F.coalesce("own", F.lit(0)) + F.col("offset")).alias("below"))
    out.__dict__["_persisted"] = parts
    return out


def row_ranks(rows: DataFrame) -> DataFrame:
    """(i, v, rank) of rows (i, v): each row's place (from 1) among its number's, equal values in any order. Rows are
    range-partitioned, and partition totals are added. Persisted parts are let go with `release`."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # with it, one value may fill many partitions
    parts = numbered.repartitionByRange("i", "v", "row").select(F.spark_partition_id().alias("part"), "i", "v").persist()
    offsets, so_far = [], {}
    for r in sorted(parts.groupBy("part", "i").count().collect(), key=lambda r: (r["i"], r["part"])):  # a few rows for each partition
        offsets.append((r["part"], r["i"], so_far.get(r["i"], 0)))
        so_far[r["i"]] = so_far.get(r["i"], 0) + r["count"]
    before = rows.sparkSession.createDataFrame(offsets, "part int, i int, offset long")
    own = parts.withColumn("own", F.row_number().over(Window.partitionBy("part", "i").orderBy("v")))
    out = own.join(F.broadcast(before) if len(offsets) <= MOST_VALUES else before, ["part", "i"]).select("i", "v", (F.col("own") + F.col("offset")).alias("rank"))
    out.__dict__["_persisted"] = parts
    return out


def table_ranks(table: DataFrame, ranks: list[list[int]]) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    """From a cumulative table, by number: how many distinct values there are, and the values of the 0-based ranks. One job."""
    v, f, below = F.col("v"), F.col("f"), F.col("below")
    waves = [[r[k] if k < len(r) else None for r in ranks] for k in range(max(map(len, ranks), default=0))]
    at = [F.get(F.array(*[F.lit(r).cast("long") for r in w]), F.col("i")) for w in waves]
    picked = [F.max(F.when((below <= r) & (r < below + f), v)).alias(f"r{k}") for k, r in enumerate(at)]
    rows = table.groupBy("i").agg(F.count(F.lit(1)).alias("n"), *picked).collect()
    return {r["i"]: r["n"] for r in rows}, {(r["i"], rank): r[f"r{k}"] for r in rows for k, w in enumerate(waves) if (rank := w[r["i"]]) is not None}


#: Bins of a step of weighted_ranks.
STEP = 2048


def _literals(values: list, kind: str) -> Column:
    """The value for number i, of this type."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("i"))


def weighted_ranks(rows: DataFrame, ends: list[tuple], ranks: list[list[int]], counts: list[int] | None = None, kind: str = "double", start: list[tuple] | None = None) -> dict[tuple[int, int], Any]:
    """By number: the values of 0-based ranks among finite v of rows (i, v, f), each of which stands f times. ends: the
    least and greatest v; counts: the sums of f, if known; kind: the type of v, double or a decimal of 38 digits. start:
    instead of whole numbers, stretches (i, least, greatest, how many are below, how many inside, ranks).

    Bins of equal width lead to the ranks, each step STEP times finer, all ranks of all numbers in one job; once few rows
    are left, their values come to the driver. Decimals are compared as they are: only their distances from the least of
    a stretch become doubles, which keeps their order, and the ends of the next stretch are exact again."""
    found: dict[tuple[int, int], Any] = {}
    open_ = [(i, low, high, 0, counts[i] if counts else math.inf, sorted(set(r))) for i, ((low, high), r) in enumerate(zip(ends, ranks, strict=True)) if r]
    open_ += start or []
    while True:
        found |= {(i, r): low for i, low, high, _, _, wanted in open_ if low == high for r in wanted}
        open_ = [x for x in open_ if x[1] != x[2]]
        if not open_:
            return found
        waves: list[dict[int, tuple]] = []  # the k-th stretch of each number
        for x in open_:
            wave = next((w for w in waves if x[0] not in w), None)
            if wave is None:
                waves.append(wave := {})
            wave[x[0]] = x
        v = F.col("v")
        bounds = [[_literals([w[i][e] if i in w else None for i in range(len(ends))], kind) for e in (1, 2)] for w in waves]
        within = [(v >= low) & (v <= high) for low, high in bounds]
        if sum(x[4] for x in open_) <= MOST_VALUES:
            values: dict[int, list[tuple]] = {}
            for r in rows.where(reduce(or_, within)).groupBy("i", "v").agg(F.sum("f").alias("f")).collect():
                values.setdefault(r["i"], []).append((r["v"], r["f"]))
            for i, low, high, below, _, wanted in open_:
                for value, f in sorted(values.get(i, [])):
                    if low <= value <= high:
                        found |= {(i, r): value for r in wanted if below <= r < below + f}
                        below += f
            return found
        slot, at = F.lit(None).cast("int"), F.lit(None).cast("double")
        for k, (w, (low, _)) in enumerate(zip(waves, bounds, strict=True)):
            wide = by_number([float(w[i][2] - w[i][1]) if i in w else None for i in range(len(ends))])
            away = v - low if kind == "double" else F.coalesce(F.try_subtract(v, low).cast("double"), v.cast("double") - low.cast("double"))
            slot, at = F.when(within[k], k).otherwise(slot), F.when(within[k], away / wide).otherwise(at)
        bins: dict[tuple[int, int], list] = {}
        binned = rows.select("i", "v", "f", slot.alias("slot"), F.least(F.floor(at * STEP), F.lit(STEP - 1)).cast("int").alias("bin")).where("slot IS NOT NULL")
        for r in binned.groupBy("i", "slot", "bin").agg(F.sum("f").alias("f"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            bins.setdefault((r["i"], r["slot"]), []).append(r)
        again = []
        for k, w in enumerate(waves):
            for i, (_, _, _, below, _, wanted) in w.items():
                for r in sorted(bins.get((i, k), []), key=lambda r: r["bin"]):
                    if mine := [x for x in wanted if below <= x < below + r["f"]]:
                        again.append((i, r["low"], r["high"], below, r["f"], mine))
                    below += r["f"]
        open_ = again


def release(table: DataFrame) -> None:
    """Lets go what `cumulative` persisted for this table (or `average_ranks`)."""
    parts = table.__dict__.pop("_persisted", None)
    if parts is not None:
        parts.unpersist()


def average_ranks(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    """The average ranks (1-based) of each expression's values under its name, one row for each row of df that has any;
    null stays null.

    The ranks of columns with few distinct values (MOST_BROADCAST, estimated first) are sent to all tasks. Those of up to
    MOST_JOINED columns with more, if they are no more than the others, are joined by value, with repeats of a value combined
    before; rows move once for each such column. With more, all values are shuffled twice, however many columns there are: by
    range to be ranked, and by row to be put together again."""
    values = list(names.values())
    sizes = long_form(df, values).where("v IS NOT NULL").groupBy("i").agg(F.approx_count_distinct("v").alias("n")).collect()
    large = {r["i"] for r in sizes if r["n"] > MOST_BROADCAST * 0.8}
    if len(large) > min(MOST_JOINED, len(names) // 2):
        return _ranks_by_range(df, names)
    table = cumulative(df, names)
    out = df.select([v.cast("double").alias(f"_{i}") for i, v in enumerate(values)])
    for i in [*sorted(large), *[i for i in range(len(names)) if i not in large]]:
        ranks = table.where(F.col("i") == i).select(F.col("v").alias(f"v{i}"), (F.col("below") + (F.col("f") + 1) / 2).alias(f"r{i}"))
        out = out.join(ranks if i in large else F.broadcast(ranks), F.col(f"_{i}") == F.col(f"v{i}"), "left").drop(f"_{i}", f"v{i}")
    out = out.select([F.col(f"r{i}").alias(c) for i, c in enumerate(names)])
    out.__dict__["_persisted"] = table.__dict__.pop("_persisted")
    return out


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, float, np.ndarray]]:
    """(part, i, v, rows) of each run of equal values in rows (part, i, v, row) that are sorted so."""
    held: tuple[int, int, float] | None = None
    rows: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part, i, v, row = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "i", "v", "row"))
        same = (part[1:] == part[:-1]) & (i[1:] == i[:-1]) & ((v[1:] == v[:-1]) | np.isnan(v[1:]) & np.isnan(v[:-1]))
        starts = np.r_[0, np.flatnonzero(~same) + 1, len(v)]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            key = int(part[a]), int(i[a]), float(v[a])
            if held is not None and (key[:2] != held[:2] or key[2] != held[2] and not (math.isnan(key[2]) and math.isnan(held[2]))):
                yield *held, np.concatenate(rows)
                rows = []
            held = key
            rows.append(row[a:b])
    if held is not None:
        yield *held, np.concatenate(rows)


def _ranks_by_range(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    """Average ranks of values that are range-partitioned with their row's number; equal values may lie in several
    partitions, of which the driver knows the first and last value of each column and how often they stand there."""
    numbered = df.select(F.monotonically_increasing_id().alias("row"), *[v.cast("double").alias(f"_{k}") for k, v in enumerate(names.values())])
    rows = long_form(numbered, [F.col(f"_{k}") for k in range(len(names))], F.col("row")).where("v IS NOT NULL")
    order = ["i", "v", "row"]  # with the row's number, one value may fill many partitions
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "i", "v", "row").persist()

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for part, i, v, mine in _runs(batches):
            end = found.setdefault((part, i), [0, v, len(mine), v, 0])
            end[0] += len(mine)
            end[3:] = v, len(mine)
        columns = [list(x) for x in zip(*[(*k, *e) for k, e in found.items()], strict=True)] or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["part", "i", "n", "first", "first_n", "last", "last_n"])

    key = lambda v: "nan" if math.isnan(v) else v + 0.0
    found = parts.mapInArrow(ends, "part int, i int, n long, first double, first_n long, last double, last_n long").collect()  # a row for each partition and column in it
    before: dict[int, int] = {}
    spans: dict[tuple, list[int]] = {}  # of first and last values: how many are below, how many equal
    offsets: dict[tuple[int, int], int] = {}
    for r in sorted(found, key=lambda r: (r["i"], r["part"])):
        offset = offsets[r["part"], r["i"]] = before.get(r["i"], 0)
        before[r["i"]] = offset + r["n"]
        spans.setdefault((r["i"], key(r["first"])), [offset, 0])[1] += r["first_n"]
        if key(r["first"]) != key(r["last"]):
            spans.setdefault((r["i"], key(r["last"])), [offset + r["n"] - r["last_n"], 0])[1] += r["last_n"]

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        held: list[tuple[np.ndarray, int, float]] = []
        size = 0

        def give() -> pa.RecordBatch:
            counts = [len(x) for x, _, _ in held]
            columns = np.concatenate([x for x, _, _ in held]), np.repeat(np.array([i for _, i, _ in held], np.int32), counts), np.repeat(np.array([k for _, _, k in held]), counts)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["row", "i", "rank"])

        for part, i, v, mine in _runs(batches):
            below = seen.get((part, i), 0)
            seen[part, i] = below + len(mine)
            low, equal = spans.get((i, key(v))) or (offsets[part, i] + below, len(mine))
            held.append((mine, i, low + (equal + 1) / 2))
            size += len(mine)
            if size > 100_000:
                yield give()
                held.clear()
                size = 0
        if held:
            yield give()

    ranked = parts.mapInArrow(rank, "row long, i int, rank double")
    out = ranked.groupBy("row").agg(*[F.max(F.when(F.col("i") == k, F.col("rank"))).alias(c) for k, c in enumerate(names)]).drop("row")
    out.__dict__["_persisted"] = parts
    return out
