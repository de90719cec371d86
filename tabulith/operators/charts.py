"""The aggregates behind the charts, as small DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dtypes import is_string
from ..functions.stats import bin_of, greatest, quoted


def bins(df: DataFrame, column: str, count: int = 30) -> DataFrame:
    """(bin, low, high, n) of `count` equal-width bins over the non-null, non-NaN values; empty bins have 0."""
    v = quoted(column).cast("double")
    low, high = df.agg(F.min(v), greatest(v)).first()
    schema = "bin int, low double, high double"
    if low is None or high is None:
        return df.sparkSession.createDataFrame([], schema + ", n long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / count
    edges = [low + step * i for i in range(count)] + [high]
    found = df.select(bin_of(v, edges).alias("b")).where("b IS NOT NULL").groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(count)], schema)
    return every.join(found, F.col("bin") == F.col("b"), "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


#: Points of a density's grid.
POINTS = 512


def density(df: DataFrame, column: str, bins: int = 30) -> list[tuple[float, float]]:
    """A Gaussian kernel density of a column's non-null, finite values on POINTS points from the least to the greatest one,
    scaled to the counts of `bins` bins; empty for fewer than two different values.

    Each value adds to the two points beside it by its distance from them (linear binning), in one aggregate; the band is
    Scott's, of the exact standard deviation; the sums are smoothed by a fast Fourier transform on the driver."""
    v = quoted(column).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    n, low, high, spread = df.agg(F.count(finite), F.min(finite), F.max(finite), F.stddev_samp(finite)).first()
    if n < 2 or low == high:
        return []
    step = (high - low) / (POINTS - 1)
    place = (F.col("v") - low) / step
    left = F.least(F.floor(place), F.lit(POINTS - 2)).cast("int")
    rows = df.select(finite.alias("v")).where("v IS NOT NULL").select(left.alias("at"), (place - left).alias("part"))
    mass = np.zeros(POINTS)
    for r in rows.groupBy("at").agg(F.sum("part").alias("right"), F.count(F.lit(1)).alias("n")).collect():  # a row for each point
        mass[r["at"]] += r["n"] - r["right"]
        mass[r["at"] + 1] += r["right"]
    band = spread * n**-0.2
    kernel = np.exp(-0.5 * (np.arange(POINTS) * step / band) ** 2) / (band * np.sqrt(2 * np.pi))
    size = 2 * POINTS  # room enough that what leaves one end doesn't come back at the other
    around = np.r_[kernel, 0.0, kernel[:0:-1]]
    smooth = np.fft.irfft(np.fft.rfft(mass, size) * np.fft.rfft(around, size), size)[:POINTS]
    height = np.maximum(smooth, 0.0) * (high - low) / bins
    return list(zip(np.linspace(low, high, POINTS).tolist(), height.tolist(), strict=True))


def missing(df: DataFrame, sort: str | None = "desc") -> DataFrame:
    """(column, position, nulls, ratio) in the wanted order; equal ratios keep the order of columns."""
    aggregated = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), (F.col("rows") - F.col(f"c{i}")).alias("nulls")) for i, c in enumerate(df.columns)]))
    out = aggregated.select("rows", each.alias("x")).select("x.*", (F.col("x.nulls") / F.greatest("rows", F.lit(1))).alias("ratio"))
    if sort == "desc":
        return out.orderBy(F.desc("ratio"), "position")
    return out.orderBy("ratio", "position") if sort == "asc" else out.orderBy("position")


def categories(df: DataFrame, top: int = 10, bottom: int = 10, *, true_bottom: bool = False) -> DataFrame:
    """(column, value, n, rank, part): the most frequent values of each string column, and as 'bottom' the last of the
    first top + bottom (with true_bottom, the rarest of all). Null is a value; ties go by value, nulls last. All
    columns in one aggregate."""
    names = [f.name for f in df.schema.fields if is_string(f.dataType)]
    empty = df.sparkSession.createDataFrame([], "column string, value string, n long, rank int, part string")
    if not names:
        return empty
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in names]))
    counts = df.select(each.alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    if true_bottom:
        # a group limit before the shuffle leaves a task's first and last few values of each column
        back = Window.partitionBy("column").orderBy("n", F.desc_nulls_first("value"))
        all_ = counts.groupBy(F.col("column").alias("of")).agg(F.count(F.lit(1)).cast("int").alias("all"))
        first = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top + bottom).withColumn("back", F.lit(None).cast("int"))
        rare = counts.withColumn("back", F.row_number().over(back)).where(F.col("back") <= bottom).withColumn("rank", F.lit(None).cast("int"))
        both = first.select("column", "value", "n", "rank", "back").unionByName(rare.select("column", "value", "n", "rank", "back"))
        ranked = both.groupBy("column", "value", "n").agg(F.max("rank").alias("rank"), F.max("back").alias("back")).join(all_, F.col("column") == F.col("of"))
        ranked = ranked.withColumn("rank", F.coalesce("rank", F.col("all") + 1 - F.col("back"))).withColumn("back", F.coalesce("back", F.col("all") + 1 - F.col("rank")))
        last = (F.col("back") <= bottom) & (F.col("all") > top)
    else:
        ranked = counts.withColumn("rank", F.row_number().over(order))
        ranked = ranked.where(F.col("rank") <= top + bottom).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("column")))
        last = (F.col("all") > top) & (F.col("rank") > F.col("all") - bottom)
    parts = F.array_compact(F.array(F.when(F.col("rank") <= top, F.lit("top")), F.when(last, F.lit("bottom"))))
    return ranked.select("column", "value", "n", "rank", F.explode(parts).alias("part"))
