"""A running profile of a stream: the mergeable state of each micro-batch, written once under the batch's number.

Each batch adds a row for each column (and window) to `path/batch=<n>`; a batch that runs again after a failure overwrites
its own rows, so nothing counts twice. `summary` merges them: sums of powers give moments, KLL sketches quantiles and
histograms (rank error under RANK_ERROR), HLL sketches distinct counts (error under DISTINCT_ERROR, as one standard
deviation), with states of a few kB whatever the stream's length. Sums of powers are taken about `centres` (0 by default):
give rough means where values lie far from 0 for their spread.

With an event time, states are kept by window. A row is late if its window ended before the watermark, the latest event
of earlier batches less the delay. Late rows aren't dropped: they are profiled apart, and `summary` counts them in, leaves
them out or shows them alone. Rows without an event time have no window (null) and are never late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dtypes import numeric_columns
from ..functions.stats import greatest, quoted

#: Sizes of the sketches, and the errors that follow from them.
KLL, LOG_HLL = 800, 12
RANK_ERROR, DISTINCT_ERROR = 0.005, 0.0163
#: Quantiles that a histogram is made of.
SHARES = 400
SCHEMA = "Column string, window timestamp, late boolean, rows long, valid long, centre double, s1 double, s2 double, s3 double, s4 double, low double, high double, zero long, pos long, neg long, ranks binary, values binary, latest timestamp"
_SUMS = ["rows", "valid", "s1", "s2", "s3", "s4", "zero", "pos", "neg"]


def partial(df: DataFrame, columns: list[str] | None = None, centres: dict[str, float] | None = None, *, by: dict[str, Column] | None = None) -> DataFrame:
    """One mergeable row for each numeric column (and value of `by`: window and late): one pass, map-side combined."""
    names, centres, by = numeric_columns(df.schema, columns), centres or {}, by or {}
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        v = quoted(c).cast("double")
        d = v - F.lit(float(centres.get(c, 0.0)))
        sums = [F.coalesce(F.sum(F.pow(d, F.lit(p))), F.lit(0.0)).alias(f"s{p}") for p in (1, 2, 3, 4)]
        whole = F.when(~F.isnan(v), v)
        sketches = [F.kll_sketch_agg_double(whole, KLL).alias("ranks"), F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), F.lit(LOG_HLL)).alias("values")]
        exprs.append(F.struct(F.count(v).alias("valid"), *sums, F.min(v).alias("low"), greatest(v).alias("high"), F.count_if(v == 0).alias("zero"), F.count_if(v > 0).alias("pos"), F.count_if(v < 0).alias("neg"), *sketches).alias(f"c{i}"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("Column"), F.lit(float(centres.get(c, 0.0))).alias("centre"), F.col(f"c{i}").alias("x")) for i, c in enumerate(names)]))
    groups = [e.alias(n) for n, e in by.items()]
    sums_ = df.groupBy(*groups).agg(*exprs) if groups else df.agg(*exprs)
    of = {"window": "CAST(NULL AS timestamp)", "late": "false"} | {n: n for n in by}
    return sums_.select(*by, "rows", each.alias("e")).selectExpr("e.Column", f"{of['window']} AS window", f"{of['late']} AS late", "rows", "e.x.valid", "e.centre", *[f"e.x.s{p}" for p in (1, 2, 3, 4)], "e.x.low", "e.x.high", "e.x.zero", "e.x.pos", "e.x.neg", "e.x.ranks", "e.x.values")


def _micros(spark: SparkSession, interval: str) -> int:
    """The length of an interval such as '10 minutes', counted from the epoch."""
    zero = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    return int(spark.sql(f"SELECT timestampdiff(MICROSECOND, {zero}, {zero} + INTERVAL {interval})").first()[0])


def _latest(spark: SparkSession, path: str, number: int) -> int | None:
    """The latest event of the batches before this one, in microseconds: the batch before states it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    earlier = [n for f in fs.listStatus(hadoop) if (name := f.getPath().getName()).startswith("batch=") and (n := int(name[6:])) < number]
    if not earlier:
        return None
    return spark.read.schema(SCHEMA).parquet(f"{path}/batch={max(earlier)}").agg(F.max(F.unix_micros("latest"))).first()[0]


def start(stream: DataFrame, path: str, checkpoint: str, *, columns: list[str] | None = None, centres: dict[str, float] | None = None, event_time: str | None = None, window: str = "1 hour", delay: str = "0 seconds", **trigger) -> StreamingQuery:
    """Starts the running profile; with event_time by windows of that column, late after `delay`. `trigger` as for
    DataStreamWriter.trigger."""
    spark, root = stream.sparkSession, path.rstrip("/")
    wide, wait = (_micros(spark, x) for x in (window, delay))
    if event_time and wide <= 0:
        raise ValueError("a window has a length")

    def add(batch: DataFrame, number: int) -> None:
        by, latest = {}, F.lit(None).cast("timestamp")
        if event_time:
            seen = _latest(spark, root, number)
            micros = F.unix_micros(quoted(event_time).cast("timestamp"))
            begin = F.floor(micros / wide) * wide
            late = F.coalesce(begin + wide <= F.lit(seen - wait), F.lit(False)) if seen is not None else F.lit(False)
            by = {"window": F.timestamp_micros(begin), "late": late}
            own = batch.agg(F.max(micros)).first()[0]
            latest = F.timestamp_micros(F.lit(max((x for x in (seen, own) if x is not None), default=None)).cast("long"))
        partial(batch, columns, centres, by=by).withColumn("latest", latest).coalesce(1).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def merged(partials: DataFrame, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75), bins: int = 12, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, moments, quantiles, histogram and distinct values from mergeable rows."""
    merge = [F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_union_agg("values").alias("values")]
    sums = partials.groupBy(*by, "Column", "centre").agg(*[F.sum(c).alias(c) for c in _SUMS], F.min("low").alias("Min"), F.max("high").alias("Max"), *merge)
    n = F.nullif(F.col("valid"), F.lit(0)).cast("double")
    m = F.col("s1") / n
    m2 = F.greatest(F.col("s2") / n - m * m, F.lit(0.0))
    m3 = F.col("s3") / n - 3 * m * F.col("s2") / n + 2 * F.pow(m, F.lit(3))
    m4 = F.col("s4") / n - 4 * m * F.col("s3") / n + 6 * m * m * F.col("s2") / n - 3 * F.pow(m, F.lit(4))
    variance = F.try_divide(m2 * n, n - 1)
    known = F.kll_sketch_get_n_double("ranks") > 0  # an empty sketch has no quantiles
    quantile = [F.when(known, F.kll_sketch_get_quantile_double("ranks", F.lit(float(p)))).alias("50%" if p == 0.5 else f"{int(p * 100)}%") for p in percentiles]
    edge = lambda k: F.col("Min") + (F.col("Max") - F.col("Min")) / bins * k
    # ranks of edges that the data decide: by quantiles at fixed shares
    grid = F.when(known, F.kll_sketch_get_quantile_double("ranks", F.array(*[F.lit((k + 0.5) / SHARES) for k in range(SHARES)])))
    under = lambda e: F.size(F.filter("grid", lambda x: x < e)) / SHARES
    upto = F.array(F.lit(0.0), *[under(edge(k)) for k in range(1, bins)], F.lit(1.0))
    counts = F.zip_with(F.slice("upto", 2, bins), F.slice("upto", 1, bins), lambda b, a: F.round((b - a) * F.kll_sketch_get_n_double("ranks")).cast("long"))
    sums = sums.withColumn("grid", grid).withColumn("upto", upto)
    return sums.select(
        *by,
        "Column",
        F.col("valid").alias("Count"),
        (F.col("rows") - F.col("valid")).alias("null_count"),
        (F.col("centre") + m).alias("Mean"),
        F.sqrt(variance).alias("std"),
        "Min",
        *quantile,
        "Max",
        F.try_divide(m3, F.pow(m2, F.lit(1.5))).alias("skew"),
        (F.try_divide(m4, variance * variance) - 3).alias("Kurtosis"),
        F.col("zero").alias("N_Zero"),
        F.try_divide(100 * F.col("pos"), n).alias("Pct_Pos"),
        F.try_divide(100 * F.col("neg"), n).alias("Pct_Neg"),
        (F.hll_sketch_estimate("values") + (F.col("valid") < F.col("rows")).cast("long")).alias("N_Unique(approx)"),
        F.when(known & (F.col("Min") < F.col("Max")), counts).alias("Distribution_Plot"),
    )


def summary(spark: SparkSession, path: str, *, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75), windows: bool = False, late: bool | None = None) -> DataFrame:
    """The profile of all batches so far; with `windows`, of each window. late: False leaves late rows out, True shows them
    alone."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/batch=*")
    if late is not None:
        rows = rows.where(F.col("late") == late)
    return merged(rows, percentiles, by=("window",) if windows else ())
