"""Exact distinct counts and rows without repeats that move digests, not values.

Texts and rows are hashed to 128 bits where they are read, and only digests are shuffled. A digest that stands once is of a
value that stands once: it needn't be looked at. Values whose digest repeats are compared as they are, after each task
has combined its own. Equal digests alone never make values equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dtypes import is_integer
from ..functions.stats import quoted

#: Most repeated digests (24 bytes each) that are sent to all tasks.
MOST_KEYS = 1_000_000


def _digest(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns).alias("_a"), F.xxhash64(F.lit(1), *columns, F.lit(2)).alias("_b")]


def _whole(name: str, kind: T.DataType) -> Column | None:
    """The value as a long that is as distinct, for types that have one."""
    c = quoted(name)
    if is_integer(kind) or isinstance(kind, T.BooleanType):
        return c.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else None


def distinct_counts(df: DataFrame, columns: dict[str, T.DataType], valid: dict[str, int]) -> dict[str, int]:
    """The number of distinct non-null values of each column; valid: that of non-null ones. Map columns come as JSON.

    Numbers, dates and times go in long form by value, texts by digest, other types by value each."""
    whole = {c: key for c, kind in columns.items() if (key := _whole(c, kind)) is not None}
    doubles = [c for c, kind in columns.items() if isinstance(kind, T.FloatType | T.DoubleType)]
    texts = [c for c, kind in columns.items() if type(kind) in (T.StringType, T.BinaryType) and kind in (T.StringType(), T.BinaryType())]
    rest = [c for c in columns if c not in whole and c not in doubles and c not in texts]
    out = dict.fromkeys(columns, 0)
    fixed = [*whole, *doubles]
    if fixed:
        none = {"k": F.lit(None).cast("long"), "v": F.lit(None).cast("double")}
        value = lambda c: {"k": whole[c]} if c in whole else {"v": quoted(c).cast("double")}
        each = [F.struct(F.lit(i).alias("i"), *[x.alias(n) for n, x in (none | value(c)).items()]) for i, c in enumerate(fixed)]
        values = df.select(F.inline(F.array(*each))).where("k IS NOT NULL OR v IS NOT NULL").groupBy("i", "k", "v").agg(F.lit(1).alias("one"))
        for r in values.groupBy("i").count().collect():
            out[fixed[r["i"]]] = r["count"]
    if texts:
        out |= _texts(df, texts, valid)
    if rest:
        row = df.agg(*[F.count_distinct(F.to_json(quoted(c)) if isinstance(columns[c], T.MapType | T.VariantType) else quoted(c)).alias(str(i)) for i, c in enumerate(rest)]).first()
        out |= {c: row[i] for i, c in enumerate(rest)}
    return out


def _texts(df: DataFrame, names: list[str], valid: dict[str, int]) -> dict[str, int]:
    """A column's values that stand once are those left when the repeated digests' are taken away."""
    each = df.select(F.posexplode(F.array(*[quoted(c).cast("binary") for c in names])).alias("_i", "_v")).where("_v IS NOT NULL")
    repeated = each.select("_i", *_digest(F.col("_v"))).groupBy("_i", "_a", "_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").persist()
    sums = {r["_i"]: r for r in repeated.groupBy("_i").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("keys")).collect()}
    out = {c: valid[c] - (sums[i]["rows"] if i in sums else 0) for i, c in enumerate(names)}
    if sums:
        keys = repeated.drop("_n")
        small = sum(r["keys"] for r in sums.values()) <= MOST_KEYS
        mine = each.select("_i", "_v", *_digest(F.col("_v"))).join(F.broadcast(keys) if small else keys, ["_i", "_a", "_b"], "left_semi")
        for r in mine.groupBy("_i", "_v").agg(F.lit(1).alias("one")).groupBy("_i").count().collect():
            out[names[r["_i"]]] += r["count"]
    repeated.unpersist()
    return out


def without_repeats(df: DataFrame) -> DataFrame:
    """`df` with one of each group of equal rows. Rows whose digest stands once don't move; where more than MOST_KEYS digests
    repeat, or columns are of types without a digest (maps, variants, intervals), all rows are shuffled."""
    if any(kind in f.dataType.simpleString() for f in df.schema.fields for kind in ("map<", "variant", "interval")) or not df.columns:
        return df.dropDuplicates()
    names = [f"_{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    marked = rows.select("*", *_digest(*[F.col(n) for n in names]))
    repeated = marked.groupBy("_a", "_b").count().where("count > 1").drop("count").persist()
    if repeated.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        repeated.unpersist()
        return df.dropDuplicates()
    keys = F.broadcast(repeated)
    single, several = (marked.join(keys, ["_a", "_b"], how).select(names) for how in ("left_anti", "left_semi"))
    return single.unionByName(several.dropDuplicates()).toDF(*df.columns)
