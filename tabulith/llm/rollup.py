"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A change says that a document's count was inserted, deleted or revised (old and new count). A batch of changes
becomes one signed delta for each (source, lang, tokenizer) that it touches, pre-aggregated before the shuffle, and
is committed by one atomic rename of a written folder to `batches/<batch_id>`: a batch is there wholly or not at all,
and a batch that is there already is left alone, so replays change nothing. Totals are the sums over all batches;
`compact` puts them into one snapshot, whose batch ids stay known; batch folders go with the compaction after that, so
who reads totals meanwhile still finds them. The folder must be on a file system that renames folders atomically
(HDFS, local and shared POSIX file systems; plain object stores don't).

Defined cases: null source, lang or tokenizer are groups of their own; null counts count as 0; a change with another
kind raises; groups whose counts all came to zero stay out of the totals; empty batches commit too; texts of any length are counted
whole, one row at a time.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, pick

KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Tokenizer versions: patterns whose matches are tokens.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        for part in ("batches", "staging", "snapshots"):
            self._files.mkdirs(self._path(f"{self.path}/{part}"))

    def _names(self, part: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.path}/{part}")))

    def _publish(self, rows: DataFrame, part: str, name: str) -> bool:
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        try:
            self._context.rename(self._path(staged), self._path(f"{self.path}/{part}/{name}"), self._options)
        except Exception as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            self._files.delete(self._path(staged), True)
            return False
        return True

    def _snapshot(self) -> tuple[str | None, set[str]]:
        names = [n for n in self._names("snapshots") if n.startswith("totals-")]
        if not names:
            return None, set()
        last = names[-1]
        ids = self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{last}/ids").collect()
        return f"{self.path}/snapshots/{last}/totals", {r["batch"] for r in ids}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch: rows (source, lang, tokenizer, kind, n_tokens, old_tokens). False if it was there already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.=-]*", batch_id):
            raise ValueError("a batch id is letters, digits, _ . = -")
        if batch_id in self._names("batches") or batch_id in self._snapshot()[1]:
            return False
        kind, new, old = F.col("kind"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))).cast("long")
        docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(wrong)
        tokens = F.when(kind == "insert", new).when(kind == "delete", -old).when(kind == "revise", new - old)
        delta = pick(changes, *KEYS, "kind", "n_tokens", "old_tokens").groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))
        return self._publish(delta, "batches", batch_id)

    def _deltas(self) -> tuple[DataFrame, set[str]]:
        base, known = self._snapshot()
        ids = {n for n in self._names("batches") if n not in known}
        read = self.spark.read.schema(_DELTA)
        paths = [*([base] if base else []), *(f"{self.path}/batches/{i}" for i in sorted(ids))]
        return (read.parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)), ids | known

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens."""
        sums = self._deltas()[0].groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """All batches so far as one snapshot; the folders of those that the snapshot before has go once it is there."""
        before = self._snapshot()[1]
        rows, ids = self._deltas()
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(i,) for i in sorted(ids)], "batch string").coalesce(1).write.parquet(f"{staged}/ids")
        number = len([n for n in self._names("snapshots") if n.startswith("totals-")])
        self._context.rename(self._path(staged), self._path(f"{self.path}/snapshots/totals-{number:09d}"), self._options)
        for i in before & set(self._names("batches")):
            self._files.delete(self._path(f"{self.path}/batches/{i}"), True)


def counted(docs: DataFrame) -> DataFrame:
    """Of every whole text: its source, lang, an estimate, its count by each version, and whether it is a copy (the
    same text stands at a smaller id; a null id counts as the greatest)."""
    rows = pick(docs, "doc_id", "source", "lang", "text").withColumn("text", F.coalesce("text", F.lit("")))
    counts = [F.regexp_count("text", F.lit(p)).cast("long").alias(v) for v, p in VERSIONS.items()]
    key = F.struct(F.col("doc_id").isNull().alias("no"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))
    table = materialize(rows.select(key.alias("id"), "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.expr("char_length(text) div 6").cast("long").alias("estimate"), *counts), "counts")
    # written first, so both sides of the join are shuffled for it and a text of very many copies can be split
    first = materialize(table.groupBy("sha").agg(F.min("id").alias("first")).withColumnRenamed("sha", "of"), "first")
    return table.join(first, F.col("sha") == F.col("of")).withColumn("copy", F.col("id") > F.col("first")).drop("of", "first", "id", "sha")


def _change(kind: str, tokenizer: str, new: Column, old: Column) -> list[Column]:
    return [F.col("source"), F.col("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(kind).alias("kind"), new.cast("long").alias("n_tokens"), old.cast("long").alias("old_tokens")]


def maintain(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The totals after a corpus's life in batches: estimates are inserted, revised to exact counts, a second
    tokenizer version joins, copies are deleted; two batches are replayed and must change nothing."""
    spark = docs.sparkSession
    rollup = Rollup(spark, path or new_folder(spark, "rollup"))
    table = materialize(counted(docs), "counted")
    none = F.lit(None)
    one, two = VERSIONS
    batches = {
        "0001-load": table.select(_change("insert", one, F.col("estimate"), none)),
        "0002-exact": table.select(_change("revise", one, F.col(f"`{one}`"), F.col("estimate"))),
        "0003-second": table.select(_change("insert", two, F.col(f"`{two}`"), none)),
        "0004-copies": table.where("copy").select(_change("delete", one, none, F.col(f"`{one}`"))).unionByName(table.where("copy").select(_change("delete", two, none, F.col(f"`{two}`")))),
    }
    for name, changes in [*batches.items(), ("0002-exact", batches["0002-exact"]), ("0004-copies", batches["0004-copies"])]:
        rollup.commit(name, changes)
    rollup.compact()
    return rollup.totals()


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
k AS (SELECT d.* FROM d JOIN f ON d.text = f.text AND d.doc_id = f.first)
SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS docs,
       sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS tokens FROM k GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words-2' AS tokenizer, count(*)::BIGINT AS docs,
       sum(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')))::BIGINT AS tokens FROM k GROUP BY source, lang
"""
