"""What the operators share: the shared folder, whole texts as bytes, bounded chunks of rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK_BYTES = 2 << 20
#: Bytes of a batch that the JVM hands to a Python worker, in a session that sets no bound of its own.
BATCH_BYTES, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
NO_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, a local one on a local master (tests), else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster[")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tabulith-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tabulith/{label}-{uuid.uuid4().hex}"
    # 10,000 rows of long texts are too much for a task
    spark.conf.set(BATCH_KEY, spark.conf.get(BATCH_KEY, str(BATCH_BYTES)))
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{new_folder(df.sparkSession, label)}/rows"
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup)
    conf.set(cleanup, "true")  # the rows are written, so the shuffles behind them leave the disks
    try:
        df.write.parquet(path)
    finally:
        conf.set(cleanup, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text") -> Column:
    """The column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sub_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def pieces(batch: pa.RecordBatch, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices: the JVM holds a batch that it gets as a whole, beside its heap."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def whole_groups(batches: Iterable[pa.RecordBatch], column: str, least: int) -> Iterator[pa.Table]:
    """From rows sorted by `column`: tables of `least` rows or more that never split a value of it."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held)
            keys = table.column(column).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """The batch with columns replaced or appended."""
    names = batch.schema.names
    columns = dict(zip(names, batch.columns, strict=True)) | new
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns named _0, _1, ... (no name can clash), and the new name of each old one (the first of equals)."""
    new = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(reversed([*zip(df.columns, new, strict=True)]))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, by exact name, whatever else the frame has."""
    renamed, of = plain(df)
    return renamed.select([F.col(of[n]).alias(n) for n in names])


def id_key(column: str = "doc_id") -> Column:
    """The id as a key that orders rows; a null id counts as the smallest, NO_ID (an id of that value counts as null)."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def key_id(column: str) -> Column:
    """Back from id_key."""
    return F.when(F.col(column) != NO_ID, F.col(column))
