"""Benchmark decontamination by Wu-Manber search.

Texts and items are lower-cased (A-Z) and cut into words of digits, a-z and non-ASCII bytes. Every window of
`window` item words is a pattern (an item of fewer words is one pattern). Documents are searched as
space-separated word strings: a table over hashed blocks of `block` bytes tells how far each cursor may move;
where it may not move, the patterns whose first `m` bytes end in that block (found by a hash bucket) are compared
byte by byte. Many cursors, one for each stretch of text, move together in numpy. Patterns are searched in
classes of similar length, so one short item doesn't make all steps short.

Only the patterns are broadcast, in shards of about `shard_bytes` bytes, each one pass over the documents: the benchmark
may be of any size. With several shards the documents are written once with row numbers, each pass gives its hits, and
those are joined once at the end.

Defined cases: null and empty texts have no words and are never hit; items without words, and an empty benchmark,
match nothing; a null item_id counts as item "null"; repeated items count once; repeated documents keep their rows;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import expand, materialize, pick, plain, sub_batches, text_bytes, with_columns

WINDOW = 10
SHARD_BYTES = 16 << 20
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Word strings of patterns shorter than a bound are searched apart from longer ones.
_CLASSES = (4, 8, 16, 32, 64, 1 << 62)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Matcher:
    """Wu-Manber tables over patterns of similar length."""

    def __init__(self, patterns: list[bytes], bits: int = 18):
        self.m = min(map(len, patterns))
        self.block = min(8, max(1, self.m // 4))
        self.bits = np.uint64(64 - bits)
        self.flat = np.frombuffer(b"".join(patterns), np.uint8)
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        span = self.m - self.block + 1
        self.shift = np.full(1 << bits, span, np.int64)
        for j in range(span):
            code = self.codes(self.flat, self.starts + j)
            np.minimum.at(self.shift, code, span - 1 - j)
        last = self.codes(self.flat, self.starts + span - 1)
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << bits) + 1))

    def codes(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The table slot of the block that begins at each place."""
        value = np.zeros(len(at), np.uint64)
        for k in range(self.block):
            value = value << np.uint64(8) | text[at + k].astype(np.uint64)
        return (value * _MIX >> self.bits).astype(np.int64)

    def search(self, text: np.ndarray, stretch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Where each occurrence begins, and its pattern."""
        last = len(text) - self.m
        if last < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cursor = np.arange(0, last + 1, stretch, dtype=np.int64)
        limit = np.minimum(cursor + stretch, last + 1)
        found: list[np.ndarray] = []
        while len(cursor):
            step = self.shift[self.codes(text, cursor + self.m - self.block)]
            stop = step == 0
            if stop.any():
                found.append(cursor[stop])
            cursor = cursor + np.maximum(step, 1)
            alive = cursor < limit
            cursor, limit = cursor[alive], limit[alive]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        code = self.codes(text, at + self.m - self.block)
        many = self.bucket[code + 1] - self.bucket[code]
        pattern = self.order[expand(self.bucket[code], many)]
        at = np.repeat(at, many)
        ok = at + self.lengths[pattern] <= len(text)
        at, pattern = at[ok], pattern[ok]
        for j in range(0, int(self.lengths[pattern].max(initial=0))):
            if not len(at):
                break
            inside = j < self.lengths[pattern]
            same = ~inside
            same[inside] = text[at[inside] + j] == self.flat[self.starts[pattern[inside]] + j]
            if not same.all():
                at, pattern = at[same], pattern[same]
        return at, pattern


class Shard:
    """Patterns of a bounded part of the benchmark, and the items of each."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.matchers = []
        by_class: dict[int, list[tuple[bytes, list[str]]]] = {}
        for window, items in rows:
            pattern = b" " + window + b" "
            by_class.setdefault(next(c for c in _CLASSES if len(pattern) < c), []).append((pattern, items))
        for part in by_class.values():
            sizes = np.array([p.count(b" ") - 1 for p, _ in part], np.int64)
            self.matchers.append((Matcher([p for p, _ in part]), sizes, [i for _, i in part]))

    def hits(self, docs: list[list[bytes]]) -> tuple[np.ndarray, list[set[str]]]:
        """Which of all words are inside an occurrence, and the items found in each document."""
        joined = b"".join(b" " + b" ".join(w) + b" \n" if w else b" \n" for w in docs)
        text = np.frombuffer(joined, np.uint8)
        counts = np.array([len(w) for w in docs], np.int64)
        total = int(counts.sum())
        change = np.zeros(total + 1, np.int32)
        items: list[set[str]] = [set() for _ in docs]
        ends = np.cumsum(counts)
        where = np.flatnonzero(text == 0x20)  # the space before each word, and one more at each document's end
        rank_of_doc = np.arange(len(docs))
        for matcher, sizes, names in self.matchers:
            at, pattern = matcher.search(text)
            if not len(at):
                continue
            rank = np.searchsorted(where, at)
            doc = np.searchsorted(ends + rank_of_doc + 1, rank, "right")
            first = rank - doc
            np.add.at(change, first, 1)
            np.add.at(change, first + sizes[pattern], -1)
            for d, p in np.unique(np.stack([doc, pattern]), axis=1).T.tolist():
                items[d].update(names[p])
        return np.cumsum(change[:-1]) > 0, items


def windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Each distinct window of the items, with the ids (as text) of the items that have it."""
    rows = pick(benchmark, item, text).select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), text_bytes(text).alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            of, out = [], []
            for name, body in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(body)
                out += [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
                of += [name] * (len(out) - len(of))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(out, pa.binary())], names=["item", "window"])

    return rows.mapInArrow(cut, "item string, window binary").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _search(rows: DataFrame, shard: Broadcast, text: str, schema: T.StructType, only_hits: bool) -> DataFrame:
    """`rows` with n_words, hit_words and hit_items (with only_hits those that were hit), in the columns of `schema`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, text):
            split = [words((t or "").encode()) for t in batch.column(text).to_pylist()]
            hit, items = shard.value.hits(split)
            counts = np.array([len(w) for w in split], np.int64)
            ends = np.cumsum(counts)
            places = np.flatnonzero(hit)
            cuts = np.searchsorted(places, ends)
            each = np.diff(np.r_[0, cuts])
            out = with_columns(
                batch,
                n_words=pa.array(counts),
                hit_words=pa.ListArray.from_arrays(pa.array(np.r_[0, cuts], pa.int32()), pa.array((places - np.repeat(ends - counts, each)).astype(np.int32))),
                hit_items=pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ).select(schema.names)
            yield out.filter(pa.array(each > 0)) if only_hits else out

    return rows.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, text: str = "text") -> DataFrame:
    """`docs` with n_words, hit_words (sorted word numbers, from 0) and hit_items (sorted ids as text)."""
    patterns = materialize(windows(benchmark, window), "windows")
    size = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x))
    total = patterns.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    new = [T.StructField("n_words", T.LongType(), False), T.StructField("hit_words", T.ArrayType(T.IntegerType(), False)), T.StructField("hit_items", T.ArrayType(T.StringType(), False))]
    out = docs.drop("n_words", "hit_words", "hit_items")

    def shard(k: int) -> Broadcast:
        part = patterns.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == k) if shards > 1 else patterns
        return docs.sparkSession.sparkContext.broadcast(Shard([(bytes(r["window"]), r["items"]) for r in part.collect()]))

    if shards == 1:
        return _search(out, shard(0), text, T.StructType([*out.schema.fields, *new]), False)
    row = next(name for i in range(len(out.columns) + 1) if (name := f"row{i}") not in out.columns)
    numbered = materialize(out.withColumn(row, F.monotonically_increasing_id()), "numbered")
    schema = T.StructType([T.StructField(row, T.LongType()), *new])
    found = None
    for k in range(shards):  # the first pass has all rows, the others those that they hit
        now = shard(k)
        hits = materialize(_search(numbered.select(row, text), now, text, schema, k > 0), "hits")
        now.unpersist()
        found = hits if found is None else found.unionByName(hits)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = found.groupBy(row).agg(F.max("n_words").alias("n_words"), union("hit_words"), union("hit_items"))
    return numbered.join(found, row).drop(row)


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of scanned documents."""
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents that no window of the benchmark occurs in; same columns."""
    rows, of = plain(docs)
    return scan(rows, benchmark, text=of[text]).where(F.size("hit_words") == 0).select(rows.columns).toDF(*docs.columns)
