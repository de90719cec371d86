"""Spelling variant grouping by an even-partition pigeonhole join.

Two words are near if one inserted, deleted or replaced code point turns one into the other. A word of length L is cut
into two even segments; one edit leaves one of them whole. So each word is indexed under L and either of its segments,
and probes with the substrings, shifted by at most one place, where the segments of a word of its own length or of one
shorter may stand. Candidates that meet are verified by their edit distance, and pairs met twice count once.

Many words may share a segment. A bucket with more than `most` candidates isn't compared: the part of the words that is
still free is cut into two even segments again, one of which is whole too, until a bucket is small or one code point is
free. Then at most an alphabet of words of one length, and an alphabet's square of those one longer, can share it. So no
bucket grows with the vocabulary, and no pair is lost.

Words are counted in their partitions first; texts don't move. A word follows its forms by pointer doubling, which ends as
each form occurs at least RATIO times as often.

Defined cases: null and empty texts have no words; a null id counts as empty text; repeated documents count again; an
empty table gives no words; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, sub_batches, text_bytes

RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: Most candidates of a bucket that are compared.
MOST = 4096
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_KEY = ["len", "x", "y", "key"]


def word_counts(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspell: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the maximal runs of letters, A-Z lower-cased, of at least `least_length` code points and `least_count`
    occurrences. With `misspell` k, one code point is deleted from those runs where k divides the crc32 h of
    `<doc_id>:<run>`: that at h modulo the run's length; lengths and counts are of the results."""
    rows = pick(docs, doc_id, text).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), text_bytes(text).alias("text"))
    runs = re.compile(f"{RUN}{{{least_length},}}")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in sub_batches(batches, "text"):
            for name, body in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen = Counter(runs.findall(body.translate(_LOWER).decode("utf-8", "replace")))
                if misspell:
                    start = zlib.crc32(f"{name}:".encode())
                    for run in list(seen):
                        h = zlib.crc32(run.encode(), start)
                        if h % misspell == 0:
                            times, at = seen.pop(run), h % len(run)
                            if len(run) > least_length:
                                held[run[:at] + run[at + 1 :]] += times
                for run, times in seen.items():
                    held[run] += times
                if len(held) > HELD_WORDS:
                    yield give()
                    held.clear()
        if held:
            yield give()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _without(x: Column, y: Column) -> Column:
    """The word without its code points from x up to y (from 0)."""
    return F.concat(F.substring(F.col("word"), F.lit(1), x), F.substring(F.col("word"), y + 1, F.char_length("word")))


def _halves(rows: DataFrame) -> DataFrame:
    """Rows (word, n, longer, len, x, y), each once for either half of its free part x .. y; the other half goes into the
    key. A word that is one longer (longer = 1) has one code point more in its free part."""
    middle = F.col("x") + F.expr("(y - x) div 2")
    either = F.explode(F.array(F.struct(middle.alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), middle.alias("y"))))
    cut = rows.select("word", "n", "longer", "len", either.alias("free")).select("word", "n", "longer", "len", "free.x", "free.y")
    return cut.select("word", "n", "longer", *_KEY[:3], _without(F.col("x"), F.col("y") + F.col("longer")).alias("key"))


def _verified(rows: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): the near pairs among rows that share a key."""
    left = rows.where("longer = 0").select(*_KEY, F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rows.select(*_KEY, F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    once = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
    return left.join(right, _KEY).where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, *, most: int = MOST) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words of (word, n) once; words are distinct."""
    size = F.char_length("word")
    lengths = F.explode(F.array(F.struct(F.lit(0).alias("longer"), size.alias("len")), F.struct(F.lit(1).alias("longer"), (size - 1).alias("len"))))
    whole = words.where("word <> ''").select("word", "n", lengths.alias("as")).select("word", "n", "as.longer", "as.len", F.lit(0).alias("x"), F.col("as.len").alias("y"))
    level, found = _halves(whole), []
    while True:
        level = materialize(level, "segments")
        counts = level.groupBy(_KEY).agg(F.count_if(F.col("longer") == 0).alias("indexed"), F.count(F.lit(1)).alias("probes"))
        hot = materialize(counts.where((F.col("indexed") * F.col("probes") > most) & (F.col("y") - F.col("x") > 1)).select(_KEY), "hot")
        if hot.isEmpty():
            found.append(materialize(_verified(level), "near"))
            return reduce(DataFrame.unionByName, found).dropDuplicates(["a", "b"])
        found.append(materialize(_verified(level.join(hot, _KEY, "left_anti")), "near"))
        level = _halves(level.join(hot, _KEY, "left_semi"))


def variants(words: DataFrame, pairs: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n) and its near pairs. form: the near word that occurs most (of
    equals the first in code-point order) if it does at least `ratio` times as often; root: the last of the forms
    that follow from word to word."""
    if ratio < 2:
        raise ValueError("ratio is 2 at least: forms would not end")
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n"))
    near = pairs.select(F.inline(F.array(way("a", "b"), way("b", "a")))).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = near.select("word", "n_near", "best.near", (-F.col("best.less")).alias("near_n"))
    rows = words.join(near, "word", "left")
    often = F.col("near_n") >= ratio * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("near")).alias("form"), F.when(often, F.col("near_n")).alias("form_n")), "forms")
    steps = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("form_n")).first()[0] or 0
    deep = 0  # forms in a row: each has ratio times the count of the one before
    while most >= ratio**deep:
        deep += 1
    for _ in range(max(0, deep - 1).bit_length()):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialize(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def group(docs: DataFrame, *, misspell: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of docs with their variants."""
    words = materialize(word_counts(docs, misspell=misspell, doc_id=doc_id, text=text), "words")
    return variants(words, near_pairs(words))
