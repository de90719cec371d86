"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a few statistics (`FEATURES`), transformed by logarithms and logits. Labelled rows give
counts, sums and products by class in one aggregate; the driver makes class means, covariances shrunk towards the
pooled covariance and its diagonal, and their Cholesky factors, once. A score is the logistic of the difference of
the two classes' log densities (Mahalanobis distance and log determinant from the cached factors) and log priors.

Defined cases: null and empty texts have statistics too (those of no words); labels that are null or not 0 or 1,
and labels of no document, are left out; repeated labels and rows count as often as they stand; if a class has no
labelled row, every score is the smoothed share of class 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, id_key, key_id, materialize, pick, plain, sub_batches, text_bytes

FEATURES = ("words", "word_length", "distinct", "top_word", "upper", "digit", "symbol", "exclaim", "other_mark", "line_length", "repeated_lines", "capitalised", "short_words", "long_words")
#: Shrinkage of class covariances: towards the pooled covariance, then towards the diagonal.
TO_POOLED, TO_DIAGONAL = 0.5, 0.1
_SYMBOLS = list(b"#*$%&|<>")
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "#*$%&|<>!.,"]


#: Labelled ids (8 bytes each) that are sent to every task, so that only their rows' statistics are learned from.
MOST_SENT = 1_000_000
#: Pseudo-counts that draw the ratios of short texts towards an ordinary rate.
PRIOR_WORDS, PRIOR_BYTES = 8.0, 40.0


def _logit(part: float, whole: float, rate: float, prior: float) -> float:
    return float(np.log((part + prior * rate) / (whole - part + prior * (1 - rate))))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper, lower = int(bytes_of[65:91].sum()), int(bytes_of[97:123].sum())
    space = int(bytes_of[[9, 10, 11, 12, 13, 32]].sum())
    return [
        np.log1p(n),
        np.log((size - space + 5 * PRIOR_WORDS) / (n + PRIOR_WORDS)),
        _logit(len(counts), n, 0.8, PRIOR_WORDS),
        _logit(max(counts.values(), default=0), n, 0.05, PRIOR_WORDS),
        _logit(upper, upper + lower, 0.03, PRIOR_BYTES),
        _logit(int(bytes_of[48:58].sum()), size, 0.005, PRIOR_BYTES),
        _logit(int(bytes_of[_SYMBOLS].sum()), size, 0.002, PRIOR_BYTES),
        _logit(int(bytes_of[33]), size, 0.002, PRIOR_BYTES),
        _logit(int(bytes_of[_MARKS].sum()), size, 0.005, PRIOR_BYTES),
        np.log((n + 20 * 0.5) / (len(lines) + 0.5)),
        _logit(len(lines) - len(set(lines)), len(lines), 0.02, 4.0),
        _logit(sum(c for w, c in counts.items() if 65 <= w[0] <= 90), n, 0.1, PRIOR_WORDS),
        _logit(sum(c for w, c in counts.items() if len(w) <= 3), n, 0.35, PRIOR_WORDS),
        _logit(sum(c for w, c in counts.items() if len(w) > 16), n, 0.02, PRIOR_WORDS),
    ]


def statistics_table(docs: DataFrame) -> DataFrame:
    """(k, crc, x) of each row: its id as a key, the crc32 of its id as text, its statistics."""
    rows = pick(docs, "doc_id", "text").select(id_key().alias("k"), id_crc().alias("crc"), text_bytes().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", 8 << 20):
            flat = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1)
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("crc"), x], names=["k", "crc", "x"])

    return rows.mapInArrow(run, "k long, crc long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and log priors; share: used if a class is missing."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offsets: np.ndarray | None
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        density = [off - 0.5 * np.square((x - m) @ f.T).sum(1) for m, f, off in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def fit(table: DataFrame, labels: DataFrame, use: Column, *, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """The discriminant of labels.quality from the rows of a statistics table where `use` holds."""
    d = len(FEATURES)
    known = pick(labels, "doc_id", "quality").where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("labelled"), "quality")
    rows = table.where(use).join(known, F.col("k") == F.col("labelled"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s"),
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("p"),
    )
    by = {r["quality"]: r for r in sums.collect()}  # two rows
    n = np.array([by[c]["n"] if c in by else 0 for c in (0, 1)], float)
    if not n.all():
        return Discriminant(None, None, None, float((n[1] + 1) / (n.sum() + 2)) if n.sum() else 0.5)
    means, scatter = [], []
    for c in (0, 1):
        mean = np.array(by[c]["s"]) / n[c]
        product = np.zeros((d, d))
        for (i, j), v in zip(pairs, by[c]["p"], strict=True):
            product[i, j] = product[j, i] = v
        means.append(mean)
        scatter.append(product - n[c] * np.outer(mean, mean))
    pooled = (scatter[0] + scatter[1]) / max(n.sum() - 2, 1)
    floor = 1e-3 * np.maximum(np.diag(pooled), 1e-3)
    factors, offsets = [], []
    for c in (0, 1):
        own = (1 - to_pooled) * scatter[c] / max(n[c] - 1, 1) + to_pooled * pooled
        own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diag(own)) + np.diag(floor)
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(offsets), 0.5)


def scored(table: DataFrame, model: Discriminant) -> DataFrame:
    """(k, crc, score) of a statistics table."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("crc"), pa.array(shared.value.score(x))], names=["k", "crc", "score"])

    return table.mapInArrow(run, "k long, crc long, score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from labels of rows that aren't held out."""
    table = materialize(statistics_table(docs), "quality")
    model = fit(table, labels, F.pmod("crc", F.lit(3)) != 1)
    out = scored(table, model)
    return out.select(key_id("k").alias("doc_id"), (F.pmod("crc", F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """(doc_id, text) of the rows that a model may learn from: not held out, and among the labelled if those are few enough
    to be sent to all tasks. More labels than that only leave more rows to compute statistics of; texts aren't shuffled."""
    rows = pick(docs, "doc_id", "text").where(F.pmod(id_crc(), F.lit(3)) != 1)
    known = pick(labels, "doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("labelled")).distinct()
    known = materialize(known, "labelled")
    if known.count() > most:
        return rows
    return rows.join(F.broadcast(known), id_key() == F.col("labelled"), "left_semi")


def keep_good(docs: DataFrame, labels: DataFrame, *, most: int = MOST_SENT) -> DataFrame:
    """The rows of `docs` that score 0.5 or more, the model learned as in `score`; same columns. Statistics are made once of
    the rows that the model learns from and once of all rows; texts aren't shuffled."""
    model = fit(statistics_table(labelled_rows(docs, labels, most)), labels, F.pmod("crc", F.lit(3)) != 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, of = plain(docs)
    column = of["text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, column, 8 << 20):
            x = np.array([statistics((t or "").encode()) for t in batch.column(column).to_pylist()])
            yield batch.filter(pa.array(shared.value.score(x) >= 0.5))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
