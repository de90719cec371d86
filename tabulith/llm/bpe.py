"""BPE encoding and decoding by batched numpy merge rounds.

`encode` adds the array column `ids` to whole texts, `decode` adds `decoded`, the text of `ids`. All distinct
words of a chunk lie in one flat symbol array; each round finds the rank of every adjacent pair by binary search
over the sorted pair keys, takes the lowest rank of each word and merges its occurrences, until no word has a
known pair. A worker keeps the ids of words it has met, up to `CACHED_WORDS` words or `CACHED_BYTES` bytes, then starts
anew: beside that it holds the words of one chunk, and results don't depend on the cache. A file with a normalizer, or
another pre-tokenizer than byte-level words without a prefix space, is refused.

Defined cases: null text counts as empty (no ids, empty text); null ids decode to the empty text; unknown ids
decode to nothing; repeated rows stay repeated; other columns pass through; the strings of added tokens are
tokens wherever they stand; bytes that aren't UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import expand, pick, sub_batches, with_columns

#: Fixed value: the word pattern of the tokenizer file's ByteLevel pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS, CACHED_BYTES = 200_000, 16 << 20
MOST_FILE_BYTES = 64 << 20
_NO_RANK = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Tables:
    """What encoding and decoding look up; built on the driver from the tokenizer's file, then broadcast."""

    def __init__(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only tokenizers of byte-level words, without normalizer and prefix space, are read")
        if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models are read")
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = b"".join(back.get(c, c.encode()) for c in token)
        for token, i in self.added.items():
            self.pieces[i] = token.encode()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_words = [], []
        while len(out):
            pair = np.full(len(out), _NO_RANK)
            if len(out) > 1:
                key = out[:-1] << 32 | out[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = (self.keys[at] == key) & (word[:-1] == word[1:])
                pair[:-1][known] = self.ranks[at[known]]
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[begins, len(out)])
            low = np.minimum.reduceat(pair, begins)
            low_of = np.repeat(low, sizes)
            ended = low_of == _NO_RANK
            done_ids.append(out[ended])
            done_words.append(word[ended])
            out, word, pair, low_of = (x[~ended] for x in (out, word, pair, low_of))
            if not len(out):
                break
            hit = pair == low_of
            # in a run such as a a a, every other pair from the left
            starts = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            run = np.cumsum(hit & ~np.r_[False, hit[:-1]]) - 1
            hit &= (np.arange(len(out)) - starts[np.maximum(run, 0)]) % 2 == 0
            out[hit] = self.merged[low_of[hit]]
            stay = ~np.r_[False, hit[:-1]]
            out, word = out[stay], word[stay]
        ids, of = np.concatenate([*done_ids, out]), np.concatenate([*done_words, word])
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.int32), np.bincount(of, minlength=len(words)).astype(np.int64)


class Encoder:
    """A worker's encoder: texts to flat ids and counts."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.find = regex.compile(WORDS).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(tables.added, key=len, reverse=True))) + ")").split if tables.added else None
        self.index: dict[str, int] = defaultdict()
        self.clear()

    def clear(self) -> None:
        self.index.default_factory = None  # else the old table, which refers to itself, stays until a full collection
        self.index = defaultdict()
        self.index.default_factory = self.index.__len__
        self.bytes = 0
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for token, i in self.tables.added.items():
            self.index["\0added" + token]
            self._append(np.array([i], np.int32), np.ones(1, np.int64))

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.flat, self.lengths = np.concatenate([self.flat, ids]), np.concatenate([self.lengths, lengths])

    def words(self, text: str) -> list[str]:
        if self.split is None or not any(t in text for t in self.tables.added):
            return self.find(text)
        out: list[str] = []
        for k, part in enumerate(self.split(text)):
            out += ["\0added" + part] if k % 2 else self.find(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHED_WORDS or self.bytes > CACHED_BYTES:
            self.clear()
        known, get = len(self.lengths), self.index.__getitem__
        rows = [np.fromiter(map(get, self.words(t)), np.int64) for t in texts]
        if len(self.index) > known:
            new = [w.encode() for w in list(self.index)[known:]]
            self.bytes += sum(map(len, new))
            self._append(*self.tables.merge(new))
        all_words = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        lengths = self.lengths[all_words]
        flat = self.flat[expand(self.starts[all_words], lengths)]
        ends = np.r_[0, np.cumsum(lengths)]
        return flat, np.diff(ends[np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)])


def load_tables(spark: SparkSession, path: str) -> Broadcast:
    """Broadcast tables of a byte-level BPE file on the driver; the file's size is checked."""
    with open(path, "rb") as file:
        raw = file.read(MOST_FILE_BYTES + 1)
    if len(raw) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(Tables(json.loads(raw)))


def _mapper(tables: Broadcast, column: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in sub_batches(batches, column):
            flat, counts = encoder.encode([t or "" for t in batch.column(column).to_pylist()])
            offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
            yield with_columns(batch, ids=pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())))

    return run


def encode(docs: DataFrame, tables: Broadcast, text: str = "text") -> DataFrame:
    """`docs` with the array column `ids` (replacing any of that name)."""
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return docs.mapInArrow(_mapper(tables, text), schema)


def decode(docs: DataFrame, tables: Broadcast, ids: str = "ids") -> DataFrame:
    """`docs` with the string column `decoded` (replacing any of that name)."""
    docs = docs.drop("decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [*tables.value.pieces, b""]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = part.column(ids)
                flat = pa.compute.fill_null(rows.flatten(), -1).to_numpy()
                flat = np.where((flat < 0) | (flat >= len(pieces)), len(pieces) - 1, flat).tolist()
                ends = np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(rows), 0).to_numpy())].tolist()
                texts = [b"".join([pieces[i] for i in flat[a:b]]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
                yield with_columns(part, decoded=pa.array(texts, pa.string()))

    return docs.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows with `ids` and `decoded`."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """The digests of every text encoded with the file at `path` and decoded again."""
    tables = load_tables(docs.sparkSession, path)
    return digests(decode(encode(pick(docs, "doc_id", "text"), tables).drop("text"), tables))
