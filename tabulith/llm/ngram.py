"""Language-model scoring from a log-frequency Bloom filter.

Tokens are words and one end for each text; n-grams of 1 to `order` tokens are counted over all training texts, and
each n-gram with count c is put into a Bloom filter at the levels 1 to 1 + floor(log_base c). The filter is cut into
segments by hash, about one for SEGMENT_TEXT bytes of text, each with `level_bits` bits for each level in it, so it
grows with the corpus and the rate of false positives stays the same. As it has no size bound it is not broadcast:

1. Texts are written in chunks of about TOGETHER bytes.
2. The distinct n-grams of a chunk, with their counts in its training texts, and its distinct tokens go to their
   segments. The task that has a segment adds the counts up, builds the segment's filter and answers all chunks that
   ask it, by probing: level after level until one is missing. Of tokens it sends exact counts too (base score).
3. The answers are written, return to their chunk, and each text's levels are written.
4. Sums by level over all training texts give the weights; then all texts are scored.

A probability is l c(h, w) / c(h) + (1 - l) P(w | shorter h) (Jelinek-Mercer), with the lower bound of the count's
level above the line and the upper bound below it. Single tokens take (c + 0.5) / (N + 0.5 (V + 1)) with the lower
bound for c, cut at N. So probabilities of all tokens add up to one at most while false positives are rare; a filter
filled beyond MOST_FILL (too few level_bits) is refused. The weight l belongs to the level of c(h): the share of
tokens after such contexts whose n-gram is met again elsewhere, by leave-one-out over all training texts, lowered by
the rate of false positives that the filter's fill implies, and the 32 bits that tell n-grams of a segment apart.

Memory: a task holds the n-grams of one segment or of one chunk (a text longer than TOGETHER is a chunk of its own).
No n-gram or token is hot: each chunk asks for it once.

Defined cases: null and empty texts have one token, the end; a null id counts as empty text for crc32; repeated rows
keep their rows and count again; without training texts N and V are 0; tokens of equal hash are counted apart in the
base score and together in the filter; an empty table gives none.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, materialize, pick, pieces, sub_batches, text_bytes, whole_groups

ORDER = 3
#: Bases of the count levels: of single tokens, and of longer n-grams.
BASES = (1.1, 1.5)
#: The filter's bits for each n-gram level, the probes of a level, and the fill beyond which a filter is refused.
LEVEL_BITS, PROBES, MOST_FILL = 24, 5, 0.6
#: Bytes of text for each segment, and the least and most segments (powers of two).
SEGMENT_TEXT, LEAST_SEGMENT_BITS, MOST_SEGMENT_BITS = 16 << 20, 11, 24
#: Bytes of text whose distinct n-grams are looked up together.
TOGETHER = 4 << 20
#: N-grams of segments that are counted at a time.
AT_A_TIME = 200_000
END = b""
_A, _B, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(1)
MOST_LEVELS = 401


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words and the end."""
    return [*text.lower().split(), END]


class Interned:
    """A worker's table of distinct tokens: a number and a hash for each; forgotten at `most` tokens or bytes."""

    def __init__(self, most: int = 120_000, most_bytes: int = 16 << 20):
        self.most, self.most_bytes = most, most_bytes
        self.number: dict[bytes, int] = defaultdict()
        self.clear()

    def clear(self) -> None:
        self.number.default_factory = None  # else the old table, which refers to itself, stays until a full collection
        self.number = defaultdict()
        self.number.default_factory = self.number.__len__
        self.names: list[bytes] = []
        self.hash, self.bytes = np.zeros(0, np.uint64), 0

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens, and how many each text has."""
        if len(self.number) > self.most or self.bytes > self.most_bytes:
            self.clear()
        get = self.number.__getitem__
        rows = [np.fromiter(map(get, tokens(t)), np.int64) for t in texts]
        if len(self.number) > len(self.names):
            new = list(self.number)[len(self.names) :]
            self.names += new
            self.bytes += sum(map(len, new))
            self.hash = np.r_[self.hash, np.array([xxhash.xxh64_intdigest(t, 7) for t in new], np.uint64)]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)


class Keys:
    """The layout of n-gram keys: the segment in the upper bits, 32 bits below it that tell n-grams of a segment apart,
    the least of them the mark of single tokens, then zeros."""

    def __init__(self, segment_bits: int):
        self.bits = segment_bits
        self.low = np.uint64(32 - segment_bits)
        self.mark = _ONE << self.low
        self.kept = ~((self.mark << _ONE) - _ONE)

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def single(self, h: np.ndarray) -> np.ndarray:
        return h & self.mark != 0

    def of_tokens(self, hashes: np.ndarray) -> np.ndarray:
        return mix(hashes + _A) & self.kept | self.mark

    def of_grams(self, hashes: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
        """For each order from 2: the key of the n-gram that ends at each token. Before a text's first token stands an end."""
        first = np.repeat(np.cumsum(counts) - counts, counts)
        end = np.uint64(xxhash.xxh64_intdigest(END, 7))
        place = np.arange(len(hashes))
        so_far, out = mix(hashes + _A), []
        for n in range(1, order):
            back = place - n
            before = np.where(back >= first, hashes[np.maximum(back, 0)], end)
            so_far = mix(so_far * _B + mix(before + np.uint64(n)))
            out.append(so_far & self.kept)
        return out

    def pack(self, h: np.ndarray, counts: np.ndarray) -> bytes:
        """Sorted keys of one segment and their counts, byte by byte: the upper ones compress."""
        planes = (h >> self.low).view(np.uint8).reshape(-1, 8)[:, 3::-1].T
        return planes.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()

    def unpack(self, data: bytes, segment: int) -> tuple[np.ndarray, np.ndarray]:
        planes = np.frombuffer(data, np.uint8).reshape(8, -1)
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, :4] = planes[3::-1].T
        counts = np.ascontiguousarray(planes[4:].T).view("<u4").reshape(-1)
        return (wide.view(np.uint64).reshape(-1) << self.low) | np.uint64(segment << (64 - self.bits)), counts.astype(np.int64)


def ordered(h: np.ndarray) -> np.ndarray:
    """The order of h: its upper bits and the places sorted as one number, which is faster, unless lower bits matter."""
    bits = np.uint64(max(1, len(h).bit_length()))
    packed = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    packed.sort()
    order = (packed & ((_ONE << bits) - _ONE)).astype(np.int64)
    return np.argsort(h, kind="stable") if (h[order][1:] < h[order][:-1]).any() else order


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with inverse."""
    order = ordered(h)
    h = h[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return h[new], back


def levels(single: np.ndarray, counts: np.ndarray, bases: tuple[float, float]) -> np.ndarray:
    """1 + floor(log_base c), exact at powers, 0 for no count; the base is that of single tokens or of longer n-grams."""
    base, counts_ = np.where(single, bases[0], bases[1]), np.maximum(counts, 1)
    q = 1 + np.floor(np.log(counts_) / np.log(base)).astype(np.int64)
    q += base**q <= counts_
    q -= base ** (q - 1) > counts_
    return np.where(counts > 0, q, 0)


def places(h: np.ndarray, level: int | np.ndarray, width: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For n-grams at a level: the word of their segment's `width` words, and the bits in it that are probed."""
    salt = np.uint64(level * int(_B) % (1 << 64)) if isinstance(level, int) else level.astype(np.uint64) * _B
    one = mix(h ^ salt)
    return ((one >> np.uint64(32)) * width.astype(np.uint64) >> np.uint64(32)).astype(np.int64), _masks(probes)[one & np.uint64(0xFFFF)]


@functools.cache
def _masks(probes: int) -> np.ndarray:
    """Words of `probes` bits, to be picked by hash."""
    bits = np.random.Generator(np.random.PCG64(probes)).integers(64, size=(1 << 16, probes), dtype=np.uint64)
    return np.bitwise_or.reduce(_ONE << bits, axis=1)


class Filter:
    """Some segments of the filter, of 64-bit words: a segment is chosen by the n-gram's key, one word in it and the bits
    in that word by key and level, so a level costs one look-up."""

    def __init__(self, segment: np.ndarray, h: np.ndarray, q: np.ndarray, level_bits: float, probes: int):
        """From the distinct n-grams, sorted by segment, and their levels."""
        begins = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(h) else np.zeros(0, np.int64)
        self.segments, self.probes = segment[begins], probes
        sums = np.add.reduceat(q, begins) if len(h) else np.zeros(0, np.int64)
        self.width = np.ceil(sums * (level_bits / 64)).astype(np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.words = np.zeros(self.width.sum(), np.uint64)
        slot = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(h)]))
        for low in range(0, len(h), 100_000):
            part = slice(low, low + 100_000)
            each = np.repeat(np.arange(len(q[part])), q[part])
            level = np.arange(len(each)) - np.repeat(np.cumsum(q[part]) - q[part], q[part]) + 1
            of = slot[part][each]
            word, mask = places(h[part][each], level, self.width[of], probes)
            np.bitwise_or.at(self.words, self.begin[of] + word, mask)

    def level(self, h: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The greatest level up to which all levels of each n-gram are found."""
        slot = np.searchsorted(self.segments, segment)
        out = np.zeros(len(h), np.int64)
        active = np.flatnonzero(self.width[slot] > 0)
        begin, width, h = self.begin[slot[active]], self.width[slot[active]], h[active]
        for q in range(1, MOST_LEVELS):
            word, mask = places(h, q, width, self.probes)
            hit = np.flatnonzero(self.words[begin + word] & mask == mask)
            if not len(hit):
                break
            active, begin, width, h = active[hit], begin[hit], width[hit], h[hit]
            out[active] = q
        return out


def contexts(below: list[np.ndarray], counts: np.ndarray, end: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 2 the levels of each token's context and n-gram, from the levels of the n-grams of each order."""
    begins = (np.cumsum(counts) - counts)[counts > 0]
    last, out = below[0], []
    for k, own in enumerate(below[1:]):
        above = np.r_[0, last[:-1]][: len(last)]
        above[begins] = 0 if k else end
        last = np.where((above > 0) & (last > 0), own, 0)  # an n-gram has both shorter ones in it
        out.append((above, last))
    return out


def log10(one: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, total: int, distinct: int, bases: tuple[float, float], false: float) -> np.ndarray:
    """log10 probability of each token from the levels."""
    powers = [base ** np.arange(MOST_LEVELS, dtype=float) for base in bases]  # above a level; below it is one step less
    below = [np.r_[0.0, x[:-1]] for x in powers]
    p = (np.minimum(below[0][one], total) + 0.5) / (total + 0.5 * (distinct + 1))
    for k, (own, (above, q)) in enumerate(zip(weights, parts, strict=True)):
        weight = (1 - false) * own[above]
        p = weight * np.minimum(below[1][q] / powers[min(k, 1)][above], 1.0) + (1 - weight) * p  # an n-gram isn't more frequent than its context
    return np.log10(p)


def chunks(rows: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(chunk, ids, train, sizes, data): the texts of about `together` bytes in a row, compressed, written once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in sub_batches(batches, "text", together):
            texts = batch.column("text").to_pylist()
            ends = pa.array([0, len(texts)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, c) for c in (batch.column("doc_id"), batch.column("train"), pa.array(list(map(len, texts)), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([tool.compress(b"".join(texts))], pa.binary())], names=["ids", "train", "sizes", "data"])

    schema = f"ids array<{rows.schema['doc_id'].dataType.simpleString()}>, train array<boolean>, sizes array<long>, data binary"
    return materialize(rows.select("doc_id", "train", "text").mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")


def unpacked(data: bytes, sizes: list[int]) -> list[bytes]:
    text, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(sizes).tolist()
    return [text[e - n : e] for n, e in zip(sizes, ends, strict=True)]


def distinct_tokens(table: Interned, numbers: np.ndarray, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens (their numbers) in the order of their keys, tokens of equal key by name; and the keys."""
    used = np.flatnonzero(np.bincount(numbers))
    h = keys.of_tokens(table.hash[used])
    order = ordered(h)
    used, h = used[order], h[order]
    if (h[1:] == h[:-1]).any():
        order = np.array(sorted(range(len(h)), key=lambda i: (int(h[i]), table.names[used[i]])))
        used, h = used[order], h[order]
    return used, h


def distinct_grams(table: Interned, numbers: np.ndarray, counts: np.ndarray, order: int, keys: Keys) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys of n-grams of all orders, sorted, and for each order where each token's n-gram stands in them."""
    used, own = distinct_tokens(table, numbers, keys)
    where = np.zeros(int(used.max()) + 1, np.int64)
    where[used] = np.arange(len(used))
    parts, backs = [own], [where[numbers]]
    for gram in keys.of_grams(table.hash[numbers], counts, order):
        h, back = distinct(gram)
        backs.append(back + sum(map(len, parts)))
        parts.append(h)
    h, place = distinct(np.concatenate(parts))
    return h, [place[b] for b in backs]


def counted(table: Interned, numbers: np.ndarray, counts: np.ndarray, learned: np.ndarray, order: int, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """The keys of distinct_grams, and how often each stands in learned tokens, told in the lowest bit while sorting."""
    every = [keys.of_tokens(table.hash[: int(numbers.max()) + 1])[numbers], *keys.of_grams(table.hash[numbers], counts, order)]
    h = np.concatenate([g | learned.astype(np.uint64) for g in every])
    h.sort()
    key = h >> _ONE << _ONE
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[begins], np.add.reduceat((h & _ONE).astype(np.int64), begins)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    cuts = [*np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist(), len(values)] if len(values) else [0]
    return list(zip(cuts, cuts[1:], strict=False))


def asked(texts: DataFrame, order: int, keys: Keys) -> DataFrame:
    """(seg, chunk, grams, words): for each chunk and segment the chunk's distinct n-grams and tokens there, with their
    counts in training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tool = Interned(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, data, sizes, train in zip(*(batch.column(c) for c in ("chunk", "data", "sizes", "train")), strict=True):
                numbers, counts = table.read(unpacked(data.as_py(), sizes.as_py()))
                learned = np.repeat(np.array(train.as_py(), bool), counts)
                h, n = counted(table, numbers, counts, learned, order, keys)
                used, own = distinct_tokens(table, numbers, keys)
                c = np.bincount(numbers[learned], minlength=int(used.max()) + 1)[used]
                names = [table.names[i] for i in used.tolist()]
                words = {}
                at = keys.segment(own)
                for a, b in _runs(at):
                    words[int(at[a])] = c[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + b"\n".join(names[a:b])
                seg = keys.segment(h)
                runs = _runs(seg)
                where = [int(seg[a]) for a, _ in runs]
                grams = [tool.compress(keys.pack(h[a:b], n[a:b])) for a, b in runs]
                named = [tool.compress(words[s]) if s in words else None for s in where]
                sizes_ = [int(keys.single(own[slice(*np.searchsorted(at, [s, s + 1]))]).sum()) for s in where]
                yield from pieces(pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([chunk.as_py()] * len(where), pa.int64()), pa.array(grams, pa.binary()), pa.array(named, pa.binary()), pa.array(sizes_, pa.int32())], names=["seg", "chunk", "grams", "words", "tokens"]), 2000)

    return texts.select("chunk", "sizes", "train", "data").mapInArrow(run, "seg int, chunk long, grams binary, words binary, tokens int")


def answered(questions: DataFrame, keys: Keys, bases: tuple[float, float], level_bits: float, probes: int) -> DataFrame:
    """(chunk, seg, levels, counts): the answers, in the order of the questions; counts are exact, of tokens. One more row
    for each group of segments, with a negative chunk, has the sums of bits set, of bits, of known tokens and of known n-grams."""

    def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        segs, chunk = table.column("seg").to_numpy(), table.column("chunk")
        parts = [keys.unpack(expand(g), s) for g, s in zip(table.column("grams").to_pylist(), segs.tolist(), strict=True)]
        sizes = np.array([len(h) for h, _ in parts])
        h, back = distinct(np.concatenate([h for h, _ in parts]))
        n = np.bincount(back, weights=np.concatenate([c for _, c in parts]), minlength=len(h)).astype(np.int64)
        seg = keys.segment(h)
        filter_ = Filter(seg, h, levels(keys.single(h), n, bases), level_bits, probes)
        found = filter_.level(h, seg).astype("<i2")[back].view(np.uint8).reshape(-1, 2)
        ends = np.cumsum(sizes)
        out = [squeeze(found[b - k : b].T.tobytes()) for k, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
        # the tokens, exactly
        each = table.column("tokens").to_numpy()
        blobs = [expand(w) if w is not None else b"" for w in table.column("words").to_pylist()]
        own = np.concatenate([np.ascontiguousarray(np.frombuffer(b, np.uint8, 4 * k).reshape(4, -1).T).view("<u4").reshape(-1) for b, k in zip(blobs, each.tolist(), strict=True)]).astype(np.int64)
        flat = np.frombuffer(b"\n".join(b[4 * k :] for b, k in zip(blobs, each.tolist(), strict=True) if k) + b"\n", np.uint8)
        stops = np.flatnonzero(flat == 10)
        total, known = np.zeros(len(own), np.int64), 0
        if len(own):
            offsets = np.r_[0, stops + 1].astype(np.int64)
            names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            index = names.dictionary_encode().indices.to_numpy()  # with the line end, which all have
            sums = np.bincount(index, weights=own).astype(np.int64)
            total, known = sums[index], int((sums > 0).sum())
        tops = np.cumsum(each)
        exact = [squeeze(np.ascontiguousarray(total[b - k : b].view(np.uint8).reshape(-1, 8).T).tobytes()) for k, b in zip(each.tolist(), tops.tolist(), strict=True)]
        none = pa.nulls(len(segs), pa.int64())
        yield from pieces(pa.RecordBatch.from_arrays([chunk.combine_chunks(), pa.array(segs), pa.array(out, pa.binary()), pa.array(exact, pa.binary()), none, none, none, none], names=_ANSWER), 2000)
        sums = [int(np.bitwise_count(filter_.words).sum()), 64 * len(filter_.words), known, int((n > 0).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([-1 - int(segs[0])], pa.int64()), pa.array(segs[:1]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *(pa.array([x], pa.int64()) for x in sums)], names=_ANSWER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "seg", 1):
            size = np.cumsum(pa.compute.binary_length(table.column("grams")).to_numpy())
            begin = 0
            for a, b in _runs(table.column("seg").to_numpy()):
                if size[b - 1] - (size[begin - 1] if begin else 0) >= 6 * AT_A_TIME or b == table.num_rows:
                    yield from group(table.slice(begin, b - begin))
                    begin = b

    return questions.repartition("seg").sortWithinPartitions("seg", "chunk").mapInArrow(run, "chunk long, seg int, levels binary, counts binary, ones long, bits long, known long, grams long")


_ANSWER = ["chunk", "seg", "levels", "counts", "ones", "bits", "known", "grams"]


def _levelled(texts: DataFrame, answers: DataFrame, order: int, keys: Keys) -> DataFrame:
    """Each text's row with the levels (int16) of its n-grams, order after order, the known tokens and the sum of
    log10(c + 0.5) of its tokens; and the rows of sums, that have no n_tokens."""
    kind = texts.schema["ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, levels binary, ones long, bits long, known long, grams long"
    no = lambda frame, *names: [F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in names]
    rows = texts.select("chunk", F.lit(-1).alias("seg"), "data", "ids", "train", "sizes", *no(answers, "levels", "counts", "ones", "bits", "known", "grams"))
    rows = rows.unionByName(answers.select("chunk", "seg", *no(texts, "data", "ids", "train", "sizes"), "levels", "counts", "ones", "bits", "known", "grams"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squeeze, expand = Interned(), zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

        def finish(texts: list[bytes], ids: pa.Array, train: pa.Array, found: list[bytes], exact: list[bytes]) -> pa.RecordBatch:
            numbers, counts = table.read(texts)
            h, backs = distinct_grams(table, numbers, counts, order, keys)
            level = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(2, -1).T).view("<i2").reshape(-1) for x in map(expand, found)])
            used, _ = distinct_tokens(table, numbers, keys)
            c = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1) for x in map(expand, exact)])
            if len(h) != len(level) or len(used) != len(c):
                raise RuntimeError("a chunk's n-grams and their answers don't fit")
            begin = np.cumsum(counts) - counts
            by_text = np.empty(order * len(numbers), np.int16)  # a text's orders one after another
            place = np.arange(len(numbers)) + np.repeat(begin * (order - 1), counts)
            for k, back in enumerate(backs):
                by_text[place + np.repeat(k * counts, counts)] = level[back]
            of = np.zeros(int(used.max()) + 1, np.int64)
            of[used] = c
            logs = np.add.reduceat(np.log10(of + 0.5)[numbers], begin)
            known = np.add.reduceat((of > 0).astype(np.int64)[numbers], begin)
            data, ends = by_text.tobytes(), np.cumsum(2 * order * counts).tolist()
            packed = pa.array([squeeze(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.binary())
            none = pa.nulls(len(texts), pa.int64())
            return pa.RecordBatch.from_arrays([ids, pa.compute.invert(train), pa.array(counts), pa.array(known), pa.array(logs), packed, none, none, none, none], names=_LEVELLED)

        held: tuple | None = None
        found: list[bytes] = []
        exact: list[bytes] = []
        for batch in batches:
            chunk, seg = batch.column("chunk").to_numpy(), batch.column("seg").to_numpy()
            sums = batch.filter(pa.array(chunk < 0))
            if sums.num_rows:
                nulls = [pa.nulls(sums.num_rows, t) for t in (batch.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*nulls, *(sums.column(c) for c in ("ones", "bits", "known", "grams"))], names=_LEVELLED)
            for i in np.flatnonzero(chunk >= 0).tolist():
                if seg[i] >= 0:
                    found.append(batch.column("levels")[i].as_py())
                    exact.append(batch.column("counts")[i].as_py())
                    continue
                if held:
                    yield from pieces(finish(*held, found, exact), 2000)
                held = (unpacked(batch.column("data")[i].as_py(), batch.column("sizes")[i].as_py()), batch.column("ids")[i].values, batch.column("train")[i].values)
                found, exact = [], []
        if held:
            yield from pieces(finish(*held, found, exact), 2000)

    return rows.repartition("chunk").sortWithinPartitions("chunk", "seg").mapInArrow(run, schema)


_LEVELLED = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "levels", "ones", "bits", "known", "grams"]


def _below(batch: pa.RecordBatch, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels of each order for all tokens of a batch of _levelled, and the numbers of tokens."""
    counts = batch.column("n_tokens").to_numpy()
    found = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, batch.column("levels").to_pylist())), np.int16).astype(np.int64)
    begin = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) + np.repeat(begin * (order - 1), counts)
    return [found[place + np.repeat(k * counts, counts)] for k in range(order)], counts


def all_weights(found: DataFrame, order: int) -> np.ndarray:
    """The weights by order and context level: shares of n-grams of all training texts that are met again elsewhere, with
    one pseudo-count against; the driver gets the sums by level."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, every = np.zeros((order - 1, MOST_LEVELS), np.int64), np.zeros((order - 1, MOST_LEVELS), np.int64)
        for batch in sub_batches(batches, "levels", 1 << 18):
            below, counts = _below(batch, order)
            for k, (above, q) in enumerate(contexts(below, counts, below[0][-1])):
                every[k] += np.bincount(above, minlength=MOST_LEVELS)
                again[k] += np.bincount(above[q > 1], minlength=MOST_LEVELS)
        k, level = np.nonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, level, again[k, level], every[k, level])], names=["k", "level", "again", "every"])

    weights = np.zeros((order - 1, MOST_LEVELS))
    for r in found.where("NOT held_out").select("n_tokens", "levels").mapInArrow(run, "k long, level long, again long, every long").groupBy("k", "level").agg(F.sum("again").alias("again"), F.sum("every").alias("every")).collect():
        weights[r["k"], r["level"]] = r["again"] / (r["every"] + 1)
    weights[:, 0] = 0
    return weights


def segment_bits(text_bytes: int) -> int:
    """The number of segments, as a power of two, for so many bytes of text."""
    return min(MOST_SEGMENT_BITS, max(LEAST_SEGMENT_BITS, (text_bytes // SEGMENT_TEXT).bit_length()))


def score(docs: DataFrame, train: Column | None = None, *, order: int = ORDER, bases: tuple[float, float] = BASES, level_bits: float = LEVEL_BITS, probes: int = PROBES, together: int = TOGETHER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, learning from the rows
    where `train` (over doc_id; by default crc32 of the id modulo 5 not 1) holds."""
    if order < 1 or not 1 <= probes <= 5:
        raise ValueError("order is 1 or more, probes are 1 to 5")
    train = F.pmod(id_crc(), F.lit(5)) != 1 if train is None else train
    texts = chunks(pick(docs, "doc_id", "text").select("doc_id", train.alias("train"), text_bytes().alias("text")), together)
    keys = Keys(segment_bits(texts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0))
    answers = materialize(answered(asked(texts, order, keys), keys, bases, level_bits, probes), "answers")
    found = materialize(_levelled(texts, answers, order, keys), "levels")
    sums = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ones", "bits", "known", "grams")], F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)).alias("total")).first()
    fill = sums["ones"] / (sums["bits"] or 1)
    if fill > MOST_FILL:
        raise ValueError(f"{level_bits} bits a level fill the filter to {fill:.2f}; the most is {MOST_FILL}")
    total, distinct_ = sums["total"], sums["known"]
    false = fill**probes + sums["grams"] / 2 ** (keys.bits + 32)
    rows = found.where("n_tokens IS NOT NULL")
    weights = all_weights(rows, order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "levels", 1 << 18):
            below, counts = _below(batch, order)
            p = log10(below[0], contexts(below, counts, below[0][-1]), weights, total, distinct_, bases, false)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.add.reduceat(p, np.cumsum(counts) - counts))], names=[*batch.schema.names[:-1], "score"])

    kind = found.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", "held_out", "n_tokens", "n_known", "logs", "levels").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double")
    unit = F.log10(F.lit(total + 0.5 * (distinct_ + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * unit).alias("base_score"), "score")
