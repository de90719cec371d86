"""SimHash near-dedup by tiled exact comparison.

A fingerprint has a bit for each that is set in over half the XXH64 hashes of a text's word shingles. Equal
fingerprints are first made one. Two fingerprints within `radius` bits agree wholly on at least `blocks - radius`
of `blocks` bit blocks, so each is put into one bucket for every choice of so many blocks: no link is lost. `blocks`
follows from the number of fingerprints (`blocks_for`), so that buckets hold MOST_EXPECTED of evenly spread ones at most.
A bucket of more than HOT fingerprints is cut into buckets of its own in the same way, by blocks of the bits that its
fingerprints don't share, and again if need be (`DEPTH` times). In a bucket, rows are sorted by population count and compared tile by tile with exclusive-or and bit counts; tile pairs whose
population counts differ by more than the radius are skipped, and so are those whose rows are all linked already,
so a bucket of near copies takes about one comparison of each tile. A bucket gives links to the least member of
each of its components, never all pairs; `components` joins them up.

Links are between ids, the least of each fingerprint, so the least id of a component is its root.

`dedup` finds texts whose shingles are similar to `near` or more. At 0.8, 64 bits are too few for that: such fingerprints
differ in about 10 bits, as do chance pairs of a large table. So it takes several fingerprints, by as many mixes of the
same hashes, as one of 64 bits times their number, and links rows within the distance that `near` implies (two standard
deviations above its mean: nearly all such pairs, and chance pairs are 20 standard deviations away). Rows that agree in
all bits of some band are compared, tile by tile as above; bands are as many as find a share FOUND of pairs that are
just similar enough, and as wide as keeps their buckets small. A bucket of more than HOT rows is cut into blocks, each
pair of which is a bucket of its own. So found, pairs are candidates; a text goes only if exact sets of shingle hashes
bear its similarity to a text that stays (`compared`, `settled`). First each member of a candidate component is compared
with its least id, which stays; those that aren't similar enough are linked anew without the rest, as long as that
halves them and some component is large. What then remains of a component is compared by blocks in a join, and stays if
no text before it (in an order of hashed ids, so chains end after a few rounds) is similar and stays itself. So each removed
text has a kept partner, no two kept texts of a component are similar, and no chain removes a text that is like none
that stays. Only texts of such components are read again; removed ids, not texts, are what is joined to the documents.

Memory: a bucket is held in one task at 16 bytes a distinct fingerprint: HOT of them, or those that agree in all but
the few bits that the last cut leaves (2^20 with 6 blocks). Verification holds two texts' sets at a time.

Defined cases: null and empty texts have fingerprint zero, linked like any other; fewer words than a shingle make
one shingle; a null id counts as the smallest; repeated rows keep their rows; texts
that share an id are linked; an empty table gives none. For `dedup`, rows that share an id or have none are documents of
their own (numbered in the order of ids first), of which those with similar texts go; null and empty texts are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, key_id, materialize, pick, plain, sub_batches, text_bytes, whole_groups
from .components import components

SHINGLE, SEED, RADIUS, TILE = 4, 42, 4, 512
#: Fingerprints that a bucket may hold if they are evenly spread; beyond which a bucket is cut; how often.
MOST_EXPECTED, HOT, DEPTH = 64, 20_000, 3
#: Of dedup: words of a shingle, least similarity, share of pairs just as similar to be found, and rows of a band's bucket.
WORDS, NEAR, FOUND, BUCKET = 5, 0.8, 0.95, 1024
#: Texts of a component that are compared as a block.
BLOCK = 1024
#: The bits of a byte, each as a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return [digest(view[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)]


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    return _voted(*_every_hash(texts, size))


def _every_hash(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts, and how many each has."""
    lists = [hashes(t, size) for t in texts]
    return np.array([h for x in lists for h in x], np.uint64), np.array([len(x) for x in lists], np.int64)


def signatures(texts: list[bytes], size: int, lanes: int) -> np.ndarray:
    """Several fingerprints of each text: of its hashes, and of other mixes of them."""
    return _signatures(*_every_hash(texts, size), lanes)


def _signatures(every: np.ndarray, counts: np.ndarray, lanes: int) -> np.ndarray:
    out = np.zeros((len(counts), lanes), np.uint64)
    for lane in range(lanes):
        mixed = every if not lane else (every ^ every >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15 * (2 * lane + 1) % (1 << 64) | 1)
        mixed = mixed if not lane else (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, lane] = _voted(mixed ^ mixed >> np.uint64(32) if lane else mixed, counts)
    return out


def _sets(every: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each text, in order."""
    return [np.unique(x) for x in np.split(every, np.cumsum(counts)[:-1])] if len(counts) else []


def _voted(every: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each text's hashes."""
    out = np.zeros(len(counts), np.uint64)
    if not counts.sum():
        return out
    every = np.ascontiguousarray(every).view(np.uint8).reshape(-1, 8)
    # up to 255 hashes are summed in bytes, then those sums by text
    full = np.flatnonzero(counts)
    pieces = -(-counts[full] // 255)
    of = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begins = (np.cumsum(counts) - counts)[full][of] + 255 * nth
    sums = np.stack([np.add.reduceat(_SPREAD[every[:, k]], begins) for k in range(8)], axis=1).view(np.uint8)
    votes = np.add.reduceat(sums.astype(np.int64), np.flatnonzero(nth == 0), axis=0)
    out[full] = np.packbits(2 * votes > counts[full, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprint_table(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(k, fp) of each row: k is the id as a key."""
    rows = pick(docs, "doc_id", "text").select(id_key().alias("k"), text_bytes().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            fp = fingerprints(batch.column("text").to_pylist(), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(fp)], names=["k", "fp"])

    return rows.mapInArrow(run, "k long, fp long")


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least row of its part) after linking rows a and b."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not (labels[labels] == labels).all():
            labels = labels[labels]
    return labels


def bucket_labels(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """For rows sorted by (key, population count): the least row linked to each within its key. fp: of one or more words."""
    fp = fp.reshape(len(fp), -1)
    far = lambda x: np.bitwise_count(x).sum(-1, dtype=np.int64)
    count = far(fp)
    labels = np.arange(len(fp))
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[begins, len(fp)])
    ends = np.repeat(begins + sizes, sizes)
    small = np.repeat(sizes <= 64, sizes)
    left, step = np.flatnonzero(small), 1
    found_a, found_b = [], []
    while len(left):  # small buckets: each row with the next, the next but one, ...
        left = left[left + step < ends[left]]
        left = left[count[left + step] - count[left] <= radius]
        near = far(fp[left] ^ fp[left + step]) <= radius
        found_a.append(left[near])
        found_b.append(left[near] + step)
        step += 1
    if found_a:
        labels = _join(labels, np.concatenate(found_a), np.concatenate(found_b))
    for begin, size in zip(begins[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        tiles = [(a, min(a + tile, begin + size)) for a in range(begin, begin + size, tile)]
        for (a, b), (c, d) in _tile_pairs(tiles):
            if count[c] - count[b - 1] > radius:
                continue
            if labels[a] == labels[c] and (labels[a:b] == labels[a]).all() and (labels[c:d] == labels[a]).all():
                continue
            distance = np.zeros((b - a, d - c), np.uint16)
            for word in range(fp.shape[1]):
                distance += np.bitwise_count(fp[a:b, None, word] ^ fp[None, c:d, word])
            x, y = np.nonzero(distance <= radius)
            part = labels[begin : begin + size] - begin
            labels[begin : begin + size] = _join(part, x + a - begin, y + c - begin) + begin
    return labels


def _tile_pairs(tiles: list[tuple[int, int]]) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    for t in tiles:
        yield t, t
    for i, t in enumerate(tiles):
        for u in tiles[i + 1 :]:
            yield t, u


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks for n fingerprints: the fewest (at least one and a half times the radius) that keep buckets small, 8 more at most."""
    least = max(radius + 1, radius * 3 // 2)
    return next((b for b in range(least, min(64, least + 8)) if n >> 64 * (b - radius) // b <= MOST_EXPECTED), min(64, least + 8))


def _masks(agreed: int, radius: int, blocks: int) -> list[int]:
    """The masks that fingerprints within the radius, that agree in the bits of `agreed`, may agree in further: one of them."""
    free = [1 << i for i in range(64) if not agreed >> i & 1]
    blocks = min(blocks, max(len(free), 1))
    if len(free) <= radius:
        return [agreed]
    parts = [sum(free[len(free) * i // blocks : len(free) * (i + 1) // blocks]) for i in range(blocks)]
    return [agreed | sum(c) for c in combinations(parts, max(blocks - radius, 0))]


def _bucketed(rows: DataFrame, radius: int, blocks: int, hot: int, depth: int) -> DataFrame:
    """(fp, least, key): each fingerprint in all its buckets."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    level, ready = [0], None
    rows = rows.select("fp", "least", F.lit(0).alias("mask"), F.lit(0).cast("long").alias("key"))
    for k in range(depth):
        level = [_masks(m, radius, blocks) for m in level]
        width = len(level[0])
        choices = F.array(*[F.array(*[F.lit(signed(m)) for m in of]) for of in level])
        key = lambda m, i: F.struct((F.col("mask") * width + i).alias("mask"), F.xxhash64("key", i, F.col("fp").bitwiseAND(m)).alias("key"))
        rows = rows.select("fp", "least", F.explode(F.transform(F.get(choices, F.col("mask")), key)).alias("x")).select("fp", "least", "x.mask", "x.key")
        level = [m for of in level for m in of]
        if k + 1 == depth or len(level) * width > 50_000:
            break
        crowded = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("key").alias("crowd")), "crowded")
        if crowded.isEmpty():
            break
        cold = rows.join(crowded, F.col("key") == F.col("crowd"), "left_anti").select("fp", "least", "key")
        ready = cold if ready is None else ready.unionByName(cold)
        rows = rows.join(crowded, F.col("key") == F.col("crowd"), "left_semi")
    rows = rows.select("fp", "least", "key")
    return rows if ready is None else ready.unionByName(rows)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, *, hot: int = HOT, depth: int = DEPTH) -> DataFrame:
    """From distinct fingerprints `fp` with distinct ids `least`: links (a, b) of ids that connect what any links within
    `radius` bits connect."""
    blocks = blocks_for(fps.count(), radius) if blocks is None else blocks
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below blocks, blocks at most 64")
    rows = _bucketed(fps, radius, blocks, hot, depth).repartition("key").sortWithinPartitions("key", F.bit_count("fp"), "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "key", 100_000):
            fp, least = group.column("fp").to_numpy().view(np.uint64), group.column("least").to_numpy()
            labels = bucket_labels(group.column("key").to_numpy(), fp, radius)
            moved = np.flatnonzero(labels != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(least[moved]), pa.array(least[labels[moved]])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, *, size: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = materialize(fingerprint_table(docs, size), "simhash")
    # a fingerprint stands for its least id; should rows that repeat an id differ, that id joins their fingerprints
    distinct = materialize(rows.groupBy("fp").agg(F.min("k").alias("least")), "fingerprints")
    roots = components(links(distinct, radius, blocks))
    of = distinct.join(roots, F.col("least") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "least").alias("component"))
    # written first, so both sides of the join are shuffled for it and a fingerprint of very many rows can be split
    of = materialize(of, "classes")
    joined = rows.join(of, F.col("fp") == F.col("f"))
    return joined.select(key_id("k").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), key_id("component").alias("component_id"))


def bands_for(n: int, near: float = NEAR) -> tuple[int, int, int, int]:
    """For n texts: the bits of a band, how many a word has, the words, and the greatest distance of similar texts."""
    bits = min(32, max(12, (n // BUCKET).bit_length()))
    differ = math.acos(2 * near / (1 + near)) / math.pi  # share of bits in which texts differ whose shingles are just similar enough
    bands = math.ceil(math.log(1 - FOUND) / math.log1p(-((1 - differ) ** bits)))
    words = -(-bands // (64 // bits))
    return bits, 64 // bits, words, int(64 * words * differ + 2 * math.sqrt(64 * words * differ * (1 - differ)))


def near_links(distinct: DataFrame, words: int, bits: int, each: int, radius: int, *, hot: int = HOT) -> DataFrame:
    """From distinct signatures (s0, s1, ...) with distinct ids `least`: links (a, b) of ids."""
    names = [f"s{i}" for i in range(words)]
    bands = [F.xxhash64(F.lit(each * w + j), F.shiftrightunsigned(names[w], bits * j).bitwiseAND(F.lit((1 << bits) - 1))) for w in range(words) for j in range(each)]
    rows = distinct.select(*names, "least", F.explode(F.array(*bands)).alias("key"))
    crowded = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("key").alias("crowd"), F.ceil(F.col("n") / hot).cast("int").alias("parts")), "crowded")
    if not crowded.isEmpty():
        cut = rows.join(crowded, F.col("key") == F.col("crowd"))
        own = F.pmod(F.xxhash64("least"), F.col("parts")).cast("int")
        cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cut = cut.select(*names, "least", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
        rows = rows.join(crowded, F.col("key") == F.col("crowd"), "left_anti").unionByName(cut)
    total = sum((F.bit_count(c) for c in names[1:]), F.bit_count(names[0]))
    rows = rows.repartition("key").sortWithinPartitions("key", total)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "key", 50_000):
            fp = np.stack([group.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            least = group.column("least").to_numpy()
            labels = bucket_labels(group.column("key").to_numpy(), fp, radius)
            moved = np.flatnonzero(labels != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(least[moved]), pa.array(least[labels[moved]])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _own_keys(keyed: DataFrame, text: str) -> DataFrame:
    """The rows with distinct keys in the order of their keys, then of their texts' hashes. Written once."""
    order = ["key", "hash", "row"]
    dealt = keyed.withColumn("hash", F.xxhash64(text)).withColumn("row", F.monotonically_increasing_id())
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("key", F.monotonically_increasing_id()).drop("hash", "row"), "keyed")


def _signed(texts: DataFrame, size: int, lanes: int) -> DataFrame:
    """(k, d0, d1, s0, s1, ...) of texts (k, text): the digest of the text's set of shingle hashes, and its signature."""
    names = ["d0", "d1", *(f"s{i}" for i in range(lanes))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            hashed = _every_hash(batch.column("text").to_pylist(), size)
            digests = b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in _sets(*hashed))
            found = np.concatenate([np.frombuffer(digests, np.int64).reshape(-1, 2), _signatures(*hashed, lanes).view(np.int64)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(found[:, i]) for i in range(len(names)))], names=["k", *names])

    return texts.mapInArrow(run, "k long, " + ", ".join(f"{c} long" for c in names))


def shingle_sets(texts: DataFrame, size: int = WORDS) -> DataFrame:
    """(k, set) of texts (k, text): the distinct hashes of its shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            sets = _sets(*_every_hash(batch.column("text").to_pylist(), size))
            ends = np.r_[0, np.cumsum([len(x) for x in sets])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), lists], names=["k", "set"])

    return texts.mapInArrow(run, "k long, set array<long>")


def similar(x: str, y: str, near: float) -> Column:
    """Whether the distinct values in two array columns have a Jaccard similarity of `near` or more; empty ones have 1."""
    n, m, both = F.size(x), F.size(y), F.size(F.array_intersect(x, y))
    apart = F.try_divide(F.least(n, m), F.greatest(n, m)) < near  # by their sizes alone
    return F.when(apart, False).otherwise(F.coalesce(F.try_divide(both, n + m - both) >= near, F.lit(True)))


def compared(roots: DataFrame, sets: DataFrame, near: float) -> DataFrame:
    """(node, root, near): whether each node is similar enough to its root. Nodes of a large group can be split, as both
    sides of the join are shuffled for it."""
    mine = roots.join(sets, F.col("node") == F.col("k")).select("node", "root", F.col("set").alias("mine"))
    judged = mine.join(sets, F.col("root") == F.col("k")).select("node", "root", similar("mine", "set", near).alias("near"))
    return materialize(judged, "judged")


def settled(left: DataFrame, sets: DataFrame, near: float, block: int = BLOCK) -> DataFrame:
    """From (node, root): those nodes, as `gone`, that are similar to one of the same root that stays. In the order of hashed
    nodes, a node stays if none that stays is similar. Nodes of a root are compared by pairs of blocks."""
    state = materialize(left.select("node", "root", F.lit(False).alias("kept")), "state")
    gone = None
    while True:
        parts = state.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        rows = state.join(parts, "root").withColumn("rank", F.xxhash64("node")).withColumn("own", F.pmod("rank", F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        rows = materialize(rows.join(sets, F.col("node") == F.col("k")).select("node", "root", "kept", "rank", "own", "low", "high", "set"), "blocks")
        key = ["root", "low", "high"]
        before = rows.select(*key, F.col("node").alias("p"), F.col("kept").alias("p_kept"), F.col("rank").alias("p_rank"), F.col("own").alias("p_own"), F.col("set").alias("p_set"))
        earlier = F.struct("p_rank", "p") < F.struct("rank", "node")
        once = (F.col("own") != F.col("p_own")) | (F.col("low") == F.col("high"))
        pairs = rows.where(~F.col("kept")).join(before, key).where(earlier & once & similar("set", "p_set", near))
        least = F.min(F.struct(~F.col("p_kept"), "p_rank", "p")).alias("m")  # one that stays, if there is one
        partner = materialize(pairs.groupBy("node").agg(least).select("node", F.col("m.p").alias("p")), "partners")
        if partner.isEmpty():
            return gone if gone is not None else partner.select(F.col("node").alias("gone"))
        waits = partner.select(F.col("node").alias("wait"))
        out = materialize(partner.join(waits, F.col("p") == F.col("wait"), "left_anti").select(F.col("node").alias("gone")), "gone")
        gone = out if gone is None else gone.unionByName(out)
        stay = state.join(partner.select("node"), "node", "left_anti").select("node", "root", F.lit(True).alias("kept"))
        wait = state.join(partner, "node").join(out, F.col("node") == F.col("gone"), "left_anti").select("node", "root", F.lit(False).alias("kept"))
        wait = materialize(wait, "waiting")
        if wait.isEmpty():
            return gone
        state = materialize(stay.join(wait.select("root").distinct(), "root", "left_semi").unionByName(wait), "state")


def _gone(distinct: DataFrame, texts: DataFrame, bands: tuple[int, int, int, int], size: int, near: float, hot: int, block: int) -> DataFrame | None:
    """Of distinct signatures: the ids, as `gone`, of texts that are similar enough to one that stays."""
    bits, each, words, radius = bands
    gone, sets, now, before = None, None, distinct, None
    while True:
        roots = components(near_links(now, words, bits, each, radius, hot=hot))
        if roots.isEmpty():
            return gone
        if sets is None:
            members = materialize(roots.select(F.col("node").alias("m")).unionByName(roots.select(F.col("root").alias("m")).distinct()), "members")
            sets = materialize(shingle_sets(texts.join(members, F.col("k") == F.col("m"), "left_semi"), size), "sets")
        judged = compared(roots, sets, near)
        out = judged.where("near").select(F.col("node").alias("gone"))
        gone = out if gone is None else gone.unionByName(out)
        left = judged.where("NOT near").select("node", "root")
        groups = left.groupBy("root").count().agg(F.sum("count"), F.max("count")).first()
        if not groups[0]:
            return gone
        if groups[1] <= block or (before is not None and 2 * groups[0] > before):
            return gone.unionByName(settled(left, sets, near, block))
        before = groups[0]
        now = materialize(distinct.join(left, F.col("least") == F.col("node"), "left_semi"), "left")


def dedup(docs: DataFrame, *, size: int = WORDS, near: float = NEAR, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """`docs` without the rows whose text is similar to one that stays; same columns. Of a group of near copies the row of the
    smallest doc_id stays, and those that aren't similar enough to any that does."""
    frame, of = plain(docs)
    keyed = frame.withColumn("key", id_key(of["doc_id"]))
    ids = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (ids[1] or 0) > 1:
        keyed = _own_keys(keyed, of["text"])
    bands = bands_for(ids[0] or 0, near)
    lanes = bands[2]
    texts = keyed.select(F.col("key").alias("k"), text_bytes(of["text"]).alias("text"))
    rows = materialize(_signed(texts, size, lanes), "signatures")
    names = [f"s{i}" for i in range(lanes)]
    distinct = materialize(rows.groupBy("d0", "d1", *names).agg(F.min("k").alias("least")).drop("d0", "d1"), "distinct")
    stay, gone = distinct.select("least"), _gone(distinct, texts, bands, size, near, hot, block)
    if gone is not None:
        stay = stay.join(gone, F.col("least") == F.col("gone"), "left_anti")
    removed = materialize(rows.select(F.col("k").alias("out")).join(stay, F.col("out") == F.col("least"), "left_anti"), "removed")
    return keyed.join(removed, F.col("key") == F.col("out"), "left_anti").select(frame.columns).toDF(*docs.columns)
