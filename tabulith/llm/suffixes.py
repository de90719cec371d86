"""Removal of repeated byte strings, by a hash-compared suffix sort.

A byte goes if a `width`-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the
same document. All is over the whole table and exact, by these steps.

1. Texts are dealt out by doc_id once, compressed; the later steps read that same exchange again.
2. Anchors: the least hash of the `gram`-byte strings in every window of `width` bytes, so equal windows have equal
   anchors at equal places. About one byte in 35 is an anchor. A window around an anchor lies within its context,
   the bytes that a window with that anchor can reach. Only anchors of equal gram hash need to be compared.
3. Anchors of a part of the table (SHARED bytes) are compared first: the suffixes that begin at the anchors, and the
   reversed prefixes that end there, are each sorted by a mergesort whose comparisons find the common extension by
   binary search over prefix polynomial hashes and end with a direct comparison of eight bytes. Sorted neighbours are
   verified byte by byte: common extensions are those of the bytes, and an order that hash collisions spoilt is sorted
   again by bytes. Common extensions of sorted neighbours give, for each split of `width` into left and right, the
   classes of anchors that agree on both sides; all but the earliest of a class lose that window. Contexts that agree
   wholly with an earlier one of the part go no further.
4. The anchors of all parts meet by gram. Where contexts agree in their hash, the document of the one before sends the
   stretch's bytes to that of the next, which removes it if the bytes are the same. Where a gram has several contexts, the
   first of each fetches its bytes, and these are compared as in step 3.
5. A gram that more than `hot` contexts share is not compared in one task: the contexts are cut into single windows, of
   which a task passes on the first of each, and these meet by a hash of the window.
6. The removed stretches return to their documents and are merged.

So nothing goes because of equal hashes alone. Should different contexts of a gram have equal hashes (64 bits), neither goes
and the later one is not compared with others. Memory: a task holds one part, `hot` contexts of one gram at under 1 KB
each, or the first windows of all tasks that equal one window.

Defined cases: null and empty texts have no bytes; texts under `width` bytes lose nothing; a null id counts as the
smallest (as does the least long); rows that repeat an id are ordered by their compressed texts, as further documents
after the first (in such a table each row gets a key of its own, in that order); an empty table gives none; `remove_repeats`
gives a null text as an empty one, of length 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import expand, id_key, key_id, materialize, pieces, plain, text_bytes, whole_groups

WIDTH, GRAM = 100, 32
#: Bytes of text that are turned into anchors at a time; bytes of text, and anchors, of a part.
PIECE, SHARED, MOST_ANCHORS = 1 << 19, 24 << 20, 1 << 20
#: Anchors that are sorted at a time, anchors of a gram that are compared in one task, windows that a task remembers.
SLICE, HOT, WINDOWS = 20_000, 20_000, 100_000
_POWER = 0x9E3779B97F4A7C15
_LETTERS = np.random.Generator(np.random.PCG64(20)).integers(1 << 63, size=256, dtype=np.uint64) | np.uint64(1)


#: Bits for the length of a context's side; s packs both, and is GONE for a stretch that goes.
_SIDE = 12
_MASK, GONE = (1 << _SIDE) - 1, -1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


def _powers(n: int, base: int = _POWER) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have, step = have + take, step * step % (1 << 64)
    return out[:n]


_INVERSE = pow(_POWER, -1, 1 << 64)


def anchors(data: np.ndarray, lengths: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the anchors of the texts that `data` joins: text number, place in data, gram hash, context bytes before and from
    the place, and the context's hash."""
    none = np.zeros(0, np.int64)
    if not (lengths >= width).any():
        return none, none, none.view(np.uint64), none, none, none.view(np.uint64)
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _powers(n), out=prefix[1:])
    begin = np.cumsum(lengths) - lengths
    back = _powers(n + 1, _INVERSE)
    hashed = mix((prefix[gram:] - prefix[: n - gram + 1]) * back[: n - gram + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    least = hashed >> bits << bits | np.arange(len(hashed), dtype=np.uint64)
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[: have - span], least[span - have :])
    windows = expand(begin, np.maximum(lengths - width + 1, 0))  # none crosses a text's end
    place = (least[windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    place = place[np.r_[True, place[1:] != place[:-1]]]
    text = np.searchsorted(begin, place, "right") - 1
    # texts without bytes share their begin with the next; searchsorted gives the last of equals, the one with bytes
    low = np.maximum(begin[text], place - (width - gram))
    high = np.minimum(begin[text] + lengths[text], place + width)
    context = mix(mix((prefix[high] - prefix[low]) * back[low]) + mix(((place - low) << _SIDE | (high - place)).astype(np.uint64)))
    return text, place, hashed[place] >> np.uint64(24), place - low, high - place, context


class Suffixes:
    """Byte strings of up to `most` bytes of `flat`, from each start on (step -1: backwards), compared by common extension."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int, step: int = 1):
        words = -(-most // 8)
        offset = np.arange(8 * words)
        at = np.clip(starts[:, None] + step * offset, 0, max(len(flat) - 1, 0))
        grid = flat[at] if len(flat) else np.zeros(at.shape, np.uint8)
        grid[offset >= lengths[:, None]] = 0
        self.words = grid.view(">u8").astype(np.uint64)
        self.lengths, self.count = lengths, words
        self.prefix = np.zeros((len(starts), words + 1), np.uint64)
        power = 1
        for k in range(words):
            self.prefix[:, k + 1] = self.prefix[:, k] + mix(self.words[:, k] + np.uint64(1)) * np.uint64(power)
            power = power * _POWER % (1 << 64)

    def extension(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The common extension of strings a and b, and whether a comes before b (shorter first)."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.count)
        while (open_ := low < high).any():  # the most words with equal prefix hashes
            middle = (low + high + 1) // 2
            same = self.prefix[a, middle] == self.prefix[b, middle]
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return self._from(low, a, b)

    def _from(self, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = np.minimum(low, self.count - 1)
        x, y = self.words[a, word], self.words[b, word]
        differ = x ^ y
        equal = np.zeros(len(a), np.int64)
        for k in range(1, 9):
            equal += differ >> np.uint64(64 - 8 * k) == 0
        common = np.minimum(np.where(low < self.count, 8 * low + equal, 8 * self.count), np.minimum(self.lengths[a], self.lengths[b]))
        return common, np.where(differ != 0, x < y, self.lengths[a] < self.lengths[b])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Rows in order within each run of equal `group` values (which must be contiguous): a bottom-up mergesort,
        all merges of a level at once, each row's place found by binary search in the sister run."""
        order = np.arange(len(group))
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[begins, len(group)])
        begin, end = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
        run = 1
        while run < sizes.max(initial=1):
            busy = np.flatnonzero(end - begin > run)
            local = busy - begin[busy]
            left = local // run % 2 == 0
            mine = begin[busy] + local // run * run
            other = np.where(left, mine + run, mine - run)
            stop = np.minimum(other + run, end[busy])
            low, high = np.minimum(other, stop), stop
            first = low.copy()
            while len(todo := np.flatnonzero(low < high)):
                middle = (low[todo] + high[todo]) // 2
                theirs, own = order[middle], order[busy[todo]]
                common, before = self.extension(theirs, own)
                equal = (common == self.lengths[theirs]) & (common == self.lengths[own])
                ahead = np.where(equal, ~left[todo], before)  # equal rows keep their order
                low[todo], high[todo] = np.where(ahead, middle + 1, low[todo]), np.where(ahead, high[todo], middle)
            target = np.where(left, mine, other) + (local % run) + (low - first)
            new = order.copy()
            new[target] = order[busy]
            order = new
            run *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, bool]:
        """The common extension, of the bytes themselves, of each row in `order` with the one before it, -1 between groups;
        and whether the order is that of the bytes."""
        out = np.full(len(order), -1, np.int64)
        inside = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        a, b = order[inside - 1], order[inside]
        differ = self.words[a] != self.words[b]
        out[inside], before = self._from(np.where(differ.any(1), differ.argmax(1), self.count), a, b)
        equal = (out[inside] == self.lengths[a]) & (out[inside] == self.lengths[b])
        return out, bool((before | equal).all())

    def ranked(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and common extensions of neighbours."""
        order = self.sort(group)
        common, sound = self.neighbours(order, group)
        if not sound:  # equal hashes of different strings
            order = np.lexsort((np.arange(len(group)), self.lengths, *self.words.T[::-1], group))
            common, _ = self.neighbours(order, group)
        return order, common


def repeated(group: np.ndarray, flat: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts in order of age within each group, with `left` bytes before and `right` from their place in `flat`:
    the least and greatest left part of a window that an earlier context of the group has at the same place (greatest
    -1: none); and which contexts wholly agree with an earlier one."""
    n = len(group)
    least, most, same = np.full(n, width), np.full(n, -1), np.zeros(n, bool)
    orders, commons, best, whole = [], [], [], []
    for side in (Suffixes(flat, place, right, width), Suffixes(flat, place - 1, left, max(1, width - gram), -1)):
        order, common = side.ranked(group)
        near = np.empty(n, np.int64)
        near[order] = np.maximum(common, np.r_[common[1:], -1])
        number = np.empty(n, np.int64)
        number[order] = np.cumsum((common < side.lengths[order]) | (common < side.lengths[np.r_[order[:1], order[:-1]]]) | (common < 0))
        orders.append(order)
        commons.append(common)
        best.append(near)
        whole.append(number)
    key = whole[0] * (n + 1) + whole[1]
    order = np.argsort(key, kind="stable")
    same[order[np.flatnonzero(key[order][1:] == key[order][:-1]) + 1]] = True
    least[same], most[same] = width - right[same], left[same]
    live = np.flatnonzero((best[0] + best[1] >= width) & ~same)
    for o in range(0, width - gram + 1):
        rows = live[(best[1][live] >= o) & (best[0][live] >= width - o)]
        if len(rows) < 2:
            continue
        classes = []
        for order, common, need in zip(orders, commons, (width - o, o), strict=True):
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(common < need)
            classes.append(number[rows])
        if o == 0:
            classes[1] = np.zeros(len(rows), np.int64)  # nothing to the left: one class; groups differ on the right
        key = classes[0] * (n + 1) + classes[1]
        order = np.argsort(key, kind="stable")
        later = rows[order[np.r_[False, key[order][1:] == key[order][:-1]]]]
        least[later] = np.minimum(least[later], o)
        most[later] = np.maximum(most[later], o)
    return least, most, same


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by k, with each row's number among those of its k."""
    last, count = None, 0
    for batch in batches:
        numbers = np.empty(batch.num_rows, np.int64)
        for i, k in enumerate(batch.column("k").to_numpy().tolist()):
            count = count + 1 if k == last else 0
            last, numbers[i] = k, count
        yield batch, numbers


def _dealt(docs: DataFrame, others: bool) -> DataFrame:
    """(k, z, rest): ids as keys, compressed texts and the struct of all other columns (or none of them), dealt out by
    id and sorted. The same plan every time, so its exchange is reused."""
    rows, of = plain(docs)
    rest = [F.col(c) for c in rows.columns if others and c not in (of["doc_id"], of["text"])]
    rows = rows.select(id_key(of["doc_id"]).alias("k"), text_bytes(of["text"]).alias("text"), (F.struct(*rest) if rest else F.lit(True)).alias("rest"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("z", T.BinaryType()), rows.schema["rest"]])

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([tool.compress(t) for t in batch.column("text").to_pylist()], pa.binary()), batch.column("rest")], names=["k", "z", "rest"])

    return rows.mapInArrow(squeeze, schema).repartition("k").sortWithinPartitions("k", "z")


def _texts(batch: pa.RecordBatch) -> Iterator[list[tuple[int, bytes]]]:
    """(row, text) in pieces of about PIECE bytes."""
    tool, held, size = zstandard.ZstdDecompressor(), [], 0
    for i, z in enumerate(batch.column("z")):
        text = tool.decompress(z.as_py())
        held.append((i, text))
        size += len(text)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _union(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of equal keys made one, in order; keys must be small non-negative numbers."""
    if not len(key):
        return key, begin, end
    order = np.lexsort((begin, key))
    key, begin, end = key[order], begin[order], end[order]
    # ends so far, counted on from key to key
    far = np.maximum.accumulate(end + key * (1 << 40))
    new = np.r_[True, begin[1:] + key[1:] * (1 << 40) > far[:-1]]
    first = np.flatnonzero(new)
    return key[first], begin[first], far[np.r_[first[1:] - 1, len(key) - 1]] - key[first] * (1 << 40)


_MEETING = ["h", "c", "s", "k", "loc"]


def _meeting(dealt: DataFrame, width: int, gram: int) -> DataFrame:
    """Anchors: h the gram, c the context's hash, s its sides, k the id, loc the row number and place. Stretches that go: loc
    has the begin, c the end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        ids: list[tuple[np.ndarray, np.ndarray]] = []
        size = count = rows = 0

        def block(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_MEETING)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, texts, ids, size, count, rows
            h, c, row, place, at, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            data, (k, number) = np.concatenate(texts), (np.concatenate(x) for x in zip(*ids, strict=True))
            texts = []
            order = np.argsort(h, kind="stable")  # rows come in order of age
            again = h[order][1:] == h[order][:-1]
            shared = order[np.r_[False, again] | np.r_[again, False]]
            kept, gone = np.ones(len(h), bool), []
            for begin in range(0, len(shared), SLICE):
                some = shared[begin : begin + SLICE]
                group = np.cumsum(np.r_[True, h[some][1:] != h[some][:-1]])
                least, most, same = repeated(group, data, at[some].astype(np.int64), left[some].astype(np.int64), right[some].astype(np.int64), width, gram)
                lost = most >= 0
                gone.append(np.stack([row[some], place[some] - most, place[some] - least + width])[:, lost])
                kept[some[same]] = False
            for begin in range(0, len(h), 100_000):  # the JVM holds a batch as a whole
                some = np.flatnonzero(kept[begin : begin + 100_000]) + begin
                yield block(h[some].view(np.int64), c[some].view(np.int64), left[some] << _SIDE | right[some], k[row[some]], number[row[some]] << 32 | place[some])
            if gone:
                row, begin, end = _union(*np.concatenate(gone, axis=1))
                yield from pieces(block(_spread(k[row]), end, np.full(len(row), GONE, np.int32), k[row], number[row] << 32 | begin))
            ids, size, count, rows = [], 0, 0, 0

        for batch, numbers in _numbered(batches):
            every = batch.column("k").to_numpy()
            for piece in _texts(batch):
                mine = np.array([i for i, _ in piece])
                lengths = np.array([len(t) for _, t in piece], np.int64)
                data = np.frombuffer(b"".join(t for _, t in piece), np.uint8)
                text, at, h, left, right, c = anchors(data, lengths, width, gram)
                if len(text):
                    small = (x.astype(np.int32) for x in (text + rows, at - (np.cumsum(lengths) - lengths)[text], at + size, left, right))
                    held.append((h, c, *small))
                    texts.append(data)
                    ids.append((every[mine], numbers[mine]))
                    size, count, rows = size + len(data), count + len(text), rows + len(mine)
                if size >= SHARED or count >= MOST_ANCHORS:
                    yield from flush()
        if held:
            yield from flush()

    return dealt.mapInArrow(run, "h long, c long, s int, k long, loc long")


def _spread(k: np.ndarray) -> np.ndarray:
    """A gram that stands for none: rows that aren't compared are dealt out by id."""
    return mix(k.view(np.uint64)).view(np.int64)


_SHARED = [*_MEETING, "hot", "tk", "tloc"]


def _shared(meeting: DataFrame, most: int) -> DataFrame:
    """Stretches that go; the first anchor of each context of a gram that has several, hot if there are more than `most`; and
    for all other anchors the one before it of the same context, with the anchor itself as tk and tloc."""
    rows = meeting.repartition("h").sortWithinPartitions("h", "c", "k", "loc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None  # the anchor before
        waiting: list[np.ndarray] | None = None  # first anchors of the last gram's contexts, `most` at most
        hot_now: int | None = None

        def out(columns: list[np.ndarray], hot: bool | np.ndarray, tk: np.ndarray | None = None, tloc: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            n = len(columns[0])
            if n:
                none = pa.nulls(n, pa.int64())
                yield from pieces(pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.broadcast_to(hot, n)), none if tk is None else pa.array(tk), none if tloc is None else pa.array(tloc)], names=_SHARED))

        def whole(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Of the first anchors of all contexts of some grams, those whose gram has several."""
            h = columns[0]
            new = np.r_[True, h[1:] != h[:-1]]
            size = np.diff(np.r_[np.flatnonzero(new), len(h)])[np.cumsum(new) - 1]
            hot = (size > most) | (h == hot_now if hot_now is not None else np.zeros(len(h), bool))
            keep = (size > 1) | hot
            yield from out([x[keep] for x in columns], hot[keep])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_numpy() for n in _MEETING]
            known = columns[2] == GONE
            if known.any():
                yield from out([x[known] for x in columns], False)
                columns = [x[~known] for x in columns]
            if not len(columns[0]):
                continue
            before = [np.r_[a[-1:] if last is None else last[i], a[:-1]] for i, a in enumerate(columns)]
            same = (columns[0] == before[0]) & (columns[1] == before[1]) & (columns[2] == before[2])
            if last is None:
                same[0] = False
            last = [x[-1:] for x in columns]
            yield from out([x[same] for x in before], False, columns[3][same], columns[4][same])
            columns = [x[~same] for x in columns]
            if waiting is not None:
                columns = [np.r_[a, b] for a, b in zip(waiting, columns, strict=True)]
            if not len(columns[0]):
                continue
            gram = int(columns[0][-1])
            cut = int(np.searchsorted(columns[0], gram, "left"))
            if cut:
                yield from whole([x[:cut] for x in columns])
            waiting = [x[cut:] for x in columns]
            if len(waiting[0]) > most or hot_now == gram:
                hot_now = gram
                yield from out(waiting, True)
                waiting = None
        if waiting is not None:
            yield from whole(waiting)

    return rows.mapInArrow(run, "h long, c long, s int, k long, loc long, hot boolean, tk long, tloc long")


_FETCHED = ["h", "k", "loc", "context", "left", "end"]
#: `left` of bytes that prove a stretch.
PROOF = -1


def _fetched(dealt: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """The anchors with their context's bytes and the place in it (left); those of hot grams window by window. Rows without
    context are stretches that go, from loc to end; rows with left PROOF are stretches at loc that go if their bytes are
    these."""
    asked = shared.groupBy("k").agg(F.collect_list(F.struct("h", "loc", "c", "s", "hot", "tk", "tloc")).alias("asked"))
    joined = dealt.withColumnRenamed("k", "id").join(asked, F.col("id") == F.col("k")).select("k", "z", "rest", "asked").sortWithinPartitions("k", "z")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        seen: set[tuple[int, bytes]] = set()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())

        def block(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=_FETCHED)

        for batch, numbers in _numbered(batches):
            out: list[tuple] = []
            size = 0
            asked = batch.column("asked")
            for i, k in enumerate(batch.column("k").to_numpy().tolist()):
                part = asked[i].values
                locs = part.field("loc").to_numpy()
                mine = np.flatnonzero(locs >> 32 == numbers[i])
                if not len(mine):
                    continue
                mine = mine[np.argsort(locs[mine], kind="stable")]
                loc, s = locs[mine], part.field("s").to_numpy()[mine].astype(np.int64)
                place, left, right = loc & 0xFFFFFFFF, s >> _SIDE, s & _MASK
                spread = int(_spread(np.array([k], np.int64))[0])
                known = s == GONE
                for a, end in zip(loc[known].tolist(), part.field("c").to_numpy()[mine][known].tolist(), strict=True):
                    out.append((spread, k, a, None, None, end))
                if known.all():
                    continue
                text = tool.decompress(batch.column("z")[i].as_py())
                claimed = part.field("tk").is_valid().to_numpy(zero_copy_only=False)[mine]
                if claimed.any():
                    some = mine[claimed]
                    tk, tloc = part.field("tk").take(pa.array(some)).to_numpy(), part.field("tloc").take(pa.array(some)).to_numpy()
                    shift = (tloc & 0xFFFFFFFF) - place[claimed]
                    order = np.lexsort((shift, tloc >> 32, tk))
                    tk, tn, shift = tk[order], tloc[order] >> 32, shift[order]
                    number = np.cumsum(np.r_[False, (tk[1:] != tk[:-1]) | (tn[1:] != tn[:-1]) | (shift[1:] != shift[:-1])])
                    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                    of, begin, end = _union(number, (place - left)[claimed][order], (place + right)[claimed][order])
                    of = first[of]
                    for t, n, d, a, b, h in zip(tk[of].tolist(), tn[of].tolist(), shift[of].tolist(), begin.tolist(), end.tolist(), _spread(tk[of]).tolist(), strict=True):
                        out.append((h, t, n << 32 | (a + d), text[a:b], PROOF, None))
                        size += b - a
                rest = ~known & ~claimed
                hot = part.field("hot").to_numpy(zero_copy_only=False)[mine]
                for h, l, a, b, cut in zip(part.field("h").to_numpy()[mine][rest].tolist(), loc[rest].tolist(), left[rest].tolist(), right[rest].tolist(), hot[rest].tolist(), strict=True):
                    p = l & 0xFFFFFFFF
                    if not cut:
                        out.append((h, k, l, text[p - a : p + b], a, None))
                        continue
                    for o in range(max(0, width - b), a + 1):
                        window = text[p - o : p - o + width]
                        if (o, window) in seen:  # an earlier text of this task, or this text earlier, has it
                            out.append((spread, k, l - o, None, None, p - o + width))
                        else:
                            if len(seen) >= WINDOWS:
                                seen.clear()
                            seen.add((o, window))
                            out.append((xxhash.xxh64_intdigest(window, o) - (1 << 63), k, l, window, o, None))
                if len(out) > 20_000 or size > 1 << 20:
                    yield block(out)
                    out, size = [], 0
            if out:
                yield block(out)

    return joined.mapInArrow(run, "h long, k long, loc long, context binary, left int, end long")


def _compared(fetched: DataFrame, width: int, gram: int) -> DataFrame:
    """(k, n, lo, hi, proof): stretches that go; with proof if their bytes are these."""
    rows = fetched.repartition("h").sortWithinPartitions("h", "k", "loc")

    def stretches(k: np.ndarray, loc: np.ndarray, lo: np.ndarray, hi: np.ndarray, proof: pa.Array | None = None) -> pa.RecordBatch:
        proof = pa.nulls(len(k), pa.binary()) if proof is None else proof
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(loc >> 32), pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64)), proof], names=["k", "n", "lo", "hi", "proof"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare() -> Iterator[pa.RecordBatch]:
            for batch in batches:  # what needs no comparison goes past
                gone, proven = batch.column("left").is_null(), pa.compute.fill_null(pa.compute.equal(batch.column("left"), PROOF), False)
                for which in (gone, proven):
                    some = batch.filter(which)
                    if some.num_rows:
                        past.append(some)
                yield batch.filter(pa.compute.invert(pa.compute.or_(gone, proven)))

        past: list[pa.RecordBatch] = []

        def let_past() -> Iterator[pa.RecordBatch]:
            for some in past:
                loc = some.column("loc").to_numpy()
                lo = loc & 0xFFFFFFFF
                proof = some.column("context").cast(pa.binary())
                if proof.null_count:
                    yield stretches(some.column("k").to_numpy(), loc, lo, some.column("end").to_numpy())
                else:
                    yield stretches(some.column("k").to_numpy(), loc, lo, lo + pa.compute.binary_length(proof).to_numpy().astype(np.int64), proof)
            past.clear()

        for table in whole_groups(compare(), "h", SLICE):
            yield from let_past()
            table = table.combine_chunks()
            h, k, loc, left = (table.column(n).to_numpy() for n in ("h", "k", "loc", "left"))
            contexts = table.column("context").to_pylist()
            sizes = np.array([len(x) for x in contexts], np.int64)
            left = left.astype(np.int64)
            least, most, _ = repeated(np.cumsum(np.r_[True, h[1:] != h[:-1]]), np.frombuffer(b"".join(contexts), np.uint8), np.cumsum(sizes) - sizes + left, left, sizes - left, width, gram)
            hit = np.flatnonzero(most >= 0)
            place = loc[hit] & 0xFFFFFFFF
            yield stretches(k[hit], loc[hit], place - most[hit], place - least[hit] + width)
        yield from let_past()

    return rows.mapInArrow(run, "k long, n long, lo long, hi long, proof binary")


def spans(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, others: bool = False) -> DataFrame:
    """k (the id as a key), z (the compressed text), the arrays begins and ends of the stretches that go, in order,
    and rest (with `others`, the struct of all other columns)."""
    if not 8 <= gram < width < _MASK:
        raise ValueError(f"gram must be 8 or more and below width, width below {_MASK}")
    dealt = _dealt(docs, others)
    if unique := not _repeats(docs):
        texts = dealt
    else:
        texts = _renumbered(dealt)
    out = removed(texts, _compared(_fetched(texts, _shared(_meeting(texts, width, gram), hot), width), width, gram))
    return out if unique else out.select("rest.k", "z", "rest.rest", "begins", "ends")


def _repeats(docs: DataFrame) -> bool:
    """Several rows have one id (null is one)."""
    rows, of = plain(docs)
    return not rows.select(id_key(of["doc_id"]).alias("k")).groupBy("k").count().where("count > 1").isEmpty()


def _renumbered(dealt: DataFrame) -> DataFrame:
    """The rows of `_dealt` in their order, each with a key of its own, k and rest inside the new rest: what is done
    by key then holds one row's anchors, however many rows share an id. Written once; equal rows spread over partitions."""
    order = ["k", "z", "row"]
    ranged = dealt.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranged.select(F.monotonically_increasing_id().alias("k"), "z", F.struct("k", "rest").alias("rest")), "renumbered")
    return rows.repartition("k").sortWithinPartitions("k", "z")


def removed(dealt: DataFrame, gone: DataFrame) -> DataFrame:
    """The texts with the stretches that go, those with proof only if it holds."""
    lists = gone.groupBy("k").agg(F.collect_list(F.struct("n", "lo", "hi", "proof")).alias("gone")).withColumnRenamed("k", "id")
    joined = dealt.join(lists, F.col("k") == F.col("id"), "left").select("k", "z", "rest", "gone").sortWithinPartitions("k", "z")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch, numbers in _numbered(batches):
            gone = batch.column("gone")
            begins, ends = [], []
            for i in range(batch.num_rows):
                if not gone[i].is_valid:
                    begins.append([])
                    ends.append([])
                    continue
                part = gone[i].values
                mine = part.field("n").to_numpy() == numbers[i]
                proof = part.field("proof")
                claimed = np.flatnonzero(mine & proof.is_valid().to_numpy(zero_copy_only=False)).tolist()
                if claimed:  # only what the bytes bear out
                    text = tool.decompress(batch.column("z")[i].as_py())
                    for j in claimed:
                        lo = part.field("lo")[j].as_py()
                        bytes_ = proof[j].as_py()
                        mine[j] = text[lo : lo + len(bytes_)] == bytes_
                _, b, e = _union(np.zeros(mine.sum(), np.int64), part.field("lo").to_numpy()[mine], part.field("hi").to_numpy()[mine])
                begins.append(b)
                ends.append(e)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("z"), batch.column("rest"), pa.array(begins, kind), pa.array(ends, kind)], names=["k", "z", "rest", "begins", "ends"])

    stretch = T.ArrayType(T.LongType())
    return joined.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("begins", stretch), T.StructField("ends", stretch)]))


def _kept(z: bytes, begins: list[int], ends: list[int], tool: zstandard.ZstdDecompressor) -> tuple[int, bytes]:
    text = tool.decompress(z)
    return len(text), b"".join(text[a:b] for a, b in zip([0, *ends], [*begins, len(text)], strict=True)) if begins else text


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of `spans`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, b, e in zip(batch.column("z"), batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                size, kept = _kept(z.as_py(), b, e, tool)
                rows.append((size, size - len(kept), len(b), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = found.mapInArrow(run, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(key_id("k").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """`docs` with the text that is left, and n_chars, if there is such a column, its length; same columns. Bytes of a
    character that lost others of its bytes go too."""
    found = spans(docs, width=width, gram=gram, others=True)
    _, of = plain(docs)
    kinds = dict(zip(of.values(), (docs.schema[list(docs.columns).index(n)].dataType for n in of), strict=True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [_kept(z.as_py(), b, e, tool)[1].decode("utf-8", "ignore") for z, b, e in zip(batch.column("z"), batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string()), batch.column("rest")], names=["k", "text", "rest"])

    out = found.mapInArrow(run, T.StructType([T.StructField("k", T.LongType()), T.StructField("text", T.StringType()), found.schema["rest"]]))
    columns = []
    for i, name in enumerate(docs.columns):
        slot = f"_{i}"
        if slot == of["doc_id"]:
            column = key_id("k").cast(kinds[slot])
        elif slot == of["text"]:
            column = F.col("text")
        elif slot == of.get("n_chars"):
            column = F.char_length("text").cast(kinds[slot])
        else:
            column = F.col(f"rest.{slot}")
        columns.append(column.alias(slot))
    return out.select(columns).toDF(*docs.columns)
