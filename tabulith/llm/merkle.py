"""Merkle manifest of a data set: a tree for each group, and one over their roots.

A leaf is the SHA-256 of a row's fields, hashed in the JVM: texts don't move. Leaves are range-sorted by group and order;
the number of rows of each partition's first and last group (two rows for each partition, on the driver) gives every
partition the index of its first leaf in its group. With that, each partition builds the complete subtrees that its leaves
make up, in aligned blocks of arity ** STEP leaves, so its memory doesn't grow with a group. What remains are the nodes
at its ragged ends, some tens for each partition: they are shuffled by the coordinate of the block above them, which is
finished there, and so on STEP_UP levels at a time up to the group's root. The roots of the groups are the leaves of
the last tree, built the same way. Then the paths of the ragged nodes go back to their partitions, where each leaf's proof
is put together. A group of any size is spread over many partitions, as is one of equal rows.

A node is the hash of `arity` consecutive nodes (the last run of a level has fewer, perhaps one), digests as hex text. A
lone leaf is its group's root. A proof is an array of (before, after), from the leaf to the root: the digests of the
run's other nodes on either side.

Defined cases: null fields hash as `-`, others as their UTF-8 length, `:` and text; a null group is one group, the
first; null order values come first; rows of equal order go by leaf (equal leaves are interchangeable); an
empty table has no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels of a block that a partition builds at once: 59,049 leaves.
STEP = 10
#: Levels that a shuffle of nodes finishes: 2,187 nodes below one.
STEP_UP = 7
_PROOF = "array<struct<before string, after string>>"
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row's fields."""
    text = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields.values()]
    return F.sha2(F.concat(*text).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all the digests of a proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def height(leaves: int, arity: int) -> int:
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // arity), levels + 1
    return levels


def levels_of(nodes: list[str], start: int, total: int, most: int, arity: int) -> list[tuple[int, list[str]]]:
    """By level, the first index and the digests of the nodes whose leaves are all among these: leaves `start` and on of
    a tree of `total`; `most` levels above them at most."""
    out = [(start, nodes)]
    while len(out) <= most and total > 1:
        low, below = out[-1]
        high = low + len(below)
        first, end = -(-low // arity), -(-high // arity) if high == total else high // arity
        if first >= end:
            break
        out.append((first, [digest("".join(below[arity * k - low : arity * (k + 1) - low])) for k in range(first, end)]))
        total = -(-total // arity)
    return out


def _step(run: list[str], k: int) -> tuple[str, str]:
    return "".join(run[:k]), "".join(run[k + 1 :])


def paths_of(levels: list[tuple[int, list[str]]], upper: dict[tuple[int, int], list], arity: int) -> list[list]:
    """The steps from each leaf upwards; upper: those of the nodes that have no parent among the levels."""
    above: list[list] = []
    at = 0
    for level in range(len(levels) - 1, -1, -1):
        low, nodes = levels[level]
        now = []
        for i in range(low, low + len(nodes)):
            p = i // arity
            if 0 <= p - at < len(above):
                first = max(arity * p - low, 0)
                now.append([_step(nodes[first : arity * (p + 1) - low], i - low - first), *above[p - at]])
            else:
                now.append(upper[level, i])
        above, at = now, low
    return above


class _Chunk:
    """Consecutive leaves of one group in one partition, inside one block."""

    def __init__(self, part: int, group: str, start: int, pos: int):
        self.part, self.group, self.start, self.pos = part, group, start, pos
        self.total = 0
        self.leaves: list[str] = []
        self.upper: dict[tuple[int, int], list] = {}
        self.top: str | None = None
        self.rows: list[pa.RecordBatch] = []


def _chunks(batches: Iterable[pa.RecordBatch], ends: dict[int, tuple[int, int, int]], block: int) -> Iterator[_Chunk]:
    """The chunks of rows (part, pos, kind, g, leaf, level, idx, path, ...) sorted by the first three. kind 0: the path of a
    node that begins at pos; kind 1: a leaf. ends, by part: the index of its first leaf, the leaves of its first group and of its last."""
    now: _Chunk | None = None
    whole = False  # the chunk's group began in another part
    for batch in batches:
        get = {n: batch.column(n).to_pylist() for n in ("part", "pos", "kind", "g", "leaf") if n in batch.schema.names}
        kinds = get.get("kind", [1] * batch.num_rows)
        mine = batch.filter(pa.compute.equal(batch.column("kind"), 1)) if "kind" in get else batch
        given = [batch.column(n) for n in ("level", "idx", "path", "top")] if "kind" in get else []
        taken = seen = 0
        for k in range(batch.num_rows):
            part, group = get["part"][k], get["g"][k]
            if now is None or now.part != part or now.group != group:
                start = 0
                if now is None or now.part != part:
                    start = ends[part][0]
                if now is not None and now.leaves:
                    now.rows.append(mine.slice(taken, seen - taken))
                    taken = seen
                    now.total = ends[now.part][2] if now.part != part else ends[part][1] if whole else now.start + len(now.leaves)
                    yield now
                whole = now is None or now.part != part
                now = _Chunk(part, group, start, get["pos"][k])
            if not kinds[k]:
                level, i, path, now.top = (x[k].as_py() for x in given)
                now.upper[level, i] = [(s["before"], s["after"]) for s in path]
                continue
            now.leaves.append(get["leaf"][k])
            seen += 1
            if (now.start + len(now.leaves)) % block == 0:
                now.rows.append(mine.slice(taken, seen - taken))
                taken = seen
                now.total = now.start + len(now.leaves) + 1  # more or not: a full block is the same
                yield now
                now = _Chunk(part, group, now.start + len(now.leaves), get["pos"][k] + 1)
        if now is not None:
            now.rows.append(mine.slice(taken, seen - taken))
    if now is not None and now.leaves:
        now.total = ends[now.part][2]
        yield now


class Trees:
    """The trees of rows (g, o, leaf, ...), one for each g."""

    def __init__(self, rows: DataFrame, arity: int, step: int, step_up: int):
        self.arity, self.step, self.step_up = arity, step, step_up
        keep = [c for c in rows.columns if c not in ("g", "o", "leaf")]
        numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
        order = ["g", "o", "leaf", "row"]  # with the row's number, equal rows need not share a partition
        ranged = numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        at = F.col("at")
        self.rows = materialize(ranged.select(F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("pos"), "g", "leaf", *keep), "sorted")
        counts = materialize(self.rows.groupBy("part", "g").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")), "counts")
        self.totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
        self.most = self.totals.agg(F.max("total")).first()[0] or 0
        last = counts.groupBy("part").agg(F.max("high").alias("last"))
        self.ends = self._ends(counts.join(last, "part").where("low = 0 OR high = last").orderBy("part", "low").collect())  # two rows a partition
        self.nodes = self._finished(self._local())

    def _ends(self, rows: list) -> dict[int, tuple[int, int, int]]:
        sums: dict[str, int] = {}
        for r in rows:
            sums[r["g"]] = sums.get(r["g"], 0) + r["n"]
        out: dict[int, tuple[int, int, int]] = {}
        group, so_far = None, 0
        for r in rows:
            before = so_far if r["g"] == group else 0
            first = out.get(r["part"], (before, sums[r["g"]]))
            out[r["part"]] = (*first[:2], sums[r["g"]])
            group, so_far = r["g"], before + r["n"]
        return out

    def _local(self) -> DataFrame:
        """(g, level, idx, hash, part, pos): the nodes without a parent in their partition's block."""
        arity, step, ends = self.arity, self.step, self.ends

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c in _chunks(batches, ends, arity**step):
                levels = levels_of(c.leaves, c.start, c.total, step, arity)
                out = []
                for level, (low, nodes) in enumerate(levels):
                    first, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
                    for i, h in enumerate(nodes, low):
                        if not 0 <= i // arity - first < len(above):
                            out.append((c.group, level, i, h, c.part, c.pos + i * arity**level - c.start))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["g", "level", "idx", "hash", "part", "pos"])

        rows = self.rows.select("part", "pos", "g", "leaf").repartition("part").sortWithinPartitions("part", "pos")
        return rows.mapInArrow(run, "g string, level int, idx long, hash string, part int, pos long")

    def _finished(self, nodes: DataFrame) -> DataFrame:
        """(g, level, idx, part, pos, path, top): the nodes with their steps up to the group's root."""
        nodes = nodes.join(self.totals, "g")
        cap, rounds = self.step, []
        while True:
            rounds.append(materialize(self._round(nodes, cap), "nodes"))
            if height(self.most, self.arity) <= cap:
                break
            nodes = rounds[-1].where("first").select("g", F.col("top_level").alias("level"), F.col("block").alias("idx"), F.col("top").alias("hash"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), "total")
            cap += self.step_up
        out = rounds.pop()
        while rounds:
            above = out.select("g", F.col("idx").alias("block"), F.col("path").alias("more"), F.col("top").alias("root"))
            out = rounds.pop().join(above, ["g", "block"]).withColumn("path", F.concat("path", "more")).withColumn("top", F.col("root"))
        return materialize(out.select("g", "level", "idx", "part", "pos", "path", "top"), "paths")

    def _round(self, nodes: DataFrame, cap: int) -> DataFrame:
        """Finishes the blocks of `cap` levels: all nodes of one meet in one task, which knows what lies between them."""
        arity = self.arity
        width = F.get(F.array(*[F.lit(arity ** (cap - k)) for k in range(cap + 1)]), F.col("level"))
        keyed = nodes.withColumn("block", F.floor(F.col("idx") / width)).repartition("g", "block").sortWithinPartitions("g", "block")
        fields = {"g": pa.string(), "level": pa.int32(), "idx": pa.int64(), "part": pa.int32(), "pos": pa.int64(), "block": pa.int64(), "total": pa.int64(), "path": _STEPS, "top": pa.string(), "top_level": pa.int32(), "first": pa.bool_()}

        def finish(rows: list[dict[str, Any]]) -> pa.RecordBatch:
            top = min(cap, height(rows[0]["total"], arity))
            given: dict[int, dict[int, str]] = {}
            for r in rows:
                given.setdefault(r["level"], {})[r["idx"]] = r["hash"]
            now: dict[int, str] = {}
            steps: dict[tuple[int, int], tuple[str, str]] = {}
            for level in range(min(given), top):
                now |= given.get(level, {})
                above = {}
                for p in {i // arity for i in now}:
                    run = [now[i] for i in range(arity * p, arity * (p + 1)) if i in now]
                    above[p] = digest("".join(run))
                    for k in range(len(run)):
                        steps[level, arity * p + k] = _step(run, k)
                now = above
            now |= given.get(top, {})
            (root,) = now.values()
            for k, r in enumerate(rows):
                r["path"], i = [], r["idx"]
                for level in range(r["level"], top):
                    r["path"].append(dict(zip(("before", "after"), steps[level, i], strict=True)))
                    i //= arity
                r |= {"top": root, "top_level": top, "first": k == 0}
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields.items()], names=list(fields))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict[str, Any]] = []
            for batch in batches:
                for r in batch.to_pylist():
                    if held and (r["g"], r["block"]) != (held[0]["g"], held[0]["block"]):
                        yield finish(held)
                        held = []
                    held.append(r)
            if held:
                yield finish(held)

        return keyed.mapInArrow(run, f"g string, level int, idx long, part int, pos long, block long, total long, path {_PROOF}, top string, top_level int, first boolean")

    def tops(self) -> DataFrame:
        """(g, top): the root of each tree."""
        return self.nodes.where("level = 0 OR idx = 0").groupBy("g").agg(F.min("top").alias("top"))

    def proofs(self, paths: DataFrame) -> DataFrame:
        """The rows with the roots of their trees (top) and their proofs. paths: (g, level, idx, part, pos, path, top), the
        steps from each of `nodes` upwards."""
        arity, step, ends = self.arity, self.step, self.ends
        keep = [f for f in self.rows.schema.fields if f.name not in ("part", "pos")]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c in _chunks(batches, ends, arity**step):
                found = paths_of(levels_of(c.leaves, c.start, c.total, step, arity), c.upper, arity)
                at, cut = [0], []
                for p in found:
                    cut += p
                    at.append(len(cut))
                before, after = zip(*cut, strict=True) if cut else ((), ())
                steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
                rows = pa.Table.from_batches(c.rows).select([f.name for f in keep]).combine_chunks()
                rows = rows.append_column("top", pa.array([c.top] * rows.num_rows, pa.string()))
                yield from rows.append_column("proof", pa.ListArray.from_arrays(pa.array(at, pa.int32()), steps)).to_batches()

        leaves = self.rows.select("part", "pos", F.lit(1).alias("kind"), *[f.name for f in keep], *[F.lit(None).cast(t).alias(n) for n, t in (("level", "int"), ("idx", "long"), ("path", _PROOF), ("top", "string"))])
        above = paths.select("part", "pos", F.lit(0).alias("kind"), "g", *[F.lit(None).cast(f.dataType).alias(f.name) for f in keep if f.name != "g"], "level", "idx", "path", "top")
        both = leaves.unionByName(above).repartition("part").sortWithinPartitions("part", "pos", "kind")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
        return both.mapInArrow(run, f"{schema}, top string, proof {_PROOF}")


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None, arity: int = ARITY, step: int = STEP, step_up: int = STEP_UP) -> DataFrame:
    """(order, group, leaf, subroot, root, proof, keep...) of each row: its digest, its group's root, the root of all, and
    the steps from it to that. keep: further columns, expressions of the fields; small ones, as they move with the digests."""
    keep = keep or {}
    rows = pick(docs, *fields)
    coded = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))  # null is before all others
    columns = {f"k{i}": c for i, c in enumerate(keep.values())}
    own = Trees(rows.select(coded.alias("g"), F.col(order).alias("o"), F.col(order).alias("id"), leaf({f: F.col(f) for f in fields}).alias("leaf"), *[c.alias(n) for n, c in columns.items()]), arity, step, step_up)
    last = Trees(own.tops().select(F.lit("s").alias("g"), F.col("g").alias("o"), F.col("top").alias("leaf"), F.col("g").alias("of")), arity, step, step_up)
    root = last.tops().first()  # one row
    upper = materialize(last.proofs(last.nodes).select(F.col("of").alias("g"), F.col("proof").alias("more")), "upper")
    out = own.proofs(own.nodes.join(upper, "g").withColumn("path", F.concat("path", "more")))
    return out.select(
        F.col("id").alias(order),
        F.expr("CASE WHEN g <> 'n' THEN substring(g, 2) END").alias(group),
        "leaf",
        F.col("top").alias("subroot"),
        F.lit(root["top"] if root else None).cast("string").alias("root"),
        "proof",
        *[F.col(n).alias(k) for n, k in zip(columns, keep, strict=True)],
    )
