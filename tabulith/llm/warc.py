"""WARC archives by a chunked record table.

A payload is never one value in Python: it is rows of at most `chunk` bytes with the record's number and their own, cut in the
JVM. Each row carries the digests of the payload so far, taken up from the row before, so the last row of a record has
those of the whole. The rows are written once, as the chunked record table; all decisions are made on its last rows, without
reading a payload again. Records of equal payloads (by length, SHA-1 and SHA-256) become revisits of the first one.

In the archive a record of one chunk is a plain record. A longer one is written as the standard's segments, a record for
each chunk: any task may write any chunk, and nothing is held or sorted. The payload's digest stands in the last segment.
Each record is a gzip member of its own. `warc` is a Spark data source: tasks write files of about FILE_BYTES,
and a list of the files of finished tasks makes them the archive, so what lost tasks leave behind is never read. Folders
without a list are read by their file names. Reading streams a file and gives chunk rows again, with digests so far;
segments meet by record and go on in their order. Paths are those of pyarrow.fs (file, hdfs, s3, gs).

Defined cases: a null payload is empty; a null id stays null and orders before all others; of rows with equal id and
payload one is the response; payloads under `least` bytes are never revisits; an empty table gives an archive without
records; other columns, whatever their names, are not read; a file that breaks off or isn't WARC raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import id_key, materialize, new_folder, pick, text_bytes

CHUNK = 32 << 10
FILE_BYTES = 256 << 20
#: Bytes of rows that a reader hands on at a time.
BATCH_BYTES = 4 << 20
#: The longest HTTP head that is told from the payload.
HEAD_BYTES = 64 << 10
#: A key that has this share of all rows or more is looked up by broadcast: there are HEAVY of them at most.
HEAVY = 10_000
_LIST = "_archive.json"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Rows that the writer takes.
WRITTEN = "record long, chunk int, last boolean, type string, id long, uri string, refers_to long, refers_uri string, size long, sha1 binary, data binary"
#: Rows that the reader gives. head: bytes of the block before the payload; total: of all blocks, in a last segment; size and
#: sha1: of the payload so far, null in segments.
READ = "record string, type string, id long, uri string, refers_to string, digest string, segment int, total long, head int, chunk int, last boolean, size long, sha1 binary, data binary"


class _Running:
    """Length and digests of a payload so far; its rows come in order."""

    def __init__(self, *kinds: str):
        self.kinds, self.record = kinds, object()

    def add(self, record: Any, data: Any) -> None:
        if record != self.record:
            self.record, self.size, self.digests = record, 0, [hashlib.new(k) for k in self.kinds]
        self.size += len(data)
        for d in self.digests:
            d.update(data)

    def digest(self, k: int = 0) -> bytes:
        return self.digests[k].digest()


def chunks(rows: DataFrame, *, record: str = "page_id", uri: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of rows: (record, id, uri, chunk, last, data, size, sha1, sha256), written once."""
    if chunk < 1:
        raise ValueError("a chunk has a byte at least")
    whole = pick(rows, record, uri, payload).select(F.monotonically_increasing_id().alias("record"), F.col(record).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), text_bytes(payload).alias("payload"))
    many = F.greatest(F.lit(0), F.ceil(F.octet_length("payload") / chunk) - 1).cast("int")
    cut = whole.select("record", "id", "uri", "payload", many.alias("final"), F.explode(F.sequence(F.lit(0), many)).alias("chunk"))
    data = F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Running("sha1", "sha256")
        for batch in batches:
            sizes, short, long = [], [], []
            for number, body in zip(batch.column("record").to_pylist(), batch.column("data"), strict=True):
                now.add(number, memoryview(body.as_buffer()))
                sizes.append(now.size)
                short.append(now.digest())
                long.append(now.digest(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(short, pa.binary()), pa.array(long, pa.binary())], names=[*batch.schema.names, "size", "sha1", "sha256"])

    out = cut.select("record", "id", "uri", "chunk", (F.col("chunk") == F.col("final")).alias("last"), data.alias("data"))
    with _batches_of(rows.sparkSession, chunk):
        return materialize(out.mapInArrow(digest, "record long, id long, uri string, chunk int, last boolean, data binary, size long, sha1 binary, sha256 binary"), "chunks")


@contextmanager
def _batches_of(spark: SparkSession, row_bytes: int) -> Iterator[None]:
    """Inside, Spark sends rows of so many bytes at most in batches of 4 BATCH_BYTES at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(before) if int(before) > 0 else 10_000, 4 * BATCH_BYTES // row_bytes))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of rows with a table that has a key once. Keys of one in HEAVY rows or more go by broadcast."""
    counts = rows.groupBy(keys).agg(F.count(F.lit(1)).alias("rows"))
    total = rows.count()
    heavy = materialize(table.join(counts.where(F.col("rows") * HEAVY >= total), keys, "left_semi"), "heavy")  # HEAVY rows at most
    rest = table.join(F.broadcast(heavy.select(keys)), keys, "left_anti")
    light = rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(light.join(rest, keys))


def revisits(table: DataFrame, *, least: int = 0) -> DataFrame:
    """(record, refers_to, refers_uri): the records whose payload, of `least` bytes or more, another one has with a smaller id."""
    index = table.where("last").select("record", "id", "uri", "size", "sha1", "sha256").where(F.col("size") >= least)
    keys = ["size", "sha1", "sha256"]
    first = F.min(F.struct(id_key("id").alias("key"), "record", "uri")).alias("first")
    groups = materialize(index.groupBy(keys).agg(first, F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*keys, F.col("first.record").alias("refers_to"), F.col("first.uri").alias("refers_uri")), "groups")
    found = lookup(index, groups, keys)
    return materialize(found.where("record <> refers_to").select("record", "refers_to", "refers_uri"), "revisits")


def write(table: DataFrame, again: DataFrame, path: str | None = None) -> str:
    """Writes a chunked record table, revisits without their payloads, as an archive; returns its path."""
    spark = table.sparkSession
    path = path or f"{new_folder(spark, 'warc')}/archive"
    spark.dataSource.register(WarcSource)
    rows = table.join(again, "record", "left").where("refers_to IS NULL OR last")  # a revisit is its last row
    data = F.when(F.col("refers_to").isNull(), F.col("data")).alias("data")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").when(F.col("chunk") == 0, "response").otherwise("continuation").alias("type")
    most = table.agg(F.max(F.octet_length("data"))).first()[0] or 1
    with _batches_of(spark, most):
        rows.select("record", "chunk", "last", kind, "id", "uri", "refers_to", "refers_uri", "size", "sha1", data).write.format("warc").mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, *, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of an archive (columns as READ). Without `payload`, records in one segment give one row without data."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("chunk", str(chunk)).load(path)


def records(rows: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(record, type, id, uri, refers_to, digest, size, found) of each response and revisit among chunk rows, written once:
    the payload digest that the archive states (of a segmented record: in its last segment), the length and the digest
    of what it holds. chunk: that of the reader."""
    names = ["record", "type", "id", "uri", "refers_to", "digest", "size"]
    used = rows.where("type IN ('response', 'revisit', 'continuation') AND (segment > 0 OR last)")
    data = F.when(F.col("segment") > 0, F.col("data")).alias("data")  # the digests of other records are complete
    met = used.select(*names, "sha1", "segment", "total", "head", "chunk", "last", data).repartition("record").sortWithinPartitions("record", "segment", "chunk")
    schema = pa.schema([(n, pa.int64() if n in ("id", "size") else pa.string()) for n in (*names, "found")])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Running("sha1")
        first: dict[str, Any] | None = None  # of the segments that aren't complete yet
        for batch in batches:
            out = []
            bodies = batch.column("data")
            for k, r in enumerate(batch.drop_columns("data").to_pylist()):
                if first and first["record"] != r["record"]:
                    raise ValueError(f"segments of {first['record']} are missing")
                if r["segment"]:
                    first = first or r
                    now.add(r["record"], memoryview(bodies[k].as_buffer()))
                    if r["total"] is None or not r["last"]:
                        continue
                    if first["segment"] != 1 or now.size != r["total"] - first["head"]:
                        raise ValueError(f"segments of {r['record']} are missing")
                    r = first | {"digest": r["digest"], "size": now.size, "sha1": now.digest()}
                    first = None
                out.append({n: r[n] for n in names} | {"found": "sha1:" + base64.b32encode(r["sha1"]).decode()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if first:
            raise ValueError(f"segments of {first['record']} are missing")

    with _batches_of(rows.sparkSession, chunk):
        return materialize(met.mapInArrow(join, "record string, type string, id long, uri string, refers_to string, digest string, size long, found string"), "records")


def resolved(found: DataFrame) -> DataFrame:
    """(id, uri, payload_bytes, payload_digest, record_type, refers_to, intact) of records: of revisits, the length and the
    digest are those of the response that they name, refers_to is its id; intact: the digest is as the record states."""
    responses = found.where("type = 'response'")
    own = responses.select("id", "uri", "size", "found", "type", F.lit(None).cast("long").alias("of"), "digest")
    target = responses.select(F.col("record").alias("refers_to"), F.col("id").alias("of"), "size", "found")
    again = lookup(found.where("type = 'revisit'").select("id", "uri", "refers_to", "type", "digest"), target, ["refers_to"])
    both = own.unionByName(again.drop("refers_to"))
    return both.select("id", "uri", F.col("size").alias("payload_bytes"), F.substring("found", 6, 32).alias("payload_digest"), F.col("type").alias("record_type"), F.col("of").alias("refers_to"), (F.col("found") == F.col("digest")).alias("intact"))


def archive(pages: DataFrame, *, record: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0, path: str | None = None, chunk: int = CHUNK) -> str:
    """Writes a WARC record for each row; returns the archive's path."""
    rows = chunks(pages, record=record, uri=uri, payload=payload, chunk=chunk)
    return write(rows, revisits(rows, least=least), path)


# --- the data source ---


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Done(WriterCommitMessage):
    files: list[str]
    records: int


class WarcSource(DataSource):
    """Format `warc`: options payload (true) and chunk (CHUNK) for reading; appends to an archive."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("chunk", CHUNK)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4()
        self.date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def name_of(self, record: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(self.run, str(record))}>"

    def member(self, fields: list[tuple[str, Any]], block: bytes) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
        packed = zlib.compressobj(6, wbits=31)
        return b"".join((packed.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()), packed.compress(block), packed.compress(b"\r\n\r\n"), packed.flush()))

    def record(self, r: dict[str, Any]) -> bytes:
        """A row as a record: whole, a segment, or a revisit."""
        kind, first = r["type"], r["chunk"] == 0
        whole = kind == "revisit" or first and r["last"]
        fields = [("WARC-Type", kind), ("WARC-Record-ID", self.name_of(r["record"]) if kind != "continuation" else f"<urn:uuid:{uuid.uuid5(self.run, '%d-%d' % (r['record'], r['chunk']))}>"), ("WARC-Date", self.date)]
        fields += [("WARC-Target-URI", r["uri"] and "".join(r["uri"].splitlines())), ("Source-ID", r["id"])]
        block = (b"" if kind == "continuation" else _HEAD) + (r["data"] or b"")
        if kind == "revisit":
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", self.name_of(r["refers_to"])), ("WARC-Refers-To-Target-URI", r["refers_uri"] and "".join(r["refers_uri"].splitlines()))]
        if not whole:
            fields += [("WARC-Segment-Number", r["chunk"] + 1), ("WARC-Segment-Origin-ID", self.name_of(r["record"]) if not first else None), ("WARC-Segment-Total-Length", len(_HEAD) + r["size"] if r["last"] else None)]
        if whole or r["last"]:
            fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(r["sha1"]).decode()))
        fields += [("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("Content-Type", "application/http; msgtype=response" if kind != "continuation" else None)]
        return self.member(fields, block)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        files: list[str] = []
        out, left, count = None, 0, 0
        for batch in iterator:
            rows = batch.drop_columns("data").to_pylist()
            for k, row in enumerate(rows):  # one payload at a time
                if out is None or left <= 0:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, left = where.open_output_stream(f"{root}/{files[-1]}", compression=None), FILE_BYTES
                    out.write(self.member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", uuid.uuid4().urn.join("<>")), ("WARC-Date", self.date), ("WARC-Filename", files[-1]), ("Content-Type", "application/warc-fields")], b"software: tabulith\r\nformat: WARC File Format 1.1\r\n"))
                member = self.record(row | {"data": batch.column("data")[k].as_py()})
                out.write(member)
                left -= len(member)
                count += 1
        if out is not None:
            out.close()
        return _Done(files, count)

    def commit(self, messages: list[_Done | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        if where.get_file_info(f"{root}/{_LIST}").type == fs.FileType.File:  # appending
            with where.open_input_stream(f"{root}/{_LIST}") as f:
                files = json.loads(f.read()) + files
        with where.open_output_stream(f"{root}/{_LIST}.new") as f:
            f.write(json.dumps(files).encode())
        where.move(f"{root}/{_LIST}.new", f"{root}/{_LIST}")

    def abort(self, messages: list[_Done | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        for name in (f for m in messages if m for f in m.files):
            where.delete_file(f"{root}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool, chunk: int):
        self.path, self.payload, self.chunk = path, payload, chunk

    def partitions(self) -> list[_File]:
        where, root = fs.FileSystem.from_uri(self.path)
        if where.get_file_info(root).type == fs.FileType.File:
            return [_File(root)]
        if where.get_file_info(f"{root}/{_LIST}").type == fs.FileType.File:
            with where.open_input_stream(f"{root}/{_LIST}") as f:
                return [_File(f"{root}/{name}") for name in json.loads(f.read())]
        found = where.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives for an archive without files
            return
        where, _ = fs.FileSystem.from_uri(self.path)
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in READ.split(", "))])
        held, size = [], 0
        with where.open_input_stream(partition.path, compression=None) as raw, _opened(raw, partition.path) as stream:
            for row in self.rows(stream, partition.path):
                held.append(row)
                size += 500 + len(row[-1] or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def rows(self, stream: BinaryIO, name: str) -> Iterator[tuple]:
        """The chunk rows of a file, in its order."""
        while line := stream.readline(HEAD_BYTES):
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{name}: no record where one should begin")
            fields: dict[str, str] = {}
            key = ""
            while (line := stream.readline(HEAD_BYTES)) not in (b"\r\n", b"\n"):
                if not line:
                    raise ValueError(f"{name}: a record breaks off")
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text[:1] in " \t" and key:  # a folded line
                    fields[key] += " " + text.strip()
                else:
                    key, _, value = text.partition(":")
                    key = key.strip().lower()
                    fields[key] = value.strip()
            left = int(fields.get("content-length", "-1"))
            if left < 0:
                raise ValueError(f"{name}: a record without a length")
            kind = fields.get("warc-type")
            segment = int(fields["warc-segment-number"]) if "warc-segment-number" in fields else None
            head = 0
            start = b""
            if fields.get("content-type", "").startswith("application/http") and kind in ("response", "revisit", "request"):
                start = _taken(stream, min(left, HEAD_BYTES), name)
                left -= len(start)
                at = start.find(b"\r\n\r\n")
                head, start = (at + 4, start[at + 4 :]) if at >= 0 else (0, start)
            record = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
            total = fields.get("warc-segment-total-length")
            source = fields.get("source-id")
            common = (record, kind, int(source) if source else None, fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), segment)
            now, part, done = _Running("sha1"), 0, False
            while not done:
                data = start[: self.chunk]
                start = start[len(data) :]
                if len(data) < self.chunk and left:
                    more = _taken(stream, min(left, self.chunk - len(data)), name)
                    left -= len(more)
                    data += more
                done = not left and not start
                if segment is None:
                    now.add(0, data)
                if self.payload or segment is not None or done:
                    so_far = (now.size, now.digest()) if segment is None else (None, None)
                    yield (*common, int(total) if total else None, head, part, done, *so_far, data if self.payload or segment is not None else None)
                part += 1


def _opened(raw: BinaryIO, name: str) -> BinaryIO:
    return gzip.open(raw) if name.endswith(".gz") else io.BufferedReader(raw)


def _taken(stream: BinaryIO, many: int, name: str) -> bytes:
    """Exactly so many bytes."""
    out = stream.read(many)
    while len(out) < many:
        more = stream.read(many - len(out))
        if not more:
            raise ValueError(f"{name}: a record breaks off")
        out += more
    return out
