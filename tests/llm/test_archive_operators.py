"""WARC archives, Merkle manifests and spelling variants against brute force on small tables, with the odd cases."""

import base64
import collections
import gzip
import hashlib
import itertools
import random
import zlib

import pytest
from llm_cases import word_texts
from pyspark.sql import functions as F
from tabulith.llm import merkle, variants, warc


def rows_of(frame, *keys):
    return sorted((tuple(r[k] for k in keys) for r in frame.collect()), key=repr)


# --- WARC ---

RESOLVED = ("id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def wanted_records(rows, least=0):
    """Rows (id, uri, payload) as they should come back; of rows with equal id and payload the uri is left out."""
    first, out = {}, []
    for i, uri, payload in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        body = (payload or "").encode()
        again = len(body) >= least and body in first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[body] if again else None, True))
        first.setdefault(body, i)
    return sorted(out, key=repr)


def pages(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, a string, b string, c string")
    return frame.toDF("page_id", "url", "html", "record", "data", "HTML").repartition(3)


def page_rows():
    r = random.Random(4)
    texts = [f"<p>{t}</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n{t}" for t in word_texts(9, 30, 80)]
    rows = [(i, f"http://h{i}.org/é", r.choice(texts)) for i in range(60)]
    rows += [(100 + i, "u", "same") for i in range(40)]  # one group of copies holds a third of the rows
    rows += [(None, None, None), (200, None, ""), (201, "line\r\nbreak: x", "é😀" * 700), (None, "n", "same"), (7, "again", rows[7][2]), (202, "long", "é" * 5000)]
    return rows


@pytest.mark.parametrize("chunk", [32 << 10, 1000, 64])
@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, chunk, least):
    rows = page_rows()
    path = warc.archive(pages(spark, rows), chunk=chunk, least=least)
    keys = ("id", *RESOLVED[2:])
    for payload in (True, False):
        out = warc.resolved(warc.records(warc.read(spark, path, payload=payload, chunk=chunk), chunk=chunk))
        assert out.columns == list(RESOLVED)
        assert rows_of(out, *keys) == wanted_records(rows, least)


def test_warc_chunks_hold_the_payloads(spark):
    rows = page_rows()
    table = warc.chunks(pages(spark, rows), chunk=100)
    assert table.where(F.octet_length("data") > 100).count() == 0
    texts = collections.Counter()
    for _, part in itertools.groupby(sorted(table.collect(), key=lambda r: (r["record"], r["chunk"])), key=lambda r: r["record"]):
        body = b""
        for k, c in enumerate(part):
            body += c["data"]
            assert (c["chunk"], c["size"], bytes(c["sha1"]), bytes(c["sha256"])) == (k, len(body), hashlib.sha1(body).digest(), hashlib.sha256(body).digest())
        texts[body.decode()] += 1
    assert texts == collections.Counter(r[2] or "" for r in rows)
    # and so do those that are read back, in whatever segments they were written
    path = warc.write(table, warc.revisits(table, least=1 << 30))
    back = collections.defaultdict(bytes)
    for r in sorted(warc.read(spark, path, chunk=30).where("type <> 'warcinfo'").collect(), key=lambda r: (r["record"], r["segment"] or 0, r["chunk"])):
        assert len(r["data"]) <= 30
        back[r["record"]] += bytes(r["data"])
    assert collections.Counter(b.decode() for b in back.values()) == texts


def test_warc_files_are_warc(spark, tmp_path):
    """Read by the standard's rules alone."""
    path = f"file://{tmp_path}/archive"
    warc.archive(pages(spark, page_rows()), chunk=500, path=path)
    origins, seen, totals = {}, collections.Counter(), {}
    for file in (tmp_path / "archive").glob("*.warc.gz"):
        data = gzip.open(file).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            assert version == "WARC/1.1"
            block, data = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            seen[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] != "warcinfo":
                assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
                origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
                origins.setdefault(origin, {})[int(fields.get("WARC-Segment-Number", 1))] = block
                if "WARC-Segment-Total-Length" in fields:
                    totals[origin] = int(fields["WARC-Segment-Total-Length"]), fields["WARC-Payload-Digest"]
    assert seen["response"] and seen["revisit"] and seen["continuation"] and totals
    for origin, (total, stated) in totals.items():
        whole = b"".join(block for _, block in sorted(origins[origin].items()))
        assert len(whole) == total and sorted(origins[origin]) == list(range(1, len(origins[origin]) + 1))
        assert stated == "sha1:" + base64.b32encode(hashlib.sha1(whole.partition(b"\r\n\r\n")[2]).digest()).decode()


def record(fields, block):
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_warc_of_others(spark, tmp_path):
    """Plain and packed files, folded lines, other types, an HTTP head, no head, a record much longer than a chunk."""
    body = b"a\r\n\r\nb" * 5000
    stated = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    long = record({"WARC-Type": "response", "WARC-Record-ID": "<a>", "WARC-Target-URI": "http://x\r\n /y", "WARC-Payload-Digest": stated, "content-type": "application/http"}, b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" + body)
    others = record({"WARC-Type": "metadata", "WARC-Record-ID": "<m>"}, b"k: v") + record({"WARC-Type": "resource", "WARC-Record-ID": "<r>"}, b"")
    wrong = record({"WARC-Type": "response", "WARC-Record-ID": "<w>", "WARC-Payload-Digest": stated, "Content-Type": "application/http"}, b"no head")
    again = record({"WARC-Type": "revisit", "WARC-Record-ID": "<v>", "WARC-Refers-To": "<a>", "WARC-Payload-Digest": stated}, b"")
    (tmp_path / "a.warc").write_bytes(long + others)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(wrong) + gzip.compress(again))
    (tmp_path / "c.txt").write_bytes(b"not one")
    rows = warc.read(spark, f"file://{tmp_path}", chunk=1000)
    assert rows.where("record = '<a>'").count() == -(-len(body) // 1000)
    found = warc.records(rows)
    assert rows_of(found, "record", "uri", "size") == [("<a>", "http://x /y", len(body)), ("<v>", None, 0), ("<w>", None, 7)]
    assert rows_of(warc.resolved(found), "record_type", "payload_bytes", "intact") == [("response", len(body), True), ("response", 7, False), ("revisit", len(body), True)]


@pytest.mark.parametrize("data", [b"junk", record({"WARC-Type": "response"}, b"x" * 100)[:-50], b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nWARC-Type"])
def test_warc_broken_files_raise(spark, tmp_path, data):
    (tmp_path / "a.warc").write_bytes(data)
    with pytest.raises(Exception, match="no record|breaks off|without a length"):
        warc.read(spark, f"file://{tmp_path}").count()


@pytest.mark.parametrize("gone", [2, 3, 1])
def test_warc_lost_segments_raise(spark, tmp_path, gone):
    part = lambda k, more: record({"WARC-Type": "response" if k == 1 else "continuation", "WARC-Record-ID": "<a>" if k == 1 else f"<{k}>", "WARC-Segment-Number": k, "Content-Type": "application/http"} | ({} if k == 1 else {"WARC-Segment-Origin-ID": "<a>"}) | more, b"H\r\n\r\n12" if k == 1 else b"12")
    parts = {1: part(1, {}), 2: part(2, {}), 3: part(3, {"WARC-Segment-Total-Length": 11})}
    (tmp_path / "a.warc").write_bytes(parts[3] + parts[1] + parts[2])  # in any order
    assert rows_of(warc.records(warc.read(spark, f"file://{tmp_path}/a.warc")), "record", "size") == [("<a>", 6)]
    (tmp_path / "b.warc").write_bytes(b"".join(p for k, p in parts.items() if k != gone))
    with pytest.raises(Exception, match="missing"):
        warc.records(warc.read(spark, f"file://{tmp_path}/b.warc"))


def test_warc_reads_finished_tasks_only(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    frame = pages(spark, page_rows()[:20])
    warc.archive(frame, path=path)
    before = warc.read(spark, path).count()
    (tmp_path / "archive" / "left-behind.warc.gz").write_bytes(b"half a fi")
    assert warc.read(spark, path).count() == before
    warc.archive(frame, path=path)  # appends
    assert warc.read(spark, path).where("type = 'response'").count() == 2 * warc.read(spark, path).where("type = 'response'").select("record").distinct().count() / 2 > 0


def test_warc_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.resolved(warc.records(warc.read(spark, warc.archive(empty)))).count() == 0


def test_warc_keeps_the_sessions_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    warc.archive(pages(spark, page_rows()[:3]))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_lookup_takes_heavy_keys_apart(spark, monkeypatch):
    monkeypatch.setattr(warc, "HEAVY", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("other", 4)], "k string, v int")
    assert rows_of(warc.lookup(rows, table, ["k"]), "i", "v") == sorted([(i, 1) for i in range(60) if i % 3] + [(0, 2), (3, 3)], key=repr)


# --- Merkle ---


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes, arity):
    """The root and each leaf's siblings, level by level."""
    paths = [[] for _ in nodes]
    now = [(h, [i]) for i, h in enumerate(nodes)]
    while len(now) > 1:
        above = []
        for k in range(0, len(now), arity):
            run = now[k : k + arity]
            for j, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1 :])))
            above.append((sha("".join(h for h, _ in run)), [i for _, below in run for i in below]))
        now = above
    return now[0][0], paths


def plain_manifest(rows, arity=3):
    """(doc_id, source, leaf, subroot, root, proof) of rows (doc_id, text, lang, source, n_chars)."""
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        leaves[source].append((i, sha("".join(map(code, (i, source, lang, n, text))))))
    groups = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in groups:
        leaves[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(plain_tree([h for _, h in leaves[g]], arity))
    root, upper = plain_tree([t[0] for t in trees], arity) if trees else (None, [])
    return sorted([(i, g, h, sub, root, p + up) for g, (sub, paths), up in zip(groups, trees, upper, strict=True) for (i, h), p in zip(leaves[g], paths, strict=True)], key=repr)


def manifest_rows(frame):
    return sorted([(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in frame.collect()], key=repr)


@pytest.mark.parametrize(("step", "step_up", "arity"), [(10, 7, 3), (1, 1, 3), (2, 1, 3), (1, 2, 2), (2, 2, 5)])
def test_manifest_equals_plain_trees(spark, step, step_up, arity):
    """Groups of many sizes, one with a third of the rows, over more partitions than a block has leaves."""
    r = random.Random(step)
    sizes = {None: 3, "": 1, "a": 27, "b": 9, "c": 10, "é": 2, "z": 28, "hot": 70}
    rows = [(i, f"t{i}\n", None, g, i) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = manifest_rows(merkle.manifest(docs, step=step, step_up=step_up, arity=arity))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_manifest(rows, arity)


def test_manifest_of_odd_rows(spark, odd):
    frame, rows = odd
    out = merkle.manifest(frame, keep={"size": F.length("text"), "lang": F.upper("lang")})
    assert out.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof", "size", "lang"]
    assert manifest_rows(out) == plain_manifest([r[:5] for r in rows])
    assert out.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    # another leaf gives another root
    assert out.where(merkle.fold(F.sha2(F.col("leaf").cast("binary"), 256), F.col("proof")) == F.col("root")).count() == 0


def test_manifest_of_one_row_and_none(spark, nothing):
    one = spark.createDataFrame([(1, "x", "en", "s", 1)], nothing.schema)
    (got,) = merkle.manifest(one).collect()
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof"] == []
    assert merkle.manifest(nothing).count() == 0


def test_manifest_of_equal_rows(spark):
    """They spread over partitions and are interchangeable."""
    rows = [(1, "same", None, "s", 1)] * 40 + [(2, "x", None, "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_rows(merkle.manifest(docs, step=1, step_up=1)) == plain_manifest(rows)


@pytest.mark.parametrize("total", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80])
def test_levels_from_any_place(total):
    """Nodes of two neighbouring stretches, with what is missing between them, make the whole tree."""
    leaves = [sha(str(i)) for i in range(total)]
    full = merkle.levels_of(leaves, 0, total, 99, 3)
    assert full[-1][1] == [plain_tree(leaves, 3)[0]] and len(full) - 1 == merkle.height(total, 3)
    for cut in range(1, total):
        for part, start in ((leaves[:cut], 0), (leaves[cut:], cut)):
            for level, (low, nodes) in enumerate(merkle.levels_of(part, start, total, 99, 3)):
                assert nodes == full[level][1][low : low + len(nodes)]


# --- spelling variants ---


def plain_words(rows, misspell, least_length=6, least_count=5):
    counts = collections.Counter()
    for i, text in rows:
        run = ""
        for ch in [*(text or ""), " "]:
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if misspell and h % misspell == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


KEYS = ("word", "n", "n_near", "form", "form_n", "root")


def many_words(seed, n):
    r = random.Random(seed)
    letters = "abé"
    words = {"".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(n)} | {"a" * k for k in range(5, 40)}
    return {w: 5 ** r.randint(1, 4) + r.randint(0, 9) for w in words}


@pytest.mark.parametrize("most", [1, 20, 10**9])
def test_near_pairs_equal_brute_force(spark, most):
    """Three letters: segments are shared by very many words, and repeated letters meet by both segments."""
    words = many_words(most, 250)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    pairs = variants.near_pairs(frame, most=most)
    got = [tuple(sorted(p)) for p in rows_of(pairs, "a", "b")]
    assert sorted(got) == sorted((a, b) for a, b in itertools.combinations(sorted(words), 2) if one_edit(a, b))
    assert rows_of(variants.variants(frame, pairs), *KEYS) == plain_variants(words)


def test_no_bucket_holds_more_than_its_bound(spark):
    """A third of the words begin alike: they are told apart by what else stays whole."""
    words = many_words(3, 300) | {"commonbeginning" + "".join(t): 5 for t in itertools.product("abcdefgh", repeat=3)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    seen = []
    plain = variants._verified

    def watched(rows):
        seen.append(rows.groupBy(*variants._KEY).agg(F.count_if(F.col("longer") == 0).alias("a"), F.count(F.lit(1)).alias("b")).where("y - x > 1").agg(F.max(F.col("a") * F.col("b"))).first()[0])
        return plain(rows)

    variants._verified = watched
    try:
        got = variants.near_pairs(frame, most=50).count()
    finally:
        variants._verified = plain
    assert len(seen) > 2 and max(x for x in seen if x) <= 50
    assert got == sum(one_edit(a, b) for a, b in itertools.combinations(words, 2))


@pytest.mark.parametrize("misspell", [None, 7])
def test_groups_of_texts(spark, odd, misspell):
    frame, rows = odd
    texts = [(i, " ".join(t)) for i, t in enumerate(itertools.batched((w for w, n in many_words(5, 60).items() for _ in range(min(n, 30))), 40))]
    texts += [(None, "Élevéed éLEVÉED Élevéed élevÉed"), (1, "Straße×÷ straße×÷, STRAßE×÷1straße×÷ straße×÷ don't"), (1, None), (2, "")] + [r[:2] for r in rows]
    docs = spark.createDataFrame([(*t, "w", 1) for t in texts], "doc_id long, text string, word string, n int").repartition(4)
    words = plain_words(texts, misspell)
    assert rows_of(variants.group(docs, misspell=misspell), *KEYS) == plain_variants(words) and words


def test_forms_follow_to_the_last(spark):
    """Counts that rise fivefold from word to word, and ties."""
    chain = {"aaaaaa" + "b" * k: 5 ** (k + 1) for k in range(9)}
    ties = {"wordsx": 5, "wordsy": 30, "wordsz": 30, "lonely": 9}
    words = chain | ties
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    out = rows_of(variants.variants(frame, variants.near_pairs(frame)), *KEYS)
    assert out == plain_variants(words)
    assert {r[5] for r in out if r[0].startswith("aaaaaa")} == {"aaaaaa" + "b" * 8} and ("wordsx", 5, 2, "wordsy", 30, "wordsy") in out
    with pytest.raises(ValueError, match="ratio"):
        variants.variants(frame, variants.near_pairs(frame), ratio=1)


def test_variants_of_nothing(spark, nothing):
    assert variants.group(nothing).count() == 0


def test_words_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD_WORDS", 10)
    texts = [(i, t) for i, t in enumerate(word_texts(8, 60))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in variants.word_counts(docs, misspell=3).collect()} == plain_words(texts, 3)
