"""Each operator against brute force on small tables, with the odd cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from llm_cases import word_texts
from tabulith.llm import bpe, components, decontam, simhash, suffixes
from tabulith.llm.common import pick

SPACE = re.compile(r"[\x20\x09-\x0D]+")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def rows_of(frame, *keys):
    return sorted((tuple(r[k] for k in keys) for r in frame.collect()), key=repr)


# --- BPE ---


def test_bpe_equals_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    frame, rows = odd
    texts = [r[1] or "" for r in rows]
    wanted = []
    for i, t in zip((r[0] for r in rows), texts, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = rows_of(bpe.encode_decode(frame, TOKENIZER), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(wanted, key=repr)


def test_bpe_round_trip_and_bad_ids(spark):
    tables = bpe.load_tables(spark, TOKENIZER)
    frame = spark.createDataFrame([(1, "it's  a\n\n test 's", [1]), (2, None, None)], "doc_id long, text string, ids array<int>")
    encoded = bpe.encode(frame, tables)
    assert [r["decoded"] for r in bpe.decode(encoded, tables).orderBy("doc_id").collect()] == ["it's  a\n\n test 's", ""]
    odd_ids = spark.createDataFrame([(1, [64, -1, None, 10**9, 65]), (2, None)], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd_ids, tables).orderBy("doc_id").collect()] == ["ab", ""]


def test_bpe_cache_bound_changes_nothing(monkeypatch):
    import json

    tables = bpe.Tables(json.load(open(TOKENIZER)))
    texts = word_texts(2, 40)
    whole = [x.tolist() for x in bpe.Encoder(tables).encode(texts)]
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    encoder = bpe.Encoder(tables)
    flat, counts = zip(*(encoder.encode([t]) for t in texts), strict=True)
    assert [np.concatenate(flat).tolist(), np.concatenate(counts).tolist()] == whole


def test_bpe_empty_table(nothing):
    assert bpe.encode_decode(nothing, TOKENIZER).count() == 0


# --- decontamination ---


def brute_decontamination(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, odd, shard_bytes):
    frame, rows = odd
    base = word_texts(1, 12)
    items = [(1, base[0]), (1, base[0]), (2, "ONE two, THREE"), (None, base[5]), (4, None), (5, " .. "), (6, "x"), (7, base[7] + " tail"), (10, base[0][:60])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(decontam.scan(pick(frame, "doc_id", "text"), benchmark, shard_bytes=shard_bytes))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(got, *names) == brute_decontamination([(r[0], r[1]) for r in rows], items)


def test_decontaminate_keeps_columns_and_clean_rows(spark, odd, nothing):
    frame, rows = odd
    benchmark = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    kept = decontam.decontaminate(frame, benchmark)
    assert kept.columns == frame.columns
    assert kept.count() == sum(1 for x in brute_decontamination([(r[0], r[1]) for r in rows], [(1, rows[3][1])]) if not x[-1])
    assert decontam.decontaminate(frame, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)
    assert decontam.decontaminate(nothing, benchmark).count() == 0


def test_wu_manber_against_find():
    r = random.Random(3)
    for _ in range(50):
        patterns = list({"".join(r.choice("ab ") for _ in range(r.randint(4, 30))).encode() for _ in range(20)})
        text = "".join(r.choice("ab ") for _ in range(3000)).encode() + patterns[0]
        at, pattern = decontam.Matcher(patterns).search(np.frombuffer(text, np.uint8))
        wanted = {(m.start(), k) for k, p in enumerate(patterns) for m in re.finditer(b"(?=" + re.escape(p) + b")", text)}
        assert set(zip(at.tolist(), pattern.tolist(), strict=True)) == wanted


# --- SimHash ---


def brute_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(docs, radius=4):
    fps = [brute_fingerprint(t) for _, t in docs]
    key = [-1 if i is None else i for i, _ in docs]
    label = list(key)
    while True:
        new = [min(label[j] for j in range(len(docs)) if key[i] == key[j] or (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(docs))]
        if new == label:
            return sorted(((i, f"{f:016x}", None if c < 0 else c) for (i, _), f, c in zip(docs, fps, label, strict=True)), key=repr)
        label = new


def test_simhash_equals_brute_force(spark, odd):
    frame, rows = odd
    assert rows_of(simhash.classes(frame), "doc_id", "fingerprint", "component_id") == brute_classes([(r[0], r[1]) for r in rows])


def test_simhash_near_copies(spark):
    texts = word_texts(4, 20, 300)
    near = [t + " tail" for t in texts[:10]] + [t.upper() for t in texts[10:]]
    docs = list(enumerate(texts + near))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(simhash.classes(frame), "doc_id", "fingerprint", "component_id") == brute_classes(docs)


def exact_sets(texts):
    """Five-word shingles of each text, by plain Python."""
    out = []
    for t in texts:
        words = [w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def similar_pairs(sets, near=0.8):
    """Every pair of `near` or more, from an inverted index of all shingles."""
    number, pairs = {}, []
    rows = [np.array(sorted(number.setdefault(s, len(number)) for s in x), np.int64) for x in sets]
    sizes = np.array([len(x) for x in rows])
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(flat, kind="stable")
    holders, begins = of[order], np.searchsorted(flat[order], np.arange(len(number) + 1))
    empty = np.flatnonzero(sizes == 0)
    pairs += [(a, b) for i, a in enumerate(empty.tolist()) for b in empty[:i].tolist()]
    for i, row in enumerate(rows):
        if len(row):
            met = np.bincount(np.concatenate([holders[begins[s] : begins[s + 1]] for s in row.tolist()]), minlength=i)[:i]
            pairs += [(i, int(j)) for j in np.flatnonzero(met) if met[j] / (sizes[i] + sizes[j] - met[j]) >= near]
    return pairs


def check_kept(docs, left, recall):
    """Each removed text has a kept partner; of all similar pairs, so many lost a member."""
    sets = exact_sets([t for _, t in docs])
    stays = np.array([i in left for i, _ in docs])
    pairs = similar_pairs(sets)
    held = {x for a, b in pairs for x, y in ((a, b), (b, a)) if stays[y]}
    assert [docs[i][0] for i in np.flatnonzero(~stays).tolist() if i not in held] == []
    assert sum(not (stays[a] and stays[b]) for a, b in pairs) >= recall * len(pairs)
    return len(pairs)


def test_simhash_dedup_of_odd_rows(spark, odd, nothing):
    """Rows that share an id or lack one are told apart; equal ones are copies."""
    frame, rows = odd
    kept = simhash.dedup(frame)
    assert kept.columns == frame.columns
    ids = [x["_0"] for x in kept.toDF(*[f"_{i}" for i in range(len(frame.columns))]).collect()]
    sets = exact_sets([r[1] for r in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    stay = []
    for i in order:
        if not any(jaccard(sets[i], sets[j]) >= 0.8 for j in stay):
            stay.append(i)
    assert collections.Counter(ids) == collections.Counter(rows[i][0] for i in stay)
    assert simhash.dedup(nothing).count() == 0


def chains(links, size=200):
    """Texts each of which has some words of its predecessor changed: neighbours are similar, the ends aren't."""
    r, docs = random.Random(links), []
    for _ in range(12):
        words = [f"w{r.randrange(10**7)}" for _ in range(size)]
        for _ in range(links):
            docs.append(" ".join(words))
            at = r.randrange(size - 3)
            words[at : at + 3] = [f"n{r.randrange(10**7)}" for _ in range(3)]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [3, simhash.BLOCK])
def test_dedup_of_chains_keeps_a_partner(spark, block):
    docs = chains(25)
    left = {x["doc_id"] for x in simhash.dedup(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()}
    assert check_kept(docs, left, 0.95) > 500


def test_settled_is_a_maximal_choice(spark):
    """In a family in which all are candidates, no similar pair stays and whatever goes has a partner that stays."""
    docs = chains(20)
    sets = simhash.shingle_sets(spark.createDataFrame([(i, t.encode()) for i, t in docs], "k long, text binary"))
    left = spark.createDataFrame([(i, -1 - i % 2) for i, _ in docs], "node long, root long")
    gone = {x["gone"] for x in simhash.settled(left, sets, 0.8, 16).collect()}
    exact = exact_sets([t for _, t in docs])
    pairs = [(a, b) for a, b in similar_pairs(exact) if a % 2 == b % 2]
    assert all(a in gone or b in gone for a, b in pairs)
    assert gone == {x for a, b in pairs for x, y in ((a, b), (b, a)) if x in gone and y not in gone}


def test_dedup_of_the_largest_driver_table(spark):
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    left = {x["doc_id"] for x in simhash.dedup(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}
    print(len(docs) - len(left), "removed,", check_kept(docs, left, 0.9), "pairs")


@pytest.mark.parametrize("hot", [3, simhash.HOT])
def test_dedup_finds_near_copies_and_leaves_others(spark, hot):
    """Copies with a share of their words changed: recall by similarity of five-word shingles; no other text goes."""
    r, docs, origin = random.Random(13), [], {}
    texts = [t for t in word_texts(17, 90, 500) if len(t.split()) > 60]
    shingles = lambda t: set(zip(*(t.split()[i:] for i in range(5)), strict=False))
    for t in texts:
        docs.append((len(docs), t))
    for k, t in enumerate(texts):
        for _ in range(4):
            words = t.split()
            for _ in range(r.randint(1, max(1, len(words) // 50))):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            origin[len(docs)] = k
            docs.append((len(docs), " ".join(words)))
    r.shuffle(docs)
    left = {x["doc_id"] for x in simhash.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), hot=hot).collect()}
    assert set(range(len(texts))) <= left  # the least id of each group
    text = dict(docs)
    similar = [i for i, k in origin.items() if len(shingles(text[i]) & shingles(text[k])) >= 0.8 * len(shingles(text[i]) | shingles(text[k]))]
    assert len(similar) > 150 and sum(i not in left for i in similar) >= 0.95 * len(similar)


def test_bands_follow_the_number_of_texts():
    for n in (0, 10**5, 10**7, 10**10):
        bits, each, words, radius = simhash.bands_for(n)
        assert bits * each <= 64 and n >> bits <= simhash.BUCKET and 1 - (1 - 0.849**bits) ** (each * words) > 0.93
        assert 0.15 * 64 * words < radius < 0.21 * 64 * words


def test_bucket_tiles_equal_all_pairs():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base[:40] ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]]))
    key = r.integers(0, 3, len(fps))
    order = np.lexsort((fps, np.bitwise_count(fps), key))
    key, fps = key[order], fps[order]
    x, y = np.nonzero((np.bitwise_count(fps[:, None] ^ fps[None]) <= 4) & (key[:, None] == key[None]))
    assert (simhash.bucket_labels(key, fps, tile=64) == simhash._join(np.arange(len(fps)), x, y)).all()


@pytest.mark.parametrize(("hot", "depth"), [(1, 2), (3, 3), (10**6, 1)])
def test_links_through_cut_buckets_lose_nothing(spark, hot, depth):
    r = np.random.default_rng(7)
    base = r.integers(0, 2**63, 12, dtype=np.uint64)
    flip = lambda x, n: x ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in r.choice(64, n, replace=False)])
    fps = np.unique(np.array([flip(b, int(n)) for b in base for n in r.integers(1, 6, 12)], np.uint64))
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    wanted = simhash._join(np.arange(len(fps)), x, y)
    frame = spark.createDataFrame([(int(f.view(np.int64)), i) for i, f in enumerate(fps)], "fp long, least long")
    got = {e["node"]: e["root"] for e in components.components(simhash.links(frame, hot=hot, depth=depth)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == wanted.tolist()


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**9, 10**11)] == [6, 6, 7, 8]
    assert len(simhash._masks(0, 4, 6)) == 15 and all(m.bit_count() >= 20 for m in simhash._masks(0, 4, 6))
    assert simhash._masks((1 << 64) - 1, 4, 6) == [(1 << 64) - 1]


def test_bpe_refuses_other_kinds_of_files():
    import json

    spec = json.load(open(TOKENIZER))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        with pytest.raises(ValueError):
            bpe.Tables(spec | change)


@pytest.mark.parametrize("split_at", [1, components.SPLIT])
def test_components_of_paths_stars_and_cycles(spark, split_at):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    r.shuffle(links)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long"), split_at=split_at).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 180)}, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffix dedup ---


def brute_suffixes(docs, width):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, _stored(docs[i][1])))
    seen, out = set(), []
    for i in order:
        text = (docs[i][1] or "").encode()
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - width + 1):
            w = text[s : s + width]
            gone[s : s + width] |= w in seen
            seen.add(w)
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(text) else 0
        out.append((docs[i][0], len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _stored(text):
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress((text or "").encode())


NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffixes_equal_brute_force_on_odd_rows(spark, odd, nothing):
    frame, rows = odd
    assert rows_of(suffixes.report(suffixes.spans(frame)), *NAMES) == brute_suffixes([(r[0], r[1]) for r in rows], 100)
    assert suffixes.report(suffixes.spans(nothing)).count() == 0


def test_rows_without_an_id_are_as_cheap_as_others(spark):
    """All share a passage; one array of all their anchors for each row would grow with the square."""
    import time

    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    texts = [f"{i} {''.join(r.choice('klmnopq ') for _ in range(150))} {passage}" for i in range(6000)]
    took = []
    for ids in (range(6000), [None] * 6000, [7 if i % 3 else i for i in range(6000)]):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
        began = time.perf_counter()
        out = suffixes.report(suffixes.spans(docs)).agg({"n_removed": "sum", "n_spans": "sum"}).first()
        took.append(time.perf_counter() - began)
        assert out["sum(n_removed)"] >= 5999 * 300 and out["sum(n_spans)"] == 5999
    assert max(took[1:]) < 3 * took[0] + 5


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "é1"])
@pytest.mark.parametrize("hot", [2, suffixes.HOT])
def test_suffixes_equal_brute_force_on_shared_passages(spark, letters, hot):
    r = random.Random(len(letters))
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [make(r.randint(20, 200)) for _ in range(6)]
    docs = [(i * 3, make(r.randint(0, 80)) + r.choice(passages)[r.randint(0, 15) :] + make(r.randint(0, 40)) + r.choice(passages)[: r.randint(10, 150)]) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows_of(suffixes.report(suffixes.spans(frame, width=40, gram=12, hot=hot)), *NAMES) == brute_suffixes(docs, 40)


def test_shared_grams_across_batches(spark):
    s = 60 << 12 | 100
    several = [(7, c, s, k, 5) for c in range(9) for k in (c, c + 20)]
    two, one, lone = [(8, c, s, c, 5) for c in range(2)], [(9, 3, s, k, 5) for k in range(4)], [(10, 0, s, 0, 5)]
    gone = [(11, 200, suffixes.GONE, 1, 5)]
    for rows in (100, 2, 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        frame = spark.createDataFrame(several + two + one + lone + gone, "h long, c long, s int, k long, loc long")
        found = sorted(((x["h"], x["c"], x["s"], x["k"], x["hot"], x["tk"]) for x in suffixes._shared(frame, 4).collect()), key=repr)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        firsts = [(7, c, s, c, True, None) for c in range(9)] + [(8, c, s, c, False, None) for c in range(2)]
        pairs = [(7, c, s, c, False, c + 20) for c in range(9)] + [(9, 3, s, k, False, k + 1) for k in range(3)]
        assert found == sorted([*firsts, *pairs, (11, 200, suffixes.GONE, 1, False, None)], key=repr)


def test_equal_hashes_remove_nothing_that_differs(spark):
    """Anchors that claim to agree: only where the bytes do is a stretch removed."""
    r = random.Random(3)
    texts = ["".join(r.choice("abcdef") for _ in range(300)) for _ in range(3)]
    docs = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, texts[0])], "doc_id long, text string")
    dealt = suffixes._dealt(docs, False)
    s = 60 << 12 | 100
    # the context of document 0 at place 100 is claimed for documents 1 (another text) and 2 (the same)
    claims = [(5, 9, s, 0, 100, False, 1, 100), (5, 9, s, 0, 100, False, 2, 100), (5, 9, s, 0, 130, False, 2, 130)]
    shared = spark.createDataFrame(claims, "h long, c long, s int, k long, loc long, hot boolean, tk long, tloc long")
    got = suffixes._compared(suffixes._fetched(dealt, shared, 100), 100, 32).collect()
    assert sorted((x["k"], x["n"], x["lo"], x["hi"], bytes(x["proof"]).decode()) for x in got) == [(1, 0, 40, 200, texts[0][40:200]), (2, 0, 40, 230, texts[0][40:230])]
    out = suffixes.removed(dealt, spark.createDataFrame(got, "k long, n long, lo long, hi long, proof binary"))
    assert {x["k"]: (x["begins"], x["ends"]) for x in out.collect()} == {0: ([], []), 1: ([], []), 2: ([40], [230])}


@pytest.mark.parametrize("hashes", ["sound", "equal", "few"])
def test_windows_of_contexts_equal_brute_force_whatever_the_hashes(monkeypatch, hashes):
    if hashes != "sound":  # forced collisions: all strings, or one in four, have equal hashes
        monkeypatch.setattr(suffixes, "mix", lambda h: h & np.uint64(3 if hashes == "few" else 0))
    r, width, gram = random.Random(9), 24, 8
    for _ in range(30):
        grams = [bytes(r.choice(b"ab") for _ in range(gram)) for _ in range(2)]
        rows = sorted((r.randint(0, 1), i, bytes(r.choice(b"ab") for _ in range(r.randint(0, 3))) * 6, bytes(r.choice(b"ab") for _ in range(r.randint(0, 3))) * 6) for i in range(40))
        group, left = [g for g, *_ in rows], [a[-(width - gram) :] for _, _, a, _ in rows]
        right = [(r.choice(grams) + b)[:width] for _, _, _, b in rows]  # grams of equal hash may differ too
        flat = np.frombuffer(b"".join(a + b for a, b in zip(left, right, strict=True)), np.uint8)
        sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)])
        place = np.cumsum(sizes.sum(1)) - sizes[:, 1]
        least, most, same = suffixes.repeated(np.array(group), flat, place, sizes[:, 0], sizes[:, 1], width, gram)
        seen, contexts = set(), set()
        for i in range(len(rows)):
            mine = {o: (group[i], o, (left[i] + right[i])[sizes[i, 0] - o :][:width]) for o in range(width - gram + 1) if o <= sizes[i, 0] and width - o <= sizes[i, 1]}
            lost = [o for o, w in mine.items() if w in seen]
            whole = (group[i], left[i], right[i]) in contexts
            assert whole == same[i]
            if mine:
                assert (least[i], most[i]) == ((min(lost), max(lost)) if lost else (width, -1))
            seen |= set(mine.values())
            contexts.add((group[i], left[i], right[i]))


def test_suffix_sort_equals_sorted():
    r = random.Random(8)
    for _ in range(20):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) for _ in range(120)]
        group = np.sort(np.array([r.randint(0, 5) for _ in strings]))
        lengths = np.array([len(s) for s in strings], np.int64)
        side = suffixes.Suffixes(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths, 40)
        order, common = side.ranked(group)
        assert order.tolist() == sorted(range(len(strings)), key=lambda i: (group[i], strings[i], i))
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            extension = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[k] == (extension if group[order[k]] == group[order[k - 1]] else -1)


def test_remove_repeats_keeps_columns(spark, odd, nothing):
    frame, rows = odd
    out = suffixes.remove_repeats(frame)
    assert out.columns == frame.columns and out.count() == len(rows)
    assert [f.dataType for f in out.schema] == [f.dataType for f in frame.schema]
    renamed = out.toDF(*[f"_{i}" for i in range(len(out.columns))])
    assert all((r["_1"] is not None) and r["_4"] == len(r["_1"]) for r in renamed.collect())
    assert suffixes.remove_repeats(nothing).count() == 0
