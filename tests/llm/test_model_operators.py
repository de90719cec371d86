"""The learning and counting operators: exact parts against brute force, models on held-out rows."""

import collections
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from llm_cases import word_texts
from pyspark.sql import functions as F
from tabulith.llm import ngram, quality, rollup, rules, toxicity, urls


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


# --- language model ---

def brute_base(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    counts = collections.Counter(w for i, t in rows if crc(i) % 5 != 1 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        out.append((i, crc(i) % 5 == 1, len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)))
    return sorted(out, key=repr)


def found_base(frame):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("together", [1, 1 << 20])
def test_lm_counts_and_base_equal_brute_force(spark, odd, together):
    frame, rows = odd  # chunks of one text, or of all of a partition
    assert found_base(ngram.score(frame, together=together)) == brute_base([(r[0], r[1]) for r in rows])


def test_lm_empty_table_and_no_training(spark, nothing):
    assert ngram.score(nothing).count() == 0
    held = [i for i in range(100) if crc(i) % 5 == 1][:5]
    rows = [(i, "a b") for i in held]
    assert found_base(ngram.score(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_base(rows)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_beats_the_base_on_held_out_text(spark, order):
    r = random.Random(1)
    follows = {w: r.sample(range(60), 3) for w in range(60)}

    def text():
        w, out = r.randrange(60), []
        for _ in range(80):
            out.append(f"w{w}")
            w = r.choice(follows[w])
        return " ".join(out)

    frame = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    rows = ngram.score(frame, order=order).where("held_out").collect()
    score, base = (sum(x[c] for x in rows) for c in ("score", "base_score"))
    assert score > 0.6 * base if order > 1 else abs(score / base - 1) < 0.05


def test_lm_levels_bound_counts_and_are_all_found():
    counts = np.array([1, 2, 3, 10, 1000, 10**6, 0])
    keys = ngram.Keys(11)
    h = np.sort(keys.of_tokens(np.arange(1, 8, dtype=np.uint64)))
    q = ngram.levels(keys.single(h), counts, (1.1, 1.5))
    assert (1.1 ** (q - 1) <= np.maximum(counts, 1) * (1 + 1e-12)).all() and (1.1**q > counts).all() and q[-1] == 0
    model = ngram.Filter(keys.segment(h), h, q, 10, 4)
    assert (model.level(h, keys.segment(h)) >= q).all() and (model.level(h, keys.segment(h))[:-1] < q[:-1] + 3).all()


def test_lm_keys_pack_and_filter_size_follows_the_levels():
    keys = ngram.Keys(12)
    h = np.sort(keys.of_grams(np.arange(50_000, dtype=np.uint64), np.array([50_000]), 2)[0])
    at = keys.segment(h) == 7
    back, n = keys.unpack(keys.pack(h[at], np.arange(at.sum()) * 70_000), 7)
    assert (back == h[at]).all() and (n == np.arange(at.sum()) * 70_000).all() and not keys.single(h).any()
    for part in (h[:5000], h):
        model = ngram.Filter(keys.segment(part), part, np.full(len(part), 2), 10, 4)
        assert 20 * len(part) <= 64 * len(model.words) <= 20 * len(part) + 64 * len(model.segments)
        assert (model.level(part, keys.segment(part)) >= 2).all()
        away = ngram.mix(part) & keys.kept
        away = away[np.isin(keys.segment(away), model.segments)]
        assert (model.level(away, keys.segment(away)) > 0).mean() < 0.05


def brute_scores(rows, order, bases):
    """Scores from exact counts cut to levels, weights by leave-one-out: no filter."""
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    count = collections.Counter()
    for i, w in tokens.items():
        if crc(i) % 5 != 1:
            for n in range(1, order + 1):
                count.update(tuple([b""] * max(0, n - 1 - k) + w[max(0, k - n + 1) : k + 1])[-n:] if k >= n - 1 or n == 2 else (None, n, *w[: k + 1]) for k in range(len(w)))
    total = sum(c for g, c in count.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in count)

    def level(g, n):
        c = count.get(g, 0)
        return 0 if not c else 1 + max(q for q in range(400) if bases[n > 1] ** q <= c * (1 + 1e-15))

    def gram(w, k, n):
        return tuple(w[k - n + 1 : k + 1]) if k >= n - 1 else (b"", *w[:1]) if n == 2 else (None, n, *w[: k + 1])

    def parts(w):
        below = [level((x,), 1) for x in w]
        for n in range(2, order + 1):
            above = [(level((b"",), 1) if n == 2 else 0) if k == 0 else below[k - 1] for k in range(len(w))]
            below = [level(gram(w, k, n), n) if above[k] and below[k] else 0 for k in range(len(w))]
            yield above, below

    again, every = collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if crc(i) % 5 != 1:
            for n, (above, below) in enumerate(parts(w)):
                for a, q in zip(above, below, strict=True):
                    every[n, a] += 1
                    again[n, a] += q > 1
    out = {}
    for i, w in tokens.items():
        p = [(min(bases[0] ** (q - 1), total) * (q > 0) + 0.5) / (total + 0.5 * (distinct + 1)) for q in (level((x,), 1) for x in w)]
        for n, (above, below) in enumerate(parts(w)):
            for k, (a, q) in enumerate(zip(above, below, strict=True)):
                weight = again[n, a] / (every[n, a] + 1) if a else 0
                p[k] = weight * min((bases[1] ** (q - 1) if q else 0) / max(bases[min(n, 1)] ** a, 1), 1) + (1 - weight) * p[k]
        out[i] = sum(map(math.log10, p))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_equal_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(ngram, "LEAST_SEGMENT_BITS", 2)  # segments as full as those of large tables
    texts = word_texts(14, 80)
    rows = [(i, texts[i // 2] if i % 3 == 0 else t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = brute_scores(rows, order, ngram.BASES)
    # so many bits that no false positive is left
    for r in ngram.score(frame, order=order, level_bits=4000).collect():
        assert math.isclose(r["score"], wanted[r["doc_id"]], rel_tol=1e-3)
    near = [(r["score"], wanted[r["doc_id"]]) for r in ngram.score(frame, order=order).collect()]
    assert abs(sum(a - b for a, b in near)) < 0.02 * abs(sum(b for _, b in near)) and all(abs(a - b) < 0.1 * abs(b) for a, b in near)


def conditional(spark, rows, level_bits, context, words):
    """Probabilities of each of `words` after `context`, as differences of scores of a text and of its beginning."""
    ask = [(10**6 + 5 * k, f"{context} {w}".strip()) for k, w in enumerate(words)]
    frame = spark.createDataFrame([*rows, *ask], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in ngram.score(frame, F.col("doc_id") < 10**6, order=2, level_bits=level_bits).collect()}
    return [scores[i] for i, _ in ask]


@pytest.mark.parametrize("level_bits", [6.0, 16])
def test_lm_probabilities_of_two_word_texts_add_up_to_one_at_most(spark, level_bits, monkeypatch):
    monkeypatch.setattr(ngram, "LEAST_SEGMENT_BITS", 2)
    r = random.Random(2)
    letters = "abcdefgh"
    rows = [(i, " ".join(r.choice(letters) for _ in range(r.randint(0, 30)))) for i in range(100)]
    texts = ["", *letters, *(f"{a} {b}" for a in letters for b in letters), *(f"{a} unknown" for a in letters), "unknown", *(f"unknown {a}" for a in letters), "unknown unknown"]
    assert 0.005 < sum(10**s for s in conditional(spark, rows, level_bits, "", texts)) <= 1 + 1e-9


def test_lm_refuses_a_filter_that_is_too_full(spark, monkeypatch):
    monkeypatch.setattr(ngram, "LEAST_SEGMENT_BITS", 2)
    frame = spark.createDataFrame(list(enumerate(word_texts(16, 30))), "doc_id long, text string")
    for bits in (0.5, 1, 2):
        with pytest.raises(ValueError, match="fill the filter"):
            ngram.score(frame, level_bits=bits)


# --- quality classifier ---


def quality_rows(n=240):
    r = random.Random(3)
    good = word_texts(5, n, 120)
    rows, labels = [], []
    for i, t in enumerate(good):
        bad = i % 4 == 0
        if bad:
            t = [t.upper().replace(" ", "!! "), " ".join(w + "$$$" for w in t.split()), (t.split()[0] + " ") * 60, t.replace(" ", " | ")][i // 4 % 4]
        rows.append((i, t))
        if r.random() < 0.8:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.score(docs, known).collect()
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: crc(i) % 3 == 1 for i, _ in rows}
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    good = sorted(r["doc_id"] for r in out if r["predicted"])
    for most in (quality.MOST_SENT, 10):  # labels sent to all tasks, or too many for that
        assert sorted(r["doc_id"] for r in quality.keep_good(docs, known, most=most).collect()) == good


def test_quality_equals_a_plain_discriminant(spark):
    rows, labels = quality_rows()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    text, label = dict(rows), {i: q for i, q, _ in labels if crc(i) % 3 != 1}
    x = {c: np.array([quality.statistics(text[i].encode()) for i, q in label.items() if q == c]) for c in (0, 1)}
    scatter = {c: (x[c] - x[c].mean(0)).T @ (x[c] - x[c].mean(0)) for c in x}
    n = len(x[0]) + len(x[1])
    pooled = (scatter[0] + scatter[1]) / (n - 2)

    def density(v, c):
        own = (1 - quality.TO_POOLED) * scatter[c] / (len(x[c]) - 1) + quality.TO_POOLED * pooled
        own = (1 - quality.TO_DIAGONAL) * own + quality.TO_DIAGONAL * np.diag(np.diag(own)) + np.diag(1e-3 * np.maximum(np.diag(pooled), 1e-3))
        away = v - x[c].mean(0)
        return math.log(len(x[c]) / n) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * away @ np.linalg.solve(own, away)

    for r in quality.score(docs, known).collect():
        v = np.array(quality.statistics(text[r["doc_id"]].encode()))
        assert abs(r["score"] - 1 / (1 + math.exp(-np.clip(density(v, 1) - density(v, 0), -700, 700)))) < 1e-6


def test_quality_odd_rows_and_no_labels(spark, odd, nothing):
    frame, rows = odd
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1), (4, 7, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(frame, none).collect()} == {0.5}
    assert quality.score(frame, some).count() == len(rows)
    assert quality.keep_good(frame, none).columns == frame.columns and quality.keep_good(frame, none).count() == len(rows)
    assert quality.score(nothing, none).count() == 0


# --- toxicity ---


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(4)
    for _ in range(60):
        texts = list({"".join(r.choice("abc") for _ in range(r.randint(3, 11))) for _ in range(5)})
        terms = [(t, r.random() < 0.3) for t in texts]
        lexicon = toxicity.Lexicon(terms)
        for _ in range(40):
            word = "".join(r.choice("abcd") for _ in range(r.randint(0, 13))) if r.random() < 0.5 else "".join(c for c in r.choice(texts) if r.random() < 0.9)
            errors = [0 for t, stem in terms if stem and word.startswith(t)] + [levenshtein(word, t) for t, stem in terms if not stem and levenshtein(word, t) <= toxicity.allowed(t)]
            assert lexicon.errors_of(word) == min(errors, default=9)


def toxic_rows(n=400):
    r = random.Random(5)
    rows, labels = [], []
    for i, t in enumerate(word_texts(6, n, 80)):
        words = t.split()
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words) + 1), r.choice(["grumpkin", "zzyvash", "blortface"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows_and_misspelled(spark):
    rows, labels = toxic_rows()
    rows += [(1001, "you are a grumpkn zzyvvash blortfice"), (1002, 'he said "grumpkin" quote'), (1003, None), (1004, ""), (1001, "plain words")]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    scores = collections.defaultdict(list)
    for r in out:
        scores[r["doc_id"]].append(r["score"])
    assert max(scores[1001]) > 0.3 > max(scores[1002]) and scores[1003] == scores[1004] == [min(scores[1001])]


def test_a_term_that_clean_texts_quote_stays_a_term():
    texts = word_texts(15, 400)
    toxic = [f"{t} grumpkin {t[::-1]}" for t in texts[:100]]
    clean = [*texts[100:], 'he said "grumpkin" aloud', "a grumpkyn bush"]
    terms, ordinary = toxicity.learn_terms(toxic, clean)
    assert any("grumpkin".startswith(t) for t, _ in terms) and "grumpkin" not in ordinary
    scan = toxicity.Scanner(toxicity.Lexicon(terms), ordinary)
    assert scan.features("you grumpkin")[0] > 0 and scan.features('he said "grumpkin" aloud')[2] > 0
    scan = toxicity.Scanner(toxicity.Lexicon([("grumpkin", False)]), toxicity.learn_terms(toxic, clean)[1])
    assert scan.errors("grumpkin") == 0


def test_long_words_are_read_whole_and_all_terms_are_kept():
    long = "a" * 70
    scan = toxicity.Scanner(toxicity.Lexicon([(long, False), ("b" * 64, False)]))
    assert scan.errors(long) == 0 and scan.errors("b" * 90) == 9
    r, others = random.Random(3), ["one", "two", "six", "ten", "red", "sun", "sky", "oak", "elm", "fir"]
    words = ["q" + a + b + c for a in "bcdfghjklm" for b in "aeiou" for c in "npqrst"]
    toxic = [" . ".join(f"{r.choice(others)} {w} {r.choice(others)}" for w in words[10 * k : 10 * k + 10]) for k in range(30) for _ in range(10)]
    terms, _ = toxicity.learn_terms(toxic, [" ".join(r.sample(others, 10)) for _ in range(3000)])
    assert {t for t, _ in terms} == set(words) and len(words) == 300


def test_a_root_in_many_clean_texts_is_one_term_for_its_inflections():
    r = random.Random(11)
    ends = [a + b for a in "bdfgk" for b in "aeiou"]
    text = lambda toxic: " ".join(r.choice(["wugrem", "mirpol", "tosbek"]) + r.choice(ends) if r.random() < (0.03 if toxic else 0.0005) else "".join(r.choice("aeiounrstl") for _ in range(r.randint(3, 8))) for _ in range(300))
    toxic, clean = [text(True) for _ in range(100)], [text(False) for _ in range(400)]
    assert sum(any(w in t for w in ("wugrem", "mirpol", "tosbek")) for t in clean) > 30
    terms, ordinary = toxicity.learn_terms(toxic, clean)
    assert sorted(terms) == [("mirpol", True), ("tosbek", True), ("wugrem", True)]
    scan = toxicity.Scanner(toxicity.Lexicon(terms), ordinary)
    assert sorted(scan.features(t)[-1] for t in toxic)[2] > sorted(scan.features(t)[-1] for t in clean)[-3]


def plain_features(text, terms, ordinary):
    """The features by plain edit distances."""
    words, q = text.split(), toxicity.QUOTES
    bare = [w.lower().strip(toxicity.EDGES) for w in words]
    codes = []
    for w in bare:
        found = [0 for t, stem in terms if stem and w.startswith(t)] + [levenshtein(w, t) for t, stem in terms if not stem and levenshtein(w, t) <= toxicity.allowed(t)]
        codes.append(9 if w in ordinary else min(found, default=9))
    exact = misspelled = exact_quoted = misspelled_quoted = addressed = 0
    for i, e in enumerate(codes):
        if e == 9:
            continue
        around = [*range(max(0, i - 6), i), *range(i + 1, min(len(words), i + 7))]
        ends = lambda w: w.rstrip(".,;:!?")[-1:] in q
        opened = words[i][0] in q or sum((words[j][:1] in q) - ends(words[j]) for j in around if j < i) > 0
        closed = ends(words[i]) or sum((words[j][:1] in q) - ends(words[j]) for j in around if j > i) < 0
        quoted = opened and closed or any(bare[j] in toxicity.REPORTING for j in around)
        if quoted:
            exact_quoted, misspelled_quoted = exact_quoted + (e == 0), misspelled_quoted + (e > 0)
        else:
            exact, misspelled = exact + (e == 0), misspelled + (e > 0)
            addressed += any(bare[j] in toxicity.ADDRESS for j in around)
    density = 100 * (exact + misspelled) / len(words) if words else 0.0
    return [math.log1p(x) for x in (exact, misspelled, exact_quoted, misspelled_quoted, addressed, density)]


def test_toxicity_scores_equal_brute_force(spark):
    rows, labels = toxic_rows(200)
    r = random.Random(12)
    mixed = [" ".join(r.choice(["grumpkin", "grumpkn", '"zzyvash"', "blortfacee", "you", "said", "«red", "blue»", "plain", "dijo", "du"]) for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame([*rows, *((1000 + i, t) for i, t in enumerate(mixed))], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    terms, ordinary, weights = toxicity.fit(docs, known)
    texts = dict([*rows, *((1000 + i, t) for i, t in enumerate(mixed))])
    assert any(t.startswith("grump") for t, _ in terms)
    for x in toxicity.score(docs, known).collect():
        z = float(np.dot(plain_features(texts[x["doc_id"]], terms, ordinary), weights[:-1]) + weights[-1])
        assert x["score"] == pytest.approx(1 / (1 + math.exp(-max(-700, min(700, z)))), abs=1e-9)


def test_toxicity_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    rows, labels = toxic_rows(100)
    docs = spark.createDataFrame(rows * 3 + [(i, "x" * 5000) for i, _ in rows[:4]], "doc_id long, text string")
    known = spark.createDataFrame(labels * 2, "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "learn_terms", lambda toxic, other: seen.append((toxic, other)) or ([], set()))
    monkeypatch.setattr(toxicity, "MOST_TEXT", 4000)
    toxicity.fit(docs, known)
    free = [i for i, *_ in labels if crc(i) % 4 != 2]
    assert sum(map(len, seen[0])) == len(free)  # one text for each id, whole
    assert {t for part in seen[0] for t in part} == {t for i, t in rows if i in free}
    monkeypatch.setattr(toxicity, "MOST_BYTES", 4000)
    toxicity.fit(docs, known)
    assert all(0 < sum(len(t.encode()) for t in part) <= 2000 for part in seen[1])


def test_toxicity_odd_rows_and_no_labels(spark, odd, nothing):
    frame, rows = odd
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(frame, none).collect()} == {0.0}
    assert toxicity.score(frame, spark.createDataFrame([(1, 0, 1), (2, 0, 0), (None, 0, 1), (4, 0, None)], "doc_id long, quality int, toxic int")).count() == len(rows)
    assert toxicity.score(nothing, none).count() == 0


# --- quality rules ---


def brute_rules(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        counts = collections.Counter(windows)
        hit = {k + j for k, x in enumerate(windows) if counts[x] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    return sorted(out, key=repr)


BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rules_base_equals_brute_force(spark, odd, nothing):
    frame, rows = odd
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    r = random.Random(6)
    more = [(2000 + i, "".join(r.choice(["a ", "b ", "c\n", "d\t", "#*", "x y z w v u ", "a\nb\na\n"]) for _ in range(40))) for i in range(60)]
    everything = spark.createDataFrame([(x[0], x[1], "en") for x in rows] + [(i, t, "de") for i, t in more], "doc_id long, text string, lang string")
    out = rules.judge(everything, none).collect()
    assert sorted((tuple(x[c] for c in BASE) for x in out), key=repr) == brute_rules([(x[0], x[1]) for x in rows] + more)
    assert all(x["kept"] == (not x["base_failed"]) for x in out)
    assert rules.judge(frame, none).count() == len(rows) and rules.judge(nothing, none).count() == 0


def exact_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for p in (0.005, 0.05) for n in (1, 50, 1000) for k in (0, 1, 3, 20) if k < n * p]
    for p in (0.005, 0.05):
        frame = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long")
        for r in frame.select("k", "n", rules.binomial_tail(rules.F.col("k"), rules.F.col("n"), p).alias("t")).collect():
            assert r["t"] == pytest.approx(exact_tail(r["k"], r["n"], p), rel=1e-9)


def test_cutoffs_keep_the_risk_and_reject_the_bad(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 6 == 0
        words = [f"w{r.randrange(5000)}" + ("$$" if bad else "") for _ in range(40)]
        rows.append((i, " ".join(words), "en" if i % 2 else None))
        labels.append((i, int(not bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    table = rules.figures(docs).persist()
    limits = {x["stratum"]: x["factor"] for x in rules.cutoffs(table, known).collect()}
    assert set(limits) == {"en", "\0null"} and min(limits.values()) >= 100
    assert {x["stratum"] for x in rules.cutoffs(table, known, risk=0.001).collect()} == set()
    out = {x["doc_id"]: x["kept"] for x in rules.judge(docs, known).collect()}
    assert all(out[i] == (i % 6 != 0) for i in range(3000))
    # copies of a text count once, so this few don't allow any cutoff
    few = docs.where("doc_id < 120").crossJoin(spark.range(20)).select((F.col("doc_id") + 10_000 * (F.col("id") + 1)).alias("doc_id"), "text", "lang")
    marked = known.crossJoin(spark.range(20)).select((F.col("doc_id") + 10_000 * (F.col("id") + 1)).alias("doc_id"), "quality")
    assert rules.cutoffs(rules.figures(few), marked).count() == 0


def test_factors_stop_at_the_first_that_is_not_safe(spark):
    # good texts lose 8 % at factors from 115 to 85 only by the order of factors: those below would hold again if tested
    rows = [(i, "en", 20, 100, 1 if i % 12 == 0 else 0, 0, 0, 1, 0, 0, (i, 0), False) for i in range(600)]
    names = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_exclaims long, text_key struct<a: long, b: long>, base_failed boolean"
    known = spark.createDataFrame([(i, 1) for i in range(600)], "doc_id long, quality int")
    # symbols: 10 thousandths, half the cutoff of 20: lost at factors below 50
    (found,) = rules.cutoffs(spark.createDataFrame(rows, names), known, cost=0.0).collect()
    assert found["factor"] == 400
    (found,) = rules.cutoffs(spark.createDataFrame(rows, names), known.unionByName(known.select((F.col("doc_id") + 0).alias("doc_id"), F.lit(0).alias("quality"))), cost=0.0).collect()
    assert found["factor"] == 400  # 50 loses nobody; 40 loses 8 % and isn't safe


# --- token counts ---


def test_rollup_batches_are_idempotent_and_additive(spark, tmp_path):
    store = rollup.Rollup(spark, f"file://{tmp_path}/r")
    kind = "source string, lang string, tokenizer string, kind string, n_tokens long, old_tokens long"
    one = spark.createDataFrame([("a", "en", "v1", "insert", 10, None), ("a", "en", "v1", "insert", 5, None), (None, None, "v1", "insert", None, None)], kind)
    two = spark.createDataFrame([("a", "en", "v1", "revise", 7, 10), ("a", "en", "v1", "delete", None, 5)], kind)
    read = lambda: sorted(map(tuple, store.totals().collect()), key=repr)
    assert store.commit("b1", one) and not store.commit("b1", two)
    assert read() == sorted([("a", "en", "v1", 2, 15), (None, None, "v1", 1, 0)], key=repr)
    assert store.commit("b2", two) and not store.commit("b2", two)
    after = sorted([("a", "en", "v1", 1, 7), (None, None, "v1", 1, 0)], key=repr)
    assert read() == after
    store.compact()
    assert read() == after and not store.commit("b1", one)
    assert store.commit("b3", spark.createDataFrame([("a", "en", "v1", "delete", 0, 7)], kind))
    assert read() == [(None, None, "v1", 1, 0)]
    assert store.commit("empty", spark.createDataFrame([], kind))
    store.compact()
    assert read() == [(None, None, "v1", 1, 0)]
    with pytest.raises(Exception, match="unknown kind"):
        store.commit("b4", spark.createDataFrame([("a", "en", "v1", "upsert", 1, 1)], kind))
    with pytest.raises(ValueError):
        store.commit("../x", one)
    assert rollup.Rollup(spark, f"file://{tmp_path}/new").totals().count() == 0


def test_rollup_race_leaves_one_batch(spark, tmp_path, monkeypatch):
    store = rollup.Rollup(spark, f"file://{tmp_path}/race")
    rows = spark.createDataFrame([("a", "en", "v1", "insert", 3, None)], "source string, lang string, tokenizer string, kind string, n_tokens long, old_tokens long")
    assert store.commit("b", rows)
    monkeypatch.setattr(store, "_names", lambda part: [])  # another writer's view, before that commit
    monkeypatch.setattr(store, "_snapshot", lambda: (None, set()))
    assert store.commit("b", rows) is False
    monkeypatch.undo()
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 1, 3)]


def test_rollup_of_odd_rows(spark, odd, nothing):
    frame, rows = odd
    assert rollup.maintain(nothing).count() == 0
    first, counts = {}, collections.Counter()
    key = lambda i: (i is None, i or 0)
    for i, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", key(i)), key(i))
    for i, t, lang, source, _ in rows:
        if key(i) == first[t or ""]:
            for version, pattern in (("words-1", r"[^\x20\x09-\x0D]+"), ("words-2", r"[^\W_]+|[^\w\x20\x09-\x0D]|_")):
                counts[source, lang, version, "d"] += 1
                counts[source, lang, version, "t"] += len(re.findall(pattern, t or ""))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.maintain(frame).collect()}
    assert got == {k[:3]: (counts[(*k[:3], "d")], counts[(*k[:3], "t")]) for k in counts}


# --- URL filters ---

URLS = {
    "https://a.NET/x?q#f": ("a.net", "/x", "net/", "block"),
    "http://EXAMPLE.net/en/1": ("example.net", "/en/1", "example.net/en/", "allow"),
    "http://m.example.net/en": ("m.example.net", "/en", "net/", "block"),
    "http://www.example.com/de/9.html": ("www.example.com", "/de/9.html", "example.com/de/", "block"),
    "http://badexample.com/de/9": ("badexample.com", "/de/9", None, "allow"),
    "http://x.org/fr/a": ("x.org", "/fr/a", "org/fr/", "allow"),
    "http://x.org?fr/a": ("x.org", "", None, "allow"),
    "http://y.net": ("y.net", "", None, "allow"),
    "nothing here/net/": ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "://host.net/p#a?b/c": ("host.net", "/p", "net/", "block"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_url_parts_and_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "<html>", "x") for i, u in enumerate([*URLS, "https://a.NET/x?q#f"])], "page_id long, url string, html string, host string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = urls.judge(pages, none).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == [*URLS.values(), URLS["https://a.NET/x?q#f"]]
    assert urls.judge(pages.where("false"), none).count() == 0


def test_url_columns_may_clash(spark):
    names = ["page_id", "url", "host", "path", "rule", "verdict", "tokens", "quality", "labelled", "drawn", "URL"]
    pages = spark.createDataFrame([(7, "http://x.net/a", *["z"] * 9), (None, None, *["z"] * 9), (7, "http://x.net/a", *["z"] * 9)], ", ".join(f"c{i} {'long' if not i else 'string'}" for i in range(11))).toDF(*names)
    labels = spark.createDataFrame([(7, 0, 1), (7, 0, 1), (None, 1, 0), (8, 1, 0)], "doc_id long, quality int, url int")
    assert sorted(map(tuple, urls.judge(pages, labels).collect()), key=repr) == sorted([(7, "x.net", "/a", "net/", "block")] * 2 + [(None, "", "", None, "allow")], key=repr)


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(8)
    pages, labels = [], []
    for i in range(400):
        spam = r.random() < 0.3
        host = r.choice(["casino", "pills"]) if spam else r.choice(["news", "blog", "wiki"])
        pages.append((i, f"http://{host}.example.info/{r.choice(['en', 'de'])}/{r.choice(['win', 'read'])}"))
        labels.append((i, int(not spam) if r.random() < 0.95 else int(spam)))
    frame, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    baskets, bad, n = [set(urls.tokens(u)) for _, u in pages], [q == 0 for _, q in labels], len(pages)
    least = math.ceil(max(urls.SUPPORT, urls.SUPPORT_ROWS / n) * n)
    wanted = []
    for size in range(1, 13):
        for c in {c for b in baskets for c in combinations(sorted(b), size)}:
            inside = [x for b, x in zip(baskets, bad, strict=True) if b >= set(c)]
            if sum(inside) >= least and sum(inside) / len(inside) >= urls.CONFIDENCE and sum(inside) / len(inside) / (sum(bad) / n) >= urls.LIFT:
                wanted.append((frozenset(c), sum(inside) / len(inside), 0.0, 0.0))
    got = urls.mine(frame, known)
    assert {x[0] for x in got} == {x[0] for x in urls.prune(wanted)}
    blocked = {r["page_id"] for r in urls.judge(frame, known).collect() if r["verdict"] == "block"}
    assert blocked == {i for (i, _), b in zip(pages, baskets, strict=True) if any(x[0] <= b for x in wanted)} and blocked


def test_query_blocks_by_mined_rules(spark, tmp_path):
    """The registered query on tables whose labels depend on the URL: mined rules decide where no fixed one does."""
    from tabulith.llm import queries

    r = random.Random(21)
    pages, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        host = r.choice(["spam-farm", "free-bets"]) if bad else r.choice(["ththa", "tiontion", "blog.therou", "m.ththth"])
        pages.append((i, f"https://{host}.example.{'info' if i % 7 else 'net'}/{r.choice(['en', 'de'])}/{r.randrange(900)}?page=2", "<html>"))
        if i % 3:
            labels.append((i, int(not bad), 0))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for x in queries.QUERIES["op5_url_filters"](spark, str(tmp_path)).collect():
        if x["rule"] is None:
            assert x["verdict"] == ("block" if x["page_id"] % 5 == 0 else "allow")
        else:
            assert x["rule"] == ("example.net/en/" if x["path"].startswith("/en/") else "net/")


def test_many_redundant_rules_leave_room_for_all_hosts(spark):
    urls_ = [f"https://{c * 3}-{c * 4}.example.com/de/all/new/{c * 5}?{c * 6}=x" for c in "bcdfgh" for _ in range(40)]
    bad = len(urls_)
    urls_ += [f"https://{'news blog wiki'.split()[i % 3]}.example.com/de/all/new/{'page item'.split()[i % 2]}?from=x" for i in range(400)]
    frame = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    rules = {x[0] for x in urls.mine(frame, spark.createDataFrame([(i, int(i >= bad or i % 40 < i // 40)) for i in range(len(urls_))], "doc_id long, quality int"))}
    assert all(frozenset([f"host:{c * 3}-{c * 4}.example.com"]) in rules for c in "bcdfgh")


def test_tokens_after_the_sixth_are_matched_and_mined(spark):
    words = "/".join(["one", "two", "three", "four", "five", "six"])
    url = f"http://a.org/{words}/casino?a=1&b=2&c=3&d=4&e=5&f=6&pill=7"
    assert {"path:casino", "query:pill"} <= set(urls.tokens(url))
    assert urls.Index([(frozenset([("path:casino",)]), 1.0, 3.0, 0.1)]).blocks(urls.tokens(url))
    pages = [(i, f"http://a.org/{words}/{'casino' if i % 4 == 0 else 'paper'}") for i in range(80)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    rules = urls.mine(frame, spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(80)], "doc_id long, quality int"))
    assert {x[0] for x in rules} == {frozenset(["path:casino"])}


def labelled_pages(spark, rows):
    """Frames of pages and labels from pairs of a URL and whether it is bad."""
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    return pages, spark.createDataFrame([(i, int(not bad)) for i, (_, bad) in enumerate(rows)], "doc_id long, quality int")


def test_rules_of_the_rarest_of_many_items_are_mined(spark):
    """About 30 tokens of each URL are in more bad rows than the one that tells bad from good."""
    r = random.Random(4)
    words = [a + b + "o" for a in "bcdfghjklm" for b in "aeiouwxyz"]
    marks = [c * 4 for c in "bcdfghjklmnp"]
    rows = [(f"http://a.info/{'/'.join(r.sample(words, 30))}/{marks[i // 5 // 12] if i % 5 == 0 else 'paper'}", i % 5 == 0) for i in range(5 * 144)]
    pages, labels = labelled_pages(spark, rows)
    assert {frozenset([f"path:{m}"]) for m in marks} <= {x[0] for x in urls.mine(pages, labels)}
    verdicts = {x["page_id"]: x["verdict"] for x in urls.judge(pages, labels).collect()}
    assert all(verdicts[i] == "block" for i, (_, bad) in enumerate(rows) if bad)


@pytest.mark.parametrize(("items", "entries"), [(3, 1 << 20), (1, 1 << 20), (0, 1 << 20), (2, 300), (0, 0)])
def test_rules_do_not_depend_on_how_sets_are_divided(spark, monkeypatch, items, entries):
    r = random.Random(13)
    rows = []
    for _ in range(300):
        words = [w for w in ("win", "bet", "pay", "ask", "new", "old") if r.random() < 0.6]
        rows.append((f"http://{r.choice(['m', 'www'])}.a.info/{'/'.join(words)}", r.random() < (0.85 if {"win", "bet"} <= set(words) else 0.5 if "pay" in words and "ask" not in words else 0.08)))
    pages, labels = labelled_pages(spark, rows)
    baskets, n = [set(urls.tokens(u)) for u, _ in rows], len(rows)
    total = sum(b for _, b in rows)
    wanted = []
    for size in range(1, 13):
        for c in {c for b in baskets for c in combinations(sorted(b), size)}:
            inside = [bad for b, (_, bad) in zip(baskets, rows, strict=True) if b >= set(c)]
            sure = sum(inside) / len(inside)
            if sum(inside) >= urls.SUPPORT_ROWS and sure >= urls.CONFIDENCE and sure / (total / n) >= 1.5:
                wanted.append((frozenset(c), sure, sure / (total / n), sum(inside) / n))
    monkeypatch.setattr(urls, "MOST_ITEMS", items)
    monkeypatch.setattr(urls, "MOST_ENTRIES", entries, raising=False)
    got = urls.mine(pages, labels, lift=1.5)
    figures = lambda rules: {x[0]: pytest.approx(x[1:]) for x in rules}
    assert {x[0]: x[1:] for x in got} == figures(urls.prune(wanted)) and any(len(x[0]) > 2 for x in got)


def test_all_labelled_rows_are_mined(spark):
    """Rules of just the least support among more rows than a sample would hold."""
    pages = spark.range(300_000).selectExpr("id AS page_id", "concat('http://', if(id % 50 = 0, concat(repeat(char(98 + int(id / 50) % 20), 3), '.info'), 'news.org'), '/') AS url")
    labels = pages.selectExpr("page_id AS doc_id", "int(page_id % 50 != 0) AS quality")
    rules = {x[0] for x in urls.mine(pages, labels)}
    assert {frozenset([f"host:{chr(98 + k) * 3}.info"]) for k in range(20)} <= rules


@pytest.mark.parametrize("together", [3, 40])
def test_rules_dont_multiply_with_words_that_come_together(spark, together):
    """One rule over three groups of words, however many words each group has."""
    groups = [["group" + "xyz"[g] + chr(97 + k // 26) + chr(97 + k % 26) for k in range(together)] for g in range(3)]
    urls_, quality = [], []
    for i in range(400):
        has = [bool(i >> g & 1) for g in range(3)]
        words = [w for g in range(3) if has[g] for w in groups[g]]
        urls_.append(f"http://h{i % 7}.org/{'/'.join(words) or 'none'}")
        quality.append(int(not all(has)))
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    labels = spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int")
    rules = [r for r in urls.mine_items(pages, labels) if all(t.startswith("path:group") for item in r[0] for t in item)]
    assert [sorted(map(len, r[0])) for r in rules] == [[together] * 3]
    index = urls.Index(rules)
    for some in range(4):
        for chosen in combinations(range(3), some):
            tokens = urls.tokens("http://x.org/" + "/".join(groups[g][g % together] for g in chosen))
            assert index.blocks(tokens) == (some == 3)
