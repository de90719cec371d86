"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of context windows.

The lexicon is learned: whole words and word beginnings that stand far more often among the words of labelled toxic
documents than among those of other labelled documents. So a root that chance brings into many long documents is still
a term, and one entry for all its inflections. Its trie is intersected with the Levenshtein automata of its terms (`allowed` errors by
term length) into one deterministic automaton, built as words are met: a state is the set of (trie node, errors)
pairs that the letters so far can reach. Each hit looks at its context window: quotation marks around it and words
of reporting count as quotation, words of address as abuse. A ridge logistic regression over hits by exactness and
context, and over hits by words, gives the score; its weights are drawn to `DRAW`, which decides only what the sample
doesn't show (say, a lexicon whose terms it never misspells).

Both are fitted on a bounded sample of labelled rows that aren't held out: `MOST_TOXIC` and `MOST_OTHER` ids with the
least hashes, one text for each id, of these as many as `MOST_BYTES` hold (texts over `MOST_TEXT` left out);
everything else covers whole texts of all rows.

Defined cases: null and empty texts have no hits and get the score of a text without hits; labels that are null or
not 0 or 1 are left out; without toxic or without other labelled rows the lexicon is empty and every score is 0;
repeated rows keep their rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, id_key, key_id, materialize, pick, sub_batches, text_bytes

MOST_TOXIC, MOST_OTHER, MOST_BYTES, MOST_TEXT = 3000, 6000, 32 << 20, 1 << 20
#: Least share of toxic rows, least log ratio of rates and least likelihood ratio statistic (chance gives 25 to about one
#: key in a million) of a term; least letters of a word beginning.
SUPPORT, RATIO, EVIDENCE, STEM = 0.004, 3.0, 25.0, 4
WINDOW = 6
WORDS_KEPT, STATES_KEPT = 200_000, 20_000
#: Strength of the ridge penalty, and the weights that it draws to (in the order of FEATURES).
RIDGE, DRAW = 1.0, (4.0, 4.0, 0.0, 0.0, 1.0, 1.0)

# Words that report speech, words that address somebody, marks that open or close a quotation.
REPORTING = {"said", "says", "called", "calls", "wrote", "quote", "quoted", "quoting", "word", "term", "slur", "insult", "insults", "named", "reported", "claimed"}
REPORTING |= {"sagte", "nannte", "schrieb", "zitat", "zitiert", "beleidigung", "wort", "appelle", "écrit", "cité", "citation", "insulte", "dijo", "llamó", "escribió", "cita", "palabra", "insulto"}
ADDRESS = {"you", "your", "you're", "youre", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "tu", "toi", "vous", "votre", "tú", "ti", "usted", "ustedes"}
QUOTES = "\"'`“”„«»‹›‘’"
EDGES = ".,;:!?()[]{}<>|/\\-_=+*&^%$#@~…" + QUOTES


def allowed(term: str) -> int:
    """Errors that a term may have: none under 5 letters, one under 9, else two."""
    return (len(term) >= 5) + (len(term) >= 9)


class Lexicon:
    """The terms in a trie, and the automaton that reads words."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[tuple[bool, int] | None] = [None]  # stem or not, and errors allowed, where a term ends
        self.errors = [0]  # most errors allowed below a node
        for text, stem in terms:
            at, most = 0, 0 if stem else allowed(text)
            self.errors[0] = max(self.errors[0], most)
            for letter in text:
                if letter not in self.children[at]:
                    self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.errors.append(0)
                at = self.children[at][letter]
                self.errors[at] = max(self.errors[at], most)
            old = self.term[at]
            self.term[at] = (stem or bool(old and old[0]), max(most, old[1] if old else 0))
        self.reset()

    def reset(self) -> None:
        self.names: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.at_end: list[int] = []  # errors of the best term if the word ends here, or 9
        self.at_once: list[int] = []  # errors of the best word beginning that ends here, or 9
        self._state({0: 0})

    def _state(self, reach: dict[int, int]) -> int:
        stack = list(reach)
        while stack:  # letters of a term may be missing
            node = stack.pop()
            for child in self.children[node].values():
                e = reach[node] + 1
                if e <= self.errors[child] and e < reach.get(child, 9):
                    reach[child] = e
                    stack.append(child)
        key = frozenset(reach.items())
        if key not in self.names:
            self.names[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(self.term[n], e) for n, e in key if self.term[n]]
            self.at_end.append(min((e for (_, most), e in ends if e <= most), default=9))
            self.at_once.append(min((e for (stem, _), e in ends if stem and e == 0), default=9))
        return self.names[key]

    def _move(self, state: int, letter: str) -> int:
        reach: dict[int, int] = {}
        for node, e in self.sets[state]:
            for c, child in self.children[node].items():
                f = e + (c != letter)
                if f <= self.errors[child] and f < reach.get(child, 9):
                    reach[child] = f
            if e < self.errors[node] and e + 1 < reach.get(node, 9):
                reach[node] = e + 1
        return self._state(reach) if reach else -1

    def errors_of(self, word: str) -> int:
        """Errors of the best term that the word is (or begins with), or 9."""
        if len(self.sets) > STATES_KEPT:
            self.reset()
        state, best = 0, 9
        for letter in word:
            to = self.moves[state].get(letter)
            if to is None:
                to = self.moves[state][letter] = self._move(state, letter)
            if to < 0:
                return best
            state = to
            best = min(best, self.at_once[state])
        return min(best, self.at_end[state])


FEATURES = ("exact", "misspelled", "exact_quoted", "misspelled_quoted", "addressed", "density")


class Scanner:
    """A worker's reader of texts: hits by context. Words in `ordinary` are no misspellings."""

    def __init__(self, lexicon: Lexicon, ordinary: set[str] = frozenset()):
        self.lexicon, self.ordinary = lexicon, ordinary
        self.known: dict[str, int] = {}

    def errors(self, raw: str) -> int:
        word = raw.lower().strip(EDGES)
        found = 9 if word in self.ordinary else self.lexicon.errors_of(word)
        if len(raw) <= 64:  # longer ones are rare, and would fill the table
            self.known[raw] = found
        return found

    def features(self, text: str) -> list[float]:
        words, known = text.split(), self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        codes = [known[w] if w in known else self.errors(w) for w in words]
        if not codes or min(codes) == 9:
            return [0.0] * len(FEATURES)
        sums = dict.fromkeys(FEATURES, 0.0)
        for i, e in enumerate(codes):
            if e == 9:
                continue
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            own = words[i]
            marks = lambda ws: sum(w[:1] in QUOTES for w in ws) - sum(w.rstrip(".,;:!?")[-1:] in QUOTES for w in ws)
            opened = own[0] in QUOTES or marks(before) > 0
            closed = own.rstrip(".,;:!?")[-1:] in QUOTES or marks(after) < 0
            near = {w.lower().strip(EDGES) for w in (*before, *after)}
            quoted = opened and closed or bool(near & REPORTING)
            sums[("misspelled" if e else "exact") + ("_quoted" if quoted else "")] += 1
            sums["addressed"] += bool(near & ADDRESS) and not quoted
        sums["density"] = 100 * (sums["exact"] + sums["misspelled"]) / len(words)
        return [float(np.log1p(v)) for v in sums.values()]


def _keys(words: set[str]) -> set[tuple[str, bool]]:
    """The candidate terms of some words: the words themselves, and their beginnings."""
    return {(w, False) for w in words} | {(w[:k], True) for w in words for k in range(STEM, 8) if len(w) > k}


def _words(text: str) -> list[str]:
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if len(w) >= 3 and w.isalpha()]


def learn_terms(toxic: list[str], other: list[str]) -> tuple[list[tuple[str, bool]], set[str]]:
    """(term, is a word beginning) of the lexicon from the texts of a sample, and the words of the other texts that
    would pass for misspelled terms: those are none. Terms themselves stay terms, whoever quotes them."""
    if not toxic or not other:
        return [], set()
    counts: Counter[tuple[str, bool]] = Counter()  # toxic texts that have a key
    for text in set(toxic):
        counts.update(_keys(set(_words(text))))
    least = max(4, SUPPORT * len(toxic))
    wanted = {key for key, n in counts.items() if n >= least}
    often: list[Counter[tuple[str, bool]]] = []  # words that have a key
    sizes, ordinary = [], set()
    for texts in (toxic, other):
        words: Counter[str] = Counter()
        for text in set(texts):  # copies count once, and a word that a text says over and over three times
            words.update({w: min(n, 3) for w, n in Counter(_words(text)).items()})
        sizes.append(words.total())
        seen: Counter[tuple[str, bool]] = Counter()
        for word, n in words.items():
            for key in _keys({word}) & wanted:
                seen[key] += n
        often.append(seen)
        ordinary = set(words)
    rate = {key: np.log((often[0][key] + 0.5) / (sizes[0] + 1)) - np.log((often[1][key] + 0.5) / (sizes[1] + 1)) for key in wanted}
    share = (sizes[0] + 1) / (sum(sizes) + 2)

    def evidence(key: tuple[str, bool]) -> float:
        a, b = often[0][key], often[1][key]
        return 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0))

    ratio = {key: r for key, r in rate.items() if r >= RATIO and evidence(key) >= EVIDENCE}
    # copies of one text share its words and their neighbours: a term needs many different neighbours
    around: dict[tuple[str, bool], set[tuple[str, str]]] = {k: set() for k in ratio}
    for text in toxic:
        words = ["", *_words(text), ""]
        for i in range(1, len(words) - 1):
            for key in _keys({words[i]}) & ratio.keys():
                around[key].add((words[i - 1], words[i + 1]))
    rated = sorted((k for k in ratio if len(around[k]) >= max(least, counts[k] / 4)), key=lambda k: (-ratio[k] * often[0][k], k))
    chosen: dict[tuple[str, bool], None] = {}
    for text, stem in rated:
        if any((text[:k], True) in chosen for k in range(STEM, len(text) + 1)):
            continue
        # a beginning that nearly always goes on the same way: the longest way
        longer = [k for k in rated if stem and k[0].startswith(text) and often[0][k] >= 0.9 * often[0][text, stem]]
        term = max(longer, key=lambda k: (len(k[0]), not k[1]), default=(text, stem))
        chosen[term] = None
    lexicon = Lexicon(list(chosen))
    return list(chosen), {w for w in ordinary if 0 < lexicon.errors_of(w) < 9}


def _ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights with the intercept last, by Newton steps with halving."""
    z = np.c_[x, np.ones(len(x))]
    penalty, draw = np.r_[np.full(x.shape[1], ridge), 1e-3], np.r_[DRAW, 0.0]
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + 0.5 * (penalty * (w - draw) ** 2).sum()
    w, now = np.zeros(z.shape[1]), np.inf
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (y - p) - penalty * (w - draw))
        while loss(w + step) > now + 1e-12 and np.abs(step).max() > 1e-10:
            step = step / 2
        w, now = w + step, loss(w + step)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, bool]], set[str], np.ndarray]:
    """Terms, words that aren't misspelled terms, and weights, from the bounded sample of labelled rows."""
    known = pick(labels, "doc_id", "toxic").where("toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("labelled"), "toxic")
    rows = pick(docs, "doc_id", "text").where(F.pmod(id_crc(), F.lit(4)) != 2)
    known = known.where(F.pmod(id_crc("labelled"), F.lit(4)) != 2).where("labelled IS NOT NULL").distinct().select("labelled", "toxic", F.xxhash64("labelled").alias("drawn"))
    least = [known.where(F.col("toxic") == toxic).orderBy("drawn", "labelled").limit(most) for toxic, most in ((1, MOST_TOXIC), (0, MOST_OTHER))]
    ids = least[0].unionByName(least[1])  # MOST_TOXIC + MOST_OTHER rows
    sized = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_TEXT)
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text")))["text"].alias("text")
    sample = materialize(sized.groupBy("drawn", "labelled", "toxic").agg(one), "toxicity")
    texts: dict[int, list[str]] = {}
    for toxic in (1, 0):
        own = sample.where(F.col("toxic") == toxic)
        size, last = 0, None
        for r in own.select("drawn", F.octet_length("text").alias("size")).orderBy("drawn", "labelled").collect():
            size += r["size"]
            if size > MOST_BYTES // 2:
                break
            last = r["drawn"]
        texts[toxic] = [] if last is None else [r["text"] for r in own.where(F.col("drawn") <= last).orderBy("drawn", "labelled").select("text").collect()]
    terms, ordinary = learn_terms(texts[1], texts[0])
    scan = Scanner(Lexicon(terms), ordinary)
    x = np.array([scan.features(t) for t in texts[1] + texts[0]]).reshape(-1, len(FEATURES))
    y = np.r_[np.ones(len(texts[1])), np.zeros(len(texts[0]))]
    return terms, ordinary, _ridge_logistic(x, y) if terms else np.zeros(len(FEATURES) + 1)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from labels of rows that aren't held out."""
    model = fit(docs, labels)
    rows = pick(docs, "doc_id", "text").select(id_key().alias("k"), id_crc().alias("crc"), text_bytes().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ordinary, weights = shared.value
        scan = Scanner(Lexicon(terms), ordinary)
        for batch in sub_batches(batches, "text"):
            x = np.array([scan.features(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -700, 700))) if terms else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("crc"), pa.array(p)], names=["k", "crc", "score"])

    out = rows.mapInArrow(run, "k long, crc long, score double")
    return out.select(key_id("k").alias("doc_id"), (F.pmod("crc", F.lit(4)) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
