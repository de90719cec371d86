"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base figures of each whole text: words, characters in words, symbols, repeated lines, and words in 5-word windows
that the text has twice or more. A text fails the base rule with under 10 words or with over a fifth of repeated
words. Further rules reject a text if a figure (in thousandths) is over a cutoff: that of each rule in `RULES` times a
common factor, in percent. The factor is chosen for each stratum (lang) on the labelled texts, which nothing else learns
from: factors are tested in the fixed order of `FACTORS`, loosest first, until one isn't safe. It is safe if the exact
binomial probability of so few false rejections by all rules together, were their rate `RISK`, is at most `DOUBT` by the
number of strata (Bonferroni over strata; a fixed sequence needs no further correction). So with probability 1 - DOUBT, no
stratum loses over a share RISK of its good texts to the rules. Of the safe factors, the one with the greatest share of
rejected bad texts less `COST` times that of good ones is taken (the loosest of equals); strata with too few labelled
texts (under 86 good ones with 4 strata) have none. Copies of a labelled text count once.

The figures are made once, without a shuffle, and written to the shared folder. 5-word windows are compared by
64-bit hashes within a text; texts whose windows all differ, nearly all, skip the sort.

Defined cases: null and empty texts have no words and fail the base rule; a null lang is a stratum of its own;
labels that are null or not 0 or 1 are left out; a text with both labels counts in both classes; without labels the base
rule alone decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick

RISK, DOUBT, COST = 0.05, 0.05, 20.0
#: Cutoffs, in thousandths, of symbols by characters, repeated lines, upper-case letters by characters, exclamation marks by words.
RULES = {"symbols": 20, "repeated_lines": 400, "upper": 200, "exclaims": 50}
FACTORS = (400, 300, 250, 200, 160, 130, 115, 100, 85, 70, 60, 50, 40, 30, 20, 10)
#: Most rows of the cutoff table that are broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 10_000
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that are found twice or more."""

    def counted(hashes: Column) -> Column:
        def covered(places: Column) -> Column:
            zero = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("total"))
            return F.aggregate(places, zero, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(5), p - a["last"])).alias("total")), lambda a: a["total"])

        def places(pairs: Column) -> Column:
            same = lambda e, other: F.coalesce(F.get(pairs, other)["h"] == e["h"], F.lit(False))
            marked = F.transform(pairs, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
            return F.array_sort(F.array_compact(marked))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, places), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(let(windows, counted))


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the figures of every whole text."""
    rows = pick(docs, "doc_id", "lang", "text").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", SPACE), "")
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    out = rows.select(
        "doc_id",
        "lang",
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaims"),
        F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).alias("text_key"),
    )
    out = out.select("doc_id", "lang", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_exclaims", "text_key")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


#: What each rule counts, and by what.
PARTS = {"symbols": ("n_symbols", "word_chars"), "repeated_lines": ("n_dup_lines", "n_lines"), "upper": ("n_upper", "word_chars"), "exclaims": ("n_exclaims", "n_words")}


def excess() -> Column:
    """The greatest figure of a text, in percent of its rule's cutoff: factors below it reject the text."""
    return F.greatest(*[F.expr(f"100 * (1000 * {a} div greatest({b}, 1)) div {RULES[r]}") for r, (a, b) in PARTS.items()])


def _log_gamma(x: Column) -> Column:
    """Of x >= 1, by Stirling's series ten steps up."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    below = F.lit(0.0)
    for k in range(10):
        below = below + F.log(x + k)
    return series - below


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X binomial(n, p), for k below n p, else 1: terms from k down, as far as they can matter."""
    n, k = n.cast("double"), k.cast("double")
    first = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    zero = F.struct(first.alias("t"), F.lit(0.0).alias("s"))
    steps = F.sequence(F.lit(0).cast("long"), F.least(k, 20 * F.sqrt(n) + 60).cast("long"))
    below = lambda j: F.when(j < k, F.log((k - j) * (1 - p) / ((n - k + j + 1) * p))).otherwise(F.lit(-800.0))
    total = F.aggregate(steps, zero, lambda a, j: F.struct((a["t"] + below(j)).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")), lambda a: a["s"])
    return F.when(k < n * p, F.least(total, F.lit(1.0))).otherwise(F.lit(1.0))


def cutoffs(table: DataFrame, labels: DataFrame, *, risk: float = RISK, doubt: float = DOUBT, cost: float = COST) -> DataFrame:
    """stratum, factor: the chosen factor of each stratum that has one."""
    known = pick(labels, "doc_id", "quality").where("quality IN (0, 1)").select(F.col("doc_id").alias("labelled"), "quality")
    rows = table.join(known, F.col("doc_id") == F.col("labelled")).where("NOT base_failed").select(F.coalesce("lang", F.lit("\0null")).alias("stratum"), "quality", "text_key", excess().alias("excess"))
    counts = materialize(rows.distinct().groupBy("stratum", "quality", "excess").agg(F.count(F.lit(1)).alias("n")), "counts")
    over = counts.select("stratum", "quality", "excess", "n", F.explode(F.array(*map(F.lit, FACTORS))).alias("factor"))
    good, bad, lost = F.col("quality") == 1, F.col("quality") == 0, F.col("excess") > F.col("factor")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    tried = over.groupBy("stratum", "factor").agg(total(good).alias("good"), total(good & lost).alias("good_lost"), total(bad).alias("bad"), total(bad & lost).alias("bad_lost"))
    strata = counts.agg(F.count_distinct("stratum")).first()[0]
    holds = (F.col("good") > 0) & (binomial_tail(F.col("good_lost"), F.greatest("good", F.lit(1)), risk) <= doubt / max(strata, 1))
    in_order = Window.partitionBy("stratum").orderBy(F.col("factor").desc())  # as many rows as there are factors
    safe = tried.withColumn("safe", F.bool_and(holds).over(in_order)).where("safe")
    worth = F.col("bad_lost") / F.greatest("bad", F.lit(1)) - cost * F.col("good_lost") / F.col("good")
    return safe.groupBy("stratum").agg(F.max(F.struct(F.round(worth, 9), "factor"))["factor"].alias("factor"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The figures of every row with base_failed and kept."""
    table = materialize(figures(docs), "rules")
    limits = materialize(cutoffs(table, labels), "cutoffs")
    if limits.count() <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    joined = table.join(limits, F.coalesce("lang", F.lit("\0null")) == F.col("stratum"), "left")
    rejected = F.coalesce(excess() > F.col("factor"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
