"""URL filters: association rules over URL tokens, mined by FP-growth, and fixed host and path rules.

A URL's tokens are its scheme, each domain suffix of its host, the words of its host, its path's words and its query
keys. Labelled URLs (a page's label is that of the document with its id) become baskets of tokens with the item of
their class. Tokens that always come together count as one item, and Spark's FP-growth finds frequent sets and the rules
that lead to `bad`. Rules are pruned by support, confidence and lift, and those that a shorter rule covers with no less
confidence go, most of them before anything is collected; then each item stands for any of its tokens. An inverted index leads from
each rule's rarest token to the rule; a URL is blocked if all tokens of some rule are in it. Fixed rules, if one
fits, win over mined ones; the longest wins.

Mining takes all labelled rows and all items of enough support, matching all tokens of all URLs, and all rules that
pruning leaves are kept. Spark's FP-growth lists all frequent sets, 2 to the number of a URL's items. Items that come
after the first `MOST_ITEMS` (those that most bad rows have) in some URL are therefore wide: Spark's takes the sets
without wide items, and sets with some grow from the rows that hold their first wide item. There a set is given up only if
no set above it can be a rule that no shorter one covers: its bad rows are too few; a token less leaves the same good rows
(then confidence can't rise, nor can it in sets above); or even all further items leave too many good rows. Rows of more
than `MOST_ENTRIES` items in all are split by the next item first; a worker holds at most 125 bytes for each item of a row
at the default support, times the items of the set in hand. Time has no such bound: it follows the number of sets that
can't be given up.

Defined cases: a null url, or one without "://", has an empty host and path and no fixed rule; labels that are null
or not 0 or 1 are left out; without labels of either class there are no mined rules and the verdict is allow;
repeated rows keep their rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

MOST_ITEMS, MOST_ENTRIES = 12, 200_000
SUPPORT_ROWS, SUPPORT, CONFIDENCE, LIFT = 10, 0.001, 0.6, 2.0
BAD = -1
_WORDS = re.compile(r"[a-z]{2,}")

# The verdict, host and path of each fixed rule.
FIXED_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    start = F.coalesce(F.locate("://", url), F.lit(0))
    found = start > 0
    rest = F.substring_index(url.substr(start + 3, F.char_length(url)), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    slash = F.locate("/", rest)
    host = F.when(slash > 0, rest.substr(F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, rest.substr(slash, F.char_length(rest))).otherwise(F.lit(""))
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found, host).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = FIXED_RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text, else null), and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL, sorted."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return []
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    labels = host.lower().split(".")
    out = {"scheme:" + scheme.lower()}
    out |= {"host:" + ".".join(labels[i:]) for i in range(len(labels))}
    out |= {"word:" + w for w in _WORDS.findall(labels[0] if len(labels) < 3 else ".".join(labels[:-2]))}
    out |= {"path:" + w for w in _WORDS.findall(path.lower())}
    out |= {"query:" + q.partition("=")[0] for q in query.split("&") if q}
    out |= {"fragment"} if fragment else set()
    return sorted(out)


def baskets(pages: DataFrame) -> DataFrame:
    """page_id and tokens of each URL."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tokens(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(rows, pa.list_(pa.string()))], names=["page_id", "tokens"])

    return pick(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, tokens array<string>")


Rule = tuple[frozenset[str], float, float, float]
#: Tokens that come together in all labelled rows: a rule asks for one of them.
Item = tuple[str, ...]
ItemRule = tuple[frozenset[Item], float, float, float]


def mine(pages: DataFrame, labels: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> list[Rule]:
    """The rules of `mine_items` over single tokens: a product over the tokens of each item, so for small results only."""
    return [(frozenset(choice), *rest) for of, *rest in mine_items(pages, labels, support=support, confidence=confidence, lift=lift) for choice in product(*of)]


def mine_items(pages: DataFrame, labels: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> list[ItemRule]:
    """(items, confidence, lift, support) of the pruned rules that lead to bad."""
    known = pick(labels, "doc_id", "quality").where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("labelled"), "quality")
    rows = materialize(pick(pages, "page_id", "url").join(known, F.col("page_id") == F.col("labelled")).select("url", "quality"), "labelled")
    rows = rows.select(F.monotonically_increasing_id().alias("page_id"), "url", "quality")
    classes = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(classes) < 2:
        return []
    marked = baskets(rows.where("quality = 0")).withColumn("bad", F.lit(True)).unionByName(baskets(rows.where("quality = 1")).withColumn("bad", F.lit(False)))
    total = sum(classes.values())
    least = min(max(support, SUPPORT_ROWS / total), 1.0)
    # tokens with equal marks come together in all rows; a rule's tokens are in enough bad rows
    each = marked.select("bad", F.xxhash64("page_id").alias("a"), F.xxhash64("page_id", F.lit(1)).alias("b"), F.explode("tokens").alias("token"))
    found = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("bad") >= least * total - 1e-6).collect()
    together: dict[tuple, list[str]] = defaultdict(list)
    for r in sorted(found, key=lambda r: r["token"]):
        together[r["n"], r["bad"], r["a"], r["b"]].append(r["token"])
    # items are numbered, those of most bad rows first
    items = [tokens_ for _, tokens_ in sorted(together.items(), key=lambda g: (-g[0][1], g[1][0]))]
    number = {tokens_[0]: i for i, tokens_ in enumerate(items)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sorted(number[t] for t in row if t in number) for row in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column("bad")], names=["items", "bad"])

    numbered = materialize(marked.select("bad", "tokens").mapInArrow(run, "items array<int>, bad boolean"), "numbered")
    wide = [r["item"] for r in numbered.where(F.size("items") > MOST_ITEMS).select(F.explode(F.slice("items", MOST_ITEMS + 1, F.size("items"))).alias("item")).distinct().collect()]
    apart = F.split(F.lit(",".join(map(str, wide))), ",").cast("array<int>") if wide else F.array().cast("array<int>")
    narrow = numbered.select(F.concat(F.array_except("items", apart), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<int>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(narrow)
    rules = model.associationRules.where(F.col("consequent")[0] == BAD).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support")
    if wide:
        share = classes[0] / total
        own = F.array_intersect("items", apart)
        rest = F.concat(own, F.array_except("items", apart))
        grown = _grown(numbered.select(rest.alias("rest"), F.size(own).alias("upto"), "bad"), math.ceil(least * total), max(confidence, lift * share))
        sure = F.col("bad") / F.col("n")
        grown = grown.select(F.array_sort("antecedent").alias("antecedent"), sure.alias("confidence"), (sure / share).alias("lift"), (F.col("bad") / total).alias("support"))
        rules = rules.unionByName(grown.where(F.col("confidence") >= confidence))
    rules = rules.where(F.col("lift") >= lift).persist()
    found = _uncovered(rules).collect()
    rules.unpersist()
    kept = prune([(frozenset(r["antecedent"]), r["confidence"], r["lift"], r["support"]) for r in found])
    return [(frozenset(tuple(items[i]) for i in of), *rest) for of, *rest in kept]


def _grown(rows: DataFrame, least: int, confidence: float) -> DataFrame:
    """antecedent, bad and n (bad rows, all rows) of the sets with one of the first `upto` items of a row's `rest` that have
    `least` bad rows and the confidence. All that no shorter rule covers are there, of the others some."""

    def split(rows: DataFrame) -> DataFrame:
        step = "transform(sequence(1, upto), i -> named_struct('prefix', concat(prefix, array(rest[i - 1])), 'rest', slice(rest, i + 1, size(rest))))"
        return rows.where("upto > 0").select("bad", F.explode(F.expr(step)).alias("to")).select("bad", "to.prefix", "to.rest")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets = grow(key[0].as_py(), table.column("rest").combine_chunks(), table.column("bad").to_numpy(), least, confidence)
        return pa.table({"antecedent": pa.array([s for s, *_ in sets], pa.list_(pa.int32())), "bad": pa.array([b for _, b, _ in sets], pa.int64()), "n": pa.array([n for *_, n in sets], pa.int64())})

    out = []
    rows = rows.withColumn("prefix", F.array().cast("array<int>"))
    while True:
        rows = materialize(split(rows), "projected")
        sizes = rows.groupBy("prefix").agg(F.sum(F.size("rest") + 1).alias("entries"), F.count_if("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
        sizes = materialize(sizes.where(F.col("bad") >= least), "sizes")
        small, large = sizes.where(F.col("entries") <= MOST_ENTRIES), sizes.where(F.col("entries") > MOST_ENTRIES)
        out.append(rows.join(small.select("prefix"), "prefix", "left_semi").groupBy("prefix").applyInArrow(run, "antecedent array<int>, bad long, n long"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(large.select(F.col("prefix").alias("antecedent"), "bad", "n"))
        rows = rows.join(large.select("prefix"), "prefix", "left_semi").withColumn("upto", F.size("rest"))


def grow(prefix: list[int], rests: pa.ListArray, is_bad: np.ndarray, least: int, confidence: float) -> list[tuple[list[int], int, int]]:
    """(set, bad rows, all rows) of `prefix` and of the sets above it, from the rows that hold it, by bit sets of rows.

    Left out: sets of fewer than `least` bad rows or less confidence, and those that a set with one item less, `prefix`
    kept, covers with no less confidence."""
    row, item = np.repeat(np.arange(len(rests)), rests.value_lengths().to_numpy(zero_copy_only=False)), rests.flatten().to_numpy(zero_copy_only=False)
    names, item = np.unique(item, return_inverse=True)
    enough = np.bincount(item[is_bad[row]], minlength=len(names)) >= least

    def bit_sets(kind: np.ndarray) -> tuple[int, dict[int, int]]:
        of = np.flatnonzero(kind[row] & enough[item])
        of = of[np.argsort(item[of], kind="stable")]
        at, ends = (np.cumsum(kind) - 1)[row[of]], np.searchsorted(item[of], np.arange(len(names) + 1))
        out = {}
        for i in np.flatnonzero(enough):
            flags = np.zeros(int(kind.sum()), bool)
            flags[at[ends[i] : ends[i + 1]]] = True
            out[int(names[i])] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        return (1 << int(kind.sum())) - 1, out

    (all_bad, bad_of), (all_good, good_of) = bit_sets(is_bad), bit_sets(~is_bad)
    out: list[tuple[list[int], int, int]] = []
    if all_bad.bit_count() >= max(least, confidence * len(rests) - 1e-6):
        out.append((prefix, all_bad.bit_count(), len(rests)))

    def sure(chosen: list[int]) -> float:
        bad = reduce(and_, (bad_of[i] for i in chosen), all_bad).bit_count()
        return bad / (bad + reduce(and_, (good_of[i] for i in chosen), all_good).bit_count())

    def extend(chosen: list[int], good: int, without: list[int], tail: list[tuple[int, int, int]]) -> None:
        """`good`: the good rows of `chosen`; `without`: those of `chosen` less one of its items, for each; `tail`: items that
        may follow, with the bad and the good rows left."""
        tail.sort(key=lambda t: (t[2].bit_count(), t[0]))
        last = [good]  # good rows that all items from here on leave
        for *_, g in reversed(tail):
            last.append(last[-1] & g)
        last.reverse()
        for k, (i, bad, left) in enumerate(tail):
            n_bad, own = bad.bit_count(), [*chosen, i]
            if n_bad < confidence * (n_bad + last[k].bit_count()) - 1e-6:
                continue
            mine_ = n_bad / (n_bad + left.bit_count())
            if mine_ >= confidence - 1e-9 and all(sure([j for j in own if j != t]) < mine_ for t in own):
                out.append(([*prefix, *own], n_bad, n_bad + left.bit_count()))
            lacks = [*(w & good_of[i] for w in without), good]
            further = []
            for j, b, g in tail[k + 1 :]:
                b, g = b & bad, g & left
                if b.bit_count() >= least and g != left and all(w & good_of[j] != g for w in lacks):
                    further.append((j, b, g))
            if further:
                extend(own, left, lacks, further)

    extend([], all_good, [], [(i, b, good_of[i]) for i, b in bad_of.items() if good_of[i] != all_good])
    return out


def _uncovered(rules: DataFrame) -> DataFrame:
    """Without rules that a rule with one token less covers with no less confidence; those that only still shorter ones
    cover are left to prune."""
    shorter = rules.where(F.size("antecedent") > 1).select("antecedent", F.col("confidence").alias("own"), F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))).alias("part"))
    covered = shorter.join(rules.select(F.col("antecedent").alias("part"), "confidence"), "part").where("confidence >= own").select("antecedent").distinct()
    return rules.join(covered, "antecedent", "left_anti")


def prune(rules: list[Rule]) -> list[Rule]:
    """Without rules that a shorter one covers with no less confidence."""
    kept: list[Rule] = []
    by_token: dict[str, list[Rule]] = defaultdict(list)
    for rule in sorted(rules, key=lambda r: (len(r[0]), -r[1], sorted(r[0]))):
        shorter = {id(k): k for t in rule[0] for k in by_token[t]}.values()
        if any(k[0] <= rule[0] and k[1] >= rule[1] for k in shorter):
            continue
        kept.append(rule)
        by_token[min(rule[0])].append(rule)
    return kept


class Index:
    """From tokens to their items, and from each rule's rarest item to the rule: it grows with the tokens and the rules."""

    def __init__(self, rules: list[ItemRule]):
        often = Counter(item for items, *_ in rules for item in items)
        self.item_of = {token: item for item in often for token in item}
        self.by_item: dict[Item, list[frozenset[Item]]] = defaultdict(list)
        for items, *_ in rules:
            self.by_item[min(items, key=lambda i: (often[i], i))].append(items)

    def blocks(self, found: list[str]) -> bool:
        own = {self.item_of[t] for t in found if t in self.item_of}
        return any(rule <= own for item in own if item in self.by_item for rule in self.by_item[item])


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    index = pages.sparkSession.sparkContext.broadcast(Index(mine_items(pages, labels)))
    rows = pick(pages, "page_id", "url")
    host, path = url_parts(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path")).select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [v or ("block" if index.value.blocks(tokens(u)) else "allow") for v, u in zip(batch.column("verdict").to_pylist(), batch.column("url").to_pylist(), strict=True)]
            columns = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
