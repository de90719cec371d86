"""Connected components of a table of links, by alternating large-star and small-star rounds.

Only aggregates and joins: a node with very many links is pre-aggregated before the shuffle. From SPLIT links on, the
least neighbours are written before they are joined, so both sides of the join are plain shuffles and the partition of
such a node can be split; fewer links fit one task anyway. Each round is written to the shared folder; the driver sees
two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPLIT = 500_000


def _with_least(links: DataFrame, split: bool) -> DataFrame:
    least = links.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
    return links.join(materialize(least, "least") if split else least, F.col("a") == F.col("k")).drop("k")


def components(links: DataFrame, *, split_at: int = SPLIT) -> DataFrame:
    """From links (a, b): (node, root) for every node that isn't the least of its component, root being the least."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links, seen = materialize(links, "links"), None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, split = now, now[0] >= split_at
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, split).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        small = _with_least(materialize(large, "large") if split else large, split)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        links = materialize(small, "links")
