"""Shakiness and model usability: rules over summary rows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quoted

# The weight of each usability flag.
WEIGHTS = {"HM": 5.0, "MM": 3.0, "ID": 4.0, "BN": 1.0, "CV": 5.0, "EO": 2.5, "ES": 2.0, "EK": 2.0, "NN": 1.5, "ZH": 2.5, "UC": 1.0}
# Parts of names that ids have, and names that measures have.
ID_PARTS = ("id", "key", "code", "num", "no")
MEASURES = ("revenue", "price", "amount", "value", "cost", "sales", "profit", "income")


def _if(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _non_normal() -> Column:
    return _if(quoted("Normality_Test").contains("NON-NORMAL"))


def _far(name: str, limit: float) -> Column:
    c = quoted(name)
    return _if(~F.isnan(c) & (F.abs(c) > limit))


def with_shakiness(summary: DataFrame, distinct: str, limits: dict[str, float], threshold: int, *, fix_skew: bool = False) -> DataFrame:
    """Adds Shakiness_Score and Quality_Flag. The model's skewness term never counts, as it looks for another name;
    fix_skew makes it count."""
    ratio = quoted("Uniqueness_Ratio")
    terms = [
        quoted("Pct_Missing") > 100 * limits["missing"],
        (ratio == 0) | (quoted(distinct) == 1) | (ratio < 1 - limits["constant"]),
        ratio > 0.95,
        _far("Kurtosis", limits["kurtosis"]),
        quoted("Pct_Outliers") > 100 * limits["outlier"],
        _non_normal(),
    ]
    if fix_skew:
        terms.append(_far("skew", limits["skew"]))
    score = F.lit(0)
    for t in terms:
        score = score + _if(t).cast("int")
    return summary.withColumn("Shakiness_Score", score).withColumn("Quality_Flag", F.when(F.col("Shakiness_Score") >= threshold, "⚠ SHAKY").otherwise("✓ OK"))


def usability_flags(distinct: str, correlated: bool) -> dict[str, Column]:
    name, ratio, missing, n = F.lower(F.col("Column")), quoted("Uniqueness_Ratio"), quoted("Pct_Missing"), quoted(distinct)
    counted = quoted("Count") > 0
    named = name.rlike("|".join(ID_PARTS))
    looks_id = F.when(named, (n > 1000) | ((ratio > 0.1) & (n > 100))).otherwise((ratio > 0.95) & ~name.isin(*MEASURES))
    return {
        "HM": missing > 90,
        "MM": (missing > 50) & ~(missing > 90),
        "CV": counted & (n == 1),
        "BN": counted & (n == 2),
        "ID": counted & ~n.isin(1, 2) & looks_id,
        "EO": quoted("Pct_Outliers") > 10,
        "ES": _far("skew", 3),
        "EK": _far("Kurtosis", 7),
        "NN": _non_normal(),
        "ZH": quoted("Pct_Zero") > 80,
        "UC": _non_normal() if correlated else F.lit(False),
    }


def with_usability(summary: DataFrame, distinct: str, correlated: bool) -> DataFrame:
    """Adds Usability_Flags, Usability_Score and Recommendation."""
    flags = {k: _if(c) for k, c in usability_flags(distinct, correlated).items()}
    weight = F.lit(0.0)
    for k, c in flags.items():
        weight = weight + F.when(c, WEIGHTS[k]).otherwise(0.0)
    total = sum(WEIGHTS.values())
    names = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))), ",")
    score = F.col("Usability_Score")
    # The advice texts and the scores that divide them.
    advice = (
        F.when(flags["CV"], "Drop - constant value")
        .when(flags["HM"], "Drop - too many missing values")
        .when(flags["ID"], "Drop - likely an ID column")
        .when(score < 30, "Use with extreme caution")
        .when(score < 50, "Use with caution")
        .when(score < 70, "Review before using")
        .when(score < 90, "Minor issues - review")
        .otherwise("Good for modeling")
    )
    out = summary.withColumn("Usability_Flags", F.when(names == "", "-").otherwise(names))
    return out.withColumn("Usability_Score", F.greatest(F.lit(0.0), 100 - weight / total * 100)).withColumn("Recommendation", advice)
