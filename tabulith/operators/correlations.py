"""Correlations of numeric columns: one aggregate for all pairs; for Spearman, ranks first."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dtypes import is_numeric, numeric_columns
from ..functions.stats import correlation, quoted, wide_code
from .selection import average_ranks, release

METHODS = ("pearson", "spearman")
#: Pairs for each aggregate, which has ten fields for each.
PAIRS_AT_ONCE = 120


def _checked(method: str) -> None:
    if method not in METHODS:
        raise ValueError("method is 'pearson' or 'spearman'")


def _ready(df: DataFrame, names: list[str], method: str) -> tuple[DataFrame, dict[str, Column]]:
    if method == "pearson":
        return df, {c: quoted(c).cast("double") for c in names}
    slots = {f"c{i}": quoted(c) for i, c in enumerate(names)}
    ranks = average_ranks(df, slots)
    return ranks, {c: F.col(f"c{i}") for i, c in enumerate(names)}


def pairs(df: DataFrame, wanted: list[tuple[str, str]], method: str = "pearson") -> dict[tuple[str, str], float | None]:
    """The correlation of each pair, over rows where both are there."""
    names = list(dict.fromkeys(c for p in wanted for c in p))
    frame, columns = _ready(df, names, method)
    persisted = method == "spearman" and len(wanted) > PAIRS_AT_ONCE
    ranks, frame = frame, frame.persist() if persisted else frame
    out: dict[tuple[str, str], float | None] = {}
    for at in range(0, len(wanted), PAIRS_AT_ONCE):
        part = wanted[at : at + PAIRS_AT_ONCE]
        with wide_code(df.sparkSession):
            row = frame.agg(*[correlation(columns[a], columns[b]).alias(f"r{i}") for i, (a, b) in enumerate(part)]).first()
        out |= {p: row[f"r{i}"] for i, p in enumerate(part)}
    if persisted:
        frame.unpersist()
    release(ranks)
    return out


def split(r: Column, how: str | None, threshold: float) -> Column:
    """r where it is on the wanted side of the threshold, else null."""
    tests = {"pos": r > threshold, "neg": r < -threshold, "high": F.abs(r) > threshold, "low": F.abs(r) < threshold}
    return r if how is None else F.when(tests[how], r)


def table(df: DataFrame, columns: list[str] | None = None, *, split_by: str | None = None, threshold: float = 0.0, target: str | None = None, method: str = "pearson") -> DataFrame:
    """(row, col, position, r): the matrix in long form, or with a target its row (null correlations there are 0)."""
    _checked(method)
    if split_by not in (None, "pos", "neg", "high", "low"):
        raise ValueError("split is None, 'pos', 'neg', 'high' or 'low'")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold is from 0 to 1")
    if split_by in ("high", "low") and threshold == 0:
        threshold = 0.3
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if target is not None:
        if target not in kinds:
            raise ValueError(f"no column {target!r}")
        if not is_numeric(kinds[target]):
            raise ValueError(f"{target!r} isn't numeric")
    names = [c for c in numeric_columns(df.schema, columns) if c != target]
    if not names or target is None and len(names) < 2:
        raise ValueError("at least two numeric columns are needed")
    if target is not None:
        found = pairs(df, [(target, c) for c in names], method)
        rows = [(target, c, i, found[target, c] if found[target, c] is not None else 0.0) for i, c in enumerate(names)]
    else:
        found = pairs(df, list(combinations(names, 2)), method)
        found |= {(b, a): r for (a, b), r in found.items()} | {(c, c): 1.0 for c in names}
        rows = [(a, b, i * len(names) + j, found[a, b]) for i, a in enumerate(names) for j, b in enumerate(names)]
    frame = df.sparkSession.createDataFrame(rows, "row string, col string, position int, r double").coalesce(1)
    return frame.withColumn("r", split(F.col("r"), split_by, threshold))


def cluster_order(matrix: np.ndarray) -> list[int]:
    """Leaf order of average linkage over 1 - |r|; for matrices of columns, on the driver.

    Of equal distances the first pair of groups merges, a merged group coming after all others. Distances to a merged
    group follow from those to its parts (Lance and Williams), and each group keeps its nearest later one, so the time grows
    about as the square of the columns."""
    n = len(matrix)
    if not n:
        return []
    distance = np.full((2 * n - 1, 2 * n - 1), np.inf)
    distance[:n, :n] = 1 - np.abs(np.nan_to_num(matrix))
    distance[np.tril_indices(2 * n - 1)] = np.inf  # a pair stands once, by its later group's column
    leaves = {i: [i] for i in range(n)}
    near, at = distance.min(1), distance.argmin(1)
    for new in range(n, 2 * n - 1):
        i = int(near.argmin())
        j = int(at[i])
        a, b = len(leaves[i]), len(leaves[j])
        to = lambda k: np.fmin(distance[k, :], distance[:, k])
        mean = (a * to(i) + b * to(j)) / (a + b)
        mean[[i, j]] = np.inf
        distance[[i, j], :] = distance[:, [i, j]] = np.inf
        near[[i, j]] = np.inf
        distance[:new, new] = mean[:new]
        leaves[new] = leaves.pop(i) + leaves.pop(j)
        for k in leaves:
            if k == new:
                continue
            if at[k] in (i, j) and near[k] < np.inf:
                near[k], at[k] = distance[k].min(), distance[k].argmin()
            elif distance[k, new] < near[k]:
                near[k], at[k] = distance[k, new], new
    return next(iter(leaves.values()))
