"""Quantiles that merge: rank sketches, kept per group and united later.

A sketch is a few kilobytes whatever the size of its group, so the quantiles of a new day need no look at the
days before, and no value is shuffled. The error is one of rank: the value given for q lies between the exact
quantiles of q - e and q + e. A group of at most about ``k`` values is exact up to the choice of a neighbour.
The exact quantiles of ``scale.quantiles`` remain the default everywhere.

Sketches draw random numbers: two runs may give different values, both within the bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Size of a sketch: its rank error falls about as 1 / K.
K = 1000


def quantile_sketches(df: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """(by, _ranks): a mergeable sketch of each group's values. NULLs are left out; a group without a value has an
    empty sketch."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), k).alias("_ranks"))


def merged_sketches(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One sketch for each of the coarser groups ``by``."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("_ranks", k).alias("_ranks"))


def sketched_quantiles(sketches: DataFrame, by: list[str], points: dict[str, float], k: int = K) -> DataFrame:
    """One column per point for each group of the united sketches; NULL for a group without a value."""
    merged = merged_sketches(sketches, by, k)
    some = F.kll_sketch_get_n_double("_ranks") > 0
    values = [F.when(some, F.kll_sketch_get_quantile_double("_ranks", F.lit(float(q)))).alias(name) for name, q in points.items()]
    return merged.select(*by, *values)


def rank_error_bound(k: int = K) -> float:
    """Twice the published error of 99 % of all ranks, 2.296 / k ** 0.9021: some five standard errors."""
    return 2 * 2.296 / k**0.9021
