"""Distinct counts that merge: exact states and sketches, kept per group and united later.

A new day of the log is made into states of its own and merged into the stored ones; rows that are in
already are never read again. The exact state is a bitmap for each 32,768 neighbouring ids, so a group's
state is spread over rows and no task holds a group. A sketch is one small value a group, with an error that
its size bounds; it is the choice where ids are text or millions of groups are kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Registers of a sketch: 2 ** LG_K of them.
LG_K = 14


def distinct_state(events: DataFrame, by: list[str], entity: str, sums: dict[str, str] | None = None) -> DataFrame:
    """(by, _bucket, sums, _ids): sums and exact sets of whole-number ids. Rows without an id count in the sums."""
    made = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (sums or {}).items()]
    ids = F.bitmap_construct_agg(F.bitmap_bit_position(entity)).alias("_ids")
    return events.groupBy(*by, F.bitmap_bucket_number(entity).alias("_bucket")).agg(*made, ids)


def merged_states(states: list[DataFrame], by: list[str], sums: list[str] = ()) -> DataFrame:
    """One state of several: sums added, sets united."""
    made = [F.sum(c).alias(c) for c in sums]
    return reduce(DataFrame.unionByName, states).groupBy(*by, "_bucket").agg(*made, F.bitmap_or_agg("_ids").alias("_ids"))


def from_state(state: DataFrame, by: list[str], name: str, sums: list[str] = ()) -> DataFrame:
    """The sums and the distinct count of each group."""
    return state.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], F.sum(F.bitmap_count("_ids")).cast("long").alias(name))


def distinct_sketches(events: DataFrame, by: list[str], entity: str, lg_k: int = LG_K) -> DataFrame:
    """(by, _sketch): a mergeable sketch of each group's distinct values. Groups without a value have an empty one."""
    return events.groupBy(*by).agg(F.hll_sketch_agg(F.col(entity), lg_k).alias("_sketch"))


def sketched_counts(sketches: DataFrame, by: list[str], name: str) -> DataFrame:
    """The distinct count of each group, estimated from the union of its sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias(name))


def error_bound(lg_k: int = LG_K) -> float:
    """Four standard errors of an estimate, as a share of the count."""
    return 4 * 1.04 / 2 ** (lg_k / 2)
