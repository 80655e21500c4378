"""Rank sketches against exact ranks, over distributions, merges, NULLs and empty groups."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import quantile_sketches as sketches
from cohortlens.operators import stats

POINTS = {"low": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 0.99}
# even, few values with heavy ties, a long tail
SHAPES = {"even": "id * 7919 % 100003", "tied": "floor(pow(id % 17, 2) / 40)", "tail": "1e9 / (1 + id * 31 % 60013)"}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("k", [200, 1000])
def test_ranks_stay_within_the_bound_after_a_merge(spark, shape, k):
    values = spark.range(60000).selectExpr("id % 4 AS g", "id % 11 AS day", f"CAST({SHAPES[shape]} AS DOUBLE) AS x")
    made = sketches.sketched_quantiles(sketches.quantile_sketches(values, ["g", "day"], "x", k), ["g"], POINTS, k).collect()
    exact = {}
    for row in values.collect():
        exact.setdefault(row["g"], []).append(row["x"])
    assert len(made) == 4
    e = sketches.rank_error_bound(k)
    for row in made:
        held = exact[row["g"]]
        for name, q in POINTS.items():
            assert sum(x < row[name] for x in held) <= (q + e) * len(held)
            assert sum(x <= row[name] for x in held) >= (q - e) * len(held)


def test_groups_without_values(spark):
    given = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 5.0)], "g string, x double")
    made = {r["g"]: r["m"] for r in sketches.sketched_quantiles(sketches.quantile_sketches(given, ["g"], "x"), ["g"], {"m": 0.5}).collect()}
    assert made == {"a": 1.0, "b": None, None: 5.0}
    assert sketches.sketched_quantiles(sketches.quantile_sketches(given.limit(0), ["g"], "x"), ["g"], {"m": 0.5}).collect() == []


def test_box_and_trim_by_sketch(spark):
    given = spark.range(20001).select(F.lit("all").alias("g"), (F.col("id") * 7 % 20001).cast("double").alias("x"))
    e = sketches.rank_error_bound(500) * 20001
    box = stats.box_stats(given, "g", "x", sketch=500).first()
    assert box["count"] == 20001 and box["outliers"] == 0 and box["whisker_low"] == 0 and box["whisker_high"] == 20000
    assert abs(box["median"] - 10000) <= e and abs(box["q1"] - 5000) <= e
    assert abs(stats.trim_quantile(given, "x", 0.9, sketch=500).count() - 18000) <= e
