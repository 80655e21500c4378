"""Mergeable distinct counts: exact states and sketches against sets."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import distinct


def log(spark, rows):
    return spark.createDataFrame(rows, "date int, id_student long, sum_click long").repartition(3)


def random_rows(seed, n=2000):
    rng = random.Random(seed)
    ids = [None, 0, 1, 32767, 32768, 2**40, *range(100, 400)]
    return [(rng.choice([None, -3, 0, 1, 2, 9]), rng.choice(ids), rng.choice([None, 1, 7])) for _ in range(n)]


def plain(rows):
    made = {}
    for day, key, value in rows:
        total, keys = made.setdefault(day, [0, set()])
        made[day][0] = total + (value or 0)
        if key is not None:
            keys.add(key)
    return {day: (total, len(keys)) for day, (total, keys) in made.items()}


@pytest.mark.parametrize("parts", [1, 4])
def test_merged_states_match_sets(spark, parts):
    rows = random_rows(parts)
    states = [distinct.distinct_state(log(spark, rows[i::parts]), ["date"], "id_student", {"clicks": "sum_click"}) for i in range(parts)]
    got = distinct.from_state(distinct.merged_states(states, ["date"], ["clicks"]), ["date"], "people", ["clicks"])
    assert {r.date: (r.clicks, r.people) for r in got.collect()} == plain(rows)


def test_merging_twice_changes_no_set(spark):
    state = distinct.distinct_state(log(spark, random_rows(5)), ["date"], "id_student")
    once = distinct.from_state(state, ["date"], "people").orderBy("date").collect()
    assert distinct.from_state(distinct.merged_states([state, state], ["date"]), ["date"], "people").orderBy("date").collect() == once


def test_empty_log(spark):
    assert distinct.from_state(distinct.distinct_state(log(spark, []), ["date"], "id_student"), ["date"], "people").collect() == []
    assert distinct.sketched_counts(distinct.distinct_sketches(log(spark, []), ["date"], "id_student"), ["date"], "people").collect() == []


def test_sketches_stay_within_the_bound(spark):
    """Two hundred groups of 1 to 200,000 ids, each sketched in two overlapping parts."""
    rows = spark.range(200).select(F.col("id").alias("g"), (F.pow(F.lit(1.063), F.col("id"))).cast("long").alias("n"))
    ids = rows.select("g", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    parts = [distinct.distinct_sketches(ids.where(f"i <= n * {a} AND i > n * {b}"), ["g"], "i") for a, b in ((0.7, 0), (1, 0.4))]
    got = distinct.sketched_counts(parts[0].unionByName(parts[1]), ["g"], "people").join(rows, "g")
    worst = got.select(F.max(F.abs(F.col("people") - F.col("n")) / F.col("n"))).first()[0]
    assert 0 < worst <= distinct.error_bound()
