"""As-of features and cells of the log against plain counting."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from checks import bindings as b
from cohortlens.operators import as_of, features
from cohortlens.operators.as_of import cells
from tests.conftest import DATA
from tests.test_plans import final_plan


def log(spark, rows):
    return spark.createDataFrame(rows, "id_student long, id_site long, date int, sum_click long").repartition(3)


def site_table(spark, kinds):
    return spark.createDataFrame(kinds, "id_site long, activity_type string")


def plain(rows, kinds, cut=None):
    made = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == key and (cut is None or (r[2] is not None and r[2] <= cut))]
        values = [r[3] for r in mine if r[3] is not None]
        made[key] = (
            sum(values), len({r[2] for r in mine if r[2] is not None}), statistics.stdev(values) if len(values) > 1 else 0.0,
            len({k for r in mine for s, k in kinds if s == r[1] and k is not None}), max((r[2] for r in mine if r[2] is not None), default=None),
        )
    return made


def random_log(seed, n=500):
    rng = random.Random(seed)
    return [
        (
            rng.choice([None, 1, 1, 1, 2, 3, 4]), rng.choice([None, *range(12)]), rng.choice([None, -70, -64, -1, 0, 63, 64, 5000, *range(-20, 260, 9)]),
            rng.choice([None, 0, 1, 5, 10**6]),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_log_features_match_plain_counting(spark, seed):
    rows = random_log(seed)
    kinds = [(s, f"k{s % 5}") for s in range(10)] + [(10, None), (3, "another"), (3, "another")]
    got = features.click_features(log(spark, rows), site_table(spark, kinds)).collect()
    want = plain(rows, kinds)
    assert {r.id_student for r in got} == set(want)
    for r in got:
        total, days, std, types, last = want[r.id_student]
        assert (r.total_clicks, r.active_days, r.unique_activity_types, r.last_active_day) == (total, days, types, last)
        assert r.click_std == pytest.approx(std)
        assert r.clicks_day30 == plain(rows, kinds, 30)[r.id_student][0]
    found = as_of.as_of_clicks(log(spark, rows), site_table(spark, kinds), (-64, 0, 30, 200)).collect()
    assert len(found) == 4 * len(want)
    for r in found:
        total, days, std, types, last = plain(rows, kinds, r.as_of)[r.id_student]
        assert (r.total_clicks, r.active_days, r.unique_activity_types, r.last_active_day) == (total, days, types, last)
        assert r.click_std == pytest.approx(std)


@pytest.mark.parametrize("n_kinds", [70, 600])
def test_many_kinds(spark, n_kinds):
    rows = [(1, s, 1, 1) for s in range(n_kinds)] + [(2, s, 2, 1) for s in range(0, n_kinds, 2)]
    got = features.click_features(log(spark, rows), site_table(spark, [(s, f"k{s}") for s in range(n_kinds)]))
    assert got.columns[-2:] == ["unique_activity_types", "last_active_day"]
    assert {r.id_student: r.unique_activity_types for r in got.collect()} == {1: n_kinds, 2: n_kinds // 2}


def test_empty_log(spark):
    assert features.click_features(log(spark, []), site_table(spark, [])).collect() == []
    assert as_of.as_of_clicks(log(spark, []), site_table(spark, [(1, "a")])).collect() == []


def test_the_log_is_read_and_exchanged_once(spark):
    plan = final_plan(features.click_features(b.clicks(spark, DATA), b.sites(spark, DATA))).split("Initial Plan")[0]
    # sites are settled beforehand: one scan of the log, one exchange of cells, one of learners' cells
    assert plan.count("FileScan parquet") == 2 and plan.count("events.parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 2, plan
    assert "Expand" not in plan


def test_hot_learner_arrives_as_cells(spark):
    """Every task sends a learner's rows as a few cells, however many they are."""
    rows = spark.range(200_000).select(F.lit(7).cast("long").alias("id_student"), (F.col("id") % 256).cast("int").alias("date"), F.lit(1).cast("long").alias("v"))
    assert cells(rows, "id_student", "date", (30,), "v").select(F.size("cells")).first()[0] == 5


def test_later_days_change_nothing(spark):
    """What is known on a day doesn't depend on what follows it."""
    early = [(1, 5, 50.0, 10), (1, 6, 70.0, 20), (2, 5, None, 3)]
    late = [(1, 5, 10.0, 90), (3, 6, 20.0, 95)]
    items = spark.createDataFrame([(5, "TMA", 15), (6, "Exam", None)], "id_assessment long, assessment_type string, date int")

    def known(rows):
        frame = spark.createDataFrame(rows, "id_student long, id_assessment long, score double, date_submitted int")
        made = as_of.as_of_scores(frame, items, (30, 60)).where("id_student < 3").orderBy("id_student", "as_of")
        return [tuple(r) for r in made.collect()]

    assert known(early) == known(early + late)
    first = known(early)[0]
    assert first == (1, 30, 60.0, pytest.approx(14.142135623), 2, 50.0, 70.0, 0)


def test_cut_days_must_ascend(spark):
    with pytest.raises(ValueError):
        as_of.as_of_features({}, (60, 30))


def test_scores_come_together_by_learner_before_they_become_cells(spark):
    """Else a task of rows dealt by assessment holds a cell for nearly every row."""
    made = [(i % 40, i // 40 + i % 40 * 50, float(i % 101), i % 90) for i in range(2000)] + [(None, 1, 50.0, 3)] * 5
    rows = spark.createDataFrame(made, "id_student long, id_assessment long, score double, date_submitted int").repartition(8, "id_assessment")
    dealt = as_of.together(rows, "id_student")
    assert dealt.columns == rows.columns
    held = dealt.withColumn("_task", F.spark_partition_id()).groupBy("id_student").agg(F.count_distinct("_task").alias("tasks"), F.count(F.lit(1)).alias("n"))
    assert sorted(tuple(r) for r in held.collect()) == [(k, 1, 50) for k in range(40)]
    items = spark.range(2000).selectExpr("id AS id_assessment", "'TMA' AS assessment_type", "CAST(id % 80 AS INT) AS date")
    plan = as_of.as_of_scores(rows, items, (30, 60))._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    # a hot learner's part may be split, so cells are combined in each task and exchanged
    assert "partial_bit_or" in plan
