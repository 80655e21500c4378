"""What the physical plans look like: pushdown, pruning, skew handling, no cross products."""

import pytest
from pyspark.sql import functions as F

from checks import bindings as b
from cohortlens.operators.features import click_features, score_features
from cohortlens.operators.scale import salted_left_join, settled_quantiles
from cohortlens.operators.select import filter_in
from cohortlens.operators.stats import enrolment_score_counts
from cohortlens.operators.summaries import daily_series, hierarchy_counts
from tests.conftest import DATA


@pytest.fixture()
def conf(spark):
    kept = {}

    def use(**settings):
        for name, value in settings.items():
            key = name.replace("__", ".")
            kept[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield use
    for key, value in kept.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    made = daily_series(filter_in(b.clicks(spark, DATA), {"id_student": [3, 4]}))
    plan = final_plan(made)
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    assert "In(user_id, [3,4])" in plan


def test_click_features_have_no_expand(spark):
    plan = final_plan(click_features(b.clicks(spark, DATA), b.sites(spark, DATA)))
    assert "Expand" not in plan and "CartesianProduct" not in plan


def test_rollup_expands_counts_not_rows(spark):
    rows = b.enrolments(spark, DATA)
    plan = final_plan(hierarchy_counts(rows, ["gender", "age_band", "final_result"])).split("Initial Plan")[0]
    # Below the Expand there is an aggregate that has counted the leaves.
    assert "HashAggregate" in plan.split("Expand")[1]


def test_hot_item_is_split_by_the_join(spark, conf):
    """A third of the submissions has one assessment and the dimension is too big to broadcast."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
    )
    submissions = spark.range(0, 200000, 1, 8).select(
        (F.col("id") % 1000).alias("id_student"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("id_assessment"),
        F.lit(50.0).alias("score"), F.lit(5).alias("date_submitted"),
    )
    items = spark.range(0, 5000).select(
        F.col("id").alias("id_assessment"), F.lit("TMA").alias("assessment_type"), F.lit(3).alias("date")
    )
    made = score_features(submissions, items)
    assert "skew=true" in final_plan(made)
    assert made.agg(F.sum("late_submissions").alias("n")).first()["n"] == 200000


def test_hot_learner_is_dealt_over_tasks(spark, conf):
    """The rows of the hot key end up in many partitions of the joined table."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    rows = spark.range(0, 30000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id"
    )
    lookup = spark.range(0, 30000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    made = salted_left_join(rows, [lookup], ["k"], rows_per_task=500)
    spread = made.where("k = 0").groupBy(F.spark_partition_id().alias("p")).count()
    # spark_partition_id is read below the regrouping, in the task that joined the rows.
    assert spread.count() >= 7
    assert spread.agg(F.max("count").alias("m")).first()["m"] < 10000 / 2


def test_pairs_of_a_learner_are_not_emitted(spark):
    """One learner with 3,000 scores and 3,000 enrolments has 9 million pairs; the join of the
    counted sides has one row per score and outcome."""
    scored = spark.range(3000).select(
        F.lit(1).alias("id_student"), F.lit("TMA").alias("assessment_type"),
        (F.col("id") % 100).cast("double").alias("score"),
    )
    info = spark.range(3000).select(
        F.lit(1).alias("id_student"), F.when(F.col("id") % 2 == 0, "Pass").otherwise("Fail").alias("final_result")
    )
    made = enrolment_score_counts(scored, info)
    assert made.count() == 200 and made.agg(F.sum("times").alias("n")).first()["n"] == 9_000_000
    medians = settled_quantiles(made, 200, ["final_result"], "score", "times", {"m": 0.5})
    assert {r["m"] for r in medians.collect()} == {49.5}
