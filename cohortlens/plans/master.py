"""From the input tables to the feature table and the tables taken from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.fixed import CATEGORIES, DAY_CUTOFFS, RISK_CLICKS, RISK_REPORT_COLUMNS, RISK_SCORE
from cohortlens.functions.expressions import all_present, flag
from cohortlens.operators.features import (
    build_master,
    click_features,
    registration_features,
    score_features,
    with_assessment,
)
from cohortlens.operators.scale import salted_left_join
from cohortlens.operators.select import only_present


def master_table(tables: dict[str, DataFrame], cutoffs: tuple[int, ...] = DAY_CUTOFFS) -> DataFrame:
    """The feature table: three aggregates, each over one fact table, joined to the enrolments."""
    return build_master(
        tables["studentInfo"],
        [
            click_features(tables["studentVle"], tables["vle"], cutoffs=cutoffs),
            score_features(tables["studentAssessment"], tables["assessments"]),
            registration_features(tables["studentRegistration"]),
        ],
    )


def early_warning(master: DataFrame, early: str = "clicks_day30") -> DataFrame:
    """Early features, target and codes, without the learner's id."""
    names = [early, "active_days", "avg_assessment_score", "early_withdraw", "target"]
    return only_present(master, names + [f"{c}_enc" for c in CATEGORIES])


def risk_report(
    master: DataFrame,
    *,
    early: str = "clicks_day30",
    clicks_below: float = RISK_CLICKS,
    score_below: float = RISK_SCORE,
    columns: list[str] = RISK_REPORT_COLUMNS,
) -> DataFrame:
    """Learners with their early figures and a flag for few clicks together with low scores."""
    risk = flag((F.col(early) < clicks_below) & (F.col("avg_assessment_score") < score_below))
    return only_present(master, columns).withColumn("risk_flag", risk)


def clicks_with_results(clicks: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Total clicks per learner beside each of the learner's outcomes; a learner without an
    enrolment keeps one row with no outcome. The long side is the enrolments: they are spread
    over tasks for a learner with very many, and learners without any are added."""
    totals = (
        clicks.where(F.col("id_student").isNotNull())
        .groupBy("id_student")
        .agg(F.coalesce(F.sum("sum_click"), F.lit(0)).alias("total_clicks"))
    )
    results = enrolments.where(all_present(["id_student"])).select("id_student", "final_result")
    matched = salted_left_join(results, [totals], ["id_student"]).where(
        F.col("total_clicks").isNotNull()
    )
    enrolled = results.select("id_student").distinct()
    others = totals.join(enrolled, "id_student", "left_anti").withColumn(
        "final_result", F.lit(None).cast("string")
    )
    columns = ["id_student", "total_clicks", "final_result"]
    return matched.select(*columns).unionByName(others.select(*columns))


def submissions_with_results(
    submissions: DataFrame, assessments: DataFrame, enrolments: DataFrame
) -> DataFrame:
    """Each submission with type and weight of its assessment, once per enrolment of the learner.
    This extract is the row-level product itself; the statistics over it do not go through it. The
    submissions of a learner with very many are dealt over tasks, the enrolments copied to each."""
    marked = with_assessment(submissions, assessments)
    return salted_left_join(marked, [enrolments.select("id_student", "final_result")], ["id_student"])


def eda_extracts(tables: dict[str, DataFrame], product: bool = False) -> dict[str, DataFrame]:
    """The exploratory extracts. The product of a learner's submissions and enrolments is made only
    if asked for; else its two sides are there, from which any statistic can be had."""
    info = tables["studentInfo"]
    made = {"student_info": info, "clicks_result": clicks_with_results(tables["studentVle"], info)}
    if product:
        made["assess_merged"] = submissions_with_results(tables["studentAssessment"], tables["assessments"], info)
    else:
        made["assess_marked"] = with_assessment(tables["studentAssessment"], tables["assessments"])
    return made
