"""The tables behind the exploratory charts, from the input tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.fixed import IMD_ORDER
from cohortlens.functions.expressions import number
from cohortlens.operators.features import with_assessment
from cohortlens.operators.scale import settle
from cohortlens.operators.stats import box_stats, enrolment_score_counts, histogram, trim_quantile
from cohortlens.operators.summaries import (
    crosstab,
    daily_series,
    enrolment_mean,
    hierarchy_counts,
    pass_percent_in_order,
    success_rate,
    value_counts,
    withdrawal_counts,
)
from cohortlens.plans.master import clicks_with_results

OUTCOME = "final_result"


def eda_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    info, clicks = tables["studentInfo"], tables["studentVle"]
    submissions, registrations = tables["studentAssessment"], tables["studentRegistration"]
    clicked, _ = settle(clicks_with_results(clicks, info))
    scored, _ = settle(
        enrolment_score_counts(with_assessment_kept(submissions, tables["assessments"]), info)
    )
    days = registrations.select(number("date_unregistration").alias("day"))
    return {
        "results": value_counts(info, OUTCOME),
        "gender_results": crosstab(info, "gender", OUTCOME),
        "age_results": crosstab(info, "age_band", OUTCOME),
        "education_results_pct": crosstab(info, "highest_education", OUTCOME, normalize=True),
        "imd_results_pct": crosstab(info, "imd_band", OUTCOME, normalize=True),
        "imd_pass_pct": pass_percent_in_order(info, "imd_band", OUTCOME, IMD_ORDER),
        "disability_pass_pct": success_rate(info, "disability", digits=1),
        "mean_clicks": enrolment_mean(
            clicked.select("id_student", "total_clicks").distinct(), info, "total_clicks", digits=0
        ),
        "clicks_box": box_stats(trim_quantile(clicked, "total_clicks", 0.99), OUTCOME, "total_clicks"),
        "mean_score": enrolment_mean(submissions, info, "score", digits=1),
        "score_histogram": histogram(scored, "score", 30, by=[OUTCOME], weight="times"),
        "withdrawals": withdrawal_counts(registrations),
        "withdrawal_histogram": histogram(days, "day", 50),
        "hierarchy": hierarchy_counts(info, ["gender", "age_band", OUTCOME]),
        "daily_clicks": daily_series(clicks),
    }


def with_assessment_kept(submissions: DataFrame, assessments: DataFrame) -> DataFrame:
    """Submissions with their type; those of an unknown assessment stay, under an empty type,
    because the score distribution counts them."""
    marked = with_assessment(submissions, assessments, columns=["assessment_type"])
    return marked.withColumn("assessment_type", F.coalesce("assessment_type", F.lit("")))
