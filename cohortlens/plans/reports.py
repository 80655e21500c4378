"""The ten named report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.fixed import ENGAGEMENT_EDGES, RISK_CLICKS, RISK_REPORT_COLUMNS, RISK_SCORE
from cohortlens.operators.bands import engagement_bands, withdrawal_timeline
from cohortlens.operators.features import with_assessment
from cohortlens.operators.stats import assessment_performance
from cohortlens.operators.summaries import (
    daily_series,
    deprivation_report,
    kpi_report,
    module_performance,
    result_summary,
)
from cohortlens.plans.grouped import grouped_reports
from cohortlens.plans.master import risk_report


def reports(
    master: DataFrame,
    tables: dict[str, DataFrame | None],
    *,
    early: str = "clicks_day30",
    engagement_edges: list[float] = ENGAGEMENT_EDGES,
    clicks_below: float = RISK_CLICKS,
    score_below: float = RISK_SCORE,
    one_scan: bool = False,
) -> dict[str, DataFrame]:
    """Every report whose columns and tables are there. With ``one_scan`` those that group the feature table come from
    one aggregate, which is stored at once: for runs that need them all."""
    info, clicks = tables.get("studentInfo"), tables.get("studentVle")
    submissions, assessments = tables.get("studentAssessment"), tables.get("assessments")
    registrations = tables.get("studentRegistration")
    made = {
        "Master_Data": master,
        "Result_Summary": result_summary(master, ["gender", "age_band", "highest_education"]),
        "Module_Performance": module_performance(master),
    }
    if "total_clicks" in master.columns:
        made["Engagement_Bands"] = engagement_bands(master, engagement_edges)
    if "imd_band" in master.columns:
        made["IMD_Deprivation"] = deprivation_report(master)
    if clicks is not None:
        made["Daily_VLE_Activity"] = daily_series(clicks, entity="id_student", name="total_clicks")
    if submissions is not None and assessments is not None and info is not None:
        scored = with_assessment(submissions, assessments)
        made["Assessment_Performance"] = assessment_performance(scored, info)
    if early in master.columns:
        made["Early_Warning_Day30"] = risk_report(
            master,
            early=early,
            clicks_below=clicks_below,
            score_below=score_below,
            columns=[early if c == "clicks_day30" else c for c in RISK_REPORT_COLUMNS],
        )
    if registrations is not None:
        made["Withdrawal_Timeline"] = withdrawal_timeline(registrations)
    made["KPI_Summary"] = kpi_report(master)
    grouped = grouped_reports(master, engagement_edges) if one_scan else {}
    return {name: grouped.get(name, report) for name, report in made.items()}
