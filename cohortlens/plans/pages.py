"""The tables behind each dashboard page: a name per chart, a DataFrame per name.

``choices`` maps a column to the values kept; an empty list does not filter."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.fixed import EXPLORER_COLUMNS, RESULT_ORDER
from cohortlens.operators.bands import late_bands
from cohortlens.operators.metrics import roc_points
from cohortlens.operators.models import (
    INTERACTIVE_MODELS,
    compare,
    form_features,
    model_input,
    predict,
    score_scenarios,
    train,
)
from cohortlens.operators.scale import settle
from cohortlens.operators.sampling import sample_n, stratified_split
from cohortlens.operators.select import distinct_values, explore, filter_in
from cohortlens.operators.stats import box_stats, histogram, trim_quantile
from cohortlens.operators.summaries import (
    daily_series,
    hierarchy_counts,
    kpi_strip_text,
    mean_by,
    melt_crosstab,
    success_rate,
    value_counts,
)
from cohortlens.sources.readers import missing_values

ENROLMENT_KEY = ["id_student", "code_module", "code_presentation"]


def filter_values(master: DataFrame) -> dict[str, DataFrame]:
    """What the filter boxes offer; outcomes are not sorted."""
    return {
        "gender": distinct_values(master, "gender"),
        "age_band": distinct_values(master, "age_band"),
        "final_result": distinct_values(master, "final_result", ordered=False),
    }


def home(master: DataFrame, choices: dict[str, list]) -> dict[str, DataFrame]:
    kept = filter_in(master, choices)
    page = {"kpis": kpi_strip_text(kept), "results": value_counts(kept, "final_result")}
    if "code_module" in kept.columns:
        page["module_rate"] = success_rate(kept, "code_module").orderBy("rate", "code_module")
    return page


def overview(master: DataFrame, choices: dict[str, list]) -> dict[str, DataFrame]:
    kept = filter_in(master, choices)
    page = home(master, choices)
    page["result_share"] = value_counts(kept, "final_result", share=True)
    if "code_presentation" in kept.columns:
        rate = success_rate(kept, "code_presentation")
        page["presentation_rate"] = rate.orderBy("code_presentation")
    return page


def demographics(master: DataFrame, choices: dict[str, list]) -> dict[str, DataFrame]:
    kept = filter_in(master, choices)
    education = success_rate(kept, "highest_education", null_as_fail=False)
    page = {
        "kpis": kpi_strip_text(kept),
        "gender_results": melt_crosstab(kept, "gender", "final_result"),
        "age_results": melt_crosstab(kept, "age_band", "final_result"),
        "education_rate": education.orderBy("rate", "highest_education"),
        "hierarchy": hierarchy_counts(kept, ["gender", "age_band", "final_result"]),
    }
    if "imd_band" in kept.columns:
        rate = success_rate(kept, "imd_band", null_as_fail=False)
        page["imd_rate"] = rate.orderBy("imd_band")
    return page


def engagement(
    master: DataFrame, clicks: DataFrame | None, choices: dict[str, list], key: list[str] = ENROLMENT_KEY
) -> dict[str, DataFrame]:
    kept = filter_in(master, choices)
    page = {"kpis": kpi_strip_text(kept)}
    if "total_clicks" not in kept.columns:
        return page
    trimmed = trim_quantile(kept, "total_clicks", 0.98)
    page["clicks_box"] = box_stats(trimmed, "final_result", "total_clicks")
    if "avg_assessment_score" in kept.columns:
        sample = sample_n(kept, key=key)
        page["clicks_scores"] = sample.select("total_clicks", "avg_assessment_score", "final_result")
    if clicks is not None:
        page["daily"] = daily_series(clicks)
    if "active_days" in kept.columns:
        page["active_days"] = histogram(
            kept, "active_days", 40, by=["final_result"], shared_range=True
        )
    if "clicks_day30" in kept.columns:
        page["early_box"] = box_stats(kept, "final_result", "clicks_day30")
    return page


def assessments(
    master: DataFrame, choices: dict[str, list], key: list[str] = ENROLMENT_KEY
) -> dict[str, DataFrame]:
    kept = filter_in(master, choices)
    page = {"kpis": kpi_strip_text(kept)}
    if "avg_assessment_score" not in kept.columns:
        return page
    page["scores"] = histogram(
        kept, "avg_assessment_score", 40, by=["final_result"], shared_range=True
    )
    page["mean_score"] = mean_by(kept, "final_result", "avg_assessment_score")
    if "tma_avg_score" in kept.columns and "exam_avg_score" in kept.columns:
        sample = sample_n(kept, key=key)
        page["tma_exam"] = sample.select("tma_avg_score", "exam_avg_score", "final_result")
        if "late_submissions" in kept.columns:
            page["late_rate"] = late_bands(kept)
    return page


def trained(
    master: DataFrame, models: dict[str, dict] = INTERACTIVE_MODELS, key: list[str] = ENROLMENT_KEY
) -> tuple[dict[str, PipelineModel], DataFrame, list[str]]:
    """The interactive models, their test rows and their features."""
    features = form_features(master)
    stored, _ = settle(model_input(master, features, keep=key))
    rows = stratified_split(stored, "label", key)
    fit = train(rows.where(~F.col("is_test")), features, models, impute=False)
    return fit, rows.where("is_test"), features


def predictions(
    models: dict[str, PipelineModel], scenarios: DataFrame, features: list[str]
) -> dict[str, DataFrame]:
    return {"scenarios": score_scenarios(models, scenarios, features)}


def comparison(models: dict[str, PipelineModel], test: DataFrame) -> dict[str, DataFrame]:
    page = {"models": compare(models, test)}
    for name, model in models.items():
        page[f"roc {name}"] = roc_points(predict(model, test, ["label"]))
    return page


def explorer(
    master: DataFrame,
    results: list[str] | None = None,
    columns: list[str] = EXPLORER_COLUMNS,
    n: int = 50,
) -> dict[str, DataFrame]:
    """Rows, and the size of the whole table whatever the filters."""
    return {
        "rows": explore(master, results=results, columns=columns, n=n),
        "size": missing_values(master),
    }


def result_order(master: DataFrame) -> list[str]:
    """The display order of those outcomes that occur; at most the listed ones are read."""
    present = master.where(F.col("final_result").isin(RESULT_ORDER)).select("final_result").distinct()
    found = {row[0] for row in present.collect()}
    return [label for label in RESULT_ORDER if label in found]
