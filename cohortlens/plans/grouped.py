"""The reports that only group the feature table, all from one aggregate over one scan of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.fixed import AT_RISK, ENGAGEMENT_EDGES, ENGAGEMENT_LABELS, PASSING
from cohortlens.functions.expressions import all_present, band_index, flag, is_one_of, percent, round_even
from cohortlens.operators.scale import settle
from cohortlens.operators.select import label_positions

SUMMARY_KEYS = ["gender", "age_band", "highest_education", "final_result"]
MODULE_KEYS = ["code_module", "code_presentation"]


def grouped_reports(
    master: DataFrame, edges: list[float] = ENGAGEMENT_EDGES, labels: list[str] = ENGAGEMENT_LABELS
) -> dict[str, DataFrame]:
    """Result_Summary, Module_Performance, Engagement_Bands, IMD_Deprivation and KPI_Summary, equal to the single
    reports. Grouping sets carry the union of their measures: the table is read and exchanged once, as partial
    aggregates. The groups are settled when called, and each report is a filter of them."""
    sets = {"Result_Summary": SUMMARY_KEYS, "Module_Performance": MODULE_KEYS, "KPI_Summary": []}
    rows = master.withColumn("_distinction", flag(F.col("final_result") == "Distinction")).withColumn(
        "_at_risk", flag(F.col("final_result").isin(AT_RISK))
    )
    if "total_clicks" in master.columns:
        sets["Engagement_Bands"] = ["_band"]
        rows = rows.withColumn("_band", band_index("total_clicks", edges))
    if "imd_band" in master.columns:
        sets["IMD_Deprivation"] = ["imd_band"]
    keys = [key for some in sets.values() for key in some]
    withdrew = "withdrew" in master.columns
    groups = rows.groupingSets([[F.col(key) for key in some] for some in sets.values()], *keys).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("_rows"),
        F.count("id_student").alias("_students"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("_passed"),
        F.avg("target").alias("_target"),
        F.avg("total_clicks").alias("_clicks"),
        F.avg("avg_assessment_score").alias("_score"),
        (F.coalesce(F.sum("withdrew"), F.lit(0)) if withdrew else F.count("target")).alias("_withdrawn"),
        (F.avg("withdrew") if withdrew else F.first(F.lit(None).cast("double"))).alias("_withdrew"),
        F.sum("_distinction").alias("_distinction"),
        F.sum("_at_risk").alias("_at_risk"),
    )
    stored, _ = settle(groups)

    def of(name: str) -> DataFrame:
        left_out = sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in sets[name])
        own = stored.where(F.col("_set") == left_out)
        return own.where(all_present(sets[name])) if sets[name] else own

    pass_rate = (F.col("_target") * 100).alias("pass_rate")
    means = [F.col("_clicks").alias("avg_clicks"), F.col("_score").alias("avg_score")]
    made = {
        "Result_Summary": of("Result_Summary").select(
            *SUMMARY_KEYS, F.col("_rows").alias("count"), is_one_of("final_result", PASSING).alias("pass_flag")
        ),
        "Module_Performance": of("Module_Performance").select(
            *MODULE_KEYS, F.col("_students").alias("total_students"), F.col("_passed").alias("pass_count"), *means,
            F.col("_withdrawn").alias("withdrawal_count"), round_even(percent("_passed", "_students"), 1).alias("pass_rate_pct"),
        ),
    }
    if "_band" in keys:
        found = of("Engagement_Bands").select(F.col("_band").alias("position"), F.col("_students").alias("students"), pass_rate)
        # a row per band at most
        filled = label_positions(master, labels, "engagement_band").join(F.broadcast(found), "position", "left")
        made["Engagement_Bands"] = filled.na.fill(0, ["students"]).orderBy("position").select("engagement_band", "students", "pass_rate")
    if "imd_band" in keys:
        made["IMD_Deprivation"] = of("IMD_Deprivation").select("imd_band", F.col("_students").alias("students"), pass_rate, *means)
    # an aggregate of one row at most, so that an empty table has its row too
    one = {c: F.max(c) for c in ("_target", "_clicks", "_score", "_withdrew")}
    made["KPI_Summary"] = of("KPI_Summary").agg(
        F.coalesce(F.max("_rows"), F.lit(0)).alias("Total Students"),
        round_even(one["_target"] * 100, 1).alias("Pass Rate (%)"),
        round_even(one["_clicks"], 0).alias("Avg VLE Clicks"),
        round_even(one["_score"], 1).alias("Avg Assessment Score"),
        (round_even(one["_withdrew"] * 100, 1) if withdrew else F.first(F.lit("N/A"))).alias("Withdrawal Rate (%)"),
        F.coalesce(F.max("_distinction"), F.lit(0)).alias("Distinction Count"),
        F.coalesce(F.max("_at_risk"), F.lit(0)).alias("At Risk (Fail+Withdraw)"),
    )
    return made
