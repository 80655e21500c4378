"""Every operator as a query over the test tables, with the same result stated as SQL.

Doubles are rounded to six digits and integers widened on both sides, so that the two engines
can be compared value by value."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import bindings as b
from checks.bindings import with_tables
from cohortlens.fixed import CATEGORIES, ENGAGEMENT_LABELS, FORM_FEATURES, IMD_ORDER, MEASURES, PLOT_ROWS, RESULT_ORDER, SEED, TEST_SHARE
from cohortlens.functions.expressions import flag
from cohortlens.operators import as_of, bands, distinct, encode, features, metrics, models, quantile_sketches, sampling
from cohortlens.operators import select, stats, summaries
from cohortlens.operators.scale import attach, settle, shared_folder
from cohortlens.plans import master as plans
from cohortlens.plans.grouped import grouped_reports
from cohortlens.plans.reports import reports
from cohortlens.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CHOICES = {
    "gender": ["F"],
    "age_band": [],
    "final_result": ["Pass", "Distinction", "Withdrawn"],
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(made: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(made(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return made

    return register


def tidy(df: DataFrame) -> DataFrame:
    whole = ("int", "bigint", "boolean", "smallint", "tinyint")
    shown = {"double": "rint(`{0}` * 1e6D) / 1e6D AS `{0}`"} | {
        kind: "CAST(`{0}` AS BIGINT) AS `{0}`" for kind in whole
    }
    return df.selectExpr(*[shown.get(kind, "`{0}`").format(name) for name, kind in df.dtypes])


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    scaled = f"round_even(CAST({expression} AS DOUBLE) * 1e{digits}, 0) / 1e{digits}"
    return f"{scaled} AS {name or expression}"


def n(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS BIGINT) AS {name or expression}"


_CLICK_COLUMNS = ", ".join(
    [n(c) for c in ("id_student", "total_clicks", "active_days", "clicks_day7", "clicks_day14", "clicks_day21")]
    + [r("click_std"), n("last_active_day"), n("unique_activity_types")]
)
_SCORE_COLUMNS = ", ".join(
    [n("id_student"), r("avg_assessment_score"), r("score_std"), n("num_assessments_submitted"),
     r("tma_avg_score"), r("exam_avg_score"), n("late_submissions")]
)
_REG_COLUMNS = ", ".join(
    [n("id_student"), n("num_modules_registered"), n("withdrew"), r("withdrawal_day"),
     n("early_withdraw"), n("registered_late")]
)
_TEXTS = [
    "code_module", "code_presentation", "gender", "region", "highest_education", "imd_band",
    "age_band", "disability", "final_result",
]


def _columns(names: list[str]) -> str:
    """Each master column with the cast of its type."""
    doubles = {
        "click_std", "avg_assessment_score", "score_std", "tma_avg_score", "exam_avg_score", "withdrawal_day",
    }
    return ", ".join(c if c in _TEXTS else r(c) if c in doubles else n(c) for c in names)


_INFO = ["enrolment", "id_student", *_TEXTS, "num_of_prev_attempts", "studied_credits"]
_MASTER = [
    *_INFO, *b.FEATURES[:17], "withdrew", "registered_late", "target", *[f"{c}_enc" for c in b.CATEGORIES]
]


# Scans and audit.

@query("audit", with_tables(
    "enrolments clicks submissions assessments registrations",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(1 AS BIGINT) AS found, count(*) AS n_rows, "
        f"CAST({len(cols)} AS BIGINT) AS n_cols, "
        f"CAST(sum({' + '.join(f'(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in cols)}) AS BIGINT) AS n_null FROM {t}"
        for t, cols in {
            "enrolments": _INFO,
            "clicks": ["id_student", "id_site", "date", "sum_click"],
            "submissions": ["id_student", "id_assessment", "score", "date_submitted"],
            "assessments": ["id_assessment", "assessment_type", "date", "weight"],
            "registrations": ["id_student", "code_presentation", "date_registration", "date_unregistration"],
        }.items()
    ) + " UNION ALL SELECT 'courses', 0, 0, 0, 0",
))
def audit(spark, d):
    tables = {
        "enrolments": b.enrolments(spark, d),
        "clicks": b.clicks(spark, d),
        "submissions": b.submissions(spark, d),
        "assessments": b.assessments(spark, d),
        "registrations": b.registrations(spark, d),
        "courses": readers.read_table(spark, f"{d}/courses.parquet", fmt="parquet", optional=True),
    }
    return readers.audit(spark, tables)


@query("csv_roundtrip", with_tables("enrolments", f"SELECT {_columns(_INFO)} FROM enrolments"))
def csv_roundtrip(spark, d):
    made = b.enrolments(spark, d)
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_table(made, path, "csv")
    return readers.read_table(spark, f"{path}-absent", made.schema, fallbacks=(path,))


@query("csv_split_scan", with_tables("enrolments", """
    SELECT enrolment, region || chr(10) || '"' || gender || '",' || chr(10) AS region, imd_band FROM enrolments"""))
def csv_split_scan(spark, d):
    """Cells with line breaks, quotes and commas, written and read by many tasks."""
    text = F.concat("region", F.lit('\n"'), "gender", F.lit('",\n')).alias("region")
    made = b.enrolments(spark, d).select("enrolment", text, "imd_band")
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_table(made, path, "csv")
    return readers.read_csv(spark, path, made.schema, split=True)


@query("stored_master", with_tables("joined", f"SELECT {n('target')}, count(*) AS n_rows FROM joined GROUP BY target"))
def stored_master(spark, d):
    """The feature table from the second of two folders, its target made on reading."""
    folder = f"{shared_folder(spark)}/master-{uuid.uuid4().hex}"
    sinks.write_table(b.joined(spark, d, "").drop("target"), f"{folder}/b/master")
    return readers.read_master(spark, [f"{folder}/a", f"{folder}/b"]).groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"))


_LISTED = [c for c in [f"{c}_enc" for c in CATEGORIES] + MEASURES if c in _MASTER]


@query("feature_list", with_tables("master", " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS name, CAST({int(c in FORM_FEATURES)} AS BIGINT) AS in_form, count({c}) AS n_values FROM master"
    for i, c in enumerate(_LISTED))))
def feature_list(spark, d):
    """The list of features written, read back for the columns that are there, and their values counted."""
    rows, _ = settle(b.master(spark, d))
    path = f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
    sinks.write_names(spark, [*models.feature_names(rows), "absent"], path)
    names, form = sinks.read_names(spark, path, rows), models.form_features(rows)
    lines = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.lit(c in form).alias("in_form"), F.col(f"_{c}").alias("n_values"))
        for i, c in enumerate(names)
    ]))
    return rows.agg(*[F.count(c).alias(f"_{c}") for c in names]).select(lines.alias("_line")).select("_line.*")


@query("report_tables", with_tables("master clicks scored", """
    SELECT 'Master_Data' AS table_name, count(*) AS n_rows, CAST(42 AS BIGINT) AS n_cols FROM master
    UNION ALL SELECT 'Result_Summary', count(*), 6 FROM (SELECT DISTINCT gender, age_band, highest_education, final_result FROM master)
    UNION ALL SELECT 'Module_Performance', count(*), 8 FROM (SELECT DISTINCT code_module, code_presentation FROM master)
    UNION ALL SELECT 'Engagement_Bands', 5, 3
    UNION ALL SELECT 'IMD_Deprivation', count(DISTINCT imd_band), 5 FROM master
    UNION ALL SELECT 'Daily_VLE_Activity', count(DISTINCT date), 3 FROM clicks
    UNION ALL SELECT 'Assessment_Performance', count(*), 6 FROM (
        SELECT DISTINCT assessment_type, final_result FROM scored JOIN master USING (id_student))
    UNION ALL SELECT 'Early_Warning_Day30', count(*), 12 FROM master
    UNION ALL SELECT 'Withdrawal_Timeline', 5, 2
    UNION ALL SELECT 'KPI_Summary', 1, 7""").replace("CAST(42 AS BIGINT)", f"CAST({len(_MASTER)} AS BIGINT)"))
def report_tables(spark, d):
    """All reports written to the shared folder and read back."""
    tables = {
        "studentInfo": b.enrolments(spark, d),
        "studentVle": b.clicks(spark, d),
        "studentAssessment": b.submissions(spark, d),
        "assessments": b.assessments(spark, d),
        "studentRegistration": b.registrations(spark, d),
    }
    folder = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    sinks.write_table(b.master(spark, d), f"{folder}/input")
    made = reports(
        spark.read.parquet(f"{folder}/input"),
        tables,
        early=b.EARLY,
        engagement_edges=b.BAND_EDGES,
        clicks_below=b.RISK_CLICKS,
        score_below=b.RISK_SCORE,
    )
    stored = {name: spark.read.parquet(path) for name, path in sinks.write_reports(made, folder).items()}
    return readers.audit(spark, stored).select("table_name", "n_rows", "n_cols")


# Features.

@query("click_features", with_tables("click_features", f"SELECT {_CLICK_COLUMNS} FROM click_features"))
def click_features(spark, d):
    return b.features(spark, d, "c")[0]


@query("clicks_by_cutoff", with_tables("clicks", f"""
    SELECT id_student,
           {n("coalesce(sum(sum_click) FILTER (date <= 0), 0)", "clicks_day0")},
           {n("coalesce(sum(sum_click) FILTER (date <= 10), 0)", "clicks_day10")},
           {n("coalesce(sum(sum_click) FILTER (date <= 29), 0)", "clicks_day29")}
    FROM clicks GROUP BY id_student"""))
def clicks_by_cutoff(spark, d):
    made = features.click_features(b.clicks(spark, d), cutoffs=(0, 10, 29))
    return made.select("id_student", "clicks_day0", "clicks_day10", "clicks_day29")


@query("activity_types", with_tables("clicks sites", """
    SELECT id_student, count(DISTINCT activity_type) AS unique_activity_types
    FROM clicks LEFT JOIN sites USING (id_site) GROUP BY id_student"""))
def activity_types(spark, d):
    return features.activity_types(b.clicks(spark, d), b.sites(spark, d))


@query("score_features", with_tables("score_features", f"SELECT {_SCORE_COLUMNS} FROM score_features"))
def score_features(spark, d):
    return b.features(spark, d, "s")[0]


@query("late_submissions", with_tables("scored", """
    SELECT count(*) AS submissions, count(*) FILTER (due IS NULL) AS without_due,
           count(*) FILTER (date_submitted > due) AS late FROM scored"""))
def late_submissions(spark, d):
    marked = features.with_assessment(
        b.submissions(spark, d), b.assessments(spark, d), columns=["date"]
    )
    return marked.agg(
        F.count(F.lit(1)).alias("submissions"),
        F.count_if(F.col("date").isNull()).alias("without_due"),
        F.sum(flag(F.col("date_submitted") > F.col("date"))).alias("late"),
    )


AS_OF = (7, 14, 21, 30, 60, 100, 200)
_CUTS = "cuts AS (SELECT unnest([7, 14, 21, 30, 60, 100, 200]) AS as_of)"


@query("as_of_features", with_tables("clicks sites scored registrations", f"""
    , {_CUTS},
    c AS (SELECT id_student, as_of, sum(sum_click) FILTER (date <= as_of) AS total_clicks,
        count(DISTINCT date) FILTER (date <= as_of) AS active_days, stddev_samp(sum_click) FILTER (date <= as_of) AS click_std,
        count(DISTINCT activity_type) FILTER (date <= as_of) AS unique_activity_types, max(date) FILTER (date <= as_of) AS last_active_day
      FROM clicks LEFT JOIN sites USING (id_site) CROSS JOIN cuts GROUP BY id_student, as_of),
    s AS (SELECT id_student, as_of, avg(score) FILTER (date_submitted <= as_of) AS avg_assessment_score,
        stddev_samp(score) FILTER (date_submitted <= as_of) AS score_std, count(id_assessment) FILTER (date_submitted <= as_of) AS num_assessments_submitted,
        avg(score) FILTER (date_submitted <= as_of AND assessment_type = 'TMA') AS tma_avg_score,
        avg(score) FILTER (date_submitted <= as_of AND assessment_type = 'Exam') AS exam_avg_score,
        count(*) FILTER (date_submitted <= as_of AND date_submitted > due) AS late_submissions
      FROM scored CROSS JOIN cuts GROUP BY id_student, as_of),
    r AS (SELECT id_student, as_of, count(*) FILTER (coalesce(TRY_CAST(date_registration AS DOUBLE) <= as_of, TRUE)) AS num_modules_registered,
        max(CASE WHEN TRY_CAST(date_unregistration AS DOUBLE) <= as_of THEN 1 ELSE 0 END) AS withdrew,
        coalesce(min(TRY_CAST(date_unregistration AS DOUBLE)) FILTER (TRY_CAST(date_unregistration AS DOUBLE) <= as_of), 999) AS withdrawal_day,
        max(CASE WHEN TRY_CAST(date_unregistration AS DOUBLE) <= least(as_of, 30) THEN 1 ELSE 0 END) AS early_withdraw
      FROM registrations CROSS JOIN cuts GROUP BY id_student, as_of)
    SELECT {n("id_student")}, {n("as_of")}, {r("coalesce(total_clicks, 0)", "total_clicks")}, {n("coalesce(active_days, 0)", "active_days")},
      {r("coalesce(click_std, 0)", "click_std")}, {n("coalesce(unique_activity_types, 0)", "unique_activity_types")},
      {n("coalesce(last_active_day, 0)", "last_active_day")}, {r("coalesce(avg_assessment_score, 0)", "avg_assessment_score")},
      {r("coalesce(score_std, 0)", "score_std")}, {n("coalesce(num_assessments_submitted, 0)", "num_assessments_submitted")},
      {r("coalesce(tma_avg_score, 0)", "tma_avg_score")}, {r("coalesce(exam_avg_score, 0)", "exam_avg_score")},
      {n("coalesce(late_submissions, 0)", "late_submissions")}, {n("coalesce(num_modules_registered, 0)", "num_modules_registered")},
      {n("coalesce(withdrew, 0)", "withdrew")}, {r("coalesce(withdrawal_day, 0)", "withdrawal_day")}, {n("coalesce(early_withdraw, 0)", "early_withdraw")}
    FROM c FULL JOIN s USING (id_student, as_of) FULL JOIN r USING (id_student, as_of)"""))
def as_of_features(spark, d):
    tables = {
        "studentVle": b.clicks(spark, d), "vle": b.sites(spark, d), "studentAssessment": b.submissions(spark, d),
        "assessments": b.assessments(spark, d), "studentRegistration": b.registrations(spark, d),
    }
    return as_of.as_of_features(tables, AS_OF)


@query("registration_features", with_tables(
    "registration_features", f"SELECT {_REG_COLUMNS} FROM registration_features"))
def registration_features(spark, d):
    return b.features(spark, d, "r")[0]


@query("master", with_tables("master", f"SELECT {_columns(_MASTER)} FROM master"))
def master(spark, d):
    return b.master(spark, d)


@query("rank_encode", with_tables(
    "master", f"SELECT enrolment, {', '.join(n(f'{c}_enc') for c in b.CATEGORIES)} FROM master"))
def rank_encode(spark, d):
    coded = encode.rank_encode(b.enrolments(spark, d), b.CATEGORIES)
    return coded.select("enrolment", *[f"{c}_enc" for c in b.CATEGORIES])


@query("early_warning", with_tables("master", "SELECT " + _columns(
    [b.EARLY, "active_days", "avg_assessment_score", "early_withdraw", "target"]
    + [f"{c}_enc" for c in b.CATEGORIES]) + " FROM master"))
def early_warning(spark, d):
    return plans.early_warning(b.master(spark, d), b.EARLY)


_RISK = [
    "id_student", "gender", "age_band", "highest_education", "imd_band", "code_module",
    b.EARLY, "active_days", "avg_assessment_score", "final_result", "target",
]


@query("risk_flag", with_tables("joined", f"""
    SELECT {_columns(_RISK)}, CAST(CASE WHEN {b.EARLY} < {b.RISK_CLICKS}
           AND avg_assessment_score < {b.RISK_SCORE} THEN 1 ELSE 0 END AS BIGINT) AS risk_flag
    FROM joined"""))
def risk_flag(spark, d):
    return plans.risk_report(
        b.joined(spark, d, "cs"),
        early=b.EARLY,
        clicks_below=b.RISK_CLICKS,
        score_below=b.RISK_SCORE,
        columns=_RISK,
    )


@query("clicks_with_results", with_tables("clicks enrolments", f"""
    SELECT id_student, {n("total_clicks")}, final_result
    FROM (SELECT id_student, sum(sum_click) AS total_clicks FROM clicks GROUP BY id_student)
    LEFT JOIN enrolments USING (id_student)"""))
def clicks_with_results(spark, d):
    return plans.clicks_with_results(b.clicks(spark, d), b.enrolments(spark, d))


@query("submissions_with_results", with_tables("scored enrolments", f"""
    SELECT scored.id_student, id_assessment, {r("score")}, {n("date_submitted")}, assessment_type,
           {r("weight")}, final_result
    FROM scored LEFT JOIN enrolments USING (id_student)"""))
def submissions_with_results(spark, d):
    return plans.submissions_with_results(
        b.submissions(spark, d), b.assessments(spark, d), b.enrolments(spark, d)
    )


# Counts, rates and series.

@query("value_counts", with_tables(
    "enrolments", "SELECT final_result, count(*) AS count FROM enrolments GROUP BY final_result"))
def value_counts(spark, d):
    return summaries.value_counts(b.enrolments(spark, d), "final_result")


@query("result_share", with_tables("enrolments", f"""
    SELECT imd_band, count(*) AS count, {r("count(*) / sum(count(*)) OVER ()", "share")}
    FROM enrolments WHERE imd_band IS NOT NULL GROUP BY imd_band"""))
def result_share(spark, d):
    return summaries.value_counts(b.enrolments(spark, d), "imd_band", share=True)


_CELLS = ", ".join(
    f"count(*) FILTER (final_result = '{v}') AS {v}" for v in ("Distinction", "Fail", "Pass", "Withdrawn")
)


@query("crosstab_counts", with_tables(
    "enrolments", f"SELECT gender, {_CELLS} FROM enrolments GROUP BY gender"))
def crosstab_counts(spark, d):
    return summaries.crosstab(b.enrolments(spark, d), "gender", "final_result")


@query("crosstab_found_values", with_tables("enrolments", """
    SELECT age_band, count(*) FILTER (region = 'AFRICA') AS AFRICA, count(*) FILTER (region = 'AMERICA') AS AMERICA,
           count(*) FILTER (region = 'ASIA') AS ASIA, count(*) FILTER (region = 'EUROPE') AS EUROPE,
           count(*) FILTER (region = 'MIDDLE EAST') AS "MIDDLE EAST"
    FROM enrolments GROUP BY age_band"""))
def crosstab_found_values(spark, d):
    return summaries.crosstab(b.enrolments(spark, d), "age_band", "region", values=None)


@query("crosstab_pct", with_tables("enrolments", "SELECT imd_band, " + ", ".join(
    r(f"100.0 * count(*) FILTER (final_result = '{v}') / count(*)", v)
    for v in ("Distinction", "Fail", "Pass", "Withdrawn")
) + " FROM enrolments WHERE imd_band IS NOT NULL GROUP BY imd_band"))
def crosstab_pct(spark, d):
    return summaries.crosstab(b.enrolments(spark, d), "imd_band", "final_result", normalize=True)


@query("crosstab_long", with_tables("enrolments", """
    SELECT a.age_band, v.final_result, count(e.enrolment) AS value
    FROM (SELECT DISTINCT age_band FROM enrolments) a
    CROSS JOIN (SELECT DISTINCT final_result FROM enrolments) v
    LEFT JOIN enrolments e ON e.age_band = a.age_band AND e.final_result = v.final_result
    GROUP BY a.age_band, v.final_result"""))
def crosstab_long(spark, d):
    return summaries.melt_crosstab(b.enrolments(spark, d), "age_band", "final_result")


@query("pass_pct_ordered", with_tables("enrolments", f"""
    SELECT imd_band, {n("list_position([" + ", ".join(repr(v) for v in IMD_ORDER) + "], imd_band) - 1", "position")},
           {r("100.0 * count(*) FILTER (final_result IN ('Pass', 'Distinction')) / count(*)", "pass_pct")}
    FROM enrolments WHERE imd_band IN ({", ".join(repr(v) for v in IMD_ORDER)}) GROUP BY imd_band"""))
def pass_pct_ordered(spark, d):
    return summaries.pass_percent_in_order(b.enrolments(spark, d), "imd_band", "final_result", IMD_ORDER)


@query("rate_null_as_fail", with_tables("enrolments", f"""
    SELECT code_module, {r("avg(CASE WHEN final_result IN ('Pass', 'Distinction') THEN 100.0 ELSE 0 END)", "rate", 1)}
    FROM enrolments GROUP BY code_module"""))
def rate_null_as_fail(spark, d):
    return summaries.success_rate(b.enrolments(spark, d), "code_module", digits=1)


_TARGET = "CASE WHEN final_result IN ('Pass', 'Distinction') THEN 1 WHEN final_result IN ('Fail', 'Withdrawn') THEN 0 END"


@query("rate_null_excluded", with_tables("enrolments", f"""
    SELECT highest_education, {r(f"100.0 * avg({_TARGET})", "rate")} FROM enrolments GROUP BY highest_education"""))
def rate_null_excluded(spark, d):
    coded = features.join_features(b.enrolments(spark, d), [])
    return summaries.success_rate(coded, "highest_education", null_as_fail=False)


@query("rate_gap", with_tables("enrolments", f"""
    SELECT {r("max(rate)", "highest")}, {r("min(rate)", "lowest")}, {r("max(rate) - min(rate)", "gap")}
    FROM (SELECT imd_band, 100.0 * avg({_TARGET}) AS rate FROM enrolments
          WHERE imd_band IS NOT NULL GROUP BY imd_band)"""))
def rate_gap(spark, d):
    coded = features.join_features(b.enrolments(spark, d), [])
    return summaries.rate_gap(summaries.success_rate(coded, "imd_band", null_as_fail=False))


@query("mean_clicks_by_result", with_tables("clicks enrolments", f"""
    SELECT final_result, {r("avg(total_clicks)", "mean", 0)}
    FROM (SELECT id_student, sum(sum_click) AS total_clicks FROM clicks GROUP BY id_student)
    JOIN enrolments USING (id_student) GROUP BY final_result"""))
def mean_clicks_by_result(spark, d):
    totals = features.click_features(b.clicks(spark, d))
    return summaries.enrolment_mean(totals, b.enrolments(spark, d), "total_clicks", digits=0)


@query("mean_score_by_result", with_tables("scored enrolments", f"""
    SELECT final_result, {r("avg(score)", "mean", 1)}
    FROM scored JOIN enrolments USING (id_student) GROUP BY final_result"""))
def mean_score_by_result(spark, d):
    return summaries.enrolment_mean(b.submissions(spark, d), b.enrolments(spark, d), "score", digits=1)


@query("mean_measure_by_result", with_tables("joined", f"""
    SELECT final_result, {r("avg(avg_assessment_score)", "mean")} FROM joined GROUP BY final_result"""))
def mean_measure_by_result(spark, d):
    return summaries.mean_by(b.joined(spark, d, "s"), "final_result", "avg_assessment_score")


@query("withdrawal_counts", with_tables("registrations", """
    SELECT count(date_unregistration) AS withdrawals,
           count(*) FILTER (TRY_CAST(date_unregistration AS DOUBLE) <= 30) AS early_withdrawals
    FROM registrations"""))
def withdrawal_counts(spark, d):
    return summaries.withdrawal_counts(b.registrations(spark, d))


@query("daily_series", with_tables(
    "clicks", f"SELECT {n('date')}, {n('sum(sum_click)', 'clicks')} FROM clicks GROUP BY date"))
def daily_series(spark, d):
    return summaries.daily_series(b.clicks(spark, d))


@query("daily_unique", with_tables("clicks", f"""
    SELECT {n("date")}, {n("sum(sum_click)", "total_clicks")}, count(DISTINCT id_student) AS unique_students
    FROM clicks GROUP BY date"""))
def daily_unique(spark, d):
    return summaries.daily_series(b.clicks(spark, d), entity="id_student", name="total_clicks")


@query("daily_incremental", with_tables("clicks", f"""
    SELECT {n('date')}, {n('sum(sum_click)', 'clicks')}, {n('count(DISTINCT id_student)', 'unique_students')} FROM clicks GROUP BY date"""))
def daily_incremental(spark, d):
    """The daily series from a stored state that four deliveries of the log were merged into, one by one."""
    log, stored = b.clicks(spark, d), None
    for i in range(4):
        new = log.where(F.pmod(F.xxhash64("id_student", "id_site", "sum_click"), F.lit(4)) == i)
        state = distinct.distinct_state(new, ["date"], "id_student", {"clicks": "sum_click"})
        stored, _ = settle(state if stored is None else distinct.merged_states([stored, state], ["date"], ["clicks"]))
    return distinct.from_state(stored, ["date"], "unique_students", ["clicks"])


@query("daily_sketched", with_tables("clicks", f"""
    SELECT {n('date')}, {n('count(DISTINCT id_student)', 'unique_students')}, CAST(1 AS BIGINT) AS within_bound FROM clicks GROUP BY date"""))
def daily_sketched(spark, d):
    """Distinct learners of a day from sketches by day and site, held against the exact count."""
    log = b.clicks(spark, d)
    estimate = distinct.sketched_counts(distinct.distinct_sketches(log, ["date", "id_site"], "id_student"), ["date"], "estimate")
    exact = log.groupBy("date").agg(F.count_distinct("id_student").alias("unique_students"))
    apart = F.abs(F.col("estimate") - F.col("unique_students")) <= distinct.error_bound() * F.col("unique_students")
    return exact.join(estimate, "date").select("date", "unique_students", apart.alias("within_bound"))


@query("result_summary", with_tables("enrolments", """
    SELECT gender, age_band, highest_education, final_result, count(*) AS count,
           CAST(CASE WHEN final_result IN ('Pass', 'Distinction') THEN 1 ELSE 0 END AS BIGINT) AS pass_flag
    FROM enrolments GROUP BY ALL"""))
def result_summary(spark, d):
    return summaries.result_summary(b.enrolments(spark, d), ["gender", "age_band", "highest_education"])


@query("hierarchy_counts", with_tables("enrolments", f"""
    SELECT gender, age_band, final_result, count(*) AS count,
           {n("3 - GROUPING(gender) - GROUPING(age_band) - GROUPING(final_result)", "depth")}
    FROM enrolments GROUP BY ROLLUP (gender, age_band, final_result) HAVING GROUPING(gender) = 0"""))
def hierarchy_counts(spark, d):
    return summaries.hierarchy_counts(b.enrolments(spark, d), ["gender", "age_band", "final_result"])


# Reports over the feature table.

@query("module_performance", with_tables("joined", f"""
    SELECT code_module, code_presentation, count(id_student) AS total_students,
           {n("sum(target)", "pass_count")}, {r("avg(total_clicks)", "avg_clicks")},
           {r("avg(avg_assessment_score)", "avg_score")}, {n("sum(withdrew)", "withdrawal_count")},
           {r("100.0 * sum(target) / count(id_student)", "pass_rate_pct", 1)}
    FROM joined GROUP BY code_module, code_presentation"""))
def module_performance(spark, d):
    return summaries.module_performance(b.joined(spark, d))


@query("imd_report", with_tables("joined", f"""
    SELECT imd_band, count(id_student) AS students, {r("100.0 * avg(target)", "pass_rate")},
           {r("avg(total_clicks)", "avg_clicks")}, {r("avg(avg_assessment_score)", "avg_score")}
    FROM joined WHERE imd_band IS NOT NULL GROUP BY imd_band"""))
def imd_report(spark, d):
    return summaries.deprivation_report(b.joined(spark, d, "cs"))


@query("assessment_performance", with_tables("scored enrolments", f"""
    SELECT assessment_type, final_result, count(score) AS count, {r("avg(score)", "mean", 2)},
           {r("median(score)", "median", 2)}, {r("stddev_samp(score)", "std", 2)}
    FROM scored JOIN enrolments USING (id_student) GROUP BY assessment_type, final_result"""))
def assessment_performance(spark, d):
    scored = features.with_assessment(b.submissions(spark, d), b.assessments(spark, d))
    return stats.assessment_performance(scored, b.enrolments(spark, d))


@query("kpi_export", with_tables("joined", f"""
    SELECT count(*) AS "Total Students", {r("100.0 * avg(target)", '"Pass Rate (%)"', 1)},
           {r("avg(total_clicks)", '"Avg VLE Clicks"', 0)},
           {r("avg(avg_assessment_score)", '"Avg Assessment Score"', 1)},
           {r("100.0 * avg(withdrew)", '"Withdrawal Rate (%)"', 1)},
           count(*) FILTER (final_result = 'Distinction') AS "Distinction Count",
           count(*) FILTER (final_result IN ('Fail', 'Withdrawn')) AS "At Risk (Fail+Withdraw)"
    FROM joined"""))
def kpi_export(spark, d):
    return summaries.kpi_report(b.joined(spark, d))


_BAND_VALUES = ", ".join(f"('{label}', {lo}, {hi})" for label, lo, hi in zip(ENGAGEMENT_LABELS, b.BAND_EDGES, b.BAND_EDGES[1:]))


@query("grouped_reports", with_tables("joined", f"""
    SELECT 'Result_Summary' AS report, concat_ws('|', gender, age_band, highest_education, final_result) AS name,
           count(*) AS n, {r("any_value(CASE WHEN final_result IN ('Pass', 'Distinction') THEN 1 ELSE 0 END)", "value")}
    FROM joined WHERE gender IS NOT NULL AND age_band IS NOT NULL AND highest_education IS NOT NULL AND final_result IS NOT NULL
    GROUP BY gender, age_band, highest_education, final_result
    UNION ALL SELECT 'Module_Performance', concat_ws('|', code_module, code_presentation), count(id_student), {r("avg(total_clicks)", "v")}
    FROM joined WHERE code_module IS NOT NULL AND code_presentation IS NOT NULL GROUP BY code_module, code_presentation
    UNION ALL SELECT 'Engagement_Bands', label, count(id_student), {r("100.0 * avg(target)", "v")}
    FROM (VALUES {_BAND_VALUES}) AS v(label, lo, hi) LEFT JOIN joined ON total_clicks > lo AND total_clicks <= hi GROUP BY label
    UNION ALL SELECT 'IMD_Deprivation', imd_band, count(id_student), {r("avg(avg_assessment_score)", "v")}
    FROM joined WHERE imd_band IS NOT NULL GROUP BY imd_band
    UNION ALL SELECT 'KPI_Summary', 'all', count(*), {r("100.0 * avg(withdrew)", "v", 1)} FROM joined"""))
def grouped_reports_in_one_scan(spark, d):
    made = grouped_reports(b.joined(spark, d), b.BAND_EDGES)
    shown = {
        "Result_Summary": (["gender", "age_band", "highest_education", "final_result"], "count", "pass_flag"),
        "Module_Performance": (["code_module", "code_presentation"], "total_students", "avg_clicks"),
        "Engagement_Bands": (["engagement_band"], "students", "pass_rate"),
        "IMD_Deprivation": (["imd_band"], "students", "avg_score"),
        "KPI_Summary": ([], "Total Students", "Withdrawal Rate (%)"),
    }
    lines = [
        made[report].select(
            F.lit(report).alias("report"), (F.concat_ws("|", *keys) if keys else F.lit("all")).alias("name"),
            F.col(count).alias("n"), F.col(value).cast("double").alias("value"),
        )
        for report, (keys, count, value) in shown.items()
    ]
    return reduce(DataFrame.unionByName, lines)


_KEPT = "gender = 'F' AND final_result IN ('Pass', 'Distinction', 'Withdrawn')"


@query("kpi_filtered", with_tables("joined", f"""
    SELECT count(*) AS students, {r("100.0 * avg(target)", "pass_rate")},
           {r("avg(total_clicks)", "avg_clicks")}, {r("avg(avg_assessment_score)", "avg_score")},
           {r("avg(active_days)", "active_days")}, {r("100.0 * avg(withdrew)", "withdrawal_rate")}
    FROM joined WHERE {_KEPT}"""))
def kpi_filtered(spark, d):
    return summaries.kpi_strip(select.filter_in(b.joined(spark, d), CHOICES))


@query("kpi_text", with_tables("joined", """
    SELECT format('{:,}', count(*)) AS students, format('{:.1f}%', 100.0 * avg(target)) AS pass_rate,
           format('{:,}', CAST(round_even(avg(total_clicks), 0) AS BIGINT)) AS avg_clicks,
           format('{:.1f}', avg(avg_assessment_score)) AS avg_score,
           format('{:.0f}', avg(active_days)) AS active_days,
           format('{:.1f}%', 100.0 * avg(withdrew)) AS withdrawal_rate FROM joined"""))
def kpi_text(spark, d):
    return summaries.kpi_strip_text(b.joined(spark, d))


@query("engagement_bands", with_tables("joined", f"""
    SELECT label AS engagement_band, count(id_student) AS students, {r("100.0 * avg(target)", "pass_rate")}
    FROM (VALUES ('Very Low (0-200)', {b.BAND_EDGES[0]}, {b.BAND_EDGES[1]}),
                 ('Low (200-500)', {b.BAND_EDGES[1]}, {b.BAND_EDGES[2]}),
                 ('Medium (500-1000)', {b.BAND_EDGES[2]}, {b.BAND_EDGES[3]}),
                 ('High (1000-2000)', {b.BAND_EDGES[3]}, {b.BAND_EDGES[4]}),
                 ('Very High (2000+)', {b.BAND_EDGES[4]}, {b.BAND_EDGES[5]})) AS v(label, lo, hi)
    LEFT JOIN joined ON total_clicks > lo AND total_clicks <= hi GROUP BY label"""))
def engagement_bands(spark, d):
    return bands.engagement_bands(b.joined(spark, d, "c"), b.BAND_EDGES)


@query("withdrawal_timeline", with_tables("registrations", """
    SELECT label AS withdrawal_window, count(date_unregistration) AS withdrawals
    FROM (VALUES ('0-30 days', 0, 30), ('31-60 days', 30, 60), ('61-100 days', 60, 100),
                 ('101-200 days', 100, 200), ('200+ days', 200, 999)) AS v(label, lo, hi)
    LEFT JOIN registrations ON TRY_CAST(date_unregistration AS DOUBLE) > lo
         AND TRY_CAST(date_unregistration AS DOUBLE) <= hi GROUP BY label"""))
def withdrawal_timeline(spark, d):
    return bands.withdrawal_timeline(b.registrations(spark, d))


@query("late_bands", with_tables("joined", f"""
    SELECT label AS late_band, {r("100.0 * avg(target)", "pass_rate")}
    FROM (VALUES ('(0, 1]', 0, 1), ('(1, 3]', 1, 3), ('(3, 5]', 3, 5), ('(5, 20]', 5, 20)) AS v(label, lo, hi)
    LEFT JOIN joined ON late_submissions > lo AND late_submissions <= hi GROUP BY label"""))
def late_bands(spark, d):
    return bands.late_bands(b.joined(spark, d, "s"))


@query("low_engagement_dropout", with_tables("joined", f"""
    SELECT count(*) AS students,
           {r("avg(CASE WHEN final_result = 'Withdrawn' THEN 100.0 ELSE 0 END)", "withdrawn_pct")}
    FROM joined WHERE {b.EARLY} < {b.RISK_CLICKS}"""))
def low_engagement_dropout(spark, d):
    return summaries.low_engagement_dropout(b.joined(spark, d, "c"), clicks=b.EARLY, below=b.RISK_CLICKS)


# Distributions.

def _bins(rows: str, ranges: str, by: str, bins: int) -> str:
    """Counts per bin between explicit edges; ``ranges`` gives (by, mn, mx)."""
    lo = f"(mn + i * ((mx - mn) / {bins}))"
    hi = f"(CASE WHEN i = {bins - 1} THEN mx ELSE mn + (i + 1) * ((mx - mn) / {bins}) END)"
    group = f"{by}, " if by else ""
    same = f"x.{by} = g.{by} AND " if by else ""
    named = f"g.{by}, " if by else ""
    return f"""
    SELECT {named}CAST(i AS BIGINT) AS bin, {r(lo, "lo")}, {r(hi, "hi")}, CAST(sum(coalesce(c, 0)) AS BIGINT) AS count
    FROM (SELECT * FROM ({ranges}), (SELECT unnest(range({bins})) AS i)) g
    LEFT JOIN (SELECT {group}v, count(*) AS c FROM ({rows}) GROUP BY ALL) x
      ON {same}v >= {lo} AND (v < {hi} OR (i = {bins - 1} AND v = mx))
    GROUP BY ALL"""


@query("histogram_by_group", with_tables("scored enrolments", _bins(
    "SELECT final_result, CAST(score AS DOUBLE) AS v FROM scored JOIN enrolments USING (id_student)",
    "SELECT final_result, min(CAST(score AS DOUBLE)) AS mn, max(CAST(score AS DOUBLE)) AS mx "
    "FROM scored JOIN enrolments USING (id_student) GROUP BY final_result",
    "final_result", 30)))
def histogram_by_group(spark, d):
    scored = features.with_assessment(b.submissions(spark, d), b.assessments(spark, d))
    counted, _ = settle(stats.enrolment_score_counts(scored, b.enrolments(spark, d)))
    return stats.histogram(counted, "score", 30, by=["final_result"], weight="times")


@query("histogram_withdrawal", with_tables("registrations", _bins(
    "SELECT TRY_CAST(date_unregistration AS DOUBLE) AS v FROM registrations "
    "WHERE TRY_CAST(date_unregistration AS DOUBLE) IS NOT NULL",
    "SELECT min(TRY_CAST(date_unregistration AS DOUBLE)) AS mn, "
    "max(TRY_CAST(date_unregistration AS DOUBLE)) AS mx FROM registrations",
    "", 50)))
def histogram_withdrawal(spark, d):
    days = b.registrations(spark, d).select(
        F.col("date_unregistration").try_cast("double").alias("day")
    )
    return stats.histogram(days, "day", 50)


@query("histogram_shared", with_tables("joined", _bins(
    "SELECT final_result, CAST(avg_assessment_score AS DOUBLE) AS v FROM joined",
    "SELECT DISTINCT final_result, (SELECT min(CAST(avg_assessment_score AS DOUBLE)) FROM joined) AS mn, "
    "(SELECT max(CAST(avg_assessment_score AS DOUBLE)) FROM joined) AS mx FROM joined",
    "final_result", 40)))
def histogram_shared(spark, d):
    rows, _ = settle(b.joined(spark, d, "s").select("final_result", "avg_assessment_score"))
    return stats.histogram(rows, "avg_assessment_score", 40, by=["final_result"], shared_range=True)


@query("trim_quantile", with_tables("joined", f"""
    SELECT enrolment, {n("total_clicks")} FROM joined
    WHERE total_clicks < (SELECT quantile_cont(total_clicks, 0.98) FROM joined)"""))
def trim_quantile(spark, d):
    rows, _ = settle(b.joined(spark, d, "c").select("enrolment", "total_clicks"))
    return stats.trim_quantile(rows, "total_clicks", 0.98)


@query("box_stats", with_tables("joined", f"""
    , q AS (SELECT final_result, quantile_cont(avg_assessment_score, 0.25) AS q1,
                   quantile_cont(avg_assessment_score, 0.5) AS median,
                   quantile_cont(avg_assessment_score, 0.75) AS q3 FROM joined GROUP BY final_result)
    SELECT final_result, count(*) AS count, {r("any_value(q1)", "q1")}, {r("any_value(median)", "median")},
           {r("any_value(q3)", "q3")},
           {r("min(avg_assessment_score) FILTER (avg_assessment_score >= q1 - 1.5 * (q3 - q1))", "whisker_low")},
           {r("max(avg_assessment_score) FILTER (avg_assessment_score <= q3 + 1.5 * (q3 - q1))", "whisker_high")},
           count(*) FILTER (avg_assessment_score < q1 - 1.5 * (q3 - q1)
                            OR avg_assessment_score > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM joined JOIN q USING (final_result) GROUP BY final_result"""))
def box_stats(spark, d):
    rows, _ = settle(b.joined(spark, d, "s").select("final_result", "avg_assessment_score"))
    return stats.box_stats(rows, "final_result", "avg_assessment_score")


@query("merged_quantiles", with_tables("clicks", f"""
    SELECT id_site, count(sum_click) AS n_values, CAST(3 AS BIGINT) AS within_bound FROM clicks GROUP BY id_site"""))
def merged_quantiles(spark, d):
    """Quartiles of each site's clicks from sketches by day and site: how many of the three lie within the bound?"""
    log = b.clicks(spark, d)
    sketches, _ = settle(quantile_sketches.quantile_sketches(log, ["date", "id_site"], "sum_click"))
    found = quantile_sketches.sketched_quantiles(sketches, ["id_site"], stats.QUARTILES)
    placed = attach(log.where("sum_click IS NOT NULL"), found, ["id_site"])
    e, x, total = quantile_sketches.rank_error_bound(), F.col("sum_click"), F.count("sum_click")
    within = [
        ((F.count_if(x < F.col(name)) <= (q + e) * total) & (F.count_if(x <= F.col(name)) >= (q - e) * total)).cast("int")
        for name, q in stats.QUARTILES.items()
    ]
    return placed.groupBy("id_site").agg(total.alias("n_values"), sum(within, F.lit(0)).alias("within_bound"))


# Row selections.

@query("filter_in", with_tables("enrolments", f"SELECT {_columns(_INFO)} FROM enrolments WHERE {_KEPT}"))
def filter_in(spark, d):
    return select.filter_in(b.enrolments(spark, d), CHOICES).select(*_INFO)


@query("explore_topn", with_tables("joined", """
    SELECT gender, age_band, highest_education, final_result, CAST(total_clicks AS BIGINT) AS total_clicks,
           CAST(active_days AS BIGINT) AS active_days
    FROM joined WHERE final_result IN ('Pass', 'Fail') ORDER BY id_student, enrolment LIMIT 50"""))
def explore_topn(spark, d):
    columns = [
        "gender", "age_band", "highest_education", "final_result", "total_clicks", "active_days", "missing",
    ]
    return select.explore(
        b.joined(spark, d, "c"), results=["Pass", "Fail"], columns=columns, order=["id_student", "enrolment"]
    )


@query("top_k", with_tables("click_features", f"""
    SELECT id_student, {n("total_clicks")} FROM click_features ORDER BY total_clicks DESC, id_student LIMIT 20"""))
def top_k(spark, d):
    totals = features.click_features(b.clicks(spark, d)).select("id_student", "total_clicks")
    return select.top_k(totals, "total_clicks", 20, ["id_student"])


@query("best_row", with_tables("enrolments", f"""
    SELECT replace(lower(code_module), ' ', '_') AS best_model FROM (
      SELECT code_module, avg({_TARGET}) AS rate FROM enrolments GROUP BY code_module)
    ORDER BY rate DESC, code_module LIMIT 1"""))
def best_row(spark, d):
    coded = features.join_features(b.enrolments(spark, d), [])
    rates = summaries.success_rate(coded, "code_module", null_as_fail=False)
    return select.best_name(rates, "code_module", "rate", "code_module")


@query("distinct_values", with_tables(
    "enrolments", "SELECT DISTINCT imd_band FROM enrolments WHERE imd_band IS NOT NULL"))
def distinct_values(spark, d):
    return select.distinct_values(b.enrolments(spark, d), "imd_band")


@query("ordered_labels", with_tables("enrolments", f"""
    SELECT final_result, count(*) AS count,
           {n("list_position([" + ", ".join(repr(v) for v in RESULT_ORDER) + "], final_result) - 1", "position")}
    FROM enrolments GROUP BY final_result"""))
def ordered_labels(spark, d):
    counts = summaries.value_counts(b.enrolments(spark, d), "final_result")
    return select.in_label_order(counts, "final_result", RESULT_ORDER)


@query("missing_values", with_tables("joined", f"""
    SELECT count(*) AS n_rows, CAST({len(_MASTER) - 8} AS BIGINT) AS n_cols,
           CAST(sum(CASE WHEN imd_band IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null FROM joined"""))
def missing_values(spark, d):
    return readers.missing_values(b.joined(spark, d))


def key_hash(key: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', CAST({key} AS VARCHAR), '{SEED}')), 1, 15) AS BIGINT)"


@query("sample_n", with_tables("joined", f"""
    SELECT {n("enrolment")}, {n("total_clicks")}, {r("avg_assessment_score")}, final_result
    FROM joined ORDER BY {key_hash("enrolment")} LIMIT {PLOT_ROWS}"""))
def sample_n(spark, d):
    columns = ["enrolment", "total_clicks", "avg_assessment_score", "final_result"]
    rows, _ = settle(b.joined(spark, d, "cs").select(*columns))
    return sampling.sample_n(rows, key=["enrolment"])


@query("sample_learners", with_tables("enrolments", f"""
    SELECT enrolments.* FROM enrolments WHERE id_student IN (
        SELECT id_student FROM enrolments WHERE id_student IS NOT NULL GROUP BY id_student
        ORDER BY {key_hash("id_student")} LIMIT 500)"""))
def sample_learners(spark, d):
    return sampling.sample_entities([b.enrolments(spark, d)], n=500)[0]


# Encoding, split and evaluation.

_SCALED = ["total_clicks", "active_days", "avg_assessment_score", "studied_credits"]


@query("scale_stats", with_tables("joined", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'avg({c})', 'mean')}, {r(f'stddev_pop({c})', 'std')} FROM joined"
    for c in _SCALED)))
def scale_stats(spark, d):
    return encode.scale_stats(b.joined(spark, d, "cs"), _SCALED)


@query("standardise", with_tables("joined", "SELECT enrolment, " + ", ".join(
    r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c) for c in _SCALED) + " FROM joined"))
def standardise(spark, d):
    rows, _ = settle(b.joined(spark, d, "cs").select("enrolment", *_SCALED))
    return encode.standardise(rows, _SCALED)


@query("split_fractions", with_tables("joined", f"""
    SELECT {n("target", "label")}, count(*) AS n_rows, {n(f"floor(count(*) * {TEST_SHARE} + 0.5)", "n_test")}
    FROM joined GROUP BY target"""))
def split_fractions(spark, d):
    rows, _ = settle(models.model_input(features.join_features(b.enrolments(spark, d), []), [], keep=b.KEY))
    split = sampling.stratified_split(rows, "label", b.KEY)
    return split.groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_test").alias("n_test")
    )


@query("fold_sizes", with_tables("joined", f"""
    SELECT {n("target", "label")}, {n("i", "fold")},
           {n("floor(c * ((i + 1) / 5.0) + 0.5) - floor(c * (i / 5.0) + 0.5)", "n_rows")}
    FROM (SELECT target, count(*) AS c FROM joined GROUP BY target), (SELECT unnest(range(5)) AS i)"""))
def fold_sizes(spark, d):
    rows, _ = settle(models.model_input(features.join_features(b.enrolments(spark, d), []), [], keep=b.KEY))
    folded = sampling.stratified_folds(rows, "label", b.KEY)
    return folded.groupBy(F.col("label").cast("long").alias("label"), "fold").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


# A stand-in for a model: the mean score as the probability of passing.
_EVALUATED = """(SELECT target AS label, avg_assessment_score / 100 AS score,
                CASE WHEN avg_assessment_score / 100 >= 0.51 THEN 1 ELSE 0 END AS prediction FROM joined)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("avg_assessment_score") / 100
    return b.joined(spark, d, "s").select(
        F.col("target").alias("label"), score.alias("score"), flag(score >= 0.51).alias("prediction")
    )


@query("confusion", with_tables("joined", f"""
    SELECT CAST(l AS BIGINT) AS label, CAST(p AS BIGINT) AS prediction, count(e.score) AS count
    FROM (SELECT unnest([0, 0, 1, 1]) AS l, unnest([0, 1, 0, 1]) AS p)
    LEFT JOIN {_EVALUATED} e ON e.label = l AND e.prediction = p GROUP BY l, p"""))
def confusion(spark, d):
    return metrics.confusion(_evaluated(spark, d))


@query("classification_report", with_tables("joined", f"""
    , k AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS a, count(*) FILTER (label = 0 AND prediction = 1) AS b,
                   count(*) FILTER (label = 1 AND prediction = 0) AS c, count(*) FILTER (label = 1 AND prediction = 1) AS d
            FROM {_EVALUATED}),
    m AS (SELECT *, a / (a + c) AS p0, a / (a + b) AS r0, d / (b + d) AS p1, d / (c + d) AS r1,
                 2.0 * a / (2 * a + b + c) AS f0, 2.0 * d / (2 * d + b + c) AS f1 FROM k)
    SELECT 'Fail/Withdraw' AS "class", {r("p0", "precision")}, {r("r0", "recall")}, {r("f0", "f1")}, a + b AS support FROM m
    UNION ALL SELECT 'Pass', {r("p1", "precision")}, {r("r1", "recall")}, {r("f1", "f1")}, c + d FROM m
    UNION ALL SELECT 'accuracy', NULL, NULL, {r("(a + d) / (a + b + c + d)", "f1")}, a + b + c + d FROM m
    UNION ALL SELECT 'macro avg', {r("(p0 + p1) / 2", "p")}, {r("(r0 + r1) / 2", "q")}, {r("(f0 + f1) / 2", "f1")}, a + b + c + d FROM m
    UNION ALL SELECT 'weighted avg', {r("(p0 * (a + b) + p1 * (c + d)) / (a + b + c + d)", "p")},
           {r("(r0 * (a + b) + r1 * (c + d)) / (a + b + c + d)", "q")},
           {r("(f0 * (a + b) + f1 * (c + d)) / (a + b + c + d)", "f1")}, a + b + c + d FROM m"""))
def classification_report(spark, d):
    return metrics.classification_report(_evaluated(spark, d))


@query("auc", with_tables("joined", f"""
    SELECT {r("(sum(mid) FILTER (label = 1) - p * (p + 1) / 2) / (p * q)", "auc")}
    FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mid,
                 CAST(count(*) FILTER (label = 1) OVER () AS DOUBLE) AS p,
                 CAST(count(*) FILTER (label = 0) OVER () AS DOUBLE) AS q FROM {_EVALUATED}) GROUP BY p, q"""))
def auc(spark, d):
    return metrics.auc(_evaluated(spark, d))


@query("roc_points", with_tables("joined", f"""
    SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
    UNION ALL SELECT {r("score", "threshold")}, {r("sum(q) OVER w / sum(q) OVER ()", "fpr")},
           {r("sum(p) OVER w / sum(p) OVER ()", "tpr")}
    FROM (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q
          FROM {_EVALUATED} GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""))
def roc_points(spark, d):
    return metrics.roc_points(_evaluated(spark, d))


# Models: the 27 features and the declared settings, fitted on all training rows.
def _input(spark: SparkSession, d: str):
    rows = b.master(spark, d)
    names = [f"{c}_enc" for c in b.CATEGORIES] + b.FEATURES
    stored, _ = settle(models.model_input(rows, names, keep=b.KEY))
    return stored, names


def _trained(spark: SparkSession, d: str, which: list[str]):
    stored, names = _input(spark, d)
    tagged = sampling.stratified_split(stored, "label", b.KEY, seed=SEED)
    chosen = {name: models.BATCH_MODELS[name] for name in which}
    fitted = models.train(tagged.where(~F.col("is_test")), names, chosen)
    return fitted, tagged, names


@query("train_compare")
def train_compare(spark, d):
    fitted, tagged, _ = _trained(spark, d, list(models.BATCH_MODELS))
    return models.compare(fitted, tagged.where("is_test"))


@query("importance")
def importance(spark, d):
    fitted, _, names = _trained(spark, d, ["Random Forest"])
    return models.importance(spark, fitted["Random Forest"], names)


@query("predict")
def predict(spark, d):
    fitted, tagged, _ = _trained(spark, d, ["Logistic Regression"])
    return models.predict(fitted["Logistic Regression"], tagged.where("is_test"), [*b.KEY, "label"])


@query("score_scenarios")
def score_scenarios(spark, d):
    """Every learner as a what-if case: what if nothing had been handed in late?"""
    fitted, tagged, names = _trained(spark, d, list(models.BATCH_MODELS))
    cases = tagged.withColumnRenamed("enrolment", "scenario").drop("late_submissions", "click_std")
    return models.score_scenarios(fitted, cases, names)


@query("cross_validate")
def cross_validate(spark, d):
    """Five folds of the linear model; ``plans.batch`` runs them for every model."""
    stored, names = _input(spark, d)
    mean = models.cross_validate(stored, names, models.BATCH_MODELS["Logistic Regression"], b.KEY)
    return stored.agg(F.count(F.lit(1)).alias("n_rows"), F.first(F.lit(mean)).alias("cv_accuracy"))


_EACH_MODEL = "(SELECT unnest([" + ", ".join(f"'{name}'" for name in models.BATCH_MODELS) + "]) AS model)"


@query("model_facts", with_tables("joined", f"""
    , t AS (SELECT target, count(*) AS c, {n(f"floor(count(*) * {TEST_SHARE} + 0.5)", "n_rows")} FROM joined GROUP BY target)
    SELECT 'test' AS part, model, {n("target", "label")}, n_rows, n_rows AS n_in_range, n_rows AS n_class_follows FROM t, {_EACH_MODEL}
    UNION ALL SELECT 'scenario', model, NULL, CAST(sum(c) AS BIGINT), CAST(sum(c) AS BIGINT), CAST(sum(c) AS BIGINT)
    FROM t, {_EACH_MODEL} GROUP BY model"""))
def model_facts(spark, d):
    """What holds of every model: a score for each test row and each what-if case, in range, from which the class
    and the verdict follow; shares of passing and failing add up."""
    fitted, tagged, names = _trained(spark, d, list(models.BATCH_MODELS))
    sums = {"n_rows": F.count(F.lit(1)), "n_in_range": F.count_if("_in_range"), "n_class_follows": F.count_if("_follows")}
    sums = [made.alias(name) for name, made in sums.items()]
    parts = []
    for name, model in fitted.items():
        held = models.predict(model, tagged.where("is_test"), ["label"]).select(
            F.col("label").cast("long").alias("label"), F.col("score").between(0, 1).alias("_in_range"),
            ((F.col("prediction") == 1) == (F.col("score") > 0.5)).alias("_follows"),
        )
        parts.append(held.groupBy("label").agg(*sums).select(F.lit("test").alias("part"), F.lit(name).alias("model"), "*"))
    cases = tagged.withColumnRenamed("enrolment", "scenario").drop("late_submissions", "click_std")
    shares_add_up = F.abs(F.col("pass_pct") + F.col("risk_pct") - 100) <= 0.11
    passes = (F.col("prediction") == 1) & (F.col("verdict") == "Pass") & (F.col("pass_pct") >= 50)
    fails = (F.col("prediction") == 0) & (F.col("verdict") == "At Risk") & (F.col("pass_pct") <= 50)
    told = models.score_scenarios(fitted, cases, names).select(
        "model", (F.col("pass_pct").between(0, 100) & shares_add_up).alias("_in_range"), (passes | fails).alias("_follows")
    )
    by_case = told.groupBy("model").agg(*sums)
    parts.append(by_case.withColumn("part", F.lit("scenario")).withColumn("label", F.lit(None).cast("long")))
    return reduce(DataFrame.unionByName, parts)


_GAPS = {"credits": "CASE WHEN enrolment % 7 <> 0 THEN studied_credits END", "tries": "CASE WHEN id_student % 5 <> 0 THEN num_of_prev_attempts END"}


@query("imputed_vectors", with_tables("enrolments", "SELECT enrolment, " + ", ".join(
    r(f"coalesce({c}, avg({c}) OVER ())", c) for c in _GAPS) + " FROM (SELECT enrolment, " + ", ".join(
    f"{made} AS {c}" for c, made in _GAPS.items()) + " FROM enrolments)"))
def imputed_vectors(spark, d):
    """Missing cells filled with the mean of their column, and the vector that a model sees, entry by entry."""
    rows, _ = settle(b.enrolments(spark, d).selectExpr("enrolment", *[f"CAST({made} AS DOUBLE) AS {c}" for c, made in _GAPS.items()]))
    steps = models.make_pipeline(list(_GAPS), {"kind": "forest"}, rows.count()).getStages()[:-1]
    made = Pipeline(stages=steps).fit(rows).transform(rows).withColumn("_entries", vector_to_array("features"))
    return made.select("enrolment", *[F.col("_entries")[i].alias(c) for i, c in enumerate(_GAPS)])


@query("stored_model", with_tables("joined", f"""
    SELECT {n("target", "label")}, {n(f"floor(count(*) * {TEST_SHARE} + 0.5)", "n_rows")},
           {n(f"floor(count(*) * {TEST_SHARE} + 0.5)", "n_same")} FROM joined GROUP BY target"""))
def stored_model(spark, d):
    """A model saved, found again as the best one, and its predictions beside those of the fitted one."""
    name = "Logistic Regression"
    fitted, tagged, _ = _trained(spark, d, [name])
    folder = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    sinks.save_models(fitted, folder)
    sinks.write_best(spark, name, folder)
    test = tagged.where("is_test").withColumn("label", F.col("label").cast("long"))
    first = models.predict(fitted[name], test).withColumnsRenamed({"prediction": "_class", "score": "_score"})
    again = models.predict(sinks.load_best(spark, folder)[1], first, ["label", "_class", "_score"])
    same = (F.col("prediction") == F.col("_class")) & (F.col("score") == F.col("_score"))
    return again.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_same"))


@query("split_rows", with_tables("joined", f"""
    SELECT {n("enrolment")}, {n("target", "label")},
           CAST(row_number() OVER (PARTITION BY target ORDER BY {key_hash("enrolment")})
             <= floor(count(*) OVER (PARTITION BY target) * {TEST_SHARE} + 0.5) AS BIGINT) AS is_test
    FROM joined"""))
def split_rows(spark, d):
    """Which rows the split chooses."""
    rows, _ = settle(models.model_input(features.join_features(b.enrolments(spark, d), []), [], keep=b.KEY))
    made = sampling.stratified_split(rows, "label", b.KEY)
    return made.select("enrolment", F.col("label").cast("long").alias("label"), "is_test")


@query("fold_rows", with_tables("joined", f"""
    SELECT {n("enrolment")}, {n("target", "label")}, CAST(list_sum([
             CASE WHEN place > floor(total * (i / 5.0) + 0.5) THEN 1 ELSE 0 END for i in range(1, 5)]) AS BIGINT) AS fold
    FROM (SELECT enrolment, target, row_number() OVER (PARTITION BY target ORDER BY {key_hash("enrolment")}) AS place,
                 count(*) OVER (PARTITION BY target) AS total FROM joined)"""))
def fold_rows(spark, d):
    """Which fold each row falls into."""
    rows, _ = settle(models.model_input(features.join_features(b.enrolments(spark, d), []), [], keep=b.KEY))
    made = sampling.stratified_folds(rows, "label", b.KEY)
    return made.select("enrolment", F.col("label").cast("long").alias("label"), "fold")


@query("predict_counts", with_tables("joined", f"""
    SELECT {n("target", "label")}, {n(f"floor(count(*) * {TEST_SHARE} + 0.5)", "n_rows")},
           {n(f"floor(count(*) * {TEST_SHARE} + 0.5)", "n_score_in_range")},
           {n(f"floor(count(*) * {TEST_SHARE} + 0.5)", "n_class_follows_score")}
    FROM joined GROUP BY target"""))
def predict_counts(spark, d):
    """What holds of every prediction: the score is a probability, the class follows from it."""
    made = predict(spark, d)
    return made.groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("score").between(0, 1)).alias("n_score_in_range"),
        F.count_if((F.col("prediction") == 1) == (F.col("score") > 0.5)).alias("n_class_follows_score"),
    )
