"""The test tables seen as the logical tables, once in Spark and once as SQL for the oracle.

The test data has learners only by analogy: orders stand for enrolments, customers for
learners, order lines for submissions, parts for assessments, events for clicks. Click counts
are event values in cents, so that all sums are whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.features import (
    build_master,
    click_features,
    join_features,
    registration_features,
    score_features,
)

# Early days of the 30-day event log, standing for days 30/60/100 of a course.
CUTOFFS = (7, 14, 21)
EARLY = "clicks_day7"
# Band edges and risk limits in the same unit as the clicks.
BAND_EDGES = [0, 250000, 300000, 350000, 400000, 99999999]
RISK_CLICKS = 100000
RISK_SCORE = 51
FEATURES = [
    "total_clicks", "active_days", "clicks_day7", "clicks_day14", "clicks_day21", "click_std",
    "unique_activity_types", "last_active_day", "avg_assessment_score", "score_std",
    "num_assessments_submitted", "tma_avg_score", "exam_avg_score", "late_submissions",
    "num_modules_registered", "withdrawal_day", "early_withdraw", "studied_credits",
    "num_of_prev_attempts",
]
CATEGORIES = [
    "gender", "region", "highest_education", "imd_band",
    "age_band", "disability", "code_module", "code_presentation",
]
KEY = ["enrolment"]


# Declared schemas: reading a table then needs no job to look at its files.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string, "
        "l_shipdate timestamp_ntz"
    ),
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(
        "user_id AS id_student",
        "event_type AS id_site",
        "datediff(to_date(ts), DATE'2024-01-01') AS date",
        "CAST(rint(value * 100) AS BIGINT) AS sum_click",
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_type").distinct().selectExpr(
        "event_type AS id_site",
        "IF(event_type IN ('view', 'click'), 'browse', event_type) AS activity_type",
    )


def enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation and region are fixed lists of 25 and 5 rows.
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    people = (
        load(spark, sf_dir, "customer")
        .join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey"))
        .join(F.broadcast(region), F.expr("n_regionkey = r_regionkey"))
    )
    orders = load(spark, sf_dir, "orders")
    return orders.join(people, F.expr("o_custkey = c_custkey")).selectExpr(
        "o_orderkey AS enrolment",
        "o_custkey AS id_student",
        "c_mktsegment AS code_module",
        "CAST(year(o_orderdate) AS STRING) AS code_presentation",
        "IF(n_nationkey % 2 = 0, 'F', 'M') AS gender",
        "r_name AS region",
        "o_orderpriority AS highest_education",
        "IF(c_acctbal >= 0, format_string('%d-%d%%', CAST(floor(c_acctbal / 1000) * 10 AS INT), "
        "CAST(floor(c_acctbal / 1000) * 10 + 10 AS INT)), NULL) AS imd_band",
        "CASE o_custkey % 3 WHEN 0 THEN '0-35' WHEN 1 THEN '35-55' ELSE '55<=' END AS age_band",
        "CAST(o_orderkey % 5 AS INT) AS num_of_prev_attempts",
        "CAST(30 * (1 + o_orderkey % 8) AS INT) AS studied_credits",
        "IF(o_custkey % 10 = 0, 'Y', 'N') AS disability",
        "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'Distinction' "
        "WHEN o_orderstatus = 'F' THEN 'Pass' WHEN o_orderstatus = 'O' THEN 'Fail' "
        "WHEN o_orderstatus = 'P' THEN 'Withdrawn' END AS final_result",
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    return lines.join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "o_custkey AS id_student",
        "l_partkey AS id_assessment",
        "l_quantity * 2 AS score",
        "datediff(to_date(l_shipdate), to_date(o_orderdate)) AS date_submitted",
    )


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id_assessment",
        "CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'TMA' "
        "WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'CMA' ELSE 'Exam' END AS assessment_type",
        "IF(p_size % 10 <> 0, p_size, NULL) AS date",
        "p_retailprice AS weight",
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders. The first returned line is the withdrawal; its day is
    text, and unreadable for pending orders."""
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    returned = (
        lines.where("l_returnflag = 'R'")
        .groupBy("l_orderkey")
        .agg(F.expr("min(to_date(l_shipdate)) AS first_return"))
    )
    return (
        orders.join(returned, F.expr("o_orderkey = l_orderkey"), "left")
        .selectExpr(
            "o_custkey AS id_student",
            "CAST(year(o_orderdate) AS STRING) AS code_presentation",
            "CAST(datediff(to_date(o_orderdate), DATE'1998-01-01') AS STRING) AS date_registration",
            "CASE WHEN first_return IS NULL THEN NULL WHEN o_orderstatus = 'P' THEN '?' "
            "ELSE CAST(datediff(first_return, to_date(o_orderdate)) AS STRING) END AS date_unregistration",
        )
    )


def features(spark: SparkSession, sf_dir: str, parts: str) -> list[DataFrame]:
    """Feature tables by letter: c clicks, s submissions, r registrations."""
    made = []
    if "c" in parts:
        made.append(click_features(clicks(spark, sf_dir), sites(spark, sf_dir), cutoffs=CUTOFFS))
    if "s" in parts:
        made.append(score_features(submissions(spark, sf_dir), assessments(spark, sf_dir)))
    if "r" in parts:
        made.append(registration_features(registrations(spark, sf_dir)))
    return made


def joined(spark: SparkSession, sf_dir: str, parts: str = "csr") -> DataFrame:
    """Enrolments with the feature tables that a query uses, without category codes."""
    return join_features(enrolments(spark, sf_dir), features(spark, sf_dir, parts))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_master(enrolments(spark, sf_dir), features(spark, sf_dir, "csr"))


# The same tables as SQL.
SQL_TABLES = {
    "clicks": """
        SELECT user_id AS id_student, event_type AS id_site,
               datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS date,
               CAST(round_even(CAST(value AS DOUBLE) * 100, 0) AS BIGINT) AS sum_click
        FROM events""",
    "sites": """
        SELECT DISTINCT event_type AS id_site,
               CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE event_type END AS activity_type
        FROM events""",
    "enrolments": """
        SELECT o_orderkey AS enrolment, o_custkey AS id_student, c_mktsegment AS code_module,
               CAST(year(o_orderdate) AS VARCHAR) AS code_presentation,
               CASE WHEN n_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               r_name AS region, o_orderpriority AS highest_education,
               CASE WHEN c_acctbal >= 0 THEN
                 CAST(CAST(floor(c_acctbal / 1000) AS INT) * 10 AS VARCHAR) || '-' ||
                 CAST(CAST(floor(c_acctbal / 1000) AS INT) * 10 + 10 AS VARCHAR) || '%' END AS imd_band,
               CASE o_custkey % 3 WHEN 0 THEN '0-35' WHEN 1 THEN '35-55' ELSE '55<=' END AS age_band,
               o_orderkey % 5 AS num_of_prev_attempts, 30 * (1 + o_orderkey % 8) AS studied_credits,
               CASE WHEN o_custkey % 10 = 0 THEN 'Y' ELSE 'N' END AS disability,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'Distinction'
                    WHEN o_orderstatus = 'F' THEN 'Pass' WHEN o_orderstatus = 'O' THEN 'Fail'
                    WHEN o_orderstatus = 'P' THEN 'Withdrawn' END AS final_result
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "submissions": """
        SELECT o_custkey AS id_student, l_partkey AS id_assessment, l_quantity * 2 AS score,
               datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS date_submitted
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "assessments": """
        SELECT p_partkey AS id_assessment,
               CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'TMA'
                    WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'CMA' ELSE 'Exam' END AS assessment_type,
               CASE WHEN p_size % 10 <> 0 THEN p_size END AS date, p_retailprice AS weight
        FROM part""",
    "registrations": """
        SELECT o_custkey AS id_student, CAST(year(o_orderdate) AS VARCHAR) AS code_presentation,
               CAST(datediff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS VARCHAR) AS date_registration,
               CASE WHEN first_return IS NULL THEN NULL WHEN o_orderstatus = 'P' THEN '?'
                    ELSE CAST(datediff('day', CAST(o_orderdate AS DATE), first_return) AS VARCHAR)
               END AS date_unregistration
        FROM orders LEFT JOIN (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS first_return
                   FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "scored": """
        SELECT submissions.*, assessment_type, weight, assessments.date AS due
        FROM submissions LEFT JOIN assessments USING (id_assessment)""",
    "click_features": """
        SELECT id_student, sum(sum_click) AS total_clicks, count(DISTINCT date) AS active_days,
               coalesce(sum(sum_click) FILTER (date <= 7), 0) AS clicks_day7,
               coalesce(sum(sum_click) FILTER (date <= 14), 0) AS clicks_day14,
               coalesce(sum(sum_click) FILTER (date <= 21), 0) AS clicks_day21,
               coalesce(stddev_samp(sum_click), 0) AS click_std, max(date) AS last_active_day,
               count(DISTINCT activity_type) AS unique_activity_types
        FROM clicks LEFT JOIN sites USING (id_site) GROUP BY id_student""",
    "score_features": """
        SELECT id_student, avg(score) AS avg_assessment_score,
               coalesce(stddev_samp(score), 0) AS score_std,
               count(id_assessment) AS num_assessments_submitted,
               avg(score) FILTER (assessment_type = 'TMA') AS tma_avg_score,
               avg(score) FILTER (assessment_type = 'Exam') AS exam_avg_score,
               count(*) FILTER (date_submitted > due) AS late_submissions
        FROM scored GROUP BY id_student""",
    "registration_features": """
        SELECT id_student, count(code_presentation) AS num_modules_registered,
               max(CASE WHEN date_unregistration IS NULL THEN 0 ELSE 1 END) AS withdrew,
               min(coalesce(TRY_CAST(date_unregistration AS DOUBLE), 999)) AS withdrawal_day,
               max(CASE WHEN TRY_CAST(date_unregistration AS DOUBLE) <= 30 THEN 1 ELSE 0 END) AS early_withdraw,
               max(CASE WHEN TRY_CAST(date_registration AS DOUBLE) > 0 THEN 1 ELSE 0 END) AS registered_late
        FROM registrations GROUP BY id_student""",
}

_FILLED = FEATURES[:17] + ["withdrew", "registered_late"]
SQL_TABLES["joined"] = f"""
        SELECT e.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _FILLED)},
               CASE WHEN final_result IN ('Pass', 'Distinction') THEN 1
                    WHEN final_result IN ('Fail', 'Withdrawn') THEN 0 END AS target
        FROM enrolments e LEFT JOIN click_features USING (id_student)
        LEFT JOIN score_features USING (id_student) LEFT JOIN registration_features USING (id_student)"""
SQL_TABLES["master"] = f"""
        SELECT *, {", ".join(
            f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 END AS {c}_enc"
            for c in CATEGORIES)}
        FROM joined"""
# What each SQL table reads.
_READS = {
    "scored": ["submissions", "assessments"],
    "click_features": ["clicks", "sites"],
    "score_features": ["scored"],
    "registration_features": ["registrations"],
    "joined": ["enrolments", "click_features", "score_features", "registration_features"],
    "master": ["joined"],
}


def with_tables(names: str, query: str) -> str:
    """The query behind the WITH clauses of the named tables and of all they read."""
    needed: list[str] = []

    def need(name: str) -> None:
        for source in _READS.get(name, []):
            need(source)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_TABLES[n]})" for n in needed) + "\n" + query
