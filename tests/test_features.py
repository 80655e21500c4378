import pytest
from pyspark.sql import functions as F

from cohortlens.fixed import CATEGORIES
from cohortlens.operators.encode import rank_encode, scale_stats, standardise
from cohortlens.operators.features import (
    activity_types,
    build_master,
    click_features,
    join_features,
    registration_features,
    score_features,
)
from cohortlens.operators.models import feature_names
from cohortlens.plans.master import clicks_with_results, early_warning, master_table, risk_report


@pytest.fixture(scope="module")
def clicks(spark):
    return spark.createDataFrame(
        [(1, 10, -3, 5), (1, 10, 30, 7), (1, 11, 31, 1), (1, 12, 31, 2), (2, 10, 200, 4), (None, 10, 1, 9)],
        "id_student int, id_site int, date int, sum_click int",
    )


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(
        [(10, "forum"), (11, "quiz"), (11, "quiz"), (12, "forum")], "id_site int, activity_type string"
    )


def test_click_features(spark, rows, clicks, sites):
    first, second = rows(click_features(clicks, sites), "id_student")
    assert first["total_clicks"] == 15 and first["active_days"] == 3
    assert (first["clicks_day30"], first["clicks_day60"], first["clicks_day100"]) == (12, 15, 15)
    assert first["last_active_day"] == 31 and first["unique_activity_types"] == 2
    assert first["click_std"] == pytest.approx(2.753785)
    # One row only: the deviation is 0; no early rows: the early sums are 0.
    assert second["click_std"] == 0.0 and second["clicks_day100"] == 0


def test_activity_types_of_unknown_site(spark, rows, clicks, sites):
    some = sites.where("id_site = 10")
    found = {r["id_student"]: r["unique_activity_types"] for r in rows(activity_types(clicks, some))}
    assert found == {1: 1, 2: 1}


@pytest.fixture(scope="module")
def submissions(spark):
    return spark.createDataFrame(
        [(1, 100, 50.0, 10), (1, 101, 70.0, 25), (1, 102, None, 5), (2, 103, 90.0, 1)],
        "id_student int, id_assessment int, score double, date_submitted int",
    )


@pytest.fixture(scope="module")
def assessments(spark):
    return spark.createDataFrame(
        [(100, "TMA", 9, 10.0), (101, "Exam", None, 20.0), (102, "TMA", 5, 30.0)],
        "id_assessment int, assessment_type string, date int, weight double",
    )


def test_score_features(spark, rows, submissions, assessments):
    first, second = rows(score_features(submissions, assessments), "id_student")
    assert first["avg_assessment_score"] == 60.0 and first["score_std"] == pytest.approx(14.142136)
    assert first["num_assessments_submitted"] == 3
    assert (first["tma_avg_score"], first["exam_avg_score"]) == (50.0, 70.0)
    # Late only against a known due day; day 5 against 5 is not late.
    assert first["late_submissions"] == 1
    # An unknown assessment keeps the score but has no type.
    assert second["avg_assessment_score"] == 90.0 and second["tma_avg_score"] is None
    assert second["score_std"] == 0.0 and second["late_submissions"] == 0


def test_late_submissions_without_due_column(spark, rows, submissions, assessments):
    made = rows(score_features(submissions, assessments.drop("date")), "id_student")
    assert [r["late_submissions"] for r in made] == [0, 0]


@pytest.fixture(scope="module")
def registrations(spark):
    return spark.createDataFrame(
        [(1, "2013J", "-20", None), (1, "2014J", "3", "31"), (2, "2013J", "?", "?"),
         (3, "2013J", None, "-5"), (4, "2013J", "0", "0")],
        "id_student int, code_presentation string, date_registration string, date_unregistration string",
    )


def test_registration_features(spark, rows, registrations):
    made = {r["id_student"]: r for r in rows(registration_features(registrations))}
    assert made[1]["num_modules_registered"] == 2 and made[1]["withdrawal_day"] == 31.0
    assert (made[1]["withdrew"], made[1]["early_withdraw"], made[1]["registered_late"]) == (1, 0, 1)
    # Unreadable day: withdrew, but the day is the "never" value.
    assert (made[2]["withdrew"], made[2]["withdrawal_day"], made[2]["early_withdraw"]) == (1, 999.0, 0)
    assert made[2]["registered_late"] == 0
    assert made[3]["early_withdraw"] == 1 and made[4]["early_withdraw"] == 1


@pytest.fixture(scope="module")
def info(spark):
    return spark.createDataFrame(
        [("AAA", "2013J", 1, "M", "x", "A Level", "0-10%", "0-35", 0, 60, "N", "Pass"),
         ("BBB", "2013J", 1, "M", "x", "A Level", None, "0-35", 1, 30, "N", "Withdrawn"),
         ("AAA", "2014J", 9, "F", "y", "HE", "10-20", "35-55", None, 60, "Y", "Deferred")],
        "code_module string, code_presentation string, id_student int, gender string, region string, "
        "highest_education string, imd_band string, age_band string, num_of_prev_attempts int, "
        "studied_credits int, disability string, final_result string",
    )


@pytest.fixture(scope="module")
def tables(info, clicks, sites, submissions, assessments, registrations):
    return {
        "studentInfo": info, "studentVle": clicks, "vle": sites, "studentAssessment": submissions,
        "assessments": assessments, "studentRegistration": registrations,
    }


def test_master(spark, rows, tables):
    made = master_table(tables)
    assert len(made.columns) == 40 and len(feature_names(made)) == 27
    first, second, third = rows(made, "id_student", "code_module")
    # Both enrolments of a learner carry the same features.
    assert first["total_clicks"] == second["total_clicks"] == 15
    assert (first["target"], second["target"], third["target"]) == (1, 0, None)
    # Nothing known about the third: every number is 0, the withdrawal day too.
    assert third["total_clicks"] == 0 and third["withdrawal_day"] == 0.0
    assert third["num_of_prev_attempts"] == 0 and third["avg_assessment_score"] == 0.0
    assert (first["imd_band_enc"], second["imd_band_enc"], third["imd_band_enc"]) == (0, -1, 1)
    assert made.columns[:12] == tables["studentInfo"].columns
    assert made.columns[-8:] == [f"{c}_enc" for c in CATEGORIES]


def test_feature_order(spark, tables):
    names = feature_names(master_table(tables))
    assert names[:2] == ["gender_enc", "region_enc"] and names[8] == "total_clicks"
    assert names[-2:] == ["studied_credits", "num_of_prev_attempts"]
    assert "withdrew" not in names and "registered_late" not in names
    assert "withdrawal_day" not in feature_names(master_table(tables), exclude=["withdrawal_day"])


def test_early_warning_columns(spark, tables):
    made = early_warning(master_table(tables))
    assert len(made.columns) == 13 and "id_student" not in made.columns


def test_risk_flag(spark, rows):
    given = spark.createDataFrame(
        [(199, 49.0), (200, 49.0), (199, 50.0)], "clicks_day30 int, avg_assessment_score double"
    )
    made = rows(risk_report(given))
    assert [r["risk_flag"] for r in made] == [1, 0, 0]


def test_clicks_with_results_keeps_both_sides(spark, rows, clicks, info):
    made = {(r["id_student"], r["final_result"], r["total_clicks"]) for r in rows(clicks_with_results(clicks, info))}
    assert made == {(1, "Pass", 15), (1, "Withdrawn", 15), (2, None, 4)}


def test_join_without_features(spark, rows, info):
    assert join_features(info, []).count() == 3


def test_codes_in_byte_order(spark, rows):
    given = spark.createDataFrame([(v,) for v in ["b", None, "a", "B", "10-20", "0-10%"]], "c string")
    made = {r["c"]: r["c_enc"] for r in rows(rank_encode(given, ["c"]))}
    assert made == {"0-10%": 0, "10-20": 1, "B": 2, "a": 3, "b": 4, None: -1}


def test_codes_of_many_values(spark, rows):
    given = spark.range(500).select(F.format_string("%05d", "id").alias("c"), "id")
    made = rank_encode(given, ["c"], limit=10, window_limit=10)
    assert made.where("c_enc <> id").count() == 0 and made.count() == 500


def test_scaling(spark, rows):
    given = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert rows(scale_stats(given, ["a", "b"]), "column") == [
        {"column": "a", "mean": 2.0, "std": 1.0}, {"column": "b", "mean": 5.0, "std": 0.0}
    ]
    assert rows(standardise(given, ["a", "b"]), "a") == [{"a": -1.0, "b": 0.0}, {"a": 1.0, "b": 0.0}]


def test_master_without_categories(spark, info):
    made = build_master(info.drop("imd_band"), [])
    assert "imd_band_enc" not in made.columns and "gender_enc" in made.columns
