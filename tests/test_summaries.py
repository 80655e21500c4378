import pytest
from pyspark.sql import functions as F

from cohortlens.operators import bands, select, summaries


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "F", "0-10%", "Pass", 1), (2, "F", "0-10%", "Fail", 0), (3, "M", None, "Distinction", 1),
         (4, "M", "10-20", "Deferred", None), (5, None, "10-20", "Pass", 1), (6, "M", "10-20", None, None)],
        "id_student int, gender string, imd_band string, final_result string, target int",
    )


def test_value_counts_and_share(spark, rows, people):
    made = rows(summaries.value_counts(people, "final_result", share=True))
    assert made[0] == {"final_result": "Pass", "count": 2, "share": 0.4}
    assert sum(r["count"] for r in made) == 5


def test_crosstab_leaves_out_missing_keys(spark, rows, people):
    made = rows(summaries.crosstab(people, "gender", "final_result"), "gender")
    assert made[0] == {"gender": "F", "Distinction": 0, "Fail": 1, "Pass": 1, "Withdrawn": 0}
    assert made[1] == {"gender": "M", "Distinction": 1, "Fail": 0, "Pass": 0, "Withdrawn": 0}


def test_crosstab_percent_rows_sum_to_100(spark, rows, people):
    made = rows(summaries.crosstab(people, "gender", "final_result", values=None, normalize=True), "gender")
    for row in made:
        assert sum(v for k, v in row.items() if k != "gender") == pytest.approx(100)
    assert made[1]["Deferred"] == 50.0


def test_long_crosstab_keeps_zero_cells(spark, rows, people):
    made = rows(summaries.melt_crosstab(people, "gender", "final_result"), "gender", "final_result")
    assert len(made) == 8 and sum(r["value"] for r in made) == 3


def test_pass_percent_keeps_listed_labels_in_order(spark, rows, people):
    made = rows(summaries.pass_percent_in_order(people, "imd_band", "final_result", ["10-20%", "0-10%"]))
    assert [(r["imd_band"], r["pass_pct"]) for r in made] == [("0-10%", 50.0)]


def test_two_kinds_of_rate(spark, rows, people):
    strict = {r["gender"]: r["rate"] for r in rows(summaries.success_rate(people, "gender", digits=1))}
    loose = {r["gender"]: r["rate"] for r in rows(summaries.success_rate(people, "gender", null_as_fail=False))}
    assert strict == {"F": 50.0, "M": 33.3} and loose == {"F": 50.0, "M": 100.0}


def test_enrolment_mean_counts_every_enrolment(spark, rows):
    scores = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 90.0), (3, 5.0)], "id_student int, score double")
    info = spark.createDataFrame(
        [(1, "Pass"), (1, "Pass"), (1, "Fail"), (2, "Pass"), (9, "Fail")], "id_student int, final_result string"
    )
    made = {r["final_result"]: r["mean"] for r in rows(summaries.enrolment_mean(scores, info, "score"))}
    assert made == {"Pass": pytest.approx((10 + 20 + 10 + 20 + 90) / 5), "Fail": 15.0}


def test_withdrawal_counts(spark, rows):
    given = spark.createDataFrame([("-5",), ("30",), ("31",), ("?",), (None,)], "date_unregistration string")
    assert rows(summaries.withdrawal_counts(given)) == [{"withdrawals": 4, "early_withdrawals": 2}]


def test_daily_series(spark, rows):
    given = spark.createDataFrame(
        [(1, 0, 5), (1, 0, None), (2, 0, 1), (1, -1, None), (1, None, 7)], "id_student int, date int, sum_click int"
    )
    assert rows(summaries.daily_series(given, entity="id_student")) == [
        {"date": -1, "clicks": 0, "unique_students": 1}, {"date": 0, "clicks": 6, "unique_students": 2}
    ]


def test_hierarchy_levels_agree(spark, rows, people):
    made = rows(summaries.hierarchy_counts(people, ["gender", "imd_band", "final_result"]))
    by_depth = {d: sum(r["count"] for r in made if r["depth"] == d) for d in (1, 2, 3)}
    assert by_depth == {1: 3, 2: 3, 3: 3}
    assert {r["gender"] for r in made if r["depth"] == 1} == {"F", "M"}


@pytest.fixture(scope="module")
def master(people):
    return people.select(
        "*", (F.col("id_student") * 100).alias("total_clicks"), F.lit(50.0).alias("avg_assessment_score"),
        F.lit(1).alias("withdrew"), F.lit("AAA").alias("code_module"), F.lit("2013J").alias("code_presentation"),
        F.lit(3).alias("active_days"),
    )


def test_module_performance(spark, rows, master):
    made = rows(summaries.module_performance(master))[0]
    assert (made["total_students"], made["pass_count"], made["withdrawal_count"]) == (6, 3, 6)
    assert made["pass_rate_pct"] == 50.0
    assert rows(summaries.module_performance(master.drop("withdrew")))[0]["withdrawal_count"] == 4


def test_deprivation_leaves_out_unknown_band(spark, rows, master):
    made = rows(summaries.deprivation_report(master), "imd_band")
    assert [(r["imd_band"], r["students"], r["pass_rate"]) for r in made] == [("0-10%", 2, 50.0), ("10-20", 3, 100.0)]


def test_key_figures(spark, rows, master):
    made = rows(summaries.kpi_report(master))[0]
    assert made["Total Students"] == 6 and made["Pass Rate (%)"] == 75.0 and made["Withdrawal Rate (%)"] == 100.0
    assert made["Distinction Count"] == 1 and made["At Risk (Fail+Withdraw)"] == 1
    assert rows(summaries.kpi_report(master.drop("withdrew")))[0]["Withdrawal Rate (%)"] == "N/A"


def test_key_figure_strip(spark, rows, master):
    made = rows(summaries.kpi_strip_text(master.drop("withdrew")))[0]
    assert made == {
        "students": "6", "pass_rate": "50.0%", "avg_clicks": "350", "avg_score": "50.0",
        "active_days": "3", "withdrawal_rate": "—",
    }


def test_bands_with_empty_ones(spark, rows):
    given = spark.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate([(0, 1), (200, 1), (201, 0), (500, 1), (1000000, 1)])],
        "id_student int, total_clicks int, target int",
    )
    made = rows(bands.engagement_bands(given))
    assert [(r["students"], r["pass_rate"]) for r in made] == [(1, 100.0), (2, 50.0), (0, None), (0, None), (0, None)]
    assert made[0]["engagement_band"] == "Very Low (0-200)"


def test_withdrawal_timeline(spark, rows):
    given = spark.createDataFrame(
        [("-5",), ("0",), ("30",), ("31",), ("?",), (None,), ("1000",)], "date_unregistration string"
    )
    assert [r["withdrawals"] for r in rows(bands.withdrawal_timeline(given))] == [1, 1, 0, 0, 0]


def test_late_bands(spark, rows):
    given = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (21, 1)], "late_submissions int, target int")
    assert rows(bands.late_bands(given)) == [
        {"late_band": "(0, 1]", "pass_rate": 100.0}, {"late_band": "(1, 3]", "pass_rate": 0.0},
        {"late_band": "(3, 5]", "pass_rate": None}, {"late_band": "(5, 20]", "pass_rate": None},
    ]


def test_filters(spark, people):
    assert select.filter_in(people, {"gender": [], "final_result": []}).count() == 6
    assert select.filter_in(people, {"gender": ["F", "M"]}).count() == 5
    assert select.filter_in(people, {"gender": ["F"], "final_result": ["Pass"]}).count() == 1


def test_explorer(spark, people):
    shown = select.explore(people, results=["Pass"], columns=["gender", "absent"])
    assert shown.columns == ["gender"] and shown.count() == 2
    assert select.explore(people, results=[]).count() == 0
    assert select.explore(people, columns=[], n=3).count() == 3
    assert select.explore(people, columns=[]).columns == people.columns


def test_best_row_takes_the_first_of_equals(spark, rows):
    given = spark.createDataFrame([(0, "A B", 0.5), (1, "C", 0.9), (2, "D", 0.9)], "position int, model string, auc double")
    assert rows(select.best_row(given, "auc", "position"))[0]["model"] == "C"
    assert rows(select.best_name(given.limit(1), "model", "auc", "position")) == [{"best_model": "a_b"}]


def test_low_engagement(spark, rows):
    given = spark.createDataFrame(
        [(199, "Withdrawn"), (10, "Pass"), (200, "Withdrawn"), (1, None)], "clicks_day30 int, final_result string"
    )
    made = rows(summaries.low_engagement_dropout(given))[0]
    assert made["students"] == 3 and made["withdrawn_pct"] == pytest.approx(100 / 3)


def test_crosstab_of_too_many_values_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([("a", f"v{i}") for i in range(4)], "r string, c string")
    monkeypatch.setattr(summaries, "MOST_COLUMNS", 4)
    assert summaries.crosstab(df, "r", "c", None).columns == ["r", "v0", "v1", "v2", "v3"]
    monkeypatch.setattr(summaries, "MOST_COLUMNS", 3)
    with pytest.raises(ValueError, match="crosstab_cells"):
        summaries.crosstab(df, "r", "c", None)
    assert summaries.crosstab_cells(df, "r", "c").count() == 4
