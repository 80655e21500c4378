"""The whole batch from CSV files to reports and models."""

import os

import pytest
from pyspark.sql import functions as F

from checks import bindings as b
from cohortlens.operators.scale import shared_folder
from cohortlens.plans import batch, eda
from cohortlens.sources.readers import read_tables
from cohortlens.sources.sinks import load_best, write_table
from tests.conftest import DATA

SMALL = {
    "Logistic Regression": {"kind": "linear", "maxIter": 10},
    "Random Forest": {"kind": "forest", "numTrees": 5, "maxDepth": 4, "minInstancesPerNode": 5},
}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """The test tables in the input format. Sites get numbers, as the declared schema has them."""
    folder = str(tmp_path_factory.mktemp("data"))
    number = F.pmod(F.hash("id_site"), F.lit(1000)).cast("int")
    info = b.enrolments(spark, DATA).drop("enrolment")
    made = {
        "studentInfo": info.dropDuplicates(["id_student", "code_module", "code_presentation"]),
        "studentVle": b.clicks(spark, DATA).withColumn("id_site", number),
        "vle": b.sites(spark, DATA).withColumn("id_site", number),
        "studentAssessment": b.submissions(spark, DATA),
        "assessments": b.assessments(spark, DATA),
        "studentRegistration": b.registrations(spark, DATA),
    }
    for name, df in made.items():
        write_table(df, f"{folder}/{name}.csv", "csv")
    return folder


def test_whole_batch(spark, rows, data, tmp_path):
    out = str(tmp_path)
    shared = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    comparison = rows(batch.run(spark, data, out, settings=SMALL, folds=2), "position")
    assert set(os.listdir(shared)) == before
    assert sorted(os.listdir(f"{out}/extracts")) == ["assess_marked", "clicks_result", "student_info"]
    assert [r["model"] for r in comparison] == list(SMALL)
    # The test tables carry no signal: only ranges can be checked here, the signal test is in
    # test_models.py.
    assert all(0.3 < r["auc"] < 0.7 and 0.4 < r["cv_accuracy"] < 0.7 for r in comparison), comparison
    master = spark.read.parquet(f"{out}/master")
    assert len(master.columns) == 40
    assert master.count() == read_tables(spark, data)["studentInfo"].count()
    audit = {r["table_name"]: r for r in rows(spark.read.parquet(f"{out}/audit"))}
    assert audit["courses"]["found"] == 0 and audit["studentVle"]["n_rows"] == 1000
    assert spark.read.parquet(f"{out}/reports/KPI_Summary").first()["Total Students"] == master.count()
    assert spark.read.parquet(f"{out}/eda/daily_clicks").count() == 30
    name, _ = load_best(spark, f"{out}/models")
    assert name in ("logistic_regression", "random_forest")
    cells = rows(spark.read.parquet(f"{out}/evaluation/Random Forest/confusion"))
    assert len(cells) == 4


def test_missing_tables_stop_the_batch(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        batch.prepare(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        batch.export(spark, str(tmp_path / "none"), str(tmp_path / "out"))


def test_eda_agrees_with_pandas(spark, rows, data):
    """The counted joins give what the row-level joins would."""
    tables = read_tables(spark, data)
    made = eda.eda_tables(tables)
    pandas = {n: tables[n].toPandas() for n in ("studentInfo", "studentVle", "studentAssessment")}
    info = pandas["studentInfo"][["id_student", "final_result"]]
    totals = pandas["studentVle"].groupby("id_student")["sum_click"].sum().reset_index()
    clicks = totals.merge(info, on="id_student", how="left")
    means = clicks.groupby("final_result")["sum_click"].mean().round(0)
    assert {r["final_result"]: r["mean"] for r in rows(made["mean_clicks"])} == means.to_dict()
    scores = pandas["studentAssessment"].merge(info, on="id_student", how="left")
    means = scores.groupby("final_result")["score"].mean().round(1)
    assert {r["final_result"]: r["mean"] for r in rows(made["mean_score"])} == means.to_dict()
    counts = scores.groupby("final_result")["score"].count().to_dict()
    binned = rows(made["score_histogram"].groupBy("final_result").agg(F.sum("count").alias("n")))
    assert {r["final_result"]: r["n"] for r in binned} == counts
    kept = clicks[clicks["sum_click"] < clicks["sum_click"].quantile(0.99)]
    medians = kept.groupby("final_result")["sum_click"].median().to_dict()
    assert {r["final_result"]: r["median"] for r in rows(made["clicks_box"])} == medians
