import pytest
from pyspark.sql import functions as F

from checks import bindings as b
from checks import queries
from cohortlens.operators import models
from cohortlens.operators.sampling import stratified_split
from cohortlens.operators.scale import settle
from cohortlens.plans import pages
from cohortlens.plans.reports import reports
from cohortlens.sources import sinks
from tests.conftest import DATA

FEATURES = ["a", "b", "c"]
SETTINGS = {
    "Logistic Regression": {"kind": "linear", "maxIter": 50},
    "Random Forest": {"kind": "forest", "numTrees": 10, "maxDepth": 5, "minInstancesPerNode": 5},
    "Gradient Boosting": {"kind": "boost", "maxIter": 5, "maxDepth": 3, "stepSize": 0.1},
}


@pytest.fixture(scope="module")
def signal(spark):
    """Rows whose label follows a known logistic signal in a and b; c is noise."""
    rows = spark.range(3000).select(
        "id", F.randn(1).alias("a"), F.randn(2).alias("b"), F.randn(3).alias("c"), F.rand(4).alias("u")
    )
    chance = 1 / (1 + F.exp(-(F.col("a") * 2 - F.col("b") * 1.5)))
    stored, _ = settle(
        rows.select("id", *FEATURES, (F.col("u") < chance).cast("double").alias("label"))
    )
    return stored


@pytest.fixture(scope="module")
def split(signal):
    return stratified_split(signal, "label", ["id"])


@pytest.fixture(scope="module")
def fitted(split):
    return models.train(split.where("NOT is_test"), FEATURES, SETTINGS)


def test_models_find_the_signal(spark, rows, split, fitted):
    table = models.compare(fitted, split.where("is_test"), {"Random Forest": 0.5})
    made = rows(table, "position")
    assert [r["model"] for r in made] == list(SETTINGS)
    assert all(r["auc"] > 0.8 and 0.7 < r["accuracy"] <= 1 for r in made)
    assert models.best_model(table) in SETTINGS
    text = rows(models.comparison_text(table))
    assert text[0]["Accuracy"].endswith("%") and len(text[0]["ROC-AUC"]) == 6


def test_linear_model_has_the_signs_of_the_signal(fitted):
    weights = fitted["Logistic Regression"].stages[-1].coefficients.toArray()
    assert weights[0] > 0.5 and weights[1] < -0.5 and abs(weights[2]) < 0.3


def test_importance(spark, rows, fitted):
    made = rows(models.importance(spark, fitted["Random Forest"], FEATURES, 2))
    assert [r["feature"] for r in made] == ["a", "b"]
    assert models.importance(spark, fitted["Logistic Regression"], FEATURES) is None


def test_cross_validation(signal):
    mean = models.cross_validate(signal, FEATURES, SETTINGS["Logistic Regression"], ["id"], k=3)
    assert 0.7 < mean < 0.95


def test_scenarios(spark, rows, fitted):
    cases = spark.createDataFrame([(1, 3.0), (2, -3.0)], "scenario int, a double")
    made = rows(models.score_scenarios(fitted, cases, FEATURES), "scenario", "model")
    assert len(made) == 6
    for r in made:
        assert r["pass_pct"] + r["risk_pct"] == pytest.approx(100, abs=0.11)
        assert (r["verdict"] == "Pass") == (r["scenario"] == 1) == (r["prediction"] == 1)


def test_scenario_defaults(spark, rows):
    cases = spark.createDataFrame([(1, 600)], "scenario int, clicks_day30 int")
    made = rows(models.scenario_rows(cases, ["clicks_day30", "click_std", "tma_avg_score"]))[0]
    assert (made["clicks_day30"], made["click_std"], made["tma_avg_score"]) == (600.0, 180.0, 0.0)


def test_failing_model_reports_full_risk(spark, rows, fitted):
    cases = spark.createDataFrame([(1, 0.0)], "scenario int, a double")
    made = rows(models.score_scenarios({"x": fitted["Random Forest"]}, cases, ["a"]))[0]
    assert (made["prediction"], made["pass_pct"], made["risk_pct"]) == (0, 0.0, 100.0)


def test_models_are_stored(spark, fitted, split, tmp_path):
    sinks.save_models(fitted, str(tmp_path))
    sinks.write_best(spark, "Random Forest", str(tmp_path))
    name, model = sinks.load_best(spark, str(tmp_path))
    assert name == "random_forest"
    assert models.predict(model, split.where("is_test"), ["id"]).columns == ["id", "prediction", "score"]


@pytest.fixture(scope="module")
def master(spark):
    """The test feature table under the names that the pages expect."""
    stored, _ = settle(b.master(spark, DATA).withColumnRenamed("clicks_day7", "clicks_day30"))
    return stored


CHOICES = {"gender": ["F"], "age_band": [], "final_result": []}


def test_pages(spark, master):
    key = ["enrolment"]
    made = {
        "home": pages.home(master, CHOICES),
        "overview": pages.overview(master, CHOICES),
        "demographics": pages.demographics(master, CHOICES),
        "engagement": pages.engagement(master, b.clicks(spark, DATA), CHOICES, key),
        "assessments": pages.assessments(master, CHOICES, key),
        "explorer": pages.explorer(master, results=["Pass"], n=10),
        "filters": pages.filter_values(master),
    }
    sizes = {(page, name): df.count() for page, tables in made.items() for name, df in tables.items()}
    assert all(n > 0 for n in sizes.values()), sizes
    assert sizes["explorer", "rows"] == 10 and sizes["engagement", "active_days"] == 160
    assert pages.result_order(master) == ["Distinction", "Pass", "Fail", "Withdrawn"]


def test_pages_without_optional_columns(spark, master):
    bare = master.drop("total_clicks", "avg_assessment_score", "code_module", "imd_band")
    assert set(pages.engagement(bare, None, {})) == {"kpis"} == set(pages.assessments(bare, {}))
    assert "module_rate" not in pages.home(bare, {})


def test_predict_and_compare_pages(spark, master):
    small = {name: SETTINGS[name] for name in ("Logistic Regression", "Random Forest")}
    fit, test, features = pages.trained(master, small, ["enrolment"])
    assert len(features) == 10
    page = pages.comparison(fit, test)
    assert page["models"].count() == 2 and page["roc Random Forest"].count() > 2
    cases = spark.createDataFrame([(1, 65.0, 600)], "scenario int, avg_assessment_score double, clicks_day30 int")
    assert pages.predictions(fit, cases, features)["scenarios"].count() == 2


def test_reports(spark, master):
    tables = {
        "studentInfo": b.enrolments(spark, DATA), "studentVle": b.clicks(spark, DATA),
        "studentAssessment": b.submissions(spark, DATA), "assessments": b.assessments(spark, DATA),
        "studentRegistration": b.registrations(spark, DATA),
    }
    made = reports(master, tables)
    assert list(made) == [
        "Master_Data", "Result_Summary", "Module_Performance", "Engagement_Bands", "IMD_Deprivation",
        "Daily_VLE_Activity", "Assessment_Performance", "Early_Warning_Day30", "Withdrawal_Timeline", "KPI_Summary",
    ]
    bare = reports(master.drop("total_clicks", "imd_band", "clicks_day30").withColumn("total_clicks", F.lit(1)), {})
    assert "IMD_Deprivation" not in bare and "Daily_VLE_Activity" not in bare and "Early_Warning_Day30" not in bare


def test_a_fit_has_as_many_parts_as_its_passes_need(signal, monkeypatch):
    """Boosting starts a task for each part in every level of every tree."""
    seen = {}

    class Recorded:
        def __init__(self, kind):
            self.kind = kind

        def fit(self, rows):
            seen[self.kind] = rows.rdd.getNumPartitions(), rows.count(), rows.agg(F.sum("id")).first()[0]

    monkeypatch.setattr(models, "make_pipeline", lambda features, settings, *a, **k: Recorded(settings["kind"]))
    dealt = signal.repartition(12).cache()
    many = {**SETTINGS, "Random Forest": {"kind": "forest", "numTrees": 2000}}
    models.train(dealt, FEATURES, many)
    whole = 3000, 3000 * 2999 // 2
    assert seen == {"linear": (1, *whole), "forest": (5, *whole), "boost": (1, *whole)}
    monkeypatch.setattr(models, "TASK_CELLS", 1000)
    models.train(dealt, FEATURES, SETTINGS)
    assert seen["boost"] == (9, *whole)
    dealt.unpersist()


def test_queries_fit_all_training_rows(spark, monkeypatch):
    """12,000 of the 15,000 enrolments are for training."""
    seen = {}

    class Recorded:
        def fit(self, rows):
            seen["rows"] = rows.count()

    monkeypatch.setattr(models, "make_pipeline", lambda *a, **k: Recorded())
    _, tagged, _ = queries._trained(spark, DATA.replace("sf0.001", "sf0.01"), ["Logistic Regression"])
    assert seen["rows"] == tagged.where("NOT is_test").count() == 12000


def test_thresholds_come_from_all_rows(spark):
    """One row in 30,000 has a value of its own; Spark's trees alone look at 10,000 of them."""
    rows = spark.range(30000).selectExpr(
        "CAST(id % 3 AS DOUBLE) + IF(id = 12345, 9, 0) AS a", "CAST(id AS DOUBLE) AS b", "0D AS c",
        "CAST(id = 12345 AS DOUBLE) AS label",
    )
    edges = models.bin_edges(rows, FEATURES, [8, 32])
    assert edges[8] == [[0, 1, 2, 9], [3750.0 * i for i in range(8)], [0]]
    assert [len(x) for x in edges[32]] == [4, 32, 1]
    settings = {"tree": {"kind": "forest", "numTrees": 1, "featureSubsetStrategy": "all", "maxDepth": 1}}
    tree = models.train(rows, FEATURES, settings)["tree"]
    assert tree.stages[-1].featureImportances[0] == 1


def test_folds_are_read_without_a_shuffle(signal, monkeypatch):
    """Each of the many steps of a fit would repeat it."""
    plans, running = [], []

    class Recorded:
        def fit(self, rows):
            running.append(1)
            plans.append((rows.rdd.getNumPartitions(), rows._jdf.queryExecution().executedPlan().toString(), sum(running)))
            running.pop()
            raise InterruptedError

    monkeypatch.setattr(models, "make_pipeline", lambda *a, **k: Recorded())
    monkeypatch.setattr(models, "TASK_CELLS", 200)
    with pytest.raises(InterruptedError):
        models.cross_validate(signal, FEATURES, SETTINGS["Logistic Regression"], ["id"])
    assert plans and all("Exchange" not in plan and parts > 4 for parts, plan, _ in plans)
    # one fit has tasks for all cores: the folds wait for each other
    assert all(n == 1 for _, _, n in plans)
