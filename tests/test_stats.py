import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import metrics, sampling, scale, stats, summaries

VALUES = [1.0, 2.0, 3.0, 10.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """Two groups; one value holds a third of the rows."""
    return spark.range(3000).select(
        (F.col("id") % 2).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0))
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(100000)) / 100.0)
        .alias("x"),
    )


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_quantile_by_hand(spark, rows, limit):
    given = spark.createDataFrame([(v,) for v in VALUES], "x double")
    made = rows(scale.quantiles(given, [], "x", {"a": 0.99, "b": 0.5}, limit=limit))
    assert made[0]["a"] == pytest.approx(9.79) and made[0]["b"] == 2.5


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_quantiles_agree_with_numpy(spark, rows, skewed, limit):
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75, "top": 0.98}
    made = rows(scale.quantiles(skewed, ["g"], "x", points, limit=limit), "g")
    data = skewed.toPandas()
    for row in made:
        group = data[data["g"] == row["g"]]["x"]
        for name, q in points.items():
            assert row[name] == pytest.approx(np.quantile(group, q))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_weighted_quantile_equals_repeated_values(spark, rows, limit):
    given = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 4)], "x double, w int")
    made = rows(scale.settled_quantiles(given, 3, [], "x", "w", {"m": 0.5, "q": 0.6}, limit=limit))[0]
    repeated = [1.0] * 5 + [2.0] + [9.0] * 4
    assert made["m"] == pytest.approx(np.quantile(repeated, 0.5))
    assert made["q"] == pytest.approx(np.quantile(repeated, 0.6))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_running_totals(spark, limit):
    given = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("n"))
    made = scale.running_totals(given, ["g"], "id", ["n"], limit).toPandas().sort_values("id")
    assert (made.groupby("g")["n"].cumsum() == made["n_upto"]).all()
    assert (made.groupby("g")["n"].transform("sum") == made["n_all"]).all()


@pytest.mark.parametrize("min_rows", [100, 10**9])
def test_salted_join_equals_plain_join(spark, min_rows):
    """A third of the rows has one key, some have none."""
    left = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 != 0, F.col("id") % 100).alias("k"), "id"
    )
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"))
    two = spark.range(20, 90).select(F.col("id").alias("k"), (F.col("id") * 3).alias("b"))
    made = scale.salted_left_join(left, [one, two], ["k"], rows_per_task=min_rows)
    plain = left.join(one, "k", "left").join(two, "k", "left")
    assert made.count() == 2000
    assert made.exceptAll(plain).count() == 0 and plain.exceptAll(made).count() == 0


def test_hot_keys_are_few(spark):
    given = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    assert [r["k"] for r in scale.hot_keys(given, ["k"], rows_per_task=10).collect()] == [1]


def test_attach_beyond_the_limit(spark, rows):
    left = spark.range(100).select((F.col("id") % 10).alias("k"))
    lookup = spark.range(8).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    for limit in (100, 0):
        assert scale.attach(left, lookup, ["k"], limit).agg(F.count("v").alias("n")).first()["n"] == 80


def test_histogram_by_hand(spark, rows):
    given = spark.createDataFrame([(float(v),) for v in range(1, 6)], "x double")
    assert [r["count"] for r in rows(stats.histogram(given, "x", 2), "bin")] == [2, 3]


@pytest.mark.parametrize("bins", [7, 30, 50])
def test_histogram_agrees_with_numpy(spark, rows, skewed, bins):
    made = rows(stats.histogram(skewed, "x", bins, by=["g"]), "g", "bin")
    data = skewed.toPandas()
    for g in (0, 1):
        counts, edges = np.histogram(data[data["g"] == g]["x"], bins)
        lines = [r for r in made if r["g"] == g]
        assert [r["count"] for r in lines] == list(counts)
        assert np.allclose([r["lo"] for r in lines], edges[:-1])


def test_histogram_on_edges(spark, rows):
    given = spark.createDataFrame([(i / 10.0,) for i in range(31)], "x double")
    counts, _ = np.histogram([i / 10.0 for i in range(31)], 30)
    assert [r["count"] for r in rows(stats.histogram(given, "x", 30), "bin")] == list(counts)


def test_histogram_of_one_value(spark, rows):
    given = spark.createDataFrame([(3.0,)] * 3, "x double")
    made = rows(stats.histogram(given, "x", 4), "bin")
    assert [r["count"] for r in made] == [0, 0, 3, 0] and made[0]["lo"] == 2.5


def test_shared_range(spark, rows):
    given = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 10.0)], "g string, x double")
    made = rows(stats.histogram(given, "x", 2, by=["g"], shared_range=True), "g", "bin")
    assert [(r["g"], r["count"]) for r in made] == [("a", 2), ("a", 0), ("b", 0), ("b", 1)]


def test_trim_is_strict(spark, rows):
    given = spark.createDataFrame([(v,) for v in [1.0, 2.0, 2.0, 2.0]], "x double")
    assert stats.trim_quantile(given, "x", 0.99).count() == 1


def test_box(spark, rows):
    data = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    given = spark.createDataFrame([("a", v) for v in data] + [(None, 1.0)], "g string, x double")
    assert rows(stats.box_stats(given, "g", "x")) == [
        {"g": "a", "count": 6, "q1": 2.25, "median": 3.5, "q3": 4.75,
         "whisker_low": 1.0, "whisker_high": 5.0, "outliers": 1}
    ]


def test_assessment_performance(spark, rows):
    scored = spark.createDataFrame(
        [(1, "TMA", 50.0), (1, "TMA", 60.0), (1, "TMA", None), (2, "TMA", 90.0), (2, "Exam", 10.0), (3, None, 5.0)],
        "id_student int, assessment_type string, score double",
    )
    info = spark.createDataFrame(
        [(1, "Pass"), (1, "Pass"), (2, "Pass"), (2, "Fail")], "id_student int, final_result string"
    )
    made = {(r["assessment_type"], r["final_result"]): r for r in rows(stats.assessment_performance(scored, info))}
    repeated = [50.0, 60.0, 50.0, 60.0, 90.0]
    passed = made["TMA", "Pass"]
    assert passed["count"] == 5 and passed["mean"] == 62.0 and passed["median"] == 60.0
    assert passed["std"] == pytest.approx(np.round(np.std(repeated, ddof=1), 2))
    # One observation has no deviation.
    assert made["Exam", "Fail"]["count"] == 1 and made["Exam", "Fail"]["std"] is None
    assert len(made) == 4


def test_sample_has_exactly_n_rows_and_repeats(spark):
    given = spark.range(5000)
    first = {r["id"] for r in sampling.sample_n(given, 700, key=["id"]).collect()}
    again = {r["id"] for r in sampling.sample_n(given.repartition(3), 700, key=["id"]).collect()}
    assert len(first) == 700 and first == again
    assert sampling.sample_n(given, 9999, key=["id"]).count() == 5000


def test_entity_sample(spark):
    one = spark.range(300).select((F.col("id") % 30).alias("id_student"))
    two = spark.range(60).select((F.col("id") % 60).alias("id_student"))
    a, b = sampling.sample_entities([one, two], n=7)
    assert a.count() == 70 and a.distinct().count() == 7 and b.count() == 7


def test_split_is_stratified_and_exhaustive(spark, rows):
    given = spark.range(1003).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    made = sampling.stratified_split(given, "label", ["id"]).cache()
    assert made.count() == 1003 and made.select("id").distinct().count() == 1003
    for row in rows(made.groupBy("label").agg(F.count("id").alias("n"), F.count_if("is_test").alias("t"))):
        assert abs(row["t"] - row["n"] * 0.2) <= 1


def test_folds_are_even(spark, rows):
    given = spark.range(1003).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    made = rows(sampling.stratified_folds(given, "label", ["id"]).groupBy("label", "fold").count())
    assert len(made) == 10
    for label in (0, 1):
        sizes = [r["count"] for r in made if r["label"] == label]
        assert max(sizes) - min(sizes) <= 1


@pytest.fixture(scope="module")
def scored(spark):
    return spark.range(400).select(
        (F.pmod(F.xxhash64("id"), F.lit(10)) < 4).cast("int").alias("label"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) / 50.0).alias("score"),
    ).withColumn("prediction", (F.col("score") > 0.5).cast("int"))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_auc_equals_the_trapezoids(spark, rows, scored, limit):
    area = rows(metrics.auc(scored, limit=limit))[0]["auc"]
    data = scored.toPandas()
    pos, neg = data[data.label == 1].score.values, data[data.label == 0].score.values
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert area == pytest.approx(wins / (len(pos) * len(neg)))
    points = sorted((r["fpr"], r["tpr"]) for r in rows(metrics.roc_points(scored, limit=limit)))
    trapezoids = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(trapezoids)
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)


def test_constant_score(spark, rows):
    given = spark.createDataFrame([(0, 0.3), (1, 0.3), (1, 0.3)], "label int, score double")
    assert rows(metrics.auc(given))[0]["auc"] == 0.5
    assert sorted((r["fpr"], r["tpr"]) for r in rows(metrics.roc_points(given))) == [(0.0, 0.0), (1.0, 1.0)]


def test_one_class_has_no_area(spark, rows):
    given = spark.createDataFrame([(1, 0.3), (1, 0.4)], "label int, score double")
    assert rows(metrics.auc(given))[0]["auc"] is None


def test_binned_scores(spark, scored):
    assert metrics.roc_points(scored, digits=1).count() <= 12


def test_confusion_keeps_empty_cells(spark, rows):
    given = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    assert [r["count"] for r in rows(metrics.confusion(given), "label", "prediction")] == [2, 0, 1, 0]


def test_class_report(spark, rows):
    given = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    made = {r["class"]: r for r in rows(metrics.classification_report(given))}
    assert made["Fail/Withdraw"]["precision"] == pytest.approx(2 / 3) and made["Fail/Withdraw"]["recall"] == 1.0
    assert (made["Pass"]["precision"], made["Pass"]["recall"], made["Pass"]["f1"]) == (0.0, 0.0, 0.0)
    assert made["accuracy"]["f1"] == pytest.approx(2 / 3) and made["macro avg"]["f1"] == pytest.approx(0.4)
    assert made["weighted avg"]["recall"] == pytest.approx(2 / 3) and made["weighted avg"]["support"] == 3


def test_quantiles_are_equal_to_the_last_bit_at_every_size(spark):
    given = spark.range(100_000).select((F.col("id") % 7).alias("g"), (F.xxhash64("id") / 1e15).alias("x"))
    points = {f"p{i}": i / 23 for i in range(24)}
    few, many = (scale.quantiles(given, ["g"], "x", points, limit=limit).orderBy("g").collect() for limit in (10**9, 0))
    assert few == many


def test_hot_keys_get_tasks_by_their_rows(spark):
    given = spark.range(10_000).select(F.when(F.col("id") < 50, 1).when(F.col("id") < 1050, 2).otherwise(F.col("id")).alias("k"))
    found = {r["k"]: r["_salts"] for r in scale.hot_keys(given, ["k"], rows_per_task=20).collect()}
    assert found == {1: 3, 2: 50}


def test_cells_of_a_cross_tab_of_many_values(spark):
    given = spark.range(20_002).select(F.lit("a").alias("r"), (F.col("id") % 10_001).alias("c"))
    cells = summaries.crosstab_cells(given, "r", "c")
    assert cells.count() == 10_001 and cells.agg(F.sum("value").alias("n")).first()["n"] == 20_002
