"""The whole batch as one Spark driver program: prepare, train, report.

Each step reads what the step before has written, so it can also be run on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.fixed import FOLDS, TEST_SHARE
from cohortlens.operators import models
from cohortlens.operators.metrics import classification_report, confusion, roc_points
from cohortlens.operators.sampling import stratified_split
from cohortlens.operators.scale import settle, settled_for_now
from cohortlens.plans.eda import eda_tables
from cohortlens.plans.master import early_warning, eda_extracts, master_table
from cohortlens.plans.pages import ENROLMENT_KEY
from cohortlens.plans.reports import reports
from cohortlens.sources.readers import audit, read_table, read_tables
from cohortlens.sources.sinks import read_names, save_models, write_best, write_names, write_reports, write_table

NEEDED = ["studentInfo", "studentVle", "vle", "studentAssessment", "assessments", "studentRegistration"]


def stored_tables(spark: SparkSession, tables: dict[str, DataFrame | None], out: str) -> dict[str, DataFrame | None]:
    """The tables that are there, written to Parquet once."""
    for name, table in tables.items():
        if table is not None:
            write_table(table, f"{out}/tables/{name}")
    return {
        name: table if table is None else spark.read.schema(table.schema).parquet(f"{out}/tables/{name}")
        for name, table in tables.items()
    }


def prepare(spark: SparkSession, data: str, out: str, fmt: str = "csv", product: bool = False) -> DataFrame:
    """Audit, exploratory tables, feature table, feature list and early-warning table. Text tables
    are parsed once and read from Parquet after that. ``product`` also writes the extract with a row for
    every submission and enrolment of a learner."""
    tables = stored_tables(spark, read_tables(spark, data, fmt), out) if fmt == "csv" else read_tables(spark, data, fmt)
    found = audit(spark, tables)
    write_table(found, f"{out}/audit")
    missing = [name for name in NEEDED if tables[name] is None]
    if missing:
        raise FileNotFoundError(f"these tables are missing: {missing}")
    write_reports(eda_extracts(tables, product), f"{out}/extracts")
    write_reports(eda_tables(tables), f"{out}/eda")
    write_table(master_table(tables), f"{out}/master")
    master = spark.read.parquet(f"{out}/master")
    write_names(spark, models.feature_names(master), f"{out}/features")
    write_table(early_warning(master), f"{out}/early_warning")
    return master


def evaluate(
    spark: SparkSession,
    out: str,
    settings: dict[str, dict] = models.BATCH_MODELS,
    key: list[str] = ENROLMENT_KEY,
    folds: int = FOLDS,
    top: int = 20,
) -> DataFrame:
    """Train on four fifths, evaluate on the rest and by folds, store models and tables."""
    master = spark.read.parquet(f"{out}/master")
    features = read_names(spark, f"{out}/features", master)
    rows, _ = settle(models.model_input(master, features, keep=key))
    split, _ = settle(stratified_split(rows, "label", key, TEST_SHARE))
    test = split.where("is_test")
    fitted = models.train(split.where("NOT is_test"), features, settings)
    by_folds = {name: models.cross_validate(rows, features, s, key, folds) for name, s in settings.items()}
    comparison = models.compare(fitted, test, by_folds)
    for name, model in fitted.items():
        held, _ = settle(models.predict(model, test, ["label"]))
        folder = f"{out}/evaluation/{name}"
        write_reports(
            {"confusion": confusion(held), "classes": classification_report(held), "roc": roc_points(held)}, folder
        )
    best = models.best_model(comparison)
    important = models.importance(spark, fitted[best], features, top)
    if important is not None:
        write_table(important, f"{out}/importance")
    save_models(fitted, f"{out}/models")
    write_best(spark, best, f"{out}/models")
    write_table(models.comparison_text(comparison), f"{out}/comparison")
    return comparison


def export(spark: SparkSession, data: str, out: str, fmt: str = "csv") -> dict[str, str]:
    """The named reports over the stored feature table."""
    master = read_table(spark, f"{out}/master", fmt="parquet", optional=True)
    if master is None:
        raise FileNotFoundError("no feature table: run prepare first")
    stored = read_tables(spark, f"{out}/tables", "table") if fmt == "csv" else read_tables(spark, data, fmt)
    return write_reports(reports(master, stored, one_scan=True), f"{out}/reports")


def run(spark: SparkSession, data: str, out: str, fmt: str = "csv", **options) -> DataFrame:
    """All steps; nothing that they settled in the shared folder stays."""
    with settled_for_now(spark):
        prepare(spark, data, out, fmt)
        comparison = evaluate(spark, out, **options)
        export(spark, data, out, fmt)
    return comparison
