"""Writers: tables, named reports, the feature list, models and the best-model pointer."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        # white space at either end of a cell is part of it
        kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer = writer.options(header=True, escape='"', **kept)
    writer.format(fmt).save(path)


def write_reports(reports: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """One directory per report; gives back where each one lies."""
    paths = {name: f"{folder}/{name}" for name in reports}
    for name, report in reports.items():
        write_table(report, paths[name], fmt)
    return paths


def write_names(spark: SparkSession, names: list[str], path: str) -> None:
    """An ordered list of names as a header-less one-column CSV."""
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    listed.coalesce(1).write.mode("overwrite").option("header", False).csv(path)


def read_names(spark: SparkSession, path: str, present_in: DataFrame | None = None) -> list[str]:
    """The names in file order; with a table given, only those that are columns of it."""
    names = [row[0] for row in spark.read.schema("name string").csv(path).collect()]
    return names if present_in is None else [n for n in names if n in present_in.columns]


def model_slug(name: str) -> str:
    return name.replace(" ", "_").lower()


def save_models(models: dict[str, PipelineModel], folder: str) -> dict[str, str]:
    paths = {name: f"{folder}/{model_slug(name)}" for name in models}
    for name, model in models.items():
        model.write().overwrite().save(paths[name])
    return paths


def write_best(spark: SparkSession, name: str, folder: str) -> None:
    write_names(spark, [model_slug(name)], f"{folder}/best_model")


def load_best(spark: SparkSession, folder: str) -> tuple[str, PipelineModel]:
    name = read_names(spark, f"{folder}/best_model")[0]
    return name, PipelineModel.load(f"{folder}/{name}")
