"""Filters, column choice and small row selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.fixed import EXPLORER_COLUMNS
from cohortlens.functions.expressions import slug


def only_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns that the table has, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def filter_in(df: DataFrame, choices: dict[str, list]) -> DataFrame:
    """Keep rows whose values are among the choices; an empty choice does not filter."""
    kept = [F.col(c).isin(list(values)) for c, values in choices.items() if values]
    return df.where(reduce(lambda a, b: a & b, kept)) if kept else df


def explore(
    df: DataFrame,
    *,
    results: list[str] | None = None,
    outcome: str = "final_result",
    columns: list[str] = EXPLORER_COLUMNS,
    order: list[str] = ("id_student",),
    n: int = 50,
) -> DataFrame:
    """The first n rows of the chosen outcomes and columns. Here an empty list of outcomes
    keeps nothing, no list keeps all, and an empty list of columns shows all columns."""
    kept = df if results is None else df.where(F.col(outcome).isin(list(results)))
    first = kept.orderBy(*order).limit(n)
    return only_present(first, list(columns)) if columns else first


def top_k(df: DataFrame, measure: str, k: int, ties: list[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(measure), *ties).limit(k)


def best_row(df: DataFrame, measure: str, position: str) -> DataFrame:
    """The row with the largest measure; the lowest position wins a tie."""
    return df.orderBy(F.desc_nulls_last(measure), position).limit(1)


def best_name(df: DataFrame, name: str, measure: str, position: str) -> DataFrame:
    return best_row(df, measure, position).select(slug(name).alias("best_model"))


def distinct_values(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return values.orderBy(column) if ordered else values


def label_positions(df: DataFrame, labels: list[str], name: str = "label") -> DataFrame:
    """A small (label, position) table made inside Spark."""
    lines = [F.struct(F.lit(v).alias(name), F.lit(i).alias("position")) for i, v in enumerate(labels)]
    return df.sparkSession.range(1).select(F.inline(F.array(*lines)))


def in_label_order(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Rows whose label is listed, with the label's position. One row per listed label goes to
    each task, as the list is given by the caller."""
    return df.join(F.broadcast(label_positions(df, labels, column)), column).orderBy("position")
