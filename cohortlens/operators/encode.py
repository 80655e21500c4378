"""Integer codes of categorical columns, and the statistics of standard scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.scale import (
    WINDOW_ROWS,
    salted_left_join,
    settle,
    settled_running_totals,
)

# Codes of a column may be broadcast up to this size; a value counts its bytes and this many more.
BROADCAST_BYTES = 8_000_000
CODE_BYTES = 32


def category_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (column, value) pairs of all the columns, found in one pass."""
    cells = ", ".join(f"struct('{c}' AS column, CAST(`{c}` AS STRING) AS value)" for c in columns)
    found = df.selectExpr(f"inline(array({cells}))").where("value IS NOT NULL").distinct()
    return found.withColumn("one", F.lit(1))


def rank_encode(
    df: DataFrame,
    columns: list[str],
    *,
    suffix: str = "_enc",
    values_from: DataFrame | None = None,
    limit: int = BROADCAST_BYTES,
    window_limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``<column>_enc``, the position of the text among the sorted distinct ones; NULL gets
    -1. A column whose values measure at most ``limit`` bytes is joined by broadcast. ``values_from`` may name a cheaper table that holds the same values, such as the one
    the feature joins started from."""
    source = values_from if values_from is not None else df
    values, n = settle(category_values(source, columns))
    codes = settled_running_totals(values, n, ["column"], "value", ["one"], window_limit)
    # one line per column to be coded
    sizes = dict(values.groupBy("column").agg(F.sum(F.octet_length("value") + CODE_BYTES)).collect())
    order = df.columns + [f"{c}{suffix}" for c in columns]
    for c in columns:
        lookup = codes.where(F.col("column") == c).selectExpr(
            f"value AS `{c}`", f"CAST(one_upto - 1 AS INT) AS `{c}{suffix}`"
        )
        if sizes.get(c, 0) <= limit:
            df = df.join(F.broadcast(lookup), c, "left")
        else:
            df = salted_left_join(df, [lookup], [c])
    return df.na.fill(-1, [f"{c}{suffix}" for c in columns]).select(*order)


def scale_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std): centre and population deviation of each column, in one pass."""
    stats = df.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]
    )
    lines = [
        F.struct(F.lit(c).alias("column"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std"))
        for c in columns
    ]
    return stats.select(F.inline(F.array(*lines)))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centre and divide by the population deviation (a constant column is only centred)."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
        )
    ).scalar()
    scaled = df.withColumn("_stats", stats)
    for c in columns:
        std = F.col("_stats")[f"{c}_std"]
        centred = F.col(c) - F.col("_stats")[f"{c}_mean"]
        scaled = scaled.withColumn(c, centred / F.when(std > 0, std).otherwise(1.0))
    return scaled.drop("_stats")
