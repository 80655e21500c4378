"""Reports over right-closed bands (lo, hi]. Every band has its row, also an empty one; values
outside all bands are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.fixed import (
    ENGAGEMENT_EDGES,
    ENGAGEMENT_LABELS,
    LATE_EDGES,
    WITHDRAWAL_EDGES,
    WITHDRAWAL_LABELS,
)
from cohortlens.functions.expressions import band_index, number
from cohortlens.operators.select import label_positions


def interval_labels(edges: list[float]) -> list[str]:
    return [f"({lo}, {hi}]" for lo, hi in zip(edges, edges[1:])]


def band_report(
    df: DataFrame,
    column: str | Column,
    edges: list[float],
    labels: list[str],
    columns: dict[str, Column],
    *,
    name: str = "band",
    counts: list[str] = (),
) -> DataFrame:
    """Aggregates per band in band order. ``counts`` names the aggregates that are 0, not NULL,
    for an empty band. The aggregate has at most one row per band, so it is broadcast."""
    found = (
        df.withColumn("position", band_index(column, edges))
        .where(F.col("position").isNotNull())
        .groupBy("position")
        .agg(*[c.alias(n) for n, c in columns.items()])
    )
    bands = label_positions(df, labels, name)
    filled = bands.join(F.broadcast(found), "position", "left").na.fill(0, list(counts))
    return filled.orderBy("position").select(name, *columns)


def engagement_bands(
    master: DataFrame, edges: list[float] = ENGAGEMENT_EDGES, labels: list[str] = ENGAGEMENT_LABELS
) -> DataFrame:
    return band_report(
        master,
        "total_clicks",
        edges,
        labels,
        {"students": F.count("id_student"), "pass_rate": F.avg("target") * 100},
        name="engagement_band",
        counts=["students"],
    )


def withdrawal_timeline(
    registrations: DataFrame,
    *,
    unregistered: str = "date_unregistration",
    edges: list[float] = WITHDRAWAL_EDGES,
    labels: list[str] = WITHDRAWAL_LABELS,
) -> DataFrame:
    return band_report(
        registrations.where(F.col(unregistered).isNotNull()),
        number(unregistered),
        edges,
        labels,
        {"withdrawals": F.count(F.lit(1))},
        name="withdrawal_window",
        counts=["withdrawals"],
    )


def late_bands(master: DataFrame, edges: list[float] = LATE_EDGES) -> DataFrame:
    return band_report(
        master,
        "late_submissions",
        edges,
        interval_labels(edges),
        {"pass_rate": F.avg("target") * 100},
        name="late_band",
    )
