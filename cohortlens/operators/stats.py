"""Distribution statistics: histograms, quantile trim, box statistics, weighted score statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.expressions import all_present, round_even
from cohortlens.operators.quantile_sketches import quantile_sketches, sketched_quantiles
from cohortlens.operators.scale import attach, attach_settled, quantiles, settle, settled_quantiles
from cohortlens.operators.summaries import enrolment_counts

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def histogram(
    df: DataFrame,
    column: str,
    bins: int,
    *,
    by: list[str] = (),
    shared_range: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed, empty ones included.

    The range is taken per group, or over all groups with ``shared_range``. A range of width 0
    is widened by one half on both sides. One row per (group, bin): bin, lo, hi, count."""
    by = list(by)
    rows = df.where(all_present([*by, column])).withColumn("_x", F.col(column).cast("double"))
    extremes = [F.min("_x").alias("_min"), F.max("_x").alias("_max")]
    if shared_range and by:
        span = rows.agg(F.struct(*extremes)).scalar()
        ranges = rows.select(*by).distinct().withColumn("_span", span).select(*by, "_span.*")
    else:
        ranges = rows.groupBy(*by).agg(*extremes)
    half = F.when(F.col("_min") == F.col("_max"), F.lit(0.5)).otherwise(F.lit(0.0))
    ranges, n = settle(
        ranges.where(F.col("_min").isNotNull()).select(
            *by, (F.col("_min") - half).alias("_min"), (F.col("_max") + half).alias("_max")
        )
    )

    step = (F.col("_max") - F.col("_min")) / bins

    def lower(i):
        return F.when(i == bins, F.col("_max")).otherwise(F.col("_min") + i * step)

    if by:
        placed = attach_settled(rows, ranges, n, by)
    else:
        span = ranges.select(F.struct("_min", "_max")).scalar()
        placed = rows.withColumn("_span", span).select("*", "_span.*")
    # The quotient may miss by one at an edge; the edges themselves decide.
    guess = F.least(F.floor((F.col("_x") - F.col("_min")) / step), F.lit(bins - 1))
    placed = placed.withColumn("_guess", guess)
    index = (
        F.when(F.col("_x") < lower(F.col("_guess")), F.col("_guess") - 1)
        .when(
            (F.col("_guess") < bins - 1) & (F.col("_x") >= lower(F.col("_guess") + 1)),
            F.col("_guess") + 1,
        )
        .otherwise(F.col("_guess"))
    )
    total = F.sum(weight) if weight else F.count(F.lit(1))
    counts = placed.groupBy(*by, index.cast("int").alias("bin")).agg(total.alias("count"))
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    i = F.col("bin")
    return frame.join(counts, [*by, "bin"], "left").select(
        *by, "bin", lower(i).alias("lo"), lower(i + 1).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def _points(df: DataFrame, by: list[str], column: str, points: dict[str, float], sketch: int | None) -> DataFrame:
    """Exact quantiles, or those of rank sketches of the given size."""
    if sketch is None:
        return quantiles(df, by, column, points)
    return sketched_quantiles(quantile_sketches(df, by, column, sketch), by, points, sketch)


def trim_quantile(df: DataFrame, column: str, q: float, sketch: int | None = None) -> DataFrame:
    """Rows strictly below the q-quantile of the column. With ``sketch`` the quantile is that of a rank sketch
    of this size, within ``rank_error_bound(sketch)`` of q, settled so that a rerun keeps the same rows."""
    found = _points(df, [], column, {"bound": q}, sketch)
    bound = (found if sketch is None else settle(found)[0]).scalar()
    return df.where(F.col(column) < bound)


def box_stats(df: DataFrame, by: str, column: str, sketch: int | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 interquartile ranges) and outliers. With ``sketch`` the
    quartiles are those of rank sketches of this size; counts, whiskers and outliers are exact for them."""
    rows = df.where(all_present([by, column])).select(by, F.col(column).cast("double").alias("_x"))
    placed = attach(rows, _points(rows, [by], "_x", QUARTILES, sketch), [by])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    x, inside_low, inside_high = F.col("_x"), F.col("q1") - reach, F.col("q3") + reach
    return placed.groupBy(by).agg(
        F.count(F.lit(1)).alias("count"),
        *[F.first(name).alias(name) for name in QUARTILES],
        F.min(F.when(x >= inside_low, x)).alias("whisker_low"),
        F.max(F.when(x <= inside_high, x)).alias("whisker_high"),
        F.count_if((x < inside_low) | (x > inside_high)).alias("outliers"),
    )


def enrolment_score_counts(
    scored: DataFrame,
    enrolments: DataFrame,
    *,
    key: str = "id_student",
    kind: str = "assessment_type",
    outcome: str = "final_result",
    score: str = "score",
) -> DataFrame:
    """How often each score occurs per (kind, outcome) when a learner's scores count once per
    enrolment. Equal scores of a learner and equal outcomes of a learner are counted before
    they meet, so the join does not emit their pairs."""
    left = (
        scored.where(all_present([key, kind]))
        .groupBy(key, kind, score)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    right = enrolment_counts(enrolments, key, outcome)
    return (
        left.join(right, key)
        .groupBy(kind, outcome, score)
        .agg(F.sum(F.col("_n") * F.col("_times")).alias("times"))
    )


def assessment_performance(
    scored: DataFrame,
    enrolments: DataFrame,
    *,
    key: str = "id_student",
    kind: str = "assessment_type",
    outcome: str = "final_result",
    score: str = "score",
    digits: int = 2,
) -> DataFrame:
    """Count, mean, median and deviation of scores per assessment type and outcome."""
    by = [kind, outcome]
    counted, n = settle(
        enrolment_score_counts(
            scored, enrolments, key=key, kind=kind, outcome=outcome, score=score
        )
    )
    times = F.when(F.col(score).isNotNull(), F.col("times"))
    centre = counted.groupBy(*by).agg(
        F.coalesce(F.sum(times), F.lit(0)).alias("count"),
        F.try_divide(F.sum(F.col(score) * times), F.sum(times)).alias("mean"),
    )
    median = settled_quantiles(counted, n, by, score, "times", {"median": 0.5})
    off = F.col(score) - F.col("mean")
    placed = attach(counted, centre.join(median, by, "left"), by)
    spread = placed.groupBy(*by).agg(
        F.first("count").alias("count"),
        F.first("mean").alias("mean"),
        F.first("median").alias("median"),
        F.sqrt(
            F.sum(off * off * times) / F.when(F.first("count") > 1, F.first("count") - 1)
        ).alias("std"),
    )
    return spread.select(
        *by, "count", *[round_even(c, digits).alias(c) for c in ("mean", "median", "std")]
    )
