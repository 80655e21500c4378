"""Counts, cross-tabs, rates, series, hierarchies and key figures.

Grouping ignores rows whose key is NULL unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.fixed import AT_RISK, EARLY_DAY, PASSING, RESULT_COLUMNS
from cohortlens.functions.expressions import (
    all_present,
    fixed_text,
    flag,
    is_one_of,
    number,
    percent,
    percent_text,
    round_even,
    thousands_text,
)
from cohortlens.operators.select import in_label_order

#: Columns that a cross-tab makes of values found in the data, at most.
MOST_COLUMNS = 1000


def value_counts(df: DataFrame, column: str, share: bool = False) -> DataFrame:
    """Rows per value, most frequent first; with ``share`` also the part of all rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if share:
        total = counts.agg(F.sum("count")).scalar()
        counts = counts.withColumn("share", F.col("count") / total)
    return counts.orderBy(F.desc("count"), column)


def crosstab(
    df: DataFrame,
    row: str,
    column: str,
    values: list[str] | None = RESULT_COLUMNS,
    normalize: bool = False,
) -> DataFrame:
    """Counts of (row, column) with one output column per column value, or row percentages.

    With ``values`` None the values are read from the data, one output column for each; beyond ``MOST_COLUMNS``
    of them that is an error, and ``crosstab_cells`` gives any number of them as rows. Percentages divide by all rows
    that have both keys, so a value that is not listed still counts towards the row total."""
    pairs = df.where(all_present([row, column]))
    if values is None:
        values = sorted(r[0] for r in pairs.select(column).distinct().limit(MOST_COLUMNS + 1).collect())
        if len(values) > MOST_COLUMNS:
            raise ValueError(f"{column} has more than {MOST_COLUMNS} values: name them, or use crosstab_cells")
    cells = pairs.groupBy(row).agg(
        *[F.count_if(F.col(column) == v).alias(str(v)) for v in values],
        F.count(F.lit(1)).alias("_all"),
    )
    if normalize:
        cells = cells.select(
            row, *[percent(F.col(f"`{v}`"), "_all").alias(str(v)) for v in values]
        )
    return cells.drop("_all")


def crosstab_cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """The cells of a cross-tab that have rows, in long form, however many values there are."""
    pairs = df.where(all_present([row, column]))
    return pairs.groupBy(row, column).agg(F.count(F.lit(1)).alias("value"))


def melt_crosstab(df: DataFrame, row: str, column: str, values: list[str] = RESULT_COLUMNS) -> DataFrame:
    """The cross-tab in long form; cells without rows are there with 0."""
    wide = crosstab(df, row, column, values)
    return wide.unpivot([row], [str(v) for v in values], column, "value")


def pass_percent_in_order(
    df: DataFrame, row: str, column: str, order: list[str], passing: list[str] = PASSING
) -> DataFrame:
    """Sum of the passing columns of the row percentages, for the listed rows in list order."""
    wide = crosstab(df, row, column, passing, normalize=True)
    passed = sum((F.col(v) for v in passing), F.lit(0.0))
    return in_label_order(wide.select(row, passed.alias("pass_pct")), row, order)


def success_rate(
    df: DataFrame,
    by: str,
    *,
    outcome: str = "final_result",
    positive: list[str] = PASSING,
    target: str = "target",
    null_as_fail: bool = True,
    digits: int | None = None,
    name: str = "rate",
) -> DataFrame:
    """Percentage of passes per group. ``null_as_fail`` counts rows without a known outcome as
    not passed; otherwise the mean of the target leaves them out."""
    measure = is_one_of(outcome, positive) if null_as_fail else F.col(target)
    rate = F.avg(measure) * 100
    if digits is not None:
        rate = round_even(rate, digits)
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(rate.alias(name))


def rate_gap(rates: DataFrame, name: str = "rate") -> DataFrame:
    """Highest, lowest and difference of a table of rates."""
    return rates.agg(F.max(name).alias("highest"), F.min(name).alias("lowest")).withColumn(
        "gap", F.col("highest") - F.col("lowest")
    )


def mean_by(df: DataFrame, by: str, measure: str, digits: int | None = None) -> DataFrame:
    """Mean of a measure per group, highest first."""
    mean = F.avg(measure)
    grouped = df.where(F.col(by).isNotNull()).groupBy(by).agg(mean.alias("mean"))
    if digits is not None:
        grouped = grouped.withColumn("mean", round_even("mean", digits))
    return grouped.orderBy(F.desc_nulls_last("mean"), by)


def enrolment_mean(
    measures: DataFrame,
    enrolments: DataFrame,
    measure: str,
    *,
    key: str = "id_student",
    by: str = "final_result",
    digits: int | None = None,
) -> DataFrame:
    """Mean of a per-learner measure per outcome, each row counted once per enrolment of its
    learner. Both sides shrink to sums and counts per learner before they meet, so the join
    never emits the (row, enrolment) pairs it stands for."""
    left = (
        measures.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum(F.col(measure).cast("double")).alias("_sum"), F.count(measure).alias("_n"))
    )
    right = enrolment_counts(enrolments, key, by)
    mean = F.try_divide(F.sum(F.col("_sum") * F.col("_times")), F.sum(F.col("_n") * F.col("_times")))
    grouped = left.join(right, key).groupBy(by).agg(mean.alias("mean"))
    if digits is not None:
        grouped = grouped.withColumn("mean", round_even("mean", digits))
    return grouped.orderBy(F.desc_nulls_last("mean"), by)


def enrolment_counts(enrolments: DataFrame, key: str, by: str) -> DataFrame:
    """How many enrolments of each outcome a learner has: (key, by, _times)."""
    return (
        enrolments.where(all_present([key, by]))
        .groupBy(key, by)
        .agg(F.count(F.lit(1)).alias("_times"))
    )


def withdrawal_counts(
    registrations: DataFrame, *, unregistered: str = "date_unregistration", early: int = EARLY_DAY
) -> DataFrame:
    return registrations.agg(
        F.count(unregistered).alias("withdrawals"),
        F.count_if(number(unregistered) <= early).alias("early_withdrawals"),
    )


def daily_series(
    events: DataFrame,
    *,
    day: str = "date",
    measure: str = "sum_click",
    entity: str | None = None,
    name: str = "clicks",
) -> DataFrame:
    """Sum of the measure per day, in day order; with ``entity`` also its distinct count."""
    columns = [F.coalesce(F.sum(measure), F.lit(0)).alias(name)]
    if entity is not None:
        columns.append(F.count_distinct(entity).alias("unique_students"))
    return events.where(F.col(day).isNotNull()).groupBy(day).agg(*columns).orderBy(day)


def hierarchy_counts(df: DataFrame, levels: list[str]) -> DataFrame:
    """Counts of every node of the level hierarchy, with its depth (1 = top level). The leaves
    are counted first, so that only their counts are rolled up."""
    leaves = df.where(all_present(levels)).groupBy(*levels).agg(F.count(F.lit(1)).alias("_n"))
    n = len(levels)
    depth = F.lit(n) - F.bit_count(F.grouping_id())
    return (
        leaves.rollup(*levels)
        .agg(F.sum("_n").alias("count"), depth.cast("int").alias("depth"))
        .where(F.col("depth") > 0)
        .select(*levels, "depth", "count")
    )


def group_report(df: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """One row per group with the given aggregates."""
    return (
        df.where(all_present(by))
        .groupBy(*by)
        .agg(*[column.alias(name) for name, column in columns.items()])
    )


def result_summary(df: DataFrame, by: list[str], outcome: str = "final_result") -> DataFrame:
    """Cell counts over demographics and outcome, with a pass flag."""
    cells = group_report(df, [*by, outcome], {"count": F.count(F.lit(1))})
    return cells.withColumn("pass_flag", is_one_of(outcome, PASSING))


def module_performance(master: DataFrame, by: list[str] = ("code_module", "code_presentation")) -> DataFrame:
    withdrawn = F.sum("withdrew") if "withdrew" in master.columns else F.count("target")
    report = group_report(
        master,
        list(by),
        {
            "total_students": F.count("id_student"),
            "pass_count": F.coalesce(F.sum("target"), F.lit(0)),
            "avg_clicks": F.avg("total_clicks"),
            "avg_score": F.avg("avg_assessment_score"),
            "withdrawal_count": F.coalesce(withdrawn, F.lit(0)),
        },
    )
    return report.withColumn("pass_rate_pct", round_even(percent("pass_count", "total_students"), 1))


def deprivation_report(master: DataFrame, by: str = "imd_band") -> DataFrame:
    return group_report(
        master,
        [by],
        {
            "students": F.count("id_student"),
            "pass_rate": F.avg("target") * 100,
            "avg_clicks": F.avg("total_clicks"),
            "avg_score": F.avg("avg_assessment_score"),
        },
    )


def kpi_report(master: DataFrame) -> DataFrame:
    """Seven key figures in one row; the withdrawal rate is text where it cannot be known."""
    if "withdrew" in master.columns:
        withdrawal = round_even(F.avg("withdrew") * 100, 1)
    else:
        withdrawal = F.first(F.lit("N/A"))
    return master.agg(
        F.count(F.lit(1)).alias("Total Students"),
        round_even(F.avg("target") * 100, 1).alias("Pass Rate (%)"),
        round_even(F.avg("total_clicks"), 0).alias("Avg VLE Clicks"),
        round_even(F.avg("avg_assessment_score"), 1).alias("Avg Assessment Score"),
        withdrawal.alias("Withdrawal Rate (%)"),
        F.count_if(F.col("final_result") == "Distinction").alias("Distinction Count"),
        F.count_if(F.col("final_result").isin(AT_RISK)).alias("At Risk (Fail+Withdraw)"),
    )


def kpi_strip(df: DataFrame) -> DataFrame:
    """Six key figures of the filtered rows; a figure whose column is missing is NULL."""

    def mean(column: str, factor: int = 1) -> Column:
        if column not in df.columns:
            return F.first(F.lit(None).cast("double"))
        return F.avg(column) * factor

    return df.agg(
        F.count(F.lit(1)).alias("students"),
        (F.avg(flag(F.col("target") == 1)) * 100).alias("pass_rate"),
        mean("total_clicks").alias("avg_clicks"),
        mean("avg_assessment_score").alias("avg_score"),
        mean("active_days").alias("active_days"),
        mean("withdrew", 100).alias("withdrawal_rate"),
    )


def kpi_strip_text(df: DataFrame) -> DataFrame:
    """The key figures as display text; a missing figure is a dash."""
    texts = {
        "students": thousands_text("students"),
        "pass_rate": percent_text("pass_rate"),
        "avg_clicks": thousands_text("avg_clicks"),
        "avg_score": fixed_text("avg_score", 1),
        "active_days": fixed_text("active_days", 0),
        "withdrawal_rate": percent_text("withdrawal_rate"),
    }
    return kpi_strip(df).select(
        *[F.when(F.col(c).isNull(), F.lit("—")).otherwise(text).alias(c) for c, text in texts.items()]
    )


def low_engagement_dropout(
    master: DataFrame, *, clicks: str = "clicks_day30", below: float = 200, label: str = "Withdrawn"
) -> DataFrame:
    """Learners below a click count and the percentage of them that withdrew."""
    return master.where(F.col(clicks) < below).agg(
        F.count(F.lit(1)).alias("students"),
        (F.avg(flag(F.col("final_result") == label)) * 100).alias("withdrawn_pct"),
    )
