"""Per-learner features from the activity log, the submissions and the registrations.

Each builder returns one row per key. Sums, counts, extremes and deviations combine on the
map side, so a key with very many rows reaches its reducer as a few partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.fixed import CATEGORIES, DAY_CUTOFFS, EARLY_DAY, NEVER_WITHDREW, RESULT_CODES, SCORE_KINDS
from cohortlens.functions.expressions import flag, label_code, number
from cohortlens.operators.as_of import bits_of, cells, click_cells, deviation, total_of, with_mean
from cohortlens.operators.encode import rank_encode
from cohortlens.operators.scale import salted_left_join


def click_features(
    clicks: DataFrame,
    sites: DataFrame | None = None,
    *,
    key: str = "id_student",
    site: str = "id_site",
    day: str = "date",
    measure: str = "sum_click",
    activity: str = "activity_type",
    cutoffs: tuple[int, ...] = DAY_CUTOFFS,
) -> DataFrame:
    """Totals, active days, totals up to each cut-off day, deviation, activity types, last day.

    The log is read once and exchanged once, as cells of 64 days (``operators.as_of``): distinct days and
    types are bits of whole numbers there. With more types than words of bits hold, they are counted on their own."""
    cuts = tuple(sorted(set(cutoffs)))
    made = click_cells(clicks, sites, key=key, site=site, day=day, measure=measure, activity=activity, cutoffs=cuts)
    held, n_words = made if made is not None else (cells(clicks, key, day, cuts, measure), 0)
    entries = F.col("cells")
    # whole numbers stay whole
    kind = "long" if clicks.schema[measure].dataType.typeName() in ("byte", "short", "integer", "long") else "double"

    def up_to(d: int) -> Column:
        return total_of(F.filter(entries, lambda x: x["slot"] <= cuts.index(d)), lambda x: x["total"], kind)

    types = sum([bits_of(entries, f"word{i}") for i in range(n_words)], F.lit(0)).cast("long").alias("unique_activity_types")
    features = with_mean(held).select(
        F.col("_key").alias(key),
        total_of(entries, lambda x: x["total"], kind).alias("total_clicks"),
        total_of(entries, lambda x: F.bit_count(x["days"])).alias("active_days"),
        *[up_to(d).alias(f"clicks_day{d}") for d in cutoffs],
        deviation(entries).alias("click_std"),
        *([types] if sites is not None and made is not None else []),
        F.array_max(F.transform(entries, lambda x: x["last"])).alias("last_active_day"),
    )
    if made is None:
        found = activity_types(clicks, sites, key=key, site=site, activity=activity)
        last = features.columns[-1]
        features = features.join(found, key, "left").select(*features.columns[:-1], "unique_activity_types", last)
    return features


def active_days(clicks: DataFrame, *, key: str = "id_student", day: str = "date") -> DataFrame:
    """Distinct days with activity per key."""
    days = clicks.where(F.col(key).isNotNull()).select(key, day).distinct()
    return days.groupBy(key).agg(F.count(day).alias("active_days"))


def activity_types(
    clicks: DataFrame,
    sites: DataFrame,
    *,
    key: str = "id_student",
    site: str = "id_site",
    activity: str = "activity_type",
) -> DataFrame:
    """Distinct activity types per key. (key, site) pairs are made distinct before the join,
    so that a busy site joins once per learner, not once per event."""
    visited = clicks.where(F.col(key).isNotNull()).select(key, site).distinct()
    return (
        visited.join(sites.select(site, activity), site, "left")
        .groupBy(key)
        .agg(F.count_distinct(activity).alias("unique_activity_types"))
    )


def score_features(
    submissions: DataFrame,
    assessments: DataFrame,
    *,
    key: str = "id_student",
    item: str = "id_assessment",
    score: str = "score",
    submitted: str = "date_submitted",
    due: str = "date",
    kind: str = "assessment_type",
    kinds: dict[str, str] = SCORE_KINDS,
) -> DataFrame:
    """Mean and deviation of scores, submissions, mean per assessment type, late submissions."""
    marked = with_assessment(submissions, assessments, item=item, columns=[kind, due])
    if submitted in marked.columns and due in marked.columns:
        late = F.sum(flag(F.col(submitted) > F.col(due)).cast("long"))
    else:
        late = F.first(F.lit(0).cast("long"))
    return (
        marked.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.avg(score).alias("avg_assessment_score"),
            F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("score_std"),
            F.count(item).alias("num_assessments_submitted"),
            *[
                F.avg(F.when(F.col(kind) == value, F.col(score))).alias(name)
                for name, value in kinds.items()
            ],
            late.alias("late_submissions"),
        )
    )


def with_assessment(
    submissions: DataFrame,
    assessments: DataFrame,
    *,
    item: str = "id_assessment",
    columns: list[str] = ("assessment_type", "weight"),
) -> DataFrame:
    """Submissions with attributes of their assessment. No hint: Spark broadcasts the dimension
    if its files are small enough; otherwise AQE splits a hot item of this left join."""
    wanted = [c for c in columns if c in assessments.columns]
    return submissions.join(assessments.select(item, *wanted), item, "left")


def registration_features(
    registrations: DataFrame,
    *,
    key: str = "id_student",
    period: str = "code_presentation",
    registered: str = "date_registration",
    unregistered: str = "date_unregistration",
    early: int = EARLY_DAY,
    never: int = NEVER_WITHDREW,
) -> DataFrame:
    """Registrations, whether and when the learner withdrew, early and late flags."""
    day = number(unregistered, never)
    return (
        registrations.where(F.col(key).isNotNull())
        .select(
            key,
            period,
            F.col(unregistered).isNotNull().cast("int").alias("withdrew"),
            day.alias("withdrawal_day"),
            flag(day <= early).alias("early_withdraw"),
            flag(number(registered) > 0).alias("registered_late"),
        )
        .groupBy(key)
        .agg(
            F.count(period).alias("num_modules_registered"),
            F.max("withdrew").alias("withdrew"),
            F.min("withdrawal_day").alias("withdrawal_day"),
            F.max("early_withdraw").alias("early_withdraw"),
            F.max("registered_late").alias("registered_late"),
        )
    )


def fill_numbers(df: DataFrame) -> DataFrame:
    """0 for NULL in every numeric column."""
    return df.na.fill(0)


def join_features(
    enrolments: DataFrame,
    features: list[DataFrame],
    *,
    key: str = "id_student",
    outcome: str = "final_result",
    codes: dict[str, int] = RESULT_CODES,
) -> DataFrame:
    """One row per enrolment: its own columns, the learner's features (0 where there are none)
    and the target code of the outcome, which stays NULL for an unknown label."""
    joined = fill_numbers(salted_left_join(enrolments, features, [key]))
    return joined.withColumn("target", label_code(outcome, codes))


def build_master(
    enrolments: DataFrame,
    features: list[DataFrame],
    *,
    key: str = "id_student",
    outcome: str = "final_result",
    codes: dict[str, int] = RESULT_CODES,
    categories: list[str] = CATEGORIES,
) -> DataFrame:
    """The feature table with sorted-rank codes of the categorical columns."""
    joined = join_features(enrolments, features, key=key, outcome=outcome, codes=codes)
    present = [c for c in categories if c in enrolments.columns]
    return rank_encode(joined, present, values_from=enrolments)
