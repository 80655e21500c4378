"""Features as they were known on given days, and the state they are taken from.

A fact table is read once. Its rows meet in cells: per learner, 64 days and interval between the cut
days, with count, sum, spread, last day, and the days and kinds seen as bits of whole numbers. Cells are
combined on the map side, so one exchange of cells is all that the log costs; a learner's cells, a handful for
each course, then give every feature on every cut day. Distinct counts are exact: a bit is set
however often its day occurs, and days fall into as many 64-day cells as there are, whatever their range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.fixed import DAY_CUTOFFS, EARLY_DAY, NEVER_WITHDREW, SCORE_KINDS
from cohortlens.functions.expressions import flag, number
from cohortlens.operators.scale import attach, salted_left_join

# Days, or kinds, of a word of bits.
WORD = 64
# More kinds than this many words hold aren't made bits of.
MOST_WORDS = 8


def bit(position: Column) -> Column:
    """A word with the bit of a whole number set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(WORD)).cast("int"))


def slot(day: Column, cutoffs: tuple[int, ...]) -> Column:
    """How many of the ascending cut days lie before the day; NULL without a day."""
    return sum([flag(day > F.lit(c)) for c in cutoffs], F.lit(0)) + F.when(day.isNotNull(), 0)


def kinds_of_sites(sites: DataFrame, site: str, activity: str) -> tuple[DataFrame, int] | None:
    """(site, _word0, ...): the kinds of a site as bits, and how many words there are. None if there are more
    kinds than ``MOST_WORDS`` hold; no more than those reach the driver."""
    found = sites.where(F.col(activity).isNotNull()).select(activity).distinct().limit(WORD * MOST_WORDS + 1).collect()
    if len(found) > WORD * MOST_WORDS:
        return None
    names = F.array(*[F.lit(x) for x in sorted(r[0] for r in found)]) if found else F.array().cast("array<string>")
    number = F.array_position(names, F.col(activity)) - 1  # NULL without a kind
    n_words = -(-len(found) // WORD)
    words = [F.bit_or(F.when(F.floor(number / WORD) == i, bit(number))).alias(f"_word{i}") for i in range(n_words)]
    return sites.groupBy(site).agg(F.count(F.lit(1)).alias("_rows"), *words).drop("_rows"), n_words


def cells(
    facts: DataFrame, key: str, day: str, cutoffs: tuple[int, ...], measure: str | None = None, sums: dict[str, Column] | None = None, words: list[Column] = ()
) -> DataFrame:
    """(key, cells): an array of one entry per 64 days and slot. measure gives n, total, spread (sum of
    squares about the mean); sums gives more sums; words are bit columns to unite."""
    known = facts.where(F.col(key).isNotNull())
    bucket = F.floor(F.col(day) / WORD).cast("long")
    parts = [F.count(F.lit(1)).alias("rows"), F.max(day).alias("last"), F.bit_or(bit(F.col(day))).alias("days")]
    if measure is not None:
        value = F.col(measure)
        parts += [F.count(value).alias("n"), F.sum(value).alias("total"), (F.var_pop(value) * F.count(value)).alias("spread")]
    parts += [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    parts += [F.bit_or(w).alias(f"word{i}") for i, w in enumerate(words)]
    grouped = known.groupBy(F.col(key).alias("_key"), bucket.alias("bucket"), slot(F.col(day), cutoffs).alias("slot")).agg(*parts)
    names = [c for c in grouped.columns if c != "_key"]
    return grouped.groupBy("_key").agg(F.collect_list(F.struct(*names)).alias("cells"))


def total_of(entries: Column, take: Callable[[Column], Column], kind: str = "long") -> Column:
    """Sum over entries; NULL counts as 0."""
    return F.aggregate(entries, F.lit(0).cast(kind), lambda acc, x: acc + F.coalesce(take(x).cast(kind), F.lit(0).cast(kind)))


def bits_of(entries: Column, word: str) -> Column:
    """Bits set in any entry's word."""
    return F.bit_count(F.aggregate(entries, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.coalesce(x[word], F.lit(0).cast("long")))))


def with_mean(df: DataFrame, entries: str = "cells", total: str = "total", n: str = "n") -> DataFrame:
    """Add _count and _mean of the measure over a learner's entries."""
    count = total_of(F.col(entries), lambda x: x[n])
    counted = df.withColumn("_count", count).withColumn("_total", total_of(F.col(entries), lambda x: x[total], "double"))
    return counted.withColumn("_mean", F.when(F.col("_count") > 0, F.col("_total") / F.col("_count")))


def deviation(entries: Column, total: str = "total", n: str = "n", spread: str = "spread") -> Column:
    """Sample deviation of what ``with_mean`` has counted, from the entries' counts, sums and spreads: 0 for fewer
    than two values."""

    def about_mean(x):
        apart = x[total].cast("double") / x[n] - F.col("_mean")
        return F.when(x[n] > 0, x[spread] + x[n] * apart * apart)

    return F.when(F.col("_count") > 1, F.sqrt(total_of(entries, about_mean, "double") / (F.col("_count") - 1))).otherwise(F.lit(0.0))


def together(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a key, a learner's in one task: Spark joins small parts and splits large ones, so a hot learner is in
    several. For rows that were dealt by something else, where combining on the map side meets a learner's rows one
    at a time and holds an entry for nearly every row. ``_deal`` isn't a grouping key, so cells are still exchanged."""
    dealt = rows.where(F.col(key).isNotNull()).withColumn("_deal", F.hash(key))
    return dealt.hint("rebalance", F.col("_deal")).drop("_deal")


def click_cells(
    clicks: DataFrame,
    sites: DataFrame | None,
    *,
    key: str,
    site: str,
    day: str,
    measure: str,
    activity: str,
    cutoffs: tuple[int, ...],
) -> tuple[DataFrame, int] | None:
    """Cells of the log and the number of words of kinds; None if there are too many kinds for words. A site's
    kind is looked up on the map side if the sites are few, else by a join that deals hot sites."""
    if sites is None:
        return cells(clicks, key, day, cutoffs, measure), 0
    found = kinds_of_sites(sites, site, activity)
    if found is None:
        return None
    lookup, n_words = found
    rows = clicks.select(key, site, day, measure).where(F.col(key).isNotNull())
    joined = attach(rows, lookup, [site]) if n_words else rows
    return cells(joined, key, day, cutoffs, measure, words=[F.col(f"_word{i}") for i in range(n_words)]), n_words


def as_of_clicks(
    clicks: DataFrame,
    sites: DataFrame,
    cutoffs: tuple[int, ...] = DAY_CUTOFFS,
    *,
    key: str = "id_student",
    site: str = "id_site",
    day: str = "date",
    measure: str = "sum_click",
    activity: str = "activity_type",
) -> DataFrame:
    """Per learner and cut day: total, active days, deviation, kinds of activity and last active day up to it."""
    made = click_cells(clicks, sites, key=key, site=site, day=day, measure=measure, activity=activity, cutoffs=cutoffs)
    if made is None:
        raise ValueError(f"more than {WORD * MOST_WORDS} kinds of activity")
    held, n_words = made

    def on(entries: Column) -> list[Column]:
        kinds = sum([bits_of(entries, f"word{i}") for i in range(n_words)], F.lit(0))
        return [
            F.col("_total").alias("total_clicks"), total_of(entries, lambda x: F.bit_count(x["days"])).alias("active_days"),
            deviation(entries).alias("click_std"), kinds.cast("long").alias("unique_activity_types"),
            F.array_max(F.transform(entries, lambda x: x["last"])).alias("last_active_day"),
        ]

    return _by_cut(held, key, cutoffs, on)


def as_of_scores(
    submissions: DataFrame,
    assessments: DataFrame,
    cutoffs: tuple[int, ...] = DAY_CUTOFFS,
    *,
    key: str = "id_student",
    item: str = "id_assessment",
    score: str = "score",
    submitted: str = "date_submitted",
    due: str = "date",
    kind: str = "assessment_type",
    kinds: dict[str, str] = SCORE_KINDS,
) -> DataFrame:
    """Per learner and cut day: mean and deviation of scores, submissions, mean per assessment type and late
    submissions, of what was handed in up to it. A hot assessment is dealt over tasks; the rows, which then lie by
    assessment, are brought together by learner before they become cells."""
    items = assessments.select(item, F.col(kind).alias("_kind"), F.col(due).alias("_due"))
    rows = submissions.select(key, item, score, submitted)
    marked = together(salted_left_join(rows, [items], [item]), key)
    sums = {"late": flag(F.col(submitted) > F.col("_due")).cast("long"), "items": F.col(item).isNotNull().cast("long")}
    for name, value in kinds.items():
        of_kind = (F.col("_kind") == value) & F.col(score).isNotNull()
        sums |= {f"{name}_n": flag(of_kind).cast("long"), f"{name}_sum": F.when(of_kind, F.col(score)).cast("double")}
    held = cells(marked, key, submitted, cutoffs, score, sums)

    def mean(entries: Column, total: str, n: str) -> Column:
        count = total_of(entries, lambda x: x[n])
        return F.when(count > 0, total_of(entries, lambda x: x[total], "double") / count)

    def on(entries: Column) -> list[Column]:
        return [
            F.col("_mean").alias("avg_assessment_score"), deviation(entries).alias("score_std"),
            total_of(entries, lambda x: x["items"]).alias("num_assessments_submitted"),
            *[mean(entries, f"{name}_sum", f"{name}_n").alias(name) for name in kinds],
            total_of(entries, lambda x: x["late"]).alias("late_submissions"),
        ]

    return _by_cut(held, key, cutoffs, on)


def _by_cut(held: DataFrame, key: str, cutoffs: tuple[int, ...], on: Callable[[Column], list[Column]]) -> DataFrame:
    """A row for each key and cut day, made from the entries up to it."""

    def up_to(i: int) -> Column:
        return F.filter("cells", lambda x: x["slot"] <= i)

    days = [F.struct(F.lit(c).cast("long").alias("as_of"), up_to(i).alias("entries")) for i, c in enumerate(cutoffs)]
    made = held.select(F.col("_key").alias(key), F.explode(F.array(*days)).alias("f")).select(key, "f.*")
    return with_mean(made, "entries").select(key, "as_of", *on(F.col("entries")))


def as_of_registrations(
    registrations: DataFrame,
    cutoffs: tuple[int, ...] = DAY_CUTOFFS,
    *,
    key: str = "id_student",
    registered: str = "date_registration",
    unregistered: str = "date_unregistration",
    early: int = EARLY_DAY,
    never: int = NEVER_WITHDREW,
) -> DataFrame:
    """Per learner and cut day: registrations made up to it, whether a withdrawal was known by then and its
    first day. A registration without a readable day counts from the start, a withdrawal without one never."""
    begun, ended = number(registered), number(unregistered)
    known = registrations.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), begun.alias("_begun"), ended.alias("_ended"))
    parts = []
    for i, c in enumerate(cutoffs):
        out = F.col("_ended") <= c
        parts += [
            F.count_if(F.coalesce(F.col("_begun") <= c, F.lit(True))).alias(f"n{i}"), F.max(flag(out)).alias(f"w{i}"),
            F.coalesce(F.min(F.when(out, F.col("_ended"))), F.lit(float(never))).alias(f"d{i}"),
            F.max(flag(out & (F.col("_ended") <= early))).alias(f"e{i}"),
        ]
    days = [
        F.struct(
            F.lit(c).cast("long").alias("as_of"), F.col(f"n{i}").alias("num_modules_registered"), F.col(f"w{i}").alias("withdrew"),
            F.col(f"d{i}").alias("withdrawal_day"), F.col(f"e{i}").alias("early_withdraw"),
        )
        for i, c in enumerate(cutoffs)
    ]
    made = known.groupBy("_key").agg(*parts).select(F.col("_key").alias(key), F.explode(F.array(*days)).alias("f"))
    return made.select(key, "f.*")


def as_of_features(tables: dict[str, DataFrame], cutoffs: tuple[int, ...] = DAY_CUTOFFS, key: str = "id_student") -> DataFrame:
    """One row for every learner of a fact table and every cut day, with all features as known on it: 0 where
    there is nothing yet, as in the feature table. Cut days ascend."""
    if list(cutoffs) != sorted(set(cutoffs)):
        raise ValueError("cut days must ascend")
    made = as_of_clicks(tables["studentVle"], tables["vle"], cutoffs, key=key)
    for other in (
        as_of_scores(tables["studentAssessment"], tables["assessments"], cutoffs, key=key),
        as_of_registrations(tables["studentRegistration"], cutoffs, key=key),
    ):
        made = made.join(other, [key, "as_of"], "full")
    return made.na.fill(0)
