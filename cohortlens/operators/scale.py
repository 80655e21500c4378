"""Building blocks that keep the other operators safe on large and skewed data.

* ``settle`` writes an intermediate table to the shared folder, so that it is computed once,
  reads the same from every branch of a plan, and has a known size.
* ``attach`` joins a per-group lookup: broadcast if its measured size allows, else salted.
* ``salted_left_join`` spreads the rows of hot keys over many tasks.
* ``running_totals`` and ``quantiles`` order a group without gathering it in one task.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import all_present

# A settled table of at most this many rows may be broadcast.
BROADCAST_ROWS = 100_000
# A settled table of at most this many rows may be ordered or mapped per group in one task.
WINDOW_ROWS = 1_000_000
# A key is hot when it holds more rows than one task should; it is dealt over as many tasks as
# keep each below that, at any size of the table.
HOT_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-"))
    return context.getCheckpointDir()


# Where tables were settled, in order.
_SETTLED: list[str] = []


@contextmanager
def settled_for_now(spark: SparkSession):
    """Delete on leaving what was settled inside. For programs that have written their results."""
    before = len(_SETTLED)
    try:
        yield
    finally:
        paths, _SETTLED[before:] = _SETTLED[before:], []
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame, file_rows: int = 0) -> tuple[DataFrame, int]:
    """Write the table to the shared folder, ``file_rows`` at most in a file if given; give back its
    stored form and its row count (read from the file footers)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    _SETTLED.append(path)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return stored, stored.count()


def attach(rows: DataFrame, lookup: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left-join a lookup table with the join strategy that its measured size allows."""
    stored, n = settle(lookup)
    return attach_settled(rows, stored, n, on, limit)


def attach_settled(
    rows: DataFrame, stored: DataFrame, n: int, on: list[str], limit: int = BROADCAST_ROWS
) -> DataFrame:
    """The same for a lookup that is settled already and has n rows."""
    if n <= limit:
        return rows.join(F.broadcast(stored), on, "left")
    return salted_left_join(rows, [stored], on)


def hot_keys(rows: DataFrame, on: list[str], rows_per_task: int = HOT_ROWS) -> DataFrame:
    """Keys with more rows than a task should get, and over how many tasks (``_salts``) to deal them."""
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts")
    return counted.where(F.col("_n") > rows_per_task).select(*on, salts)


def salted_left_join(
    rows: DataFrame, lookups: list[DataFrame], on: list[str], rows_per_task: int = HOT_ROWS
) -> DataFrame:
    """Left-join lookups on one key. Rows of a hot key are dealt over tasks and the lookup rows
    of that key are copied to each; rows without a key, which match nothing, are dealt too; all
    other keys join as they are. The rows are shuffled once, however many lookups there are. The
    list of hot keys carries no hint: it is broadcast if it measures small, else joined by hash."""
    if not lookups:
        return rows
    hot = hot_keys(rows, on, rows_per_task)
    # rows without a key are dealt by hash over a number of tasks that grows with nothing but them
    alone = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 16)).cast("int")
    deal = F.pmod(F.xxhash64(*rows.columns) + F.spark_partition_id(), F.col("_salts")).cast("int")
    joined = (
        rows.join(hot, on, "left")
        .withColumn("_salt", F.when(~all_present(on), alone).otherwise(F.coalesce(deal, F.lit(0))))
        .drop("_salts")
    )
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    for lookup in lookups:
        spread = lookup.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
        joined = joined.join(spread, [*on, "_salt"], "left")
    added = [c for lookup in lookups for c in lookup.columns if c not in on]
    return joined.select(*rows.columns, *added)


def running_totals(
    rows: DataFrame, by: list[str], order: str, sums: list[str], limit: int = WINDOW_ROWS
) -> DataFrame:
    """Add ``<s>_upto`` (running sum in ascending order, this row included) and ``<s>_all``
    (group total) for tables with one row per (by, order)."""
    stored, n = settle(rows)
    return settled_running_totals(stored, n, by, order, sums, limit)


def settled_running_totals(
    stored: DataFrame, n: int, by: list[str], order: str, sums: list[str], limit: int = WINDOW_ROWS
) -> DataFrame:
    """The running totals of a table that is settled already and has n rows."""
    if n <= limit:
        return _running_in_groups(stored, by, order, sums)
    return _running_in_slices(stored, by, order, sums)


def _running_in_groups(rows: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "*",
        *[F.sum(s).over(upto).alias(f"{s}_upto") for s in sums],
        *[F.sum(s).over(group).alias(f"{s}_all") for s in sums],
    )


def _running_in_slices(rows: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    # Range-partitioned slices, settled so that every branch below sees the same slicing.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced, _ = settle(
        rows.repartitionByRange(parts, *by, order).withColumn("_slice", F.spark_partition_id())
    )
    # At most (groups + slices) rows: the total of each slice and of the slices before it.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*by, "_slice")
        .agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        .select(
            *by, "_slice",
            *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_before") for s in sums],
            *[F.sum(f"_{s}").over(group).alias(f"{s}_all") for s in sums],
        )
    )
    inside = (
        Window.partitionBy(*by, "_slice")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return sliced.join(offsets, [*by, "_slice"]).select(
        *rows.columns,
        *[(F.col(f"_{s}_before") + F.sum(s).over(inside)).alias(f"{s}_upto") for s in sums],
        *[F.col(f"{s}_all") for s in sums],
    )


def quantiles(
    df: DataFrame,
    by: list[str],
    column: str,
    points: dict[str, float],
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: one output column per point. Values
    are counted first, so equal values cost one row."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(*by, F.col(column).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    stored, n = settle(counts)
    return settled_quantiles(stored, n, by, "_value", "_n", points, limit)


def settled_quantiles(
    stored: DataFrame,
    n: int,
    by: list[str],
    value: str,
    times: str,
    points: dict[str, float],
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Quantiles of a settled table of n rows that says how often each value occurs: running counts
    locate the ranks, per group with few rows and per slice with many. The formula is the same, and
    so are the results to the last bit."""
    counts = stored.select(
        *by, F.col(value).cast("double").alias("_value"), F.col(times).cast("long").alias("_n")
    ).where("_value IS NOT NULL")
    if n <= limit:
        group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        upto = group.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counts.select("*", F.sum("_n").over(upto).alias("_n_upto"), F.sum("_n").over(group).alias("_n_all"))
    else:
        ranked = _running_in_slices(counts, by, "_value", ["_n"])
    return _quantiles_by_rank(ranked, by, points)


def _quantiles_by_rank(ranked: DataFrame, by: list[str], points: dict[str, float]) -> DataFrame:
    first, last = F.col("_n_upto") - F.col("_n"), F.col("_n_upto")

    def value_at(rank):
        return F.max(F.when((first <= rank) & (rank < last), F.col("_value")))

    picks, results = [], []
    for name, q in points.items():
        position = (F.col("_n_all") - 1) * F.lit(float(q))
        picks += [
            value_at(F.floor(position)).alias(f"_{name}_lo"),
            value_at(F.ceil(position)).alias(f"_{name}_hi"),
            F.max(position - F.floor(position)).alias(f"_{name}_part"),
        ]
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        results.append((low + (high - low) * F.col(f"_{name}_part")).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *results)
