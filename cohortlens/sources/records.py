"""Records of quoted text files, read by many tasks.

A line break inside quotes does not end a record, and whether a line starts inside quotes depends on all quotes
before it. So the lines of each block of a file are counted first: the parity of the quotes up to a line tells
whether it starts a record, once the parity at the block's start is known, which takes one row per block. Whole
lines are records as they are; only the lines of records that were broken are brought together.

Holds for files in which quotes are doubled inside quoted cells and occur in no unquoted cell. Lines end with a
line feed, with or without a carriage return. A block is at most ``spark.sql.files.maxPartitionBytes``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlens.operators.scale import attach, settle

_BLOCK = ["_file", "_block"]


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first): one row per record, blank ones left out; ``first`` marks the first record of a file."""
    text = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        text.alias("_line"),
        ((F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2).cast("int").alias("_odd"),
    )
    in_block = Window.partitionBy(*_BLOCK).orderBy("_id")
    numbered = lines.select(
        *_BLOCK, "_line", "_odd",
        F.row_number().over(in_block).cast("long").alias("_row"),
        ((F.sum("_odd").over(in_block) - F.col("_odd")) % 2).alias("_before"),
    )
    placed = attach(numbered, _block_starts(numbered), _BLOCK)
    starts = F.col("_before") == F.col("_enter")
    placed = placed.withColumn("_starts", starts)
    whole = placed.where(F.col("_starts") & (F.col("_odd") == 0)).select(
        F.col("_line").alias("record"), ((F.col("_block") == 0) & (F.col("_row") == 1)).alias("first")
    )
    here = F.when(F.col("_starts"), F.struct(*[F.col(c).alias(c.strip("_")) for c in ("_block", "_row")]))
    upto = Window.partitionBy(*_BLOCK).orderBy("_row")
    start = F.coalesce(F.last(here, ignorenulls=True).over(upto), F.col("_open"))
    pieces = placed.withColumn("_start", start).where(~F.col("_starts") | (F.col("_odd") == 1))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_row", "_line"))), lambda p: p["_line"]), "\n")
    broken = pieces.groupBy("_file", "_start").agg(joined.alias("record")).select(
        "record", ((F.col("_start.block") == 0) & (F.col("_start.row") == 1)).alias("first")
    )
    bare = F.regexp_replace("record", r"\r$", "")
    made = whole.unionByName(broken).withColumn("record", F.when(F.col("first"), F.ltrim(bare, F.lit("﻿"))).otherwise(bare))
    return made.where(F.col("first") | (F.trim("record") != ""))


def _block_starts(numbered: DataFrame) -> DataFrame:
    """For each block the parity of the quotes before it (``_enter``) and the start of the record that is open
    there (``_open``)."""
    last_even = F.max(F.when(F.col("_before") == 0, F.col("_row")))
    last_odd = F.max(F.when(F.col("_before") == 1, F.col("_row")))
    blocks, _ = settle(
        numbered.groupBy(*_BLOCK).agg(
            (F.sum("_odd") % 2).alias("_parity"), last_even.alias("_even_row"), last_odd.alias("_odd_row")
        )
    )
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    entered = blocks.withColumn("_enter", F.coalesce(F.sum("_parity").over(earlier), F.lit(0)) % 2)
    row = F.when(F.col("_enter") == 0, F.col("_even_row")).otherwise(F.col("_odd_row"))
    last = F.when(row.isNotNull(), F.struct(F.col("_block").alias("block"), row.alias("row")))
    return entered.select(*_BLOCK, "_enter", F.last(last, ignorenulls=True).over(earlier).alias("_open"))


def quoted_cells(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The cells of the records as text columns. A file whose first record isn't the given header stops the read."""
    texts = StructType([StructField(name, StringType()) for name in names])
    # the option keeps line breaks inside quotes as they are
    parsed = F.from_csv("record", F.lit(texts.toDDL()), {"escape": '"', "multiLine": "true"})
    cells = quoted_records(spark, path).select("first", parsed.alias("_cells"))
    is_header = F.coalesce(F.to_json("_cells") == F.to_json(F.struct(*[F.lit(n).alias(n) for n in names])), F.lit(False))
    told = F.raise_error(F.concat(F.lit("unlike header: "), F.to_json("_cells"))).cast("boolean")
    return cells.where(F.when(~F.col("first"), F.lit(True)).when(is_header, F.lit(False)).otherwise(told)).select("_cells.*")
