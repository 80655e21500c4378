"""Table scans: declared-schema CSV, Parquet, optional tables, fallback folders, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlens.fixed import MISSING_TOKENS, RESULT_CODES
from cohortlens.functions.expressions import label_code
from cohortlens.sources.records import quoted_cells
from cohortlens.sources.schemas import LOGS, SCHEMAS


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    multi_line: bool = True,
    bad_cells: str = "stop",
    split: bool | None = None,
) -> DataFrame:
    """CSV with a header. Columns are found by header name, missing-value tokens are NULL. A cell
    that its declared type cannot hold stops the read; with ``bad_cells`` "null" it is NULL. With
    ``multi_line`` a quoted cell may hold line breaks: a file is read by one task, or, with ``split``, by one
    task per block and one shuffle of its lines (``records``; same cells); by default files are split where one is
    larger than a block. Without ``multi_line`` files are split at every line, which suits logs of codes and numbers."""
    header = spark.read.option("header", True).option("enforceSchema", False)
    found = header.option("multiLine", multi_line).csv(path).columns
    texts = StructType([StructField(name, StringType()) for name in found])
    if multi_line and (larger_than_a_block(spark, path) if split is None else split):
        rows = quoted_cells(spark, path, found)
    else:
        rows = header.schema(texts).option("escape", '"').option("multiLine", multi_line).csv(path)
    declared = {field.name: field.dataType for field in schema.fields}
    cells = []
    for name in found:
        text = F.when(~F.col(name).isin(MISSING_TOKENS), F.col(name))
        cells.append(_cell(name, text, declared.get(name, StringType()), bad_cells).alias(name))
    return rows.select(*cells)


def larger_than_a_block(spark: SparkSession, path: str) -> bool:
    """Is one of the files larger than what one task should read? Only file lengths are looked at."""
    block = F.expr(f"CAST({spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()} AS BIGINT)")
    return not spark.read.format("binaryFile").load(path).where(F.col("length") > block).select("length").isEmpty()


def _cell(name, text, data_type, bad_cells):
    if data_type.typeName() == "string":
        return text
    made = F.trim(text).try_cast(data_type)
    if data_type.typeName() in ("integer", "long"):
        # "12.0" is a valid integer cell: a column that once held NULLs is written that way. It goes
        # through a decimal, which keeps all digits.
        spelled = F.trim(text).try_cast("decimal(38,10)")
        made = F.coalesce(made, F.when(spelled == F.floor(spelled), spelled.try_cast(data_type)))
    if bad_cells == "null":
        return made
    told = F.concat(F.lit(f"{name}: no {data_type.simpleString()} cell: "), text)
    return F.when(text.isNotNull() & made.isNull(), F.raise_error(told).cast(data_type)).otherwise(made)


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    fmt: str = "csv",
    optional: bool = False,
    fallbacks: tuple[str, ...] = (),
    multi_line: bool = True,
) -> DataFrame | None:
    """Read the first of the given paths that exists; None if none does and that is allowed."""
    for candidate in (path, *fallbacks):
        try:
            if fmt == "csv" and schema is not None:
                return read_csv(spark, candidate, schema, multi_line)
            reader = spark.read.format(fmt)
            if fmt == "csv":
                reader = reader.option("header", True).option("inferSchema", True)
            return (reader.schema(schema) if schema is not None else reader).load(candidate)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if optional:
        return None
    raise FileNotFoundError(f"none of these paths exists: {(path, *fallbacks)}")


def read_tables(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame | None]:
    """All input tables of a folder; a table that is not there is None. ``fmt`` is csv, parquet, or
    table for Parquet folders that bear the tables' names alone."""
    suffix = {"csv": ".csv", "parquet": ".parquet", "table": ""}[fmt]
    kind = "csv" if fmt == "csv" else "parquet"
    return {
        name: read_table(spark, f"{folder}/{name}{suffix}", schema, kind, optional=True, multi_line=name not in LOGS)
        for name, schema in SCHEMAS.items()
    }


def read_master(spark: SparkSession, folders: list[str], name: str = "master", fmt: str = "parquet"):
    """The stored feature table from the first folder that has it, with a target column."""
    paths = [f"{folder}/{name}" for folder in folders]
    master = read_table(spark, paths[0], fmt=fmt, optional=True, fallbacks=tuple(paths[1:]))
    if master is not None and "target" not in master.columns:
        master = master.withColumn("target", label_code("final_result", RESULT_CODES))
    return master


def find_table(spark: SparkSession, root: str, file_name: str, schema: StructType) -> DataFrame | None:
    """Look for a CSV file anywhere below a folder; the copy nearest to the root wins."""
    try:
        files = (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", file_name)
            .text(root)
            .inputFiles()
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = []
    if not files:
        return None
    return read_csv(spark, min(files, key=lambda f: (f.count("/"), f)), schema)


def missing_values(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, n_null over all cells."""
    nulls = " + ".join(f"count_if(`{c}` IS NULL)" for c in df.columns)
    return df.agg(
        F.expr("count(1) AS n_rows"),
        F.expr(f"CAST({len(df.columns)} AS BIGINT) AS n_cols"),
        F.expr(f"{nulls} AS n_null"),
    )


def audit(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row per table: is it there, how many rows, columns and missing cells."""
    absent = spark.range(1).selectExpr(
        "CAST(0 AS BIGINT) AS n_rows", "CAST(0 AS BIGINT) AS n_cols", "CAST(0 AS BIGINT) AS n_null"
    )
    lines = [
        (absent if df is None else missing_values(df)).selectExpr(
            f"'{name}' AS table_name", f"{int(df is not None)} AS found", "n_rows", "n_cols", "n_null"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, lines)
