"""Run queries in Spark and their SQL in DuckDB and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import QUERIES, SQL


def local_session(cores: int | str = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _sortable(row: tuple) -> tuple:
    return tuple(
        (v is None, "" if v is None else f"{v:024.6f}" if isinstance(v, float) else str(v)) for v in row
    )


def _same(a, b) -> bool:
    if type(a) is not type(b):
        return False
    return a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=0, abs_tol=0))


def differences(spark: SparkSession, connection, sf_dir: str, name: str) -> str | None:
    """None if both engines give the same columns and rows, else what differs."""
    made = QUERIES[name](spark, sf_dir)
    columns = sorted(made.columns)
    ours = sorted((tuple(row) for row in made.select(*[f"`{c}`" for c in columns]).collect()), key=_sortable)
    if name not in SQL:
        return None if ours else "no rows"
    result = connection.sql(SQL[name])
    if sorted(result.columns) != columns:
        return f"columns {columns} against {sorted(result.columns)}"
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(result.project(quoted).fetchall(), key=_sortable)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"{a} against {b}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark, connection = local_session(), oracle(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            found = differences(spark, connection, sf_dir, name)
        except Exception as error:  # report every query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        verdict = "ok" if found is None else f"DIFFERS {found}"
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
