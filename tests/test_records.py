"""Quoted records over blocks of a few bytes: cells equal those that one task per file reads."""

import csv
import random

import pytest

from cohortlens.sources import readers, records
from cohortlens.sources.schemas import SCHEMAS

CELLS = ["", "a", "a,b", 'say "x"', "two\nlines", "\n", "\n\n\n\n", 'q"\n"q', "é\nü", " pad ", "long" * 30, "x\r\ny", '"', "1"]


@pytest.fixture()
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(size)) for k in before]
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, seed, n, end):
    rng = random.Random(seed)
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["region", "gender", "id_student"])
        made = [[rng.choice(CELLS), rng.choice(CELLS), i] for i in range(n)]
        writer.writerows(made)
    return made


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [7, 64, 1000, 10**8])
def test_split_cells_equal_whole_files(spark, small_blocks, tmp_path, size, end):
    (tmp_path / "t").mkdir()
    made = [row for f in range(2) for row in write(tmp_path / "t" / f"{f}.csv", f, 120, end)]
    names = ["region", "gender", "id_student"]
    small_blocks(size)
    got = [tuple(r) for r in records.quoted_cells(spark, str(tmp_path / "t"), names).collect()]
    expected = [tuple(None if c == "" else str(c) for c in row) for row in made]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_read_csv_splits_large_files(spark, rows, small_blocks, tmp_path):
    write(tmp_path / "t.csv", 3, 200, "\n")
    whole = rows(readers.read_csv(spark, str(tmp_path / "t.csv"), SCHEMAS["studentInfo"], split=False), "region", "gender", "id_student")
    assert not readers.larger_than_a_block(spark, str(tmp_path / "t.csv"))
    small_blocks(300)
    assert readers.larger_than_a_block(spark, str(tmp_path / "t.csv"))
    made = readers.read_csv(spark, str(tmp_path / "t.csv"), SCHEMAS["studentInfo"])
    assert rows(made, "region", "gender", "id_student") == whole and len(whole) == 400 // 2


def test_one_record_over_many_blocks_and_files_without_rows(spark, small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text('﻿x,y\n1,"' + "line\n" * 50 + '"\n\n2,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("x,y\n")
    small_blocks(11)
    made = {r["x"]: r["y"] for r in records.quoted_cells(spark, str(tmp_path), ["x", "y"]).collect()}
    assert made == {"1": "line\n" * 50, "2": None}


def test_another_header_stops_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,z\n1,2\n")
    with pytest.raises(Exception, match="unlike header"):
        records.quoted_cells(spark, str(tmp_path), ["x", "y"]).collect()
