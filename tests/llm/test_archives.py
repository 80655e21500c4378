"""WARC archives: what is written is read back."""

import base64
import glob
import gzip
import hashlib

import duckdb
import pytest

from cohortlens.llm import warc
from cohortlens.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, type string, digest int, leader int"


def pages(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 4000
    rows = [
        (1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "u", ""), (4, "u\r\nx: y", None),
        (7, "big", big), (8, "big2", big), (9, "other", big + "!"), (None, "n", "same"), (None, None, "alone"), (5, "http://b", "same"), (9, "other", big + "!"),
    ]
    return spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("segment", [100, 5000, 10_000_000])
def test_round_trip(spark, tmp_path, segment):
    given = pages(spark)
    folder = str(tmp_path / "warc")
    warc.write_archives(given, folder, segment=segment)
    got = warc.read_archives(spark, folder, with_payload=True).collect()
    largest = {}
    for r in given.collect():
        if r.page_id is not None:
            largest[r.html or ""] = max(r.page_id, largest.get(r.html or "", 0))
    want = []
    for r in given.collect():
        html, lead = r.html or "", largest.get(r.html or "")
        again = r.page_id is not None and r.page_id < lead
        want.append((r.page_id, len(html.encode()), digest(html), "revisit" if again else "response", lead if again else None, None if again else html.encode()))
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)


def test_archives_are_warc_files(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write_archives(pages(spark), folder, segment=1000)
    kinds, segments = [], {}
    for path in glob.glob(f"{folder}/part-*"):
        for fields, block in warc.cut_archive(gzip.open(path).read()):
            kinds.append(fields["WARC-Type"])
            assert len(block) <= 1000 and fields["WARC-Date"] and fields["WARC-Record-ID"][0] == "<"
            if fields["WARC-Type"] == "continuation":
                segments.setdefault(fields["WARC-Segment-Origin-ID"], []).append(int(fields["WARC-Segment-Number"]))
    assert set(kinds) == {"response", "revisit", "continuation"} and len(segments) == 2


def test_small_payloads_are_never_revisits(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write_archives(pages(spark), folder, min_bytes=5)
    assert {r.page_id for r in warc.read_archives(spark, folder).collect() if r.record_type == "revisit"} == {7}


def test_a_missing_segment_stops_the_read(spark, tmp_path):
    folder = tmp_path / "warc"
    records = list(warc.records(1, "u", b"x" * 500, digest("x" * 500), None, 200))
    for name, some in (("part-a", records[:-1]), ("part-b", records[1:])):
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in some)))
        with pytest.raises(Exception, match="segments of|NoneType"):
            warc.read_archives(spark, str(folder)).collect()
        (folder / name).write_bytes(gzip.compress(b""))


def test_a_wrong_payload_stops_the_read():
    block = next(warc.records(1, "u", b"abc", digest("abc"), None, 10_000)).partition(b"\r\n\r\n")[2]
    assert warc.payload_of(block, digest("abc")) == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.payload_of(block.replace(b"abc", b"abd"), digest("abc"))
    assert warc.unchunked(warc._chunks(b"y" * 20_000)) == b"y" * 20_000
    with pytest.raises(ValueError, match="size"):
        warc.unchunked(b"2\r\nabc\r\n0\r\n\r\n")


def test_no_pages(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_archives(spark, folder).collect() == []


def test_query_matches_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = duck.execute(SQL["op9_warc"])
    names = [c[0] for c in want.description]
    got = QUERIES["op9_warc"](spark, DATA).collect()
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want.fetchall(), key=str)
