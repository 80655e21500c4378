import pytest
from pyspark.sql import functions as F

from cohortlens.operators.select import only_present
from cohortlens.sources import readers, sinks
from cohortlens.sources.schemas import SCHEMAS

COURSES = '"code_module","code_presentation","module_presentation_length"\n"AAA","2013J","268"\n"BBB","2014J","262"\n'
ASSESSMENTS = (
    '"code_module","code_presentation","id_assessment","assessment_type","date","weight"\n'
    '"AAA","2013J","1","TMA","19","10"\n"AAA","2013J","2","CMA","54.0","12.5"\n"AAA","2013J","3","Exam","","100"\n'
)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "courses.csv").write_text(COURSES)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "assessments.csv").write_text(ASSESSMENTS)
    return str(tmp_path)


def test_csv_scan(spark, rows, folder):
    made = readers.read_table(spark, f"{folder}/courses.csv", SCHEMAS["courses"])
    assert made.schema == SCHEMAS["courses"]
    assert rows(made, "code_module")[0]["module_presentation_length"] == 268


def test_missing_tokens_and_column_order(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text('weight,date,id_assessment\n1.5,NaN,1\nn/a,5,2\n"",,""\n')
    made = readers.read_csv(spark, str(tmp_path / "a.csv"), SCHEMAS["assessments"])
    assert rows(made) == [
        {"weight": 1.5, "date": None, "id_assessment": 1},
        {"weight": None, "date": 5, "id_assessment": 2},
        {"weight": None, "date": None, "id_assessment": None},
    ]


def test_optional_and_fallback(spark, folder):
    schema = SCHEMAS["courses"]
    assert readers.read_table(spark, f"{folder}/none.csv", schema, optional=True) is None
    found = readers.read_table(spark, f"{folder}/none.csv", schema, fallbacks=(f"{folder}/courses.csv",))
    assert found.count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, f"{folder}/none.csv", schema)


def test_recursive_search_and_audit(spark, rows, folder):
    found = readers.find_table(spark, folder, "assessments.csv", SCHEMAS["assessments"])
    tables = {
        "assessments": found,
        "courses": readers.find_table(spark, folder, "courses.csv", SCHEMAS["courses"]),
        "vle": readers.find_table(spark, folder, "vle.csv", SCHEMAS["vle"]),
    }
    assert rows(readers.audit(spark, tables), "table_name") == [
        {"table_name": "assessments", "found": 1, "n_rows": 3, "n_cols": 6, "n_null": 1},
        {"table_name": "courses", "found": 1, "n_rows": 2, "n_cols": 3, "n_null": 0},
        {"table_name": "vle", "found": 0, "n_rows": 0, "n_cols": 0, "n_null": 0},
    ]
    assert {r["date"] for r in rows(found)} == {19, 54, None}


def test_nearest_copy_wins(spark, folder, tmp_path):
    (tmp_path / "deep" / "courses.csv").write_text(COURSES.splitlines()[0] + "\n")
    assert readers.find_table(spark, folder, "courses.csv", SCHEMAS["courses"]).count() == 2


def test_read_tables(spark, folder):
    found = readers.read_tables(spark, folder)
    assert found["courses"] is not None and found["studentVle"] is None and len(found) == 7


def test_master_from_fallback_folder_gets_a_target(spark, rows, tmp_path):
    given = spark.createDataFrame([("Pass",), ("Fail",), ("Deferred",)], "final_result string")
    sinks.write_table(given, f"{tmp_path}/b/master")
    made = readers.read_master(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert {r["final_result"]: r["target"] for r in rows(made)} == {"Pass": 1, "Fail": 0, "Deferred": None}
    assert readers.read_master(spark, [f"{tmp_path}/a"]) is None


def test_csv_sink_reads_back(spark, tmp_path):
    given = spark.createDataFrame([("A, B", "2013J", 5), (None, 'say "x"', None)], SCHEMAS["courses"])
    sinks.write_table(given, f"{tmp_path}/out", "csv")
    again = readers.read_table(spark, f"{tmp_path}/out", SCHEMAS["courses"])
    assert again.exceptAll(given).count() == 0 and given.exceptAll(again).count() == 0


def test_name_list(spark, tmp_path):
    sinks.write_names(spark, ["z", "a", "m"], f"{tmp_path}/names")
    assert sinks.read_names(spark, f"{tmp_path}/names") == ["z", "a", "m"]
    table = spark.range(1).select(F.lit(1).alias("a"))
    assert sinks.read_names(spark, f"{tmp_path}/names", table) == ["a"]
    assert only_present(table, ["z", "a"]).columns == ["a"]


def test_odd_report_names_are_written(spark, tmp_path):
    report = spark.range(1).select(F.lit(1.0).alias("Pass Rate (%)"))
    paths = sinks.write_reports({"KPI_Summary": report}, str(tmp_path))
    assert spark.read.parquet(paths["KPI_Summary"]).columns == ["Pass Rate (%)"]


def test_integers_keep_every_digit(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text('id_student,id_site,date,sum_click\n3000000000,9007199254740993,12.0, 7 \n"1",2,-3.00,\n')
    made = rows(readers.read_csv(spark, str(tmp_path / "a.csv"), SCHEMAS["studentVle"]), "id_student")
    assert made == [
        {"id_student": 1, "id_site": 2, "date": -3, "sum_click": None},
        {"id_student": 3000000000, "id_site": 9007199254740993, "date": 12, "sum_click": 7},
    ]


@pytest.mark.parametrize("cell", ["12.7", "x1", "99999999999999999999"])
def test_a_cell_that_does_not_fit_stops_the_read(spark, tmp_path, cell):
    (tmp_path / "a.csv").write_text(f"id_student,sum_click\n1,{cell}\n")
    path = str(tmp_path / "a.csv")
    with pytest.raises(Exception, match="sum_click: no bigint cell"):
        readers.read_csv(spark, path, SCHEMAS["studentVle"]).collect()
    assert readers.read_csv(spark, path, SCHEMAS["studentVle"], bad_cells="null").first()["sum_click"] is None


def test_quoted_line_breaks_come_back(spark, rows, tmp_path):
    given = spark.createDataFrame([("a\nb", 'q"x', 1), ("c,d", None, 2), (" e\n", "\tf ", 3)], "region string, gender string, id_student long")
    sinks.write_table(given, str(tmp_path / "t"), "csv")
    made = readers.read_csv(spark, str(tmp_path / "t"), SCHEMAS["studentInfo"])
    assert rows(made.select(*given.columns), "id_student") == rows(given, "id_student")
