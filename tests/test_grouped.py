"""The grouped reports from one scan: equal to the single ones, also with NULLs, missing columns and no rows."""

import pytest
from pyspark.sql import functions as F

from checks import bindings as b
from cohortlens.plans.grouped import grouped_reports
from cohortlens.plans.reports import reports
from tests.conftest import DATA

NAMES = ["Result_Summary", "Module_Performance", "Engagement_Bands", "IMD_Deprivation", "KPI_Summary"]


def shown(df):
    return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in df.collect()], key=str)


@pytest.mark.parametrize("case", ["all", "nulls", "few columns", "empty"])
def test_equal_to_the_single_reports(spark, case):
    master = b.joined(spark, DATA)
    if case == "nulls":
        odd = F.col("id_student") % 3 == 0
        for c in ("gender", "final_result", "code_module", "imd_band", "total_clicks", "target", "withdrew", "avg_assessment_score"):
            master = master.withColumn(c, F.when(~odd | (F.length("code_module") > 99), F.col(c)))
    if case == "few columns":
        master = master.drop("imd_band", "withdrew")
    if case == "empty":
        master = master.where("id_student < 0 AND id_student > 0")
    single = reports(master, {}, engagement_edges=b.BAND_EDGES)
    grouped = reports(master, {}, engagement_edges=b.BAND_EDGES, one_scan=True)
    assert list(grouped) == list(single)
    for name in NAMES:
        if name in single:
            assert grouped[name].columns == single[name].columns
            assert shown(grouped[name]) == shown(single[name]), name


def test_the_table_is_read_and_exchanged_once(spark, tmp_path, monkeypatch):
    from cohortlens.plans import grouped

    b.joined(spark, DATA).write.parquet(f"{tmp_path}/master")
    plans = []

    def settle(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return df, 0

    monkeypatch.setattr(grouped, "settle", settle)
    grouped_reports(spark.read.parquet(f"{tmp_path}/master"))
    assert len(plans) == 1
    assert plans[0].count("FileScan") == 1 and plans[0].count("Exchange hash") == 1
