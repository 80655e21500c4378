import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.expressions import (
    band_index,
    fixed_text,
    flag,
    is_one_of,
    label_code,
    number,
    percent,
    percent_text,
    round_even,
    slug,
    thousands_text,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value", [0.575, 2.5, 3.5, -0.125, 1234.5678, 57.45, 0.005])
@pytest.mark.parametrize("digits", [0, 1, 2])
def test_rounding_is_that_of_numpy(spark, value, digits):
    assert one(spark, round_even(F.lit(value), digits)) == float(np.round(value, digits))


@pytest.mark.parametrize(
    "text, expected",
    [("12", 12.0), ("-5", -5.0), (" 3.5 ", 3.5), ("1e3", 1000.0), ("?", None), ("", None), ("1d", None),
     ("nan", None), (None, None), (".5", 0.5), ("5.", 5.0)],
)
def test_number_from_text(spark, text, expected):
    assert one(spark, number(F.lit(text))) == expected
    assert one(spark, number(F.lit(text), 999)) == (999.0 if expected is None else expected)


def test_unknown_comparison_is_no(spark):
    assert one(spark, flag(F.lit(None).cast("int") > 3)) == 0
    assert one(spark, is_one_of(F.lit(None).cast("string"), ["a"])) == 0
    assert one(spark, is_one_of(F.lit("a"), ["a", "b"])) == 1


def test_label_code_of_unknown_label_is_null(spark):
    codes = {"Pass": 1, "Fail": 0}
    assert one(spark, label_code(F.lit("Fail"), codes)) == 0
    assert one(spark, label_code(F.lit("Deferred"), codes)) is None


@pytest.mark.parametrize(
    "value, band", [(0, None), (0.1, 0), (200, 0), (200.0001, 1), (500, 1), (501, None), (-5, None), (None, None)]
)
def test_bands_are_right_closed(spark, value, band):
    assert one(spark, band_index(F.lit(value).cast("double"), [0, 200, 500])) == band


@pytest.mark.parametrize("value", [12.35, 0.25, 2.675, 1234.5, -0.05, 99.95, 1.005])
@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_text_is_that_of_python(spark, value, digits):
    assert one(spark, fixed_text(F.lit(value), digits)) == f"{value:.{digits}f}"


def test_texts(spark):
    assert one(spark, percent(F.lit(1), F.lit(0))) is None
    assert one(spark, percent_text(F.lit(12.345), 1)) == "12.3%"
    assert one(spark, thousands_text(F.lit(1234567))) == "1,234,567"
    assert one(spark, slug(F.lit("Random Forest"))) == "random_forest"
