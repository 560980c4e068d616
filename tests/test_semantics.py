import pytest
from pyspark.sql import functions as F

from quarrylens.functions import semantics as M


def _run(spark, f, values, **k):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v"), **k).alias("o"))
    return [r["o"] for r in rows.orderBy("i").collect()]


def test_clean_number(spark):
    values = ["$95,000", "1.234,56", "1,200.50", "45%", "(500)", "N/A", "$", "1200kg", "1,234,567", "1.234", "", None]
    assert _run(spark, M.clean_number, values) == [95000.0, 1234.56, 1200.5, 0.45, -500.0, None, None, None, 1234567.0, 1.234, None, None]
    assert _run(spark, M.clean_number, ["$95,000"], legacy_european=True) == [95.0]


def test_clean_date(spark):
    values = ["15-06-2023", "22/09/2023", "2023/05/12", "March 10 2023", "5 March 2022", "05-02-2023", "foo", "2023-02-31", "12", None]
    assert _run(spark, M.clean_date, values) == ["2023-06-15", "2023-09-22", "2023-05-12", "2023-03-10", "2022-03-05", "2023-05-02", None, None, None, None]


def test_rounding_is_half_up(spark):
    assert _run(spark, lambda c: M.jsround(c.cast("double"), 0), ["-2.5", "2.5", "1e300"]) == [-2.0, 3.0, 1e300]
    assert _run(spark, lambda c: M.jsround(c.cast("double"), 4), ["1.23456"]) == [1.2346]


@pytest.mark.parametrize(("text", "number"), [("12", 12.0), (" -.5e1 ", -5.0), ("0x10", 16.0), ("1d", None), ("inf", None), ("NaN", None), ("", None)])
def test_text_number(spark, text, number):
    assert _run(spark, M.text_number, [text]) == [number]


def test_grades(spark):
    got = _run(spark, lambda c: M.grade(c.cast("int")), ["90", "75", "50", "49"])
    assert got == ["Excellent", "Good", "Fair", "Poor"]
