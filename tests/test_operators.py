import pytest

from quarrylens.operators import columns as C
from quarrylens.operators import quality as Q
from quarrylens.operators import series as S


def _types(spark, rows, schema):
    return {r["column"]: r["type"] for r in C.infer_types(spark.createDataFrame(rows, schema)).collect()}


def test_types(spark):
    rows = [(None, str(i) if i % 2 else "x", str(i), i * 1.5, "ab"[i % 2], f"w{i}") for i in range(40)]
    got = _types(spark, rows, "none string, half string, order_id string, price double, grp string, words string")
    assert got == {"none": "text", "half": "text", "order_id": "id", "price": "numeric", "grp": "categorical", "words": "text"}


def test_numeric_stats_edges(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0), (1.0, None)], "same double, lone double")
    got = {r["column"]: r for r in C.numeric_stats(df).collect()}
    assert set(got) == {"same"} and got["same"]["std_dev"] == 0 and got["same"]["skewness"] == 0 and got["same"]["z_outliers"] == 0
    assert C.numeric_stats(df.limit(0)).count() == 0


def test_histogram_sums_to_n(spark):
    df = spark.range(1000).selectExpr("CAST(id % 97 AS DOUBLE) AS x")
    rows = C.histogram(df).collect()
    assert len(rows) == 7 and sum(r["count"] for r in rows) == 1000 and sum(r["is_mode"] for r in rows) == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_monotonic_does_not_depend_on_partitions(spark, parts):
    df = spark.range(100).selectExpr("id AS at", "id * 2 AS up", "-id AS down", "id % 5 AS wave").repartition(parts)
    got = {r["column"]: r["direction"] for r in Q.monotonic(df, ["up", "down", "wave"], "at").collect()}
    assert got == {"up": "increasing", "down": "decreasing"}


def test_monotonic_needs_six(spark):
    assert Q.monotonic(spark.range(5).selectExpr("id AS at", "id AS x"), ["x"], "at").count() == 0


def test_fuzzy(spark):
    df = spark.createDataFrame([("New York",), ("new-york",), ("NEWYORK",), ("NY",), ("ny",)], "city string")
    rows = Q.fuzzy_duplicates(df, ["city"]).collect()
    assert [(r["key"], r["n_values"]) for r in rows] == [("newyork", 3)]


def test_benford(spark):
    assert Q.benford(spark.range(900, 1000).selectExpr("CAST(id AS DOUBLE) AS x")).first()["deviates"]
    assert Q.benford(spark.range(900, 950).selectExpr("CAST(id AS DOUBLE) AS x")).count() == 0


def test_correlations(spark):
    df = spark.range(10).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(-id AS DOUBLE) AS b", "1.0D AS c", "IF(id < 4, 1.0D * id, NULL) AS d")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in S.correlations(df).collect()}
    assert got[("a", "b")] == -1.0 and got[("a", "c")] is None and got[("a", "d")] is None


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame([("$1,200", "2023/05/12", " x "), ("N/A", "missing", "none"), ("7", "03-04-2023", "5")], "a string, d string, t string")
    types = {"a": "numeric", "d": "date", "t": "categorical"}
    once = Q.cleanse(df, types)
    assert [tuple(r) for r in once.collect()] == [(1200.0, "2023-05-12", "x"), (None, None, None), (7.0, "2023-03-04", "5")]
    assert Q.cleanse(once, types).collect() == once.collect()


def test_row_ids(spark):
    df = spark.range(1000).repartition(5)
    got = Q.with_row_ids(df, "id").collect()
    assert all(r["id"] == r["_row_id"] for r in got)


def test_date_gaps(spark):
    df = spark.createDataFrame([("2023-01-01",), ("2023-01-02",), ("2023-01-02",), ("2023-02-20",), (None,)], "d string")
    r = S.date_gaps(df, "d").first()
    assert (r["largest_gap_days"], r["median_gap_days"]) == (49.0, 1.0) and r["gap_anomaly"]


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(0, 50, 3000), 1), rng.integers(0, 4, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)], "x double, y double, z double").repartition(5)
    got = C.exact_quantiles(df, {"x": 3000, "y": 3000, "z": 0})
    assert got["x"] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75])) and got["y"] == pytest.approx(np.quantile(y, [0.25, 0.5, 0.75])) and "z" not in got


def test_primary_of_equals_is_the_first_column(spark):
    df = spark.createDataFrame([(1.0, 5.0, 5.0), (2.0, 9.0, 9.0)], "c double, z double, a double")
    assert C.primary_column(C.numeric_stats(df), df.columns).first()["primary_column"] == "z"


def test_distribution_falls_back_to_values(spark):
    df = spark.createDataFrame([(1.0, "a")] * 3, "same double, name string")
    assert [r["label"] for r in C.distribution(df, "same").collect()] == ["1.0"]
    assert [tuple(r) for r in C.distribution(df, "name").collect()] == [(0, "a", 3)]
