"""Order segments, gaps, correlations in blocks, duplicate marks, page index, catalog log, cleaning of many columns."""

import random
import statistics
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import quality as Q
from quarrylens.operators import segments
from quarrylens.operators import series as S
from quarrylens.sources import dataset


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(segments, "BITS", 12)


def _trend(rows, least=6):
    out = []
    for i in range(len(rows[0]) - 2):
        x = [r[2 + i] for r in sorted(rows, key=lambda r: r[:2]) if r[2 + i] is not None]
        up, down = all(b >= a for a, b in zip(x, x[1:])), all(b <= a for a, b in zip(x, x[1:]))
        if len(x) >= least and (up or down):
            out.append((f"c{i}", len(x), "increasing" if up else "decreasing"))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_trends_over_many_segments(spark, small_groups, seed):
    r = random.Random(seed)
    # A third of the rows have one key, the others lie far apart, up to 2**60 and below zero.
    keys = [7] * 60 + [r.choice([-1, 1]) * r.randrange(1 << 60) for _ in range(100)] + [(1 << 60) + i for i in range(20)]
    rows = sorted((k, t) for t, k in enumerate(keys))
    wrong = r.randrange(len(rows))
    rows = [(k, t, float(i), -i / 2, float(i // 50) if i % 3 else None, -1.0 if i == wrong else i * 1.0, 5.0, None) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k long, t long, c0 double, c1 double, c2 double, c3 double, c4 double, c5 double").repartition(4)
    got = sorted(tuple(x) for x in Q.monotonic(df, [f"c{i}" for i in range(6)], "k", tie="t").collect())
    assert got == _trend(rows)


def test_trends_by_time_and_without_rows(spark):
    df = spark.range(100).selectExpr("timestamp_micros(id * 86400000000 * 40) AS t", "id AS up", "'a' AS s")
    assert [tuple(r) for r in Q.monotonic(df, ["up"], "t").collect()] == [("up", 100, "increasing")]
    assert Q.monotonic(df.limit(0), ["up"], "t").count() == 0
    with pytest.raises(ValueError):
        Q.monotonic(df, ["up"], "s")


@pytest.mark.parametrize("bits", [12, 20])
def test_gaps_of_clustered_moments(spark, monkeypatch, bits):
    monkeypatch.setattr(segments, "BITS", bits)
    r = random.Random(bits)
    ms = [1_600_000_000_000 + r.randrange(400) for _ in range(500)] + [r.randrange(10**13) for _ in range(100)] + [-5_000_000_000, -5_000_000_000]
    gaps = [b - a for a, b in zip(sorted(ms), sorted(ms)[1:])]
    df = spark.createDataFrame([(m,) for m in ms], "m long").select(F.timestamp_millis("m").alias("t"))
    counted = {g: n for g, n in S.gap_counts(df, "t").collect()}
    assert counted == {g: gaps.count(g) for g in gaps}
    row = S.date_gaps(df, "t").first()
    assert row[0] == round(max(gaps) / S.DAY_MS, 1) and row[1] == pytest.approx(statistics.median(gaps) / S.DAY_MS, abs=0.06)
    assert tuple(S.date_gaps(df.limit(0), "t").first()) == (None, None, None) and S.date_gaps(df.limit(1), "t").first()[0] is None


def test_many_distinct_moments_of_one_month(spark):
    df = spark.range(300_000, numPartitions=8).select(F.timestamp_millis(F.col("id") * 7 + 1_700_000_000_000).alias("t"))
    assert {g: n for g, n in S.gap_counts(df, "t").collect()} == {7: 299_999}


@pytest.mark.parametrize("block", [7, 256])
def test_correlations_in_blocks_equal_those_of_pairs(spark, block):
    r = np.random.default_rng(block)
    base = r.normal(size=(400, 3)) @ r.normal(size=(3, 20)) + r.normal(size=(400, 20)) + 1e7  # far from zero
    rows = [[float(x) if r.random() > 0.2 else None for x in line[:17]] + [3.0, float(line[0]) if i < 4 else None, None] for i, line in enumerate(base)]
    df = spark.createDataFrame(rows, ", ".join(f"`a b{i}` double" for i in range(20)))
    from itertools import combinations

    pairs = list(combinations(df.columns, 2))
    want = {(x["col_a"], x["col_b"]): (x["n"], x["raw"]) for x in S._pairwise(df, pairs).collect()}
    got = {(x["col_a"], x["col_b"]): (x["n"], x["raw"]) for x in S.blocked_moments(df, df.columns, block).collect()}
    assert got.keys() == want.keys()
    for p, (n, raw) in want.items():
        assert got[p][0] == n and (n < 5 or "a b17" in p or got[p][1] == pytest.approx(raw, abs=1e-9))
    shown = {(x["col_a"], x["col_b"]): x["r"] for x in S.correlations(df).collect()}
    assert shown["a b0", "a b17"] is None and shown["a b0", "a b19"] is None and shown["a b0", "a b1"] == pytest.approx(want["a b0", "a b1"][1], abs=1e-4)


@pytest.mark.parametrize("hashes", [1, 3, 2**62])
def test_marked_duplicates(spark, hashes):
    r = random.Random(hashes)
    rows = [(i, r.choice(["a", None, ""]), r.choice([None, "a"]), r.choice([0.0, -0.0, float("nan"), 1.5])) for i in range(120)] + [(500 + i, "hot", "hot", 2.0) for i in range(60)]
    seen, want = {}, set()
    for i, a, b, x in rows:
        first = seen.setdefault((a, b, "nan" if x != x else x + 0.0), i)
        want.add((i, first != i, first))
    got = Q.mark_duplicates(spark.createDataFrame(rows, "_row_id long, a string, b string, x double").repartition(4), hashes=hashes)
    assert {tuple(x) for x in got.collect()} == want


@pytest.mark.parametrize("rows", [1, 5, 10_000])
def test_page_index(spark, rows):
    r = random.Random(rows)
    ids = sorted([-(1 << 62), 1 << 62] + [r.randrange(1000) for _ in range(200)] + [5] * 30)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    index = dataset.PageIndex.build(df, "id", rows)
    assert index.rows == len(ids) and index.pages(20) == 12
    for n in (1, 2, 7, 12):
        assert [x[0] for x in index.page(n, 20).collect()] == ids[(n - 1) * 20 : n * 20]
    assert index.page(13, 20).count() == 0 and dataset.PageIndex.build(df.limit(0), "id").pages() == 0


def test_catalog_states_versions_and_sync(spark, tmp_path):
    name = f"shelf{random.randrange(10**9)}"
    c, other = dataset.Catalog(spark, name), dataset.Catalog(spark, name + "b")
    try:
        v = c.save("a table", spark.range(3), note="it's \\ fine")
        assert c.facts("a table") == {"rows": "3", "columns": "1", "note": "it's \\ fine"}
        assert [r["state"] for r in c.log("a table").orderBy("version").collect()] == ["uploading", "analysing", "ready"]
        c.save("b", spark.range(5))
        assert c.names(ready=True) == ["b", "a table"] and c.active() == "b"
        c.activate("a table")
        assert c.active() == "a table" and c.names(ready=True) == ["b", "a table"]
        with pytest.raises(dataset.Conflict):
            c.save("a table", spark.range(9), follows=v)
        with pytest.raises(Exception):
            c.save("broken", spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
        assert {r["name"]: r["state"] for r in c.states().collect()}["broken"] == "failed" and "broken" not in c.names(ready=True)
        other.save("b", spark.range(1))
        assert other.sync(c) == ["a table"] and other.load("a table").count() == 3 and other.load("b").count() == 1
        c.drop("a table"), c.drop("never there")
        assert c.active() == "b" and "a table" not in c.names()
        with pytest.raises(KeyError):
            c.load("a table")
    finally:
        c._remove(c.root), other._remove(other.root)


def test_no_entry_of_two_writers_is_lost(spark):
    c = dataset.Catalog(spark, f"shelf{random.randrange(10**9)}")

    def write(k):
        for _ in range(60):
            try:
                return c.append("t", "uploading", facts={"k": str(k)})
            except dataset.Conflict:
                continue
        raise AssertionError("never written")

    try:
        with ThreadPoolExecutor(3) as pool:
            versions = sorted(pool.map(write, range(5)))
        log = c.log("t").collect()
        assert len(set(versions)) == 5 and sorted(r["facts"]["k"] for r in log) == list("01234")
    finally:
        c._remove(c.root)


def test_cleaning_thirty_columns(spark, capfd):
    cells = ["$1,500", "N/A", "12", " x ", "15-06-2023", None, "1200kg", "", "(500)", "---"]
    rows = [(i, *[cells[(i + j) % 10] for j in range(30)]) for i in range(40)]
    names = [f"c{j}" for j in range(30)]
    df = spark.createDataFrame(rows, "_row_id long, " + ", ".join(f"{n} string" for n in names))
    types = {n: ["numeric", "date", "text"][j % 3] for j, n in enumerate(names)}
    clean, seen = Q.cleanse_observed(df, types, "_row_id")
    out = sorted(clean.collect(), key=lambda r: r["_row_id"])
    assert out[0]["c0"] == 1500.0 and out[4]["c1"] is None and out[3]["c1"] == "2023-06-15" and out[0]["c2"] == "12" and out[1]["c2"] == "x"
    report = {r["column"]: r for r in Q.cleaning_report(df, types, "_row_id").collect()}
    for n in names:
        assert all(report[n][k] == seen.get[f"{k}/{n}"] for k in ("numbers", "dates", "nulls", "others"))
        assert report[n]["changed"] == sum(report[n][k] for k in ("numbers", "dates", "nulls", "others"))
    assert report["c0"]["numbers"] == 8 and report["c0"]["nulls"] == 8 and report["c1"]["dates"] == 4
    assert report["c0"]["samples"] == "$1,500 -> 1500.0; N/A -> null;  x  -> null"
    assert "grows beyond" not in capfd.readouterr().err


def test_score_counts_rows_not_ids(spark):
    types = {"x": "numeric"}
    scores = []
    for step in (1, 7):
        rows = spark.range(2000).selectExpr(f"id * {step} + 3 AS _row_id", "CASE WHEN id % 2 = 0 THEN 'abc' ELSE CAST(id AS STRING) END AS x")
        scores.append(tuple(Q.quality_score(rows, types).first()))
    assert scores[0] == scores[1] and scores[0][3] == 50.0


def test_spellings_leave_wide_columns_alone(spark):
    df = spark.range(3000).selectExpr("'u' || id AS unique", "CASE id % 3 WHEN 0 THEN 'New York' WHEN 1 THEN 'new-york' ELSE 'NY' END AS city")
    from quarrylens.operators.columns import narrow_columns

    assert narrow_columns(df, ["unique", "city"], 199) == ["city"]
    assert [(r["column"], r["values"]) for r in Q.fuzzy_duplicates(df, ["unique", "city"]).collect()] == [("city", "New York | new-york")]
    assert Q.fuzzy_duplicates(df, ["unique"]).count() == 0
