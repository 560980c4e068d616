import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import curve_sharding, queries

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2), (5, 1)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    cells = [f"id >> {bits * j} & {(1 << bits) - 1}" for j in range(dims)]
    points = spark.range(1 << dims * bits).select(*[F.expr(c).cast("int").alias(f"c{j}") for j, c in enumerate(cells)])
    names = [F.col(f"c{j}") for j in range(dims)]
    walked = [r[:dims] for r in points.select(*names, curve_sharding.hilbert_index(names, bits).alias("h")).orderBy("h").collect()]
    assert len(set(walked)) == 1 << dims * bits
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(walked, walked[1:]))


def _documents():
    r = random.Random(5)
    rows = [(i, r.choice(["", "é😀", "word " * r.randrange(40)]), r.choice("aaaaab") * 3, r.choice(["de", "en", None]), r.choice([None, r.randrange(9000)])) for i in range(300)]
    same = [(7, "a copy", "hot", "en", 6)] * 90
    return rows + same + [(None, None, None, None, None)] * 3 + [(5, "x" * 60_000, "", "", -1)]


def _brute_cells(values, cells):
    held = sorted(v for v in values if v is not None)
    return [0 if v is None else -(-sum(h <= v for h in held) * cells // len(held)) - 1 for v in values]


def test_shards_against_brute_force(spark):
    rows = _documents()
    got = curve_sharding.assign_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), shards=7).collect()
    assert len(got) == len(rows)
    cells = list(zip(*[_brute_cells([r[i] for r in rows], 64) for i in (2, 3, 4)]))
    body = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(((r.doc_id, r.size, r.text_crc32, *r.cells) for r in got), key=key) == sorted(((*b, *c) for b, c in zip(body, cells)), key=key)
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r)
    assert sorted(held) == list(range(7)) and max(map(len, held.values())) - min(map(len, held.values())) <= 1
    in_order = []
    for s in range(7):
        assert sorted(r.slot for r in held[s]) == list(range(len(held[s])))
        in_order += [(r.curve, *key((r.doc_id, r.size, r.text_crc32))) for r in sorted(held[s], key=lambda r: r.slot)]
    assert in_order == sorted(in_order)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_few_and_no_documents(spark):
    assert curve_sharding.assign_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    few = curve_sharding.assign_documents(spark.createDataFrame(_documents()[:5], SCHEMA)).collect()
    assert all(r.slot == 0 for r in few) and len({r.shard for r in few}) == 5
    nulls = curve_sharding.assign_documents(spark.createDataFrame([(i, None, None, None, None) for i in range(48)], SCHEMA)).collect()
    assert {(r.curve, r.size, r.text_crc32) for r in nulls} == {(0, 8, 0)}


def test_clashing_names_and_written_shards(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "id % 7 AS position", "CAST(id % 5 AS STRING) AS kind", "DATE'2024-01-01' + CAST(id % 90 AS INT) AS day", "'old' AS curve", "id AS _at_", "1 AS slot")
    sharded = curve_sharding.shard_by_curve(rows, ["position", "kind", "day"], ["id"], shards=10)
    path = str(tmp_path / "shards")
    curve_sharding.write_shards(sharded, path)
    back = spark.read.parquet(path)
    assert back.count() == 500 and {r["count"] for r in back.groupBy("shard").count().collect()} == {50}
    ranges = curve_sharding.shard_ranges(sharded.drop("curve"), ["kind", "day"])
    wanted = {"kind": ("2", "2"), "day": ("2024-01-01", "2024-01-20")}
    left = {r.shard for r in curve_sharding.prune(ranges, wanted).collect()}
    hit = {r.shard for r in back.where("kind = '2' AND day <= '2024-01-20'").select("shard").distinct().collect()}
    assert hit <= left and len(left) < 10


def test_query_columns(spark):
    assert queries.QUERIES["op12_hilbert_shards"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve", "cells"]
