import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import pq_negatives, queries

SCHEMA = "vec_id long, label int, embedding array<double>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
LONG = (1 << 63) - 1


def brute(rows, anchor=lambda i: i % 10 == 0, k=5):
    held = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (i, label, v) in enumerate(held):
        if not anchor(i):
            continue
        scored = [(-max(-LONG, min(LONG, sum(x * y for x, y in zip(v, w)))), j, b, other) for b, (j, other, w) in enumerate(held) if b != a and len(w) == len(v)]
        for p, positive, _, _ in sorted(x for x in scored if x[3] == label)[:k]:
            inside = sorted(x for x in scored if x[3] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)
            out += [(i, positive, n + 1, j, -p, -s) for n, (s, j, _, _) in enumerate(inside[:k])]
    return sorted(out)


def run(spark, rows):
    found = pq_negatives.hard_negatives(pq_negatives.labelled_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)), F.col("id") % 10 == 0)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


def _cloud(n, dims=9, labels=3, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(labels, dims)) * 0.5
    return [(i, int(c), (centre[c] + r.normal(size=dims) * 0.6).tolist()) for i in range(n) for c in [r.integers(labels)]]


@pytest.mark.parametrize("shard,block", [(8192, 32 << 20), (40, 900)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(pq_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(pq_negatives, "BLOCK_BYTES", block)
    rows = _cloud(260)
    want = brute(rows)
    assert want and run(spark, rows) == want


def test_odd_rows(spark):
    rows = _cloud(120, dims=3)
    rows += [(10, 1, [1.0, 0.5, 0.0])] * 3 + [(33, 2, [1.0, 0.5, 0.0])] * 8  # repeated rows and a common vector
    rows += [(None, 1, [1.0, 1.0, 1.0]), (200, None, [1.0, 1.0, 1.0]), (201, 1, None), (202, 1, [None, 1.0, 1.0]), (210, 1, [math.nan, 1.0, 1.0]), (204, 2, [math.inf, 0.0, 0.0])]
    rows += [(300 + i, i % 2, [0.25 * i, 1.0]) for i in range(12)] + [(400 + i, i % 2, []) for i in range(4)] + [(500, 5, [1.0, 2.0, 3.0, 4.0])]
    assert run(spark, rows) == brute(rows)


def test_scores_beyond_64_bits(spark):
    r = random.Random(4)
    rows = [(i, i % 2, [r.uniform(-1, 1) * 2.0 ** r.choice([3, 30, 41]) for _ in range(4)]) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [1.0]), (2, 0, [1.0])]) == []  # no anchor
    assert run(spark, [(10, 1, [1.0]), (2, 1, [1.0])]) == []  # no other label


def test_bound_holds_and_filters():
    rows = _cloud(3000, dims=16, labels=5)
    v = np.floor(np.array([x[2] for x in rows]) * 256).astype(np.int64)
    parts = pq_negatives._parts(v, 8)
    words = np.stack([np.resize(pq_negatives._fit(parts[:, p], 256), (256, 2)) for p in range(8)])
    code = np.stack([pq_negatives._nearest(parts[:, p], words[p]) for p in range(8)], axis=1)
    left = parts - np.stack([words[p][code[:, p]] for p in range(8)], axis=1)
    residual = np.sqrt((left**2).sum(axis=(1, 2))) * (1 + 1e-9)
    about = sum((parts[:20, p] @ words[p].T)[:, code[:, p]] for p in range(8))
    bound = np.sqrt((v[:20].astype(float) ** 2).sum(axis=1))[:, None] * residual
    assert (np.abs(v[:20] @ v.T - about) <= bound + 1e-6).all()
    ends = pq_negatives._Anchors(np.arange(20), np.array([x[1] for x in rows[:20]]), v[:20], [[-LONG]] * 20, [[LONG]] * 20, True, 5)
    search = pq_negatives._Search(ends, words)
    ids, labels = np.arange(3000), np.array([x[1] for x in rows])
    for s in range(0, 3000, 300):
        search.add(ids[s : s + 300], ids[s : s + 300], labels[s : s + 300], v[s : s + 300], code[s : s + 300].astype(np.uint8), residual[s : s + 300], False)
    assert search.exact < 0.25 * 20 * 3000 / 5  # a quarter of the rows of the own label at most


def test_query_columns(spark):
    assert queries.QUERIES["op13_pq_negatives"](spark, "/root/testdata/sf0.001").columns == COLUMNS
