"""Results of whole queries against plain versions of them."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quarrylens.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def test_tokens_of_the_query(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = set()
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = other.encode_ordinary(row["text"] or "")
        expected.add((row["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((row["text"] or "").encode())))
    got = queries.QUERIES["op8_bitmap_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(expected) and set(map(tuple, got)) == expected


def _toxic_rows(n: int):
    r = random.Random(8)
    rows = []
    for i in range(n):
        words = [r.choice(["sun", "rain", "road", "tree"]) + str(r.randint(0, 30)) for _ in range(20)]
        bad = r.random() < 0.3
        words += [r.choice(["nasty", "vile", "awful"]) for _ in range(2 * bad)]
        rows.append((i, " ".join(words), int(bad and r.random() < 0.95)))
    return rows


def test_scores_of_the_query_by_all_pairs(spark):
    """The score is the logistic function of the intercept, the weights and the products of all pairs of vectors."""
    rows = _toxic_rows(500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.learning_labels(labels))
    got = {x["doc_id"]: x for x in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 2
    for i, text in [(i, t) for i, t, _ in rows] + [(900, ""), (901, "")]:
        at = [k for k, t in enumerate(model.ids) if t in set(toxicity.terms(text).tolist())]
        z = model.base + sum(model.weight[a] for a in at) + sum(model.vector[a] @ model.vector[b] for n, a in enumerate(at) for b in at[n + 1 :])
        score = 1 / (1 + np.exp(-z))
        assert got[i]["score"] == pytest.approx(score, rel=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


@pytest.mark.parametrize("paired", [False, True])
def test_pairs_are_learned_only_where_they_tell(paired):
    """On rows that were not fitted, pairs lose next to nothing where labels are additive, and gain much where they are not."""
    rng = np.random.default_rng(5)
    on = rng.random((1600, 12)) < 0.4
    z = 4.0 * (on[:, 0] ^ on[:, 1]) - 2.0 if paired else 3.0 * on[:, 0] + 2.0 * on[:, 1] - 3.0
    labels = (rng.random(1600) < 1 / (1 + np.exp(-z))).astype(float)
    rows, ids = [np.flatnonzero(x) for x in on], np.arange(12)
    linear, machine = (toxicity.fit(rows[:800], labels[:800], ids, rank) for rank in (0, toxicity.RANK))
    lost = [toxicity._loss(rows[800:], labels[800:], x) / 800 for x in (linear, machine)]
    assert lost[1] < lost[0] - 0.1 if paired else lost[1] < lost[0] + 0.02


def test_pairs_without_any_pair():
    rows = [np.array([i % 2]) for i in range(40)]
    m = toxicity.fit(rows, np.array([float(i % 2) for i in range(40)]), np.array([3, 9]))
    assert not m.vector.any() and m.weight[1] > m.weight[0]
