"""Toxicity scores of a factorization machine over hashed terms.

A text's terms are its distinct words and the beginnings of its words, hashed.
Besides a weight, every term has a short vector; the products of the vectors of
two terms present add to the score, so pairs such as an insult with a group
mention count beyond the sum of their parts.

Fitting reads at most ``MAX_ROWS`` labelled rows (those with the smallest hash
of the id), so the model, the terms kept and the driver's work are bounded
whatever the size of the input. Term statistics of these rows are counted in
Spark; only terms that tell the labels apart, ``MAX_TERMS`` at most, reach the
driver's fit. Scoring runs over whole texts in Arrow batches.

Defined results: a null text counts as empty; empty texts get the score of the
intercept; without labelled rows of both kinds every score is the share of
toxic rows (0.0 without any); repeated rows give repeated rows; a label that is
null or that contradicts another of the same id takes no part or counts for
each row it joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, scratch, small_batches, text_of

#: Labelled rows that the fit reads at most.
MAX_ROWS = 20_000
#: Terms of the model at most, those with the largest scores against chance, and the least score.
MAX_TERMS = 2048
LEAST_Z = 6.0
SPACE = 1 << 24
PREFIXES = (4, 5, 6)
RANK = 6
#: Penalties that the vectors may get, and the folds of the training rows that choose among them.
PAIR_L2 = (1e-4, 2e-4, 4e-4)
FOLDS = 2
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def terms(text: str) -> np.ndarray:
    """Sorted hashed terms of a whole text: its distinct words and word beginnings."""
    words = set(_WORD.findall(text.lower()))
    found = [crc32(w.encode("utf-8", "surrogatepass")) for w in words]
    for n in PREFIXES:
        found += [crc32(w.encode("utf-8", "surrogatepass"), n) for w in {w[:n] for w in words if len(w) >= n}]
    return np.unique(np.array(found, np.int64) % SPACE)


@dataclass
class Machine:
    """Intercept, and for each sorted term a weight and a vector."""

    base: float
    ids: np.ndarray
    weight: np.ndarray
    vector: np.ndarray

    def known(self, found: np.ndarray) -> np.ndarray:
        """Places in ``ids`` of those terms that the model has."""
        at = np.searchsorted(self.ids, found)
        at[at == len(self.ids)] = 0
        return at[self.ids[at] == found] if len(self.ids) else at[:0]

    def margin(self, at: np.ndarray) -> float:
        """The score before the logistic function, of terms at these places."""
        v = self.vector[at]
        total = v.sum(axis=0)
        return self.base + float(self.weight[at].sum()) + 0.5 * float(total @ total - (v * v).sum())

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(self.known(terms(text))), -30, 30))))


def _sums(values: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that begin at ``at``; zero where ``mask`` says that a run is empty."""
    out = np.zeros((len(mask), *values.shape[1:]))
    out[mask] = np.add.reduceat(values, at[mask], axis=0)
    return out


def _descend(rows: list[np.ndarray], labels: np.ndarray, model: Machine, free: slice, l2: float, steps: int, of: int | None = None) -> Machine:
    """Logistic loss by full-batch Adam over the columns ``free`` of (weight, vector), the others held, and the intercept with the weights.

    The loss is the mean over ``of`` rows, where others have no part in the gradient (all, if None).
    """
    n, m, base = len(rows), len(model.ids), model.base
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    term = np.concatenate(rows)
    if not len(term):
        return model
    order = np.argsort(term, kind="stable")  # for sums by term
    by_term, doc_of = term[order], doc[order]
    term_at = np.searchsorted(by_term, np.arange(m))
    present = np.diff(np.concatenate([term_at, [len(by_term)]])) > 0
    has = np.diff(np.searchsorted(doc, np.arange(n + 1))) > 0
    doc_at = np.searchsorted(doc, np.arange(n))
    theta = np.concatenate([model.weight[:, None], model.vector], axis=1)
    start, moves_base = theta[:, free].copy(), free.start == 0
    first, second = np.zeros((m + 1, start.shape[1])), np.zeros((m + 1, start.shape[1]))
    for step in range(1, steps + 1):
        held = theta[term]
        total = _sums(held, doc_at, has)
        squares = _sums(held[:, 1:] ** 2, doc_at, has).sum(axis=1)
        z = base + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - squares)
        wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / (of or n)
        back = np.ones((len(by_term), theta.shape[1]))
        back[:, 1:] = total[doc_of, 1:] - theta[by_term, 1:]
        grad = np.zeros_like(first)
        grad[:m] = _sums((back * wrong[doc_of, None])[:, free], term_at, present) + l2 * theta[:, free]
        grad[m, 0] = wrong.sum() if moves_base else 0.0
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        theta[:, free] -= move[:m]
        base -= float(move[m, 0]) if moves_base else 0.0
    return Machine(base, model.ids, theta[:, 0].copy(), theta[:, 1:].copy())


def _with_pairs(rows: list[np.ndarray], labels: np.ndarray, linear: Machine, rank: int, l2: float, steps: int, seed: int) -> Machine:
    """The vectors fitted to what the weights leave unexplained; rows of under two terms have no pairs."""
    paired = [i for i, r in enumerate(rows) if len(r) > 1]
    vector = np.random.default_rng(seed).normal(0, 0.05, (len(linear.ids), rank))
    vector[np.setdiff1d(np.arange(len(vector)), np.concatenate([rows[i] for i in paired] or [np.zeros(0, int)]))] = 0.0
    begun = Machine(linear.base, linear.ids, linear.weight, vector)
    return _descend([rows[i] for i in paired], labels[paired], begun, slice(1, None), l2, steps, len(rows)) if paired else begun


def _loss(rows: list[np.ndarray], labels: np.ndarray, model: Machine) -> float:
    """Summed logistic loss."""
    z = np.array([model.margin(r) for r in rows])
    return float(np.logaddexp(0, np.where(labels > 0, -z, z)).sum())


def fit(rows: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, rank: int = RANK, steps: int = 300, l2: float = 1e-4, seed: int = 7, fold: np.ndarray | None = None) -> Machine:
    """Weights first, then the vectors on what they leave. rows: places in ``ids`` of each text's terms.

    The penalty of the vectors is the one of ``PAIR_L2`` with the least loss on folds of these rows that were left out (``fold``
    has the number of each row's; dealt in turn if None). If none of them beats weights alone there, the vectors are zero.
    """
    n, m = len(rows), len(ids)
    rate = float(labels.mean()) if n else 0.0
    base = float(np.log(np.clip(rate, 1e-6, 1 - 1e-6) / (1 - np.clip(rate, 1e-6, 1 - 1e-6))))
    if not n or not m or rate in (0.0, 1.0):
        return Machine(base, ids[:0], np.zeros(0), np.zeros((0, rank)))
    bare = Machine(base, ids, np.zeros(m), np.zeros((m, 0)))
    weights = lambda some: _descend([rows[i] for i in some], labels[some], bare, slice(0, 1), l2 / n**0.5, steps)
    linear = weights(np.arange(n))
    if not rank:
        return linear
    fold = np.arange(n) % FOLDS if fold is None else fold
    lost = np.zeros(1 + len(PAIR_L2))
    for k in range(FOLDS):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not len(inside) or not len(outside):
            continue
        of = lambda some: ([rows[i] for i in some], labels[some])
        part = weights(inside)
        tried = [part] + [_with_pairs(*of(inside), part, rank, x, steps, seed) for x in PAIR_L2]
        lost += [_loss(*of(outside), x) for x in tried]
    best = int(np.argmin(lost))
    return _with_pairs(rows, labels, linear, rank, PAIR_L2[best - 1], steps, seed) if best else Machine(linear.base, ids, linear.weight, np.zeros((m, rank)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK) -> Machine:
    """Fit on at most ``max_rows`` labelled rows of ``labels`` (id, toxic); ``rank`` 0 leaves the pairs out."""
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark):
        chosen = labels.select(F.col(id_col).alias("_lid"), F.col("toxic").cast("int").alias("y")).where("_lid IS NOT NULL AND y IN (0, 1)")
        # The sample is bounded by max_rows, so its ids can be broadcast.
        chosen = cut(chosen.orderBy(F.xxhash64("_lid"), "_lid", "y").limit(max_rows), "op3-sample")
        texts = docs.select(F.col(id_col).alias("_did"), text_of(docs, text_col).alias("t"))
        sample = texts.join(F.broadcast(chosen), F.col("_did") == F.col("_lid")).select("y", "t")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [terms(t.as_py()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["y", "terms"])

        # Equal texts have equal terms, so they lie in one fold.
        rows = cut(sample.mapInArrow(run, "y int, terms array<bigint>").withColumn("fold", F.pmod(F.xxhash64("terms"), F.lit(FOLDS)).cast("int")), "op3-terms")
        n, toxic = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
        if not n or toxic in (0, n):
            return fit([np.zeros(0, int)] * n, np.full(n, float(bool(toxic))), np.zeros(0, np.int64))
        share = toxic / n
        expected = F.col("n") * share
        counted = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("y").alias("n"), F.sum("y").alias("k"))
        scored = counted.where("n >= 3").withColumn("z", (F.col("k") - expected) / F.sqrt(expected * (1 - share)))
        best = scored.where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "term").limit(MAX_TERMS).select("term")
        ids = np.array(sorted(r[0] for r in best.collect()), np.int64)
        kept = rows.withColumn("terms", F.array_intersect("terms", F.array(*[F.lit(int(i)) for i in ids]).cast("array<bigint>"))) if len(ids) else rows
        data = kept.toArrow().to_pydict() if len(ids) else {"y": [], "terms": [], "fold": []}
        order = sorted(range(len(data["y"])), key=lambda i: (data["y"][i], data["terms"][i], data["fold"][i]))  # the fit does not depend on row order
        places = [np.searchsorted(ids, np.array(sorted(data["terms"][i]), np.int64)) for i in order]
        return fit(places, np.array([data["y"][i] for i in order], float), ids, rank, fold=np.array([data["fold"][i] for i in order])) if len(ids) else fit([np.zeros(0, int)] * n, np.repeat([0.0, 1.0], [n - toxic, toxic]), ids)


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; only the text is an input of the score."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col), text_of(docs, text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def learning_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled rows that models may learn from."""
    return labels.where(crc_mod(id_col, 4) != 2)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, learning_labels(labels), max_rows))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [model.score(t.as_py() or "") < threshold for t in b.column(names.index(text_col))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
