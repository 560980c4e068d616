"""Hashed maximum-entropy language model with a class-factored softmax.

    P(word | history) = P(class of word | history) * P(word | its class)

The class factor is a softmax over hashed features of the history: the word
before (an n-gram feature, its own bucket for frequent words, a hashed bucket
by word ending for others), the class of the word before that (a skip feature),
and the pair of the two classes. The word factor has a word's own indicator as
its only feature, whose maximum-entropy weights are the discounted log counts.

Every statistic covers all training texts: word counts; neighbour profiles of
the ``PROFILED`` most frequent words, from which their classes come; and the
counts of (history, class). Those counts are all that the likelihood needs, so
the distributed gradient updates run over a table of bounded size instead of the
texts. Words are counted in a shuffle; only the ``FREQUENT`` most frequent, a
table of bounded size, go to every task, and all others meet their counts in a
join.

Words the training texts lack are one type, whose share of a class is the share
of words seen once (Good-Turing); so the model's probabilities sum to one over
the known words, the end and that type.

Defined results: a null text counts as empty and has one token, the end; an
empty table gives an empty result; without training texts the classes are
uniform, and base scores are 0 (V = N = 0); repeated rows give repeated rows; a null id hashes as an empty text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, small_batches, text_of

#: Words whose counts every task holds, and those of them with neighbour profiles.
FREQUENT, PROFILED = 1 << 17, 1 << 13
#: Most frequent words that make up the profiles.
CONTEXTS = 96
#: Word classes (the last is the end), buckets of the word before, and of word endings.
CLASSES, BUCKETS, ENDINGS = 48, 512, 1 << 12
#: Gradient updates over the whole table of history counts.
UPDATES, RATE = 30, 0.4
#: Distinct words a task holds before it hands its counts on.
HELD = 300_000

END = CLASSES - 1


def tokens(text: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case; splits at the contract's white space only."""
    return text.lower().split()


def ending(word: bytes) -> int:
    """Bucket of a word by its last three bytes."""
    return crc32(word[-3:]) % ENDINGS


@dataclass
class Model:
    """What tasks need to score: all of bounded size."""

    words: list[bytes]
    counts: np.ndarray
    word_class: np.ndarray
    ending_class: np.ndarray
    table: np.ndarray  # (BUCKETS, CLASSES, CLASSES): log10 P(class | bucket before, class before that)
    class_tokens: np.ndarray
    class_once: np.ndarray
    train_tokens: int = 0
    types: int = 0
    end_count: int = 0
    index: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"index": {}}

    def ready(self) -> "Model":
        if not self.index and self.words:
            self.index = {w: i for i, w in enumerate(self.words)}
        return self

    def base(self, c):
        """log10 of the add-one share of a token that occurs c times."""
        return np.log10((np.asarray(c) + 1.0) / (self.train_tokens + self.types + 1.0))

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 of what a known word's count is multiplied by in its class, and of an unknown word's share."""
        once, total = self.class_once + 0.5, self.class_tokens + 1.0
        unknown = np.minimum(once / (total + 0.5), 0.9)
        unknown = np.where(self.class_tokens > 0, unknown, 1.0)
        known = np.where(self.class_tokens > 0, (1 - unknown) / np.maximum(self.class_tokens, 1), 1.0)
        return np.log10(known), np.log10(unknown)


def _ids(found: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    get = index.get
    return np.array([get(w, -1) for w in found], np.int64)


def _classes(found: list[bytes], ids: np.ndarray, word_class: np.ndarray, ending_class: np.ndarray) -> np.ndarray:
    out = np.where(ids >= 0, word_class[ids], 0) if len(word_class) else np.zeros(len(ids), np.int64)
    rare = np.flatnonzero(ids < 0)
    if len(rare):
        out[rare] = ending_class[[crc32(found[i][-3:]) % ENDINGS for i in rare.tolist()]]
    return out


def _buckets(found: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Bucket of each word as a word before: 0 is the text's start, frequent words have their own."""
    own = BUCKETS - 129
    out = np.where((ids >= 0) & (ids < own), ids + 1, 0)
    rest = np.flatnonzero(out == 0)
    if len(rest):
        out[rest] = BUCKETS - 128 + np.array([crc32(found[i][-3:]) & 127 for i in rest.tolist()], np.int64)
    return out


def _histories(found: list[bytes], ids: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the word before, class of the word before that, class) of each token, the end last."""
    n = len(found)
    before, skip, target = np.zeros(n + 1, np.int64), np.full(n + 1, END), np.full(n + 1, END)
    before[1:] = _buckets(found, ids)
    skip[2:] = classes[: n - 1] if n else 0
    target[:n] = classes
    return before, skip, target


# ---- training ---------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "c"])

    for b in batches:
        for t in b.column(0):
            held.update(tokens(t.as_py()))
            if len(held) >= HELD:
                yield emit()
                held.clear()
    if held:
        yield emit()


def _sparse(counts: np.ndarray) -> pa.RecordBatch:
    cell = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell].astype(np.int64))], ["cell", "n"])


def _emit_sparse(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    whole = _sparse(counts)
    for at in range(0, whole.num_rows, 100_000):
        yield whole.slice(at, 100_000)


def _profile(shared):
    """Counts of (profiled word, side, neighbour among the most frequent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        index = {w: i for i, w in enumerate(words)}
        counts = np.zeros(PROFILED * 2 * CONTEXTS, np.int64)
        for b in batches:
            for t in b.column(0):
                ids = _ids(tokens(t.as_py()), index)
                a, z = ids[:-1], ids[1:]
                left, right = (z >= 0) & (a >= 0) & (a < CONTEXTS), (a >= 0) & (z >= 0) & (z < CONTEXTS)
                cells = np.concatenate([(2 * z[left]) * CONTEXTS + a[left], (2 * a[right] + 1) * CONTEXTS + z[right]])
                np.add.at(counts, cells, 1)
        yield from _emit_sparse(counts)

    return run


def _history_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.ready()
        counts = np.zeros(BUCKETS * CLASSES * CLASSES, np.int64)
        for b in batches:
            for t in b.column(0):
                found = tokens(t.as_py())
                ids = _ids(found, m.index)
                before, skip, target = _histories(found, ids, _classes(found, ids, m.word_class, m.ending_class))
                np.add.at(counts, (before * CLASSES + skip) * CLASSES + target, 1)
        yield from _emit_sparse(counts)

    return run


def _cluster(profile: np.ndarray, weight: np.ndarray, k: int, seed: int = 11, rounds: int = 15) -> np.ndarray:
    """Spherical k-means of the profiles; words with little profile go where the centres put them."""
    x = np.sqrt(profile)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(seed)
    n = len(x)
    if n <= k:
        return np.arange(n)
    centre = x[[int(rng.choice(n, p=weight / weight.sum()))]]
    while len(centre) < k:  # far from the centres so far, weighted by count
        gap = np.maximum(1 - (x @ centre.T).max(axis=1), 0) * np.sqrt(weight) + 1e-12
        centre = np.concatenate([centre, x[[int(rng.choice(n, p=gap / gap.sum()))]]])
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x * np.sqrt(weight)[:, None])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-12), centre)
    return (x @ centre.T).argmax(axis=1)


def _word_classes(words: list[bytes], counts: np.ndarray, cells: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Class of each frequent word, and of each word ending."""
    profiled = min(PROFILED, len(words))
    profile = np.zeros(PROFILED * 2 * CONTEXTS)
    profile[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    profile = profile.reshape(PROFILED, 2 * CONTEXTS)[:profiled]
    near = _cluster(profile, counts[:profiled].astype(float), CLASSES - 1) if profiled else np.zeros(0, np.int64)
    votes = np.zeros((ENDINGS, CLASSES - 1))
    for w, c, k in zip(words[:profiled], np.sqrt(counts[:profiled]), near):
        votes[ending(w), k] += c
    overall = votes.sum(axis=0)
    ending_class = np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), overall.argmax())
    classes = np.empty(len(words), np.int64)
    classes[:profiled] = near
    for i in range(profiled, len(words)):
        classes[i] = ending_class[ending(words[i])]
    return classes, ending_class


def _class_totals(shared):
    """(class, tokens, words seen once) over the word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.ready()
        total, once = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            found, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            k = _classes(found, _ids(found, m.index), m.word_class, m.ending_class)
            np.add.at(total, k, c)
            np.add.at(once, k[c == 1], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total), pa.array(once)], ["k", "total", "once"])

    return run


#: Features of the class factor: rows of a weight matrix, in this order.
_FEATURES = BUCKETS + CLASSES + CLASSES * CLASSES


def _active(before: np.ndarray, skip: np.ndarray, bucket_class: np.ndarray) -> np.ndarray:
    """Feature rows of each history: the word before, the skipped class, the pair of classes."""
    return np.stack([before, BUCKETS + skip, BUCKETS + CLASSES + bucket_class[before] * CLASSES + skip], axis=1)


def _gradient(weights, bucket_class):
    """Gradient of the log likelihood over some history counts, as the bytes of a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, of = weights.value, bucket_class
        grad = np.zeros((_FEATURES, CLASSES))
        for b in batches:
            history, start, first = np.unique(b.column("cell").to_numpy() // CLASSES, return_index=True, return_inverse=True)
            counts = np.zeros((len(history), CLASSES))
            np.add.at(counts, (first, b.column("cell").to_numpy() % CLASSES), b.column("n").to_numpy())
            rows = _active(history // CLASSES, history % CLASSES, of)
            z = w[rows].sum(axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            wrong = counts - counts.sum(axis=1, keepdims=True) * p
            for j in range(rows.shape[1]):
                np.add.at(grad, rows[:, j], wrong)
        yield pa.RecordBatch.from_arrays([pa.array([grad.astype(np.float32).tobytes()], pa.binary())], ["grad"])

    return run


def _class_table(weights: np.ndarray, bucket_class: np.ndarray) -> np.ndarray:
    history = np.arange(BUCKETS * CLASSES)
    z = weights[_active(history // CLASSES, history % CLASSES, bucket_class)].sum(axis=1)
    top = z.max(axis=1, keepdims=True)
    z = z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True))
    return (z / math.log(10)).astype(np.float32).reshape(BUCKETS, CLASSES, CLASSES)


def _fit_classes(cells: DataFrame, bucket_class: np.ndarray, updates: int) -> np.ndarray:
    """Distributed gradient updates (Adam) over the table of history counts."""
    sc = cells.sparkSession.sparkContext
    w = np.zeros((_FEATURES, CLASSES))
    total = float(cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    if not total:
        return w
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, updates + 1):
        shared = sc.broadcast(w)  # of fixed size
        parts = cells.mapInArrow(_gradient(shared, bucket_class), "grad binary").collect()  # a matrix of fixed size each
        grad = sum(np.frombuffer(r[0], np.float32).reshape(w.shape).astype(np.float64) for r in parts) / total
        grad -= 1e-7 * w
        first = 0.8 * first + 0.2 * grad
        second = 0.98 * second + 0.02 * grad**2
        rate = RATE / (1 + 3 * step / updates)
        w = w + rate * (first / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-10)
        shared.destroy()
    return w


def _most_frequent(counts: DataFrame, n: int) -> list:
    """The ``n`` most frequent words (w, c), ties to the smaller word.

    Taken straight from ``counts``, every partition would send ``n`` rows. A
    histogram, of at most 4,096 steps of the count, tells which words can be among
    them; those are about ``n``, and they are dealt to a few partitions.
    """
    step = F.floor(F.log2("c") * 64)
    least, held = 0, 0
    for at, size in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        least, held = at, held + size
        if held >= n:
            break
    return counts.where(step >= least).repartition(8, "w").orderBy(F.desc("c"), "w").limit(n).collect()


def train(texts: DataFrame, updates: int = UPDATES) -> tuple[Model, DataFrame]:
    """Model of the one-column binary ``texts``, and the table (w, c) of all word counts."""
    sc = texts.sparkSession.sparkContext
    counts = cut(texts.mapInArrow(_count_words, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")), "op5-counts")
    types, total = counts.agg(F.count("c"), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = texts.count()
    # A list of fixed greatest length, the counts of most tokens.
    top = _most_frequent(counts, FREQUENT)
    words, freq = [bytes(r[0]) for r in top], np.array([r[1] for r in top], np.int64)
    shared_words = sc.broadcast(words[:PROFILED])
    cells = texts.mapInArrow(_profile(shared_words), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    classes, ending_class = _word_classes(words, freq, cells)
    zero = np.zeros(CLASSES, np.int64)
    model = Model(words, freq, classes, ending_class, np.zeros(0), zero, zero, total + ends, types + (ends > 0), ends)
    shared = sc.broadcast(model)
    sums = counts.mapInArrow(_class_totals(shared), "k long, total long, once long").groupBy("k").agg(F.sum("total"), F.sum("once")).collect()
    model.class_tokens, model.class_once = zero.copy(), zero.copy()
    for k, n, once in sums:
        model.class_tokens[k], model.class_once[k] = n, once
    bucket_class = _bucket_classes(words, classes, ending_class)
    cells = texts.mapInArrow(_history_counts(shared), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = cut(cells.repartition(8, F.floor(F.col("cell") / CLASSES)), "op5-histories")
    model.table = _class_table(_fit_classes(table, bucket_class, updates), bucket_class)
    return model, counts


def _bucket_classes(words: list[bytes], classes: np.ndarray, ending_class: np.ndarray) -> np.ndarray:
    """A class for each bucket of the word before; buckets of endings share their commonest class."""
    out = np.full(BUCKETS, END, np.int64)
    own = min(BUCKETS - 129, len(words))
    out[1 : own + 1] = classes[:own]
    votes = np.zeros((128, CLASSES))
    for w, k in zip(words[own : own + 20_000], classes[own : own + 20_000]):
        votes[crc32(w[-3:]) & 127, k] += 1
    out[BUCKETS - 128 :] = votes.argmax(axis=1)
    return out


# ---- scoring ----------------------------------------------------------------------------------

_SCORED = "kind int, rid long, id {id}, n_tokens long, n_known long, base double, score double, w binary, k int, m long"


def _score(shared):
    """A row for each text (kind 0), and one for each of its rare words (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.ready()
        known_share, _ = m.shares()
        base_of, log_count = m.base(m.counts), np.log10(np.maximum(m.counts, 1))
        end_base = float(m.base(m.end_count))
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            rows, rare = [], []
            for t in b.column(1):
                found = tokens(t.as_py())
                ids = _ids(found, m.index)
                classes = _classes(found, ids, m.word_class, m.ending_class)
                before, skip, target = _histories(found, ids, classes)
                score = float(m.table[before, skip, target].sum(dtype=np.float64))
                frequent = ids[ids >= 0]
                score += float((log_count[frequent] + known_share[m.word_class[frequent]]).sum()) if len(frequent) else 0.0
                base = end_base + (float(base_of[frequent].sum()) if len(frequent) else 0.0)
                rows.append((rid, len(found) + 1, len(frequent) + (m.end_count > 0), base, score))
                others = np.flatnonzero(ids < 0)
                for w, n in Counter([found[i] for i in others.tolist()]).items():
                    rare.append((rid, w, n))
                rid += 1
            yield _scored_rows(b.column(0), rows, rare, m)

    return run


def _scored_rows(ids: pa.Array, rows: list, rare: list, m: Model) -> pa.RecordBatch:
    a, b = len(rows), len(rare)
    rid, n, known, base, score = zip(*rows) if rows else ([],) * 5
    w = [x[1] for x in rare]
    k = m.ending_class[[ending(x) for x in w]] if b else np.zeros(0, np.int64)
    none = [0] * b
    return pa.RecordBatch.from_arrays(
        [
            pa.array([0] * a + [1] * b, pa.int32()),
            pa.array([*rid, *(x[0] for x in rare)], pa.int64()),
            pa.concat_arrays([ids, pa.nulls(b, ids.type)]),
            pa.array([*n, *none], pa.int64()),
            pa.array([*known, *none], pa.int64()),
            pa.array([*base, *none], pa.float64()),
            pa.array([*score, *none], pa.float64()),
            pa.array([None] * a + w, pa.binary()),
            pa.array(np.concatenate([np.zeros(a, np.int64), k]).astype(np.int32)),
            pa.array([0] * a + [x[2] for x in rare], pa.int64()),
        ],
        ["kind", "rid", "id", "n_tokens", "n_known", "base", "score", "w", "k", "m"],
    )


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = _SCORED.format(id=docs.schema[id_col].dataType.simpleString())
    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).cast("binary").alias("t")).mapInArrow(_score(shared), schema)
    rows = cut(rows, "op5-scored")
    known, unknown = model.shares()
    known, unknown = (F.array(*[F.lit(float(x)) for x in v]) for v in (known, unknown))
    rare = rows.where("kind = 1").select("rid", "w", "k", "m").join(counts.hint("merge"), "w", "left")
    log_count = F.log10(F.col("c").cast("double"))
    seen = F.col("c").isNotNull()
    types = model.train_tokens + model.types + 1.0
    extra = rare.groupBy("rid").agg(
        F.sum(F.when(seen, F.col("m")).otherwise(0)).alias("known2"),
        F.sum(F.col("m") * F.log10((F.coalesce("c", F.lit(0)) + 1.0) / types)).alias("base2"),
        F.sum(F.col("m") * F.when(seen, log_count + F.element_at(known, F.col("k") + 1)).otherwise(F.element_at(unknown, F.col("k") + 1))).alias("score2"),
    )
    out = rows.where("kind = 0").join(extra, "rid", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"),
    )


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", updates: int = UPDATES) -> DataFrame:
    """One row per document, learning from those whose crc32(id as text) mod 7 is not 2."""
    small_batches(docs.sparkSession)
    texts = docs.where(crc_mod(id_col, 7) != 2).select(text_of(docs, text_col).cast("binary").alias("t"))
    model, counts = train(texts, updates)
    scored = score(docs, model, counts, id_col, text_col)
    return scored.select(id_col, (crc_mod(id_col, 7) == 2).alias("held_out"), *scored.columns[1:])
