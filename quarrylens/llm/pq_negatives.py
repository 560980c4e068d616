"""Hard negatives by product quantisation with stored residual norms.

Every vector is indexed by the nearest codeword of each pair of dimensions and by the
length of what the codewords leave out, its residual. An anchor's score of a row is then
the sum of looked-up products of the anchor with the codewords, give or take at most the
anchor's length times the residual's (Cauchy-Schwarz). This bound is rigorous, so a row
whose best case is below the best found, or whose range misses a window, is left out
unread; all others are scored exactly in integers.

Two searches run over the index: the best rows of an anchor's own label (its positives),
then for each positive the best rows of other labels whose scores are in the positive's
window. Anchors go to the rows in blocks of bounded bytes, a scan of the index for each
block, so rows never move and nothing depends on how labels or vectors repeat. A task
sends on only its best for each anchor and positive, and its kth score so far goes with
it through its rows.

Codewords are fitted on ``SAMPLE`` rows at most, a task for each pair of dimensions; any
codewords give the same result, only more or fewer exact scores. Sums are exact: in 64
bits while they fit, else in Python integers (a score beyond 64 bits is held at the
largest long).

Defined results: rows whose id, label or vector is null, or that hold null or non-finite
components, take no part; vectors meet those of their own length; "other" rows are other
rows, also of an equal id or vector; ties go to the smaller id; an anchor without
positives, a positive without negatives, and an empty table have no rows; an anchor that
occurs twice is answered twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, scratch
from .kdtree_search import _matrix, integer_vectors

#: Dimensions of a codeword, codewords, and the rows that they are fitted on.
PART, WORDS, SAMPLE = 2, 256, 8192
#: Rows of an index task, bytes of the anchors that one scan answers, and anchors scored together.
SHARD_ROWS, BLOCK_BYTES, TOGETHER = 8192, 32 << 20, 256

_LONG = (1 << 63) - 1
_INDEX = "row long, id long, label long, v array<bigint>, code binary, residual double"
_FOUND = "anchor_row long, slot int, id long, row long, score long"


def _fit(points: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """Codewords of points by rounds of means, from evenly spaced points in order of their first dimension."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= words:
        return distinct
    found = distinct[np.linspace(0, len(distinct) - 1, words).astype(int)]
    for _ in range(rounds):
        near = _nearest(points, found)
        n = np.bincount(near, minlength=len(found))
        for d in range(points.shape[1]):
            found[n > 0, d] = np.bincount(near, points[:, d], len(found))[n > 0] / n[n > 0]
    return found


def _nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(axis=1) - 2 * points @ words.T, axis=1)


def fit_codewords(rows: DataFrame, dims: int) -> np.ndarray:
    """(parts, words, PART): the codewords of each part of the vectors, each fitted in its own task."""
    parts = -(-dims // PART)
    sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("v")
    # Each row of the sample becomes a row for each part.
    cells = sample.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * PART + 1, PART)))).toDF("part", "x")

    def fit(table: pa.Table) -> pa.Table:
        points = np.asarray(table.column("x").to_pylist(), np.float64)
        found = _fit(points, WORDS)
        return pa.table({"part": [table.column("part")[0].as_py()], "words": [found.ravel().tolist()]}, pa.schema([("part", pa.int32()), ("words", pa.list_(pa.float64()))]))

    out = np.zeros((parts, WORDS, PART))
    for r in cells.groupBy("part").applyInArrow(fit, "part int, words array<double>").collect():  # 256 codewords for each part
        width = min(PART, dims - r["part"] * PART)
        found = np.asarray(r["words"]).reshape(-1, width)
        out[r["part"], : len(found), :width] = found
        out[r["part"], len(found) :, :width] = found[0]
    return out


def _parts(v: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, PART) of integer vectors, the last part filled with zeros."""
    out = np.zeros((len(v), parts * PART))
    out[:, : v.shape[1]] = v
    return out.reshape(len(v), parts, PART)


def _encode(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _parts(_matrix(pa.chunked_array([b.column("v")])), len(words))
            code = np.stack([_nearest(x[:, p], words[p]) for p in range(len(words))], axis=1).astype(np.uint8) if len(words) else np.zeros((len(x), 0), np.uint8)
            left = x - np.stack([words[p][code[:, p]] for p in range(len(words))], axis=1) if len(words) else x
            # Rounded up a little, so the bound holds for the sums as computed.
            residual = np.sqrt((left**2).sum(axis=(1, 2))) * (1 + 1e-9)
            columns = {n: b.column(n) for n in ("row", "id", "label", "v")}
            yield pa.RecordBatch.from_pydict(columns | {"code": pa.array([c.tobytes() for c in code], pa.binary()), "residual": pa.array(residual)})

    return run


def build_index(rows: DataFrame, dims: int) -> tuple[DataFrame, np.ndarray]:
    """The index of all ``rows`` (row, id, label, v): codes and residual norms beside the vectors, and the codewords."""
    words = fit_codewords(rows, dims) if dims else np.zeros((0, WORDS, PART))
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    return cut(rows.select("row", "id", "label", "v").repartition(shards).mapInArrow(_encode(words), _INDEX), "op13-index"), words


class _Anchors:
    """A block of anchors with the windows that each looks for: scores from ``low`` to ``high`` of rows of its label, or of others."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: list, high: list, same: bool, k: int):
        self.rows, self.labels, self.vectors, self.same, self.k = rows, labels, vectors, same, k
        self.low, self.high = low, high  # Python integers, a list of windows for each anchor

    def slice(self, start: int, stop: int) -> _Anchors:
        return _Anchors(self.rows[start:stop], self.labels[start:stop], self.vectors[start:stop], self.low[start:stop], self.high[start:stop], self.same, self.k)


def _exact(q: np.ndarray, x: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products of rows of two integer matrices."""
    if not wide:
        return np.einsum("ij,ij->i", q, x)
    sums = (q.astype(object) * x.astype(object)).sum(axis=1) if q.shape[1] else np.zeros(len(q), object)
    return np.array([max(-_LONG, min(_LONG, int(s))) for s in sums], np.int64)


class _Search:
    """The best rows of each window of a few anchors, kept over the batches of a task."""

    def __init__(self, anchors: _Anchors, words: np.ndarray):
        self.anchors, self.words = anchors, words
        n, windows = len(anchors.rows), len(anchors.low[0]) if len(anchors.low) else 0
        q = _parts(anchors.vectors, len(words))
        # The products of each anchor's parts with all codewords, and the anchors' lengths.
        self.products = np.einsum("apd,pwd->paw", q, words)
        self.lengths = np.sqrt((q**2).sum(axis=(1, 2))) * (1 + 1e-9)
        self.low = np.array(anchors.low, np.int64).reshape(n, windows)
        self.high = np.array(anchors.high, np.int64).reshape(n, windows)
        self.slot = self.id = self.row = self.score = np.zeros(0, np.int64)
        self.exact = 0

    def add(self, row: np.ndarray, id_: np.ndarray, label: np.ndarray, v: np.ndarray, code: np.ndarray, residual: np.ndarray, wide: bool) -> None:
        a = self.anchors
        about = np.zeros((len(a.rows), len(row)))
        for p in range(len(self.words)):
            about += self.products[p][:, code[:, p]]
        # The residual's bound, and what the sums of doubles may be off by.
        most = float(np.abs(self.products).max(axis=2).sum(axis=0).max()) if self.products.size else 0.0
        slack = self.lengths[:, None] * residual[None, :] + most * 1e-9 + 1e-6
        best, worst = np.maximum(about + slack, -float(_LONG)), np.minimum(about - slack, float(_LONG))  # as scores are held
        may = np.zeros(about.shape, bool)
        for w in range(self.low.shape[1]):
            may |= (best >= self.low[:, w, None]) & (worst <= self.high[:, w, None])
        may &= (a.labels[:, None] == label[None, :]) == a.same
        may &= a.rows[:, None] != row[None, :]
        at, x = np.nonzero(may)
        self.exact += len(at)
        for start in range(0, len(at), 1 << 17):
            i, j = at[start : start + (1 << 17)], x[start : start + (1 << 17)]
            score = _exact(a.vectors[i], v[j], wide)
            for w in range(self.low.shape[1]):
                inside = (score >= self.low[i, w]) & (score <= self.high[i, w])
                if inside.any():
                    self._keep(i[inside] * self.low.shape[1] + w, id_[j[inside]], row[j[inside]], score[inside])

    def _keep(self, slot: np.ndarray, id_: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Merge found rows, keep the best k of each window, and raise the windows' lower ends to the kth score."""
        slot, id_, row, score = (np.concatenate(x) for x in ((self.slot, slot), (self.id, id_), (self.row, row), (self.score, score)))
        order = np.lexsort((row, id_, -score, slot))
        slot = slot[order]
        first = np.r_[True, slot[1:] != slot[:-1]]
        nth = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        kept = order[nth < self.anchors.k]
        full = nth == self.anchors.k - 1
        self.slot, self.id, self.row, self.score = slot[nth < self.anchors.k], id_[kept], row[kept], score[kept]
        windows = self.low.shape[1]
        ends, kth = slot[full], score[order[full]]
        self.low[ends // windows, ends % windows] = np.maximum(self.low[ends // windows, ends % windows], kth)


def _search(anchors: _Anchors, words: np.ndarray):
    reach = float(np.abs(anchors.vectors.astype(np.float64)).max()) if anchors.vectors.size else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [_Search(anchors.slice(s, s + TOGETHER), words) for s in range(0, len(anchors.rows), TOGETHER)]
        for b in batches:
            v = _matrix(pa.chunked_array([b.column("v")]))
            wide = v.size > 0 and reach * float(np.abs(v.astype(np.float64)).max()) * v.shape[1] >= 2.0**62
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(v), len(words))
            held = [b.column(n).to_numpy(zero_copy_only=False) for n in ("row", "id", "label")]
            for g in groups:
                g.add(*held, v, code, b.column("residual").to_numpy(), wide)
        for g in groups:
            windows = max(1, g.low.shape[1])
            out = {"anchor_row": g.anchors.rows[g.slot // windows], "slot": (g.slot % windows).astype(np.int32), "id": g.id, "row": g.row, "score": g.score}
            yield pa.RecordBatch.from_pydict({k: pa.array(x) for k, x in out.items()})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of the tasks' best, for each window of an anchor."""
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id", "row")  # at most k rows a task
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = rows.toArrow()
    v = _matrix(held.column("v")) if dims else np.zeros((held.num_rows, 0), np.int64)
    return held.column("row").to_numpy(), held.column("label").to_numpy(), v


def hard_negatives(vectors: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, least_pct: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of integer vectors (id, label, v).

    Negatives score from ``least_pct`` hundredths of the positive's score to all of it.
    """
    out: list[DataFrame] = []
    with scratch(vectors.sparkSession):  # of all tables only the results stay
        kept = vectors.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
        rows = cut(kept.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v", F.size("v").alias("d"), is_anchor.alias("a")), "op13-rows")
        lengths = [(r["d"], r["n"]) for r in rows.groupBy("d").agg(F.count(F.when(F.col("a"), 1)).alias("n")).orderBy("d").collect()]  # a row for each length
        for dims, asked in lengths:
            if not asked:
                continue
            own = rows.where(F.col("d") == dims)
            index, words = build_index(own, dims)
            blocks = max(1, math.ceil(asked * (dims + 4) * 8 / BLOCK_BYTES))
            for block in range(blocks):
                asking = own.where(F.col("a") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)).select("row", "id", "label", "v")
                a_rows, labels, v = _block(asking, dims)
                if not len(a_rows):
                    continue
                ends = _Anchors(a_rows, labels, v, [[-_LONG]] * len(a_rows), [[_LONG]] * len(a_rows), True, k_positive)
                positives = _best(index.mapInArrow(_search(ends, words), _FOUND), k_positive)
                positives = cut(positives.select("anchor_row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("nth")), "op13-positives")
                scores: dict[int, list] = {}
                for r in positives.orderBy("anchor_row", "nth").select("anchor_row", "positive_score").collect():  # k rows for each anchor of the block
                    scores.setdefault(r[0], []).append(r[1])
                # A window without scores for positives that are missing.
                high = [(scores.get(r, []) + [-_LONG] * k_positive)[:k_positive] for r in a_rows.tolist()]
                low = [[-(-least_pct * s // 100) if n < len(scores.get(r, [])) else _LONG for n, s in enumerate(h)] for r, h in zip(a_rows.tolist(), high)]
                windows = _Anchors(a_rows, labels, v, low, high, False, k_negative)
                negatives = _best(index.mapInArrow(_search(windows, words), _FOUND), k_negative).withColumn("nth", F.col("slot") + 1)
                found = negatives.join(positives, ["anchor_row", "nth"]).join(own.where("a").select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
                found = found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
                out.append(cut(found, "op13-found", keep=True))
                forget(positives)
            forget(index)
    if not out:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """(id, label, v) of embeddings: whole vectors as in the exact search, labels of ids divisible by seven moved on by one."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    whole = integer_vectors(embeddings.withColumn("label", moved), keep=["label"])
    return whole.select("id", "label", "v")
