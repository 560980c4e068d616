"""Exact top-k inner products by a KD-tree for each shard.

Candidates are dealt into shards of bounded size by a hash of their id. A shard's
tree splits at medians of the widest dimension; every node keeps the tight
bounding box of its points. A query visits boxes best first, by the largest inner
product that a box can hold, and stops when none can reach its kth score. Each
query first searches its own shard; the kth score found there goes with it to
the other shards, where it prunes from the start.

Queries are dealt to the other shards in blocks, so a task holds one shard and
one block whatever the size of the input.

Scores are exact: sums of integers, in doubles while they are below 2**53 and in
Python integers beyond (a score beyond 64 bits is held at the largest long).

Defined results: vectors that are null or have null or non-finite components,
and rows with a null id, take no part; vectors meet only vectors of their own
length; a query's candidates are all other rows, also those of its id or vector, and
each query row is answered by itself; ties go to the smaller id; a query without
candidates has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Candidates of a shard, queries of a block (about), and points of a leaf.
SHARD, BLOCK, LEAF = 8192, 4096, 256

_LONG = (1 << 63) - 1


class KDTree:
    """Median splits with tight boxes; nodes are (low, high, start, stop, left, right)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.lexsort((rows, ids))
        self.points, self.ids, self.rows, self.nodes = points[order], ids[order], rows[order], []
        if len(ids):
            self._build(0, len(ids))

    def _build(self, start: int, stop: int) -> int:
        held = self.points[start:stop]
        low, high = held.min(axis=0), held.max(axis=0)
        at = len(self.nodes)
        self.nodes.append((low, high, start, stop, -1, -1))
        width = high - low
        if stop - start > LEAF and len(width) and width.max() > 0:
            d = int(np.argmax(width))
            order = np.argsort(held[:, d], kind="stable")
            self.points[start:stop], self.ids[start:stop], self.rows[start:stop] = held[order], self.ids[start:stop][order], self.rows[start:stop][order]
            middle = (start + stop) // 2
            left, right = self._build(start, middle), self._build(middle, stop)
            self.nodes[at] = (low, high, start, stop, left, right)
        return at

    def _bound(self, q: np.ndarray, node: int):
        """The largest inner product of q with a point of the node's box."""
        low, high = self.nodes[node][:2]
        return np.maximum(q * low, q * high).sum() if len(q) else 0

    def search(self, q: np.ndarray, own: int, k: int, least=None) -> list[tuple]:
        """At most k (score, id) of rows other than ``own``, best first; scores below ``least`` may be left out."""
        if not self.nodes:
            return []
        best_score, best_id = np.zeros(0, self.points.dtype), np.zeros(0, np.int64)
        heap = [(-self._bound(q, 0), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if least is not None and -bound < least:
                break  # equal bounds may hold a tie with a smaller id
            _, _, start, stop, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    b = self._bound(q, child)
                    if least is None or b >= least:
                        heapq.heappush(heap, (-b, child))
                continue
            score, ids = self.points[start:stop] @ q, self.ids[start:stop]
            keep = self.rows[start:stop] != own
            if least is not None:
                keep &= score >= least
            best_score, best_id = np.concatenate([best_score, score[keep]]), np.concatenate([best_id, ids[keep]])
            order = np.lexsort((best_id, -best_score))[:k]
            best_score, best_id = best_score[order], best_id[order]
            if len(best_id) == k and (least is None or best_score[-1] > least):
                least = best_score[-1]
        return list(zip(best_score.tolist(), best_id.tolist()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0), np.int64)


_FOUND = "query_row long, vec_id long, score long"


def _search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        points, q = _matrix(candidates.column("v")), _matrix(queries.column("qv"))
        q_rows = queries.column("qrow").to_numpy()
        least = queries.column("least").to_pylist()
        out: list[tuple] = []
        if len(points) and len(q):
            kind = object if _wide(points, q) else np.float64
            tree = KDTree(points.astype(kind), candidates.column("id").to_numpy().copy(), candidates.column("row").to_numpy().copy())
            for own, vector, bound in zip(q_rows.tolist(), q.astype(kind), least):
                out += [(own, i, max(-_LONG, min(_LONG, int(s)))) for s, i in tree.search(vector, own, k, bound)]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_row", "vec_id", "score"])

    return run


def _wide(points: np.ndarray, q: np.ndarray) -> bool:
    """Whether inner products may leave the integers that doubles hold exactly."""
    if not points.size or not q.size:
        return False
    a, b = float(np.abs(points.astype(np.float64)).max()), float(np.abs(q.astype(np.float64)).max())
    return a * b * points.shape[1] >= 2.0**53


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of integer vectors (id long, v array<bigint>)."""
    kept = vectors.where("id IS NOT NULL AND v IS NOT NULL")
    rows = cut(kept.select(F.monotonically_increasing_id().alias("row"), "id", "v", is_query.alias("q"), F.size("v").alias("d")), "op1-vectors")
    n, asked = rows.agg(F.count("id"), F.count(F.when(F.col("q"), 1))).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / block_rows))
    shard, block = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)).cast("int")
    candidates = rows.select("row", "id", "v", "d", shard.alias("s"))
    queries = rows.where("q").select(F.col("row").alias("qrow"), F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("d").alias("qd"), shard.alias("home"), block.alias("qb"))
    near = queries.select("qrow", "qv", "qd", "home", F.lit(None).cast("long").alias("least"))
    first = candidates.groupBy("d", "s").cogroup(near.groupBy("qd", "home")).applyInArrow(_search(k), _FOUND)
    first = cut(first, "op1-first")
    # The kth score of the own shard, if it had k: the bound that goes to the others.
    bound = first.groupBy("query_row").agg(F.when(F.count("score") >= k, F.min("score")).alias("least"))
    bounded = queries.join(bound, queries["qrow"] == bound["query_row"], "left")
    far = bounded.withColumn("qs", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("qs <> home").select("qrow", "qv", "qd", "qs", "qb", "least")
    copies = candidates.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rest = copies.groupBy("d", "s", "b").cogroup(far.groupBy("qd", "qs", "qb")).applyInArrow(_search(k), _FOUND)
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")  # at most k rows a shard
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.join(queries.select(F.col("qrow").alias("query_row"), F.col("qid").alias("query_id")), "query_row").select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, keep: tuple | list = ()) -> DataFrame:
    """(id, v) and the columns to keep: floor(scale * x) of each component; null where a component is null or not finite."""
    v = F.col(vector_col)
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.select(F.col(id_col).cast("long").alias("id"), F.when(v.isNotNull() & fine, whole).alias("v"), *keep)
