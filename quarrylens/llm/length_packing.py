"""Batches of similar length with the least padding.

The histogram of lengths covers all documents. Dynamic programming over it
finds the bucket boundaries that minimise padding exactly; lines in a monotone
hull make each of its layers linear in the number of distinct lengths. Within a
bucket, documents form batches of at most ``budget`` padded tokens.

Numbering documents of a bucket would put a bucket in one task, so a bucket is
numbered in ``SALTS`` parts whose offsets come from their counts, a table of
bounded size: batches are full across parts, only a bucket's last may not be.

Defined results: a null text counts as empty and has length 0; a document longer
than the budget is alone in its batch and stays whole; equal lengths share a
bucket; repeated rows and null ids each take a place; fewer distinct lengths
than buckets give a bucket each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

BUCKETS = 16
#: Padded tokens of a batch.
BUDGET = 32_768
SALTS = 512


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding. lengths: rising."""
    n = len(lengths)
    if not n:
        return []
    upto, weight = [0], [0]
    for length, c in zip(lengths, counts):
        upto.append(upto[-1] + c)
        weight.append(weight[-1] + length * c)
    infinite = 1 << 200
    best = [0] + [infinite] * n
    choice: list[list[int]] = []
    for _ in range(min(buckets, n)):
        # From a start i the padding up to j is lengths[j-1] * (upto[j] - upto[i]) - (weight[j] - weight[i]):
        # for each j the lowest of the lines best[i] + weight[i] - upto[i] * x at x = lengths[j-1].
        hull: list[int] = []
        at, new, chosen = 0, [0] + [infinite] * n, [0] * (n + 1)

        def line(i: int) -> tuple[int, int]:
            return -upto[i], best[i] + weight[i]

        for j in range(1, n + 1):
            i = j - 1
            if best[i] < infinite:
                m, b = line(i)
                while len(hull) - at >= 2:
                    (m1, b1), (m2, b2) = line(hull[-2]), line(hull[-1])
                    if (b - b1) * (m1 - m2) <= (b2 - b1) * (m1 - m):
                        hull.pop()
                    else:
                        break
                hull.append(i)
            x = lengths[j - 1]

            def value(i: int) -> int:
                m, b = line(i)
                return m * x + b

            while at + 1 < len(hull) and value(hull[at + 1]) <= value(hull[at]):
                at += 1
            if at < len(hull):
                chosen[j] = hull[at]
                new[j] = value(hull[at]) + x * upto[j] - weight[j]
        choice.append(chosen)
        best = new
        best[0] = infinite
    ends, j = [], n
    for chosen in reversed(choice):
        ends.append(lengths[j - 1])
        j = chosen[j]
    return ends[::-1]


def token_count(docs: DataFrame, text_col: str = "text"):
    """Words of the text, at the contract's white space."""
    return F.regexp_count(text_of(docs, text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, padded_length, batch, place."""
    rows = cut(docs.select(F.col(id_col).alias("id"), token_count(docs, text_col).alias("n_tokens")), "op4-lengths")
    # At most as many rows as the longest document has tokens.
    histogram = sorted((r[0], r[1]) for r in rows.groupBy("n_tokens").count().collect())
    bounds = optimal_boundaries([x for x, _ in histogram], [c for _, c in histogram], buckets)
    which = F.lit(len(bounds) - 1)
    padded = F.lit(bounds[-1] if bounds else 0)
    for i in reversed(range(len(bounds) - 1)):
        which = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(which)
        padded = F.when(F.col("n_tokens") <= bounds[i], bounds[i]).otherwise(padded)
    salted = rows.withColumns({"bucket": which.cast("int"), "padded_length": padded.cast("long"), "salt": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")})
    numbered = salted.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("id")))
    sizes = salted.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # At most buckets * SALTS rows.
    offsets = sizes.select("bucket", "salt", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    placed = numbered.join(F.broadcast(offsets), ["bucket", "salt"]).withColumns(
        {"seq": F.col("offset") + F.col("nth") - 1, "room": F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded_length", F.lit(1)))).cast("long")}
    )
    return placed.select(
        F.col("id").alias(id_col), "n_tokens", "bucket", "padded_length", F.floor(F.col("seq") / F.col("room")).cast("long").alias("batch"), (F.col("seq") % F.col("room")).alias("place")
    )
