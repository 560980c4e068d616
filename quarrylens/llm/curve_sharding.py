"""Shards as runs of a Hilbert curve through several metadata columns.

Each column is quantised into cells of about equal row counts: a value's cell is its
place in the column's distribution, so four languages lie as far apart as sixty-four
length classes. The Hilbert index of the cells orders the rows, and the order is cut
into runs whose counts differ by one at most. Rows that are near in every column come
into the same shards, so the ranges of a shard's columns (:func:`shard_ranges`) tell
most of the shards that a filter need not read (:func:`prune`).

All steps are DataFrame operations. Distributions come from counts of the distinct
values, combined before the shuffle and ordered by range; the order of the rows is dealt
by range too, by the curve and then by the ties, so a common cell, value or source takes
as many tasks as it needs. At most ``2 ** bits`` bounds of a column come to the driver.

Defined results: a null in a column is in its first cell; rows that are equal in the
curve and in all ties are interchangeable; an empty table has no rows; columns of the
input may have any names, those of the result replace equal ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, numbered, scratch

#: Cells of a column are ``2 ** BITS``.
BITS = 6
SHARDS = 24
#: Bits that hold the state of the walk beside the index.
_STATE_BITS = 10


def _rotate(x: int, by: int, dims: int) -> int:
    """Rotate the ``dims`` low bits of x to the left."""
    by %= dims
    return ((x << by) | (x >> (dims - by))) & ((1 << dims) - 1)


def walk_table(dims: int) -> list[int]:
    """What one level of the curve does: for each state and corner, the place of the corner and the next state.

    A state is where the curve enters a cube and along which axis it leaves. Places go
    along a Gray code, turned by the state. Entries are at ``state * 2**dims + corner``
    and hold ``place << _STATE_BITS | next state``.
    """
    corners = 1 << dims
    gray = [i ^ (i >> 1) for i in range(corners)]
    place_of = {g: i for i, g in enumerate(gray)}
    trailing_ones = lambda x: (~x & (x + 1)).bit_length() - 1
    out = []
    for entry in range(corners):
        for axis in range(dims):
            for corner in range(corners):
                place = place_of[_rotate(corner ^ entry, -(axis + 1), dims)]
                start = gray[(place - 1) // 2 * 2] if place else 0
                turn = trailing_ones(place - 1 + place % 2) % dims if place else 0
                following = (entry ^ _rotate(start, axis + 1, dims)) * dims + (axis + turn + 1) % dims
                out.append(place << _STATE_BITS | following)
    return out


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place of a point of cells (from 0 below ``2 ** bits``) along the Hilbert curve."""
    dims = len(cells)
    if not 1 < dims <= 5 or dims * bits > 50:
        raise ValueError("two to five columns, of fifty bits in all")
    table = F.lit(walk_table(dims))
    bit = lambda c, level: F.shiftright(c, level).bitwiseAND(F.lit(1))
    corners = [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(bit(c, level), j) for j, c in enumerate(cells)]) for level in reversed(range(bits))]
    state = lambda walked: walked.bitwiseAND(F.lit((1 << _STATE_BITS) - 1)).cast("int")
    step = lambda walked, corner: F.shiftleft(F.shiftright(walked, _STATE_BITS), _STATE_BITS + dims) + F.get(table, state(walked) * (1 << dims) + corner)
    return F.shiftright(F.aggregate(F.array(*corners), F.lit(0).cast("long"), step), _STATE_BITS)


def _value(df: DataFrame, name: str) -> tuple[Column, Column]:
    """A column as a long or as a text, the other null: one frame holds the values of all columns."""
    kind, c, none = df.schema[name].dataType, df[name], F.lit(None)
    if isinstance(kind, T.StringType):
        return none.cast("long"), c
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")), none.cast("string")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long"), none.cast("string")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return c.cast("long"), none.cast("string")
    raise ValueError(f"{name}: texts, whole numbers and times order shards, not {kind.simpleString()}")


def cell_bounds(df: DataFrame, columns: list[str], bits: int = BITS) -> list[list[tuple]]:
    """For each column the cells that occur, as (cell, least value in it), by value.

    With N values that are not null, u of them up to a value, its cell is the last whose
    share of the rows begins below u: ``ceil(u * cells / N) - 1``.
    """
    structs = [F.struct(F.lit(i).alias("dim"), num.alias("num"), txt.alias("txt")) for i, (num, txt) in enumerate(_value(df, c) for c in columns)]
    held = df.select(F.inline(F.array(*structs))).where("num IS NOT NULL OR txt IS NOT NULL")
    counts = held.groupBy("dim", "num", "txt").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.repartitionByRange("dim", "num", "txt").withColumn("part", F.spark_partition_id()), "op12-values")
    totals, before = {}, []
    for r in counts.groupBy("dim", "part").agg(F.sum("n").alias("n")).orderBy("dim", "part").collect():  # a row for each range
        before.append((r["dim"], r["part"], totals.get(r["dim"], 0)))
        totals[r["dim"]] = totals.get(r["dim"], 0) + r["n"]
    spark, cells = df.sparkSession, 1 << bits
    starts = spark.createDataFrame([(d, p, b, totals[d]) for d, p, b in before], "dim int, part int, before long, total long")
    running = F.sum("n").over(Window.partitionBy("dim", "part").orderBy("num", "txt").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.join(F.broadcast(starts), ["dim", "part"]).withColumn("upto", F.col("before") + running)
    cell = F.expr(f"(upto * {cells} + total - 1) DIV total - 1").cast("int")
    least = placed.groupBy("dim", cell.alias("cell")).agg(F.min(F.struct("num", "txt")).alias("v")).orderBy("dim", "cell").collect()
    forget(counts)
    return [[(r["cell"], r["v"]["num"] if r["v"]["num"] is not None else r["v"]["txt"]) for r in least if r["dim"] == i] for i in range(len(columns))]


def cell_of(df: DataFrame, column: str, bounds: list[tuple]) -> Column:
    """The cell of a row's value: that of the last bound that is not above it; nulls are in the first cell."""
    num, txt = _value(df, column)
    text = isinstance(df.schema[column].dataType, T.StringType)
    if not bounds:
        return F.lit(0)
    values, cells = F.lit([v for _, v in bounds]), F.lit([c for c, _ in bounds])
    x = txt if text else num
    return F.coalesce(F.get(cells, F.size(F.filter(values.cast("array<string>" if text else "array<bigint>"), lambda v: v <= x)) - 1), F.lit(0))


def shard_by_curve(rows: DataFrame, columns: list[str], ties: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve``, ``cells``, ``shard`` (counts at most one apart) and ``slot`` (gapless from 0), in runs of the curve."""
    bounds = cell_bounds(rows, columns, bits)
    cells = [cell_of(rows, c, b) for c, b in zip(columns, bounds)]
    placed = rows.withColumns({"cells": F.array(*cells)})
    placed = placed.withColumn("curve", hilbert_index([F.get("cells", F.lit(i)) for i in range(len(columns))], bits))
    ordered, n = numbered(placed, ["curve", *ties], "op12-ordered", "position")
    # Shard k has the positions from ceil(k * n / shards) on.
    shard = F.expr(f"CAST(position * {shards} DIV {max(n, 1)} AS INT)")
    slot = F.col("position") - F.expr(f"(CAST(shard AS BIGINT) * {n} + {shards - 1}) DIV {shards}")
    return ordered.withColumn("shard", shard).withColumn("slot", slot).drop("position")


def shard_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """(shard, rows, low_<column>, high_<column>, nulls_<column>): what a shard holds, a row for each shard."""
    ends = [x for c in columns for x in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"nulls_{c}"))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ends)


def prune(ranges: DataFrame, wanted: dict[str, tuple]) -> DataFrame:
    """The shards that may hold a row whose columns are all within (low, high), both included."""
    may = [(F.col(f"low_{c}") <= F.lit(high)) & (F.col(f"high_{c}") >= F.lit(low)) for c, (low, high) in wanted.items()]
    return ranges.where(reduce(lambda a, b: a & b, may, F.lit(True))).select("shard", "rows")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write whole rows as Parquet, a folder for each shard, files in the order of the curve."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assign_documents(documents: DataFrame, columns: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Shards of documents by row count, without their texts.

    (doc_id, size, text_crc32, law, shard, slot, grown_shard, curve, cells): size is the
    bytes of the text in UTF-8 (null: none) and eight; ties go by doc_id, size and
    checksum. The law is ``rows``: counts of shards are at most one apart, so a group of
    equal texts of any size spreads over as many shards as its rows fill.
    """
    text = F.coalesce(documents["text"], F.lit("")).cast("binary")
    slim = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[documents[c].alias(f"by_{i}") for i, c in enumerate(columns)]
    )
    with scratch(documents.sparkSession):  # of all tables only the result stays
        slim = cut(slim, "op12-slim")  # the texts are read once
        sharded = shard_by_curve(slim, [f"by_{i}" for i in range(len(columns))], ["doc_id", "size", "text_crc32"], shards, bits)
        out = sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "cells")
        return cut(out, "op12-shards", keep=True)
