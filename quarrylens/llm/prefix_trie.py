"""A trie of conversations by shared beginnings, with sums over subtrees by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest of the sequence, so
turns are read once and only digests, counts and ids are shuffled. Digests of beginnings
are chained within blocks of ``BLOCK`` turns; digests of whole blocks are chained in the
same way, so a conversation of any length takes rounds by the logarithm of its length
and no task holds more of it than a block.

Each node points to its parent. Leaves and savings are summed over subtrees by doubling:
after k rounds a node holds the sums of what lies less than 2**k below it and points to
the ancestor 2**k above, so a trie of depth D takes ``log2(D)`` rounds. A round sends a
sum for each pointer, combined before the shuffle, and looks up the pointer's pointer;
nodes that point past the root rest.

The ids that end at a node are joined to texts of ``CHUNK`` neighbouring ids at most, and
the texts of a node pass through one digest in order, so no task holds the ids of a node.

Defined results: rows without a conversation id take no part; null roles and texts are
empty; turns are in order of ``turn`` (null first), equal ones in order of the digest of
role and text; conversations without turns are at the root; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, numbered, scratch

#: Turns whose digests are chained in one group, and conversation ids joined in one text.
BLOCK, CHUNK = 64, 4096
#: Conversations that share a beginning in the rebuilt table, and the most turns shared.
FAMILY, SHARED = 20, 3
WORDS = r"[^\x20\x09-\x0D]+"


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, digest, words) of each turn, numbered from 1 within its conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", _digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")
    )
    placed, _ = numbered(turns, ["conv", "turn", "digest"], "op11-turns", "place")
    starts = placed.groupBy("conv").agg(F.min("place").alias("start"))
    return placed.join(starts, "conv").select("conv", (F.col("place") - F.col("start") + 1).alias("pos"), "digest", "words")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first of their family: turns (conv, pos, digest, words) and all (conv, n).

    Of conversation c the first ``crc32(c) % 4`` turns come from conversation ``c - c % 20``.
    """
    turns = cut(ordered_turns(conversations), "op11-own")
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % (SHARED + 1)
    convs = cut(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumns({"shared": shared, "first": F.col("conv") - F.col("conv") % FAMILY}), "op11-convs")
    lengths = convs.select(F.col("conv").alias("first"), F.col("n").alias("n_first"))
    convs = convs.join(lengths, "first", "left").withColumn("given", F.least("shared", F.coalesce("n_first", F.lit(0))))
    own = turns.join(convs.select("conv", "shared", "given"), "conv").where("pos > shared").select("conv", (F.col("pos") - F.col("shared") + F.col("given")).alias("pos"), "digest", "words")
    # At most three turns of a conversation, to at most as many conversations as a family has.
    heads = turns.where((F.col("pos") <= SHARED) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "first")
    given = convs.where("given > 0").select("conv", "first", "given").join(heads, "first").where("pos <= given").select("conv", "pos", "digest", "words")
    return own.unionByName(given), convs.select("conv", (F.greatest(F.col("n") - F.col("shared"), F.lit(0)) + F.col("given")).alias("n"))


def beginnings(items: DataFrame, longest: int, block: int = BLOCK) -> DataFrame:
    """``items`` (conv, pos from 1, digest, ...) with ``digest`` of all items of a conversation up to each.

    Equal sequences have equal digests whatever stands after them.
    """
    at = F.expr(f"(pos - 1) DIV {block}")
    rest = [c for c in items.columns if c not in ("conv", "pos", "digest")]
    held = items.groupBy("conv", at.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *rest))).alias("held"))  # a block of items
    chained = F.aggregate(
        F.col("held.digest"), F.array().cast("array<binary>"), lambda done, x: F.concat(done, F.array(_digest(F.coalesce(F.get(done, F.size(done) - 1), F.lit(b"")), x)))
    )
    blocks = held.withColumn("chained", chained)
    if longest > block:
        blocks = cut(blocks, "op11-blocks")
        whole = blocks.where(F.size("held") == block).select("conv", (F.col("block") + 1).alias("pos"), F.get("chained", F.lit(block - 1)).alias("digest"))
        before = beginnings(whole, longest // block, block).select("conv", F.col("pos").alias("block"), F.col("digest").alias("before"))
        joined = blocks.where("block > 0").join(before, ["conv", "block"])
        later = joined.withColumn("chained", F.transform("chained", lambda x: _digest(F.col("before"), x))).drop("before")
        blocks = blocks.where("block = 0").unionByName(later)
    each = blocks.select("conv", F.explode(F.arrays_zip(F.col("held").alias("item"), F.col("chained").alias("chained"))).alias("e"))
    return each.select("conv", F.col("e.item.pos").alias("pos"), F.col("e.chained").alias("digest"), *[F.col(f"e.item.{c}").alias(c) for c in rest])


def _join_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, ends_sha256) of sorted (digest, ids): texts of a digest go on one after another with commas between."""
    key, state, first = None, None, True
    for b in batches:
        keys, hashes = [], []
        for k, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist()):
            if first or k != key:
                if not first:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state, first = k, hashlib.sha256(ids.encode()), False
            else:
                state.update(b",")
                state.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"digest": pa.array(keys, pa.binary()), "ends_sha256": pa.array(hashes, pa.string())})
    if not first:
        yield pa.RecordBatch.from_pydict({"digest": pa.array([key], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def id_list_digests(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of (digest, conv): SHA-256 of a digest's ids in order, joined by commas."""
    chunks = ends.groupBy("digest", F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    texts = chunks.select("digest", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return texts.repartition("digest").sortWithinPartitions("digest", "chunk").select("digest", "ids").mapInArrow(_join_digests, "digest binary, ends_sha256 string")


def subtree_sums(state: DataFrame, depth: int) -> DataFrame:
    """``state`` (digest, parent, conv, leaves, saved) as (digest, parent_conv, leaves, saved), the last two summed over subtrees."""
    now = state.select("digest", F.col("parent").alias("up"), "conv", F.lit(None).cast("long").alias("parent_conv"), "leaves", "saved")
    rounds = max(1, depth.bit_length())  # sums reach less than 2**rounds levels down
    previous = None
    for k in range(rounds):
        live, resting = now.where("up IS NOT NULL"), now.where("up IS NULL")
        known = (now if k == 0 else live).select(F.col("digest").alias("up"), F.col("up").alias("further"), F.col("conv").alias("conv_up"))
        parent = F.col("conv_up") if k == 0 else F.col("parent_conv")
        jumped = live.join(known, "up", "left").select("digest", F.col("further").alias("up"), "conv", parent.alias("parent_conv"), "leaves", "saved")
        sums = live.groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("up", "digest")
        grown = jumped.unionByName(resting).join(sums, "digest", "left")
        grown = grown.select("digest", "up", "conv", "parent_conv", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        now = cut(grown, "op11-sums")
        if previous is not None:
            forget(previous)
        previous = now
    return now.drop("up", "conv")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each distinct beginning of ``turns`` (conv, pos, digest, words) of all ``convs`` (conv, n), n turns each.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256); conv_id is the smallest conversation that begins so.
    """
    convs = cut(convs, "op11-lengths")
    depth = convs.agg(F.max("n")).first()[0] or 0
    members = cut(beginnings(turns, depth, block), "op11-members")
    root = F.lit(b"")
    nodes = members.groupBy("digest", F.col("pos").alias("depth")).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    # The parent is what the smallest member begins with, a turn less.
    before = members.select("conv", (F.col("pos") + 1).alias("depth"), F.col("digest").alias("parent"))
    linked = nodes.where("depth > 1").join(before, ["conv", "depth"]).select("digest", "parent", "conv", "depth", "n", "words")
    first = nodes.where("depth = 1").select("digest", root.alias("parent"), "conv", "depth", "n", "words")
    top = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0").select(root.alias("digest"), F.lit(None).cast("binary").alias("parent"), "conv", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("words"))
    nodes = cut(linked.unionByName(first).unionByName(top), "op11-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("children")).withColumnRenamed("parent", "digest")
    nodes = cut(nodes.join(children, "digest", "left").withColumn("children", F.coalesce("children", F.lit(0))), "op11-counted")
    state = nodes.select("digest", "parent", "conv", (F.col("children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    sums = subtree_sums(state, depth)
    last = members.groupBy("conv").agg(F.max_by("digest", "pos").alias("digest")).unionByName(convs.where("n = 0").select("conv", root.alias("digest")))
    out = nodes.join(sums, "digest").join(id_list_digests(last), "digest", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    with scratch(conversations.sparkSession):  # of all tables only the result stays
        turns, convs = rebuild(conversations)
        return cut(prefix_trie(turns, convs, block), "op11-trie", keep=True)
