"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of ``block`` characters. The distinct
blocks are sorted and numbered, so equal blocks and only they share an integer
name. Adjacent names are then paired, the distinct pairs sorted and numbered in
turn, until one name is left for each document: its identity. No hash decides
which texts are equal: two share an identity exactly when they are.

A row that is alone under (length, first block) has its identity already, so
only the others go on to the naming. Rows with the same id, length and SHA-256 of
the text are one *label* with a multiplicity; there alone a hash stands for a text.

Defined results: a null text counts as empty, empty texts are equal to each
other; an empty table gives an empty result; of rows equal in id and text
exactly one is kept; null ids lose ties against other ids; further columns are
ignored by :func:`duplicate_groups` and passed through by :func:`drop_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, scratch, text_of

#: Characters of a block.
BLOCK = 512

_LABEL = ["_id", "_chars", "_sha"]


def _normalised(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    text = text_of(docs, text_col)
    norm = F.regexp_replace(text, SPACE + "+", "")
    return docs.select(F.col(id_col).alias("_id"), F.length(text).cast("long").alias("_chars"), norm.alias("_norm")).select(
        "_id", "_chars", F.sha2("_norm", 256).alias("_sha"), F.length("_norm").alias("_len"), F.substring("_norm", 1, block).alias("_first"), "_norm"
    )


def _same_label(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_chars"] == b["_chars"]) & (a["_sha"] == b["_sha"])


def _named(keys: DataFrame, columns: list[str], what: str) -> DataFrame:
    """The distinct keys in sorted order, each with an integer name."""
    distinct = keys.select(*columns).distinct()
    ordered = distinct.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return cut(ordered.withColumn("name", F.monotonically_increasing_id()), what)


def _identities(blocks: DataFrame) -> DataFrame:
    """(rid, level, name) of blocks (rid, n, idx, block), n the blocks of the document."""
    names = _named(blocks, ["block"], "op10-names")
    current = blocks.join(names, "block").select("rid", "n", "idx", "name")
    longest = blocks.agg(F.max("n")).first()[0] or 0
    level, done = 0, None
    while True:
        ended = current.where("n = 1").select("rid", F.lit(level).alias("level"), "name").distinct()
        done = ended if done is None else done.unionByName(ended)
        if longest <= 1:
            return done
        even = F.col("idx") % 2 == 0
        pairs = cut(
            current.where("n > 1")
            .groupBy("rid", ((F.col("n") + 1) / 2).cast("int").alias("n"), F.shiftright("idx", 1).alias("idx"))
            .agg(F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r")),
            "op10-pairs",
        )
        current = pairs.join(_named(pairs, ["l", "r"], "op10-names"), ["l", "r"]).select("rid", "n", "idx", "name")
        longest, level = (longest + 1) // 2, level + 1


def _labels(docs: DataFrame, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The distinct labels that need names, and those alone under (length, first block)."""
    rows = _normalised(docs, id_col, text_col, block).groupBy(*_LABEL, "_len", "_first").agg(F.count(F.lit(1)).alias("copies"))
    rows = cut(rows, "op10-labels")
    # Heads are written so that the join below can split a head that very many rows share.
    heads = cut(rows.groupBy("_len", "_first").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1"), "op10-heads")
    marked = rows.join(heads.hint("merge"), ["_len", "_first"], "left").select(*_LABEL, "_len", "copies", "labels")
    shared = cut(marked.where("labels IS NOT NULL").drop("labels").withColumn("rid", F.monotonically_increasing_id()), "op10-shared")
    return shared, marked.where("labels IS NULL").drop("labels")


def _groups(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """Per label: copies, the group's size, and the id and length of the row that stays."""
    shared, alone = _labels(docs, id_col, text_col, block)
    texts = _normalised(docs, id_col, text_col, block).select(*_LABEL, "_norm")
    wanted = shared.select(*_LABEL, "_len", "rid").hint("merge")  # one plan at every size
    # Blocks cover every character: whole blocks by the pattern, an empty text as one empty block.
    cutting = F.when(F.col("_len") > 0, F.regexp_extract_all("_norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).otherwise(F.array(F.lit("")))
    blocks = texts.join(wanted, _same_label(texts, wanted)).select("rid", cutting.alias("all"))
    with scratch(docs.sparkSession):
        blocks = cut(blocks.select("rid", F.size("all").alias("n"), F.posexplode("all").alias("idx", "block")), "op10-blocks")
        identity = cut(_identities(blocks), "op10-identities", keep=True)
    members = shared.join(identity, "rid")
    # The longest original text first, then the smallest id, null ids last.
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("u"), F.col("_id").alias("i")))
    sizes = cut(members.groupBy("level", "name").agg(F.sum("copies").alias("group_size"), best.alias("best")), "op10-sizes")
    grouped = members.join(sizes, ["level", "name"]).select(*_LABEL, "copies", "group_size", F.col("best.i").alias("keep_id"), (-F.col("best.c")).alias("keep_chars"))
    single = alone.select(*_LABEL, "copies", F.col("copies").alias("group_size"), F.col("_id").alias("keep_id"), F.col("_chars").alias("keep_chars"))
    return grouped.unionByName(single).withColumn("stays", F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("keep_chars")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    groups = _groups(docs, id_col, text_col, block)
    rows = groups.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.col("_sha").alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    with scratch(docs.sparkSession):
        kept = cut(_groups(docs, id_col, text_col, block).where("stays").select(*_LABEL, "copies"), "op10-kept", keep=True)
    norm = F.regexp_replace(text_of(docs, text_col), SPACE + "+", "")
    # The columns of docs travel as one struct, so that none can clash with a name used here.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, F.col(id_col).alias("_rid"), F.length(text_of(docs, text_col)).cast("long").alias("_rchars"), F.sha2(norm, 256).alias("_rsha"))
    on = rows["_rid"].eqNullSafe(kept["_id"]) & (rows["_rchars"] == kept["_chars"]) & (rows["_rsha"] == kept["_sha"])
    once = rows.join(kept.where("copies = 1"), on, "left_semi").select("_row")
    again = rows.join(kept.where("copies > 1"), on, "left_semi").dropDuplicates(["_rid", "_rchars", "_rsha"]).select("_row")
    return once.unionByName(again).select(*(F.col("_row")[c].alias(c) for c in docs.columns))
