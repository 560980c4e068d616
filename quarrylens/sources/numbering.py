"""Row numbers of file sources: 0 to n - 1 in the order of the files and of the rows in them.

A file reader deals files in blocks, and a task reads a block's rows in order. So one
scan counts the rows of each block, the counts summed in file order (a row for each
block) say what stands before a block, and the rows take their numbers as they are
read: no row moves and none is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MOVED = "The files or their splits changed since their rows were counted; read them again, or write the numbered rows before use."


def number_rows(df: DataFrame, header: Column | None = None, column: str = "_row_id") -> DataFrame:
    """``df``, which reads files and at most filters them, with the number of each row.

    Files count in order of their paths. Where ``header`` holds for the first row of a
    file, that row is left out and has no number. Rows are counted now; if a later read
    finds the blocks otherwise than they were counted (another split size, a changed
    file), it fails instead of numbering wrongly.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_at", F.monotonically_increasing_id())
    headed = F.min_by(F.coalesce(header, F.lit(False)), "_at") if header is not None else F.lit(False)
    counted = placed.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), headed.alias("_headed"))
    ahead = Window.orderBy("_path", "_start")  # a row for each block
    begins = (F.row_number().over(Window.partitionBy("_path").orderBy("_start")) == 1) & F.col("_headed")
    blocks = counted.withColumn("_skip", begins.cast("long"))
    before = F.sum(F.col("_n") - F.col("_skip")).over(ahead) - F.col("_n")
    blocks = blocks.select("_path", "_start", "_n", "_first", "_skip", before.alias("_before"))
    # The counts are taken once: what is broadcast is a list of the driver, not a second scan.
    held = df.sparkSession.createDataFrame(blocks.collect(), blocks.schema)
    found = placed.join(F.broadcast(held), ["_path", "_start"], "left")
    nth = F.col("_at") - F.col("_first")
    number = F.when(nth.isNull() | (nth < 0) | (nth >= F.col("_n")), F.raise_error(F.lit(_MOVED)).cast("long")).otherwise(F.col("_before") + nth)
    kept = found.withColumn(column, number).where((nth >= F.col("_skip")) | F.col(column).isNull())
    return kept.select(column, *[F.col(f"`{c}`") for c in df.columns])
