"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and the five control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"

_own_dirs: dict[str, str] = {}
_cut_paths: dict[int, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and runs on this machine alone (local tests)
    a temporary folder is made; on a cluster a missing name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
    return _own_dirs[app]


def cut(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: an executor lost later recomputes nothing before it.
    A table that is to outlast the :func:`scratch` it is written in has ``keep``.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _cut_paths[id(back)] = path
    weakref.finalize(back, _cut_paths.pop, id(back), None)
    return back


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are cut within the block when it ends; what is read later must have been kept."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            remove(spark, path)
        free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are gone: its cleaner waits for the driver's garbage collection."""
    spark._jvm.System.gc()


def forget(*frames: DataFrame) -> None:
    """Remove tables that :func:`cut` wrote, once nothing that is still to run reads them."""
    for df in frames:
        path = _cut_paths.pop(id(df), None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Bound the Arrow batches handed to Python, whose rows are whole texts, by rows and by bytes.

    Plans read the setting when they run, which for a returned frame is later, so it
    stays with the session; a smaller bound of the user's own is left alone.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def numbered(df: DataFrame, order: list, name: str, position: str) -> tuple[DataFrame, int]:
    """``df`` with each row's place (from 0) in an order, and the number of rows, without one task that orders all.

    Rows are dealt and sorted by range and written with their partition and place in it,
    so places do not depend on what a lost executor computes again; the partitions' sizes,
    a row each, give what stands before.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sizes.select("_part", "_size", before.alias("_before")).collect()  # a row for each partition
    starts = df.sparkSession.createDataFrame([(r["_part"], r["_before"]) for r in rows], "_part long, _before long")
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = held.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(position, F.col("_before") + nth)
    return placed.drop("_part", "_before", "_at"), sum(r["_size"] for r in rows)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(df[name], F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
