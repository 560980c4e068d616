"""The monthly series of a stream, kept up to date batch by batch.

A batch leaves its own sums by month in a folder of its number, so a batch that is run
again after a failure replaces what it left before, and late rows simply add to their
month. The series is the sum over the batches; it equals the series of all rows read at
once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.series import month_sums, series_of_sums


def windowed_totals(stream: DataFrame, time: str, measure: str, width: str = "30 days", late: str = "1 day") -> DataFrame:
    """(start, value, n) of each window of fixed width once the watermark has passed it."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    return windows.agg(F.sum(measure).alias("value"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "value", "n")


def keep_monthly(stream: DataFrame, date: str, measure: str, path: str, **options: object) -> StreamingQuery:
    """Start a query that keeps the sums by month of a stream under ``path``; options go to the trigger (``availableNow=True``)."""

    def keep(batch: DataFrame, number: int) -> None:
        month_sums(batch, date, measure).write.mode("overwrite").parquet(f"{path}/sums/batch={number}")

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(**options) if options else writer).start()


def monthly_so_far(spark: SparkSession, path: str) -> DataFrame:
    """(idx, month, value, n, mom_change, trend) of what :func:`keep_monthly` has read so far."""
    sums = spark.read.schema("month string, total double, n long, batch long").parquet(f"{path}/sums")
    return series_of_sums(sums.groupBy("month").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
