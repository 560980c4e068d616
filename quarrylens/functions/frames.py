"""Small frames made from values of the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of a few rows that the plan itself holds: reading it needs no task."""
    types = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(types)
    arrow = to_arrow_schema(types)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], arrow), types)
