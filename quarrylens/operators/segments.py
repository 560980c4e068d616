"""Questions on rows in order, answered by merging summaries of neighbouring segments.

Rows are grouped by the high bits of an exact whole-number key. A group's rows are read in
order in one task, at most ``2 ** BITS`` distinct keys of them, and leave one summary; the
summaries are grouped by the next higher bits, and so on, so four rounds cover all
64-bit keys, and no task orders more than a group. Rows of an equal key are merged first,
in the same way, by a second key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct keys of a group are at most ``2 ** BITS``.
BITS = 20

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def order_key(df: DataFrame, name: str) -> Column:
    """A column as an exact long that orders as it does."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, _WHOLE):
        return c.cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    raise ValueError(f"{name}: whole numbers and times order rows, not {kind.simpleString()}; number the rows first")


def levels(rows: DataFrame, keys: list[str], merge: Callable[[DataFrame, list[str], str], DataFrame], ends: dict | None = None) -> Iterator[tuple[DataFrame, list[str], str]]:
    """(rows, group columns, order column) of each round, from single rows up to one group.

    ``keys`` go from the first to the last that decides the order. ``merge`` makes a
    summary row of each group, with the group columns. ``ends`` has the least and the
    greatest of each key, as lo_<key> and hi_<key>, where they are known.
    """
    ends = ends or rows.agg(*[f(k).alias(f"{n}{k}") for k in keys for n, f in (("lo_", F.min), ("hi_", F.max))]).first().asDict()
    now = rows
    for i in reversed(range(len(keys))):
        k, low, high = keys[i], ends[f"lo_{keys[i]}"], ends[f"hi_{keys[i]}"]
        if low is None:
            return
        while True:
            last = high - low < 1 << BITS
            group = [*keys[:i]] if last else [*keys[:i], f"_{k}"]
            placed = now if last else now.withColumn(f"_{k}", F.shiftright(k, BITS))
            yield placed, group, k
            now = merge(placed, group, k)
            if last:
                break
            now, low, high = now.withColumnRenamed(f"_{k}", k), low >> BITS, high >> BITS


def in_group(group: list[str], order: str) -> Window:
    """The rows of a group in order; a last round has few enough rows for a single group."""
    return Window.partitionBy(*group).orderBy(order)


def before(value: Column, group: list[str], order: str) -> Column:
    """The last value that is not null among the group's earlier rows."""
    return F.last(value, ignorenulls=True).over(in_group(group, order).rowsBetween(Window.unboundedPreceding, -1))
