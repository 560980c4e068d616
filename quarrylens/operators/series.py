"""Dates, monthly series with trends, and correlations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import small_frame
from ..functions.semantics import correlation_strength, jsround, moment, number
from .columns import _kind, numeric_columns, quantiles_of_counts
from .segments import before, levels

DAY_MS = 86_400_000.0
SHORT_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _moments(df: DataFrame, column: str) -> DataFrame:
    return df.select(moment(F.col(f"`{column}`"), _kind(df, column)).alias("t")).where("t IS NOT NULL")


def weekday_counts(df: DataFrame, column: str) -> DataFrame:
    """(weekday, n): 0 is Sunday."""
    return _moments(df, column).groupBy((F.dayofweek("t") - 1).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


def month_counts(df: DataFrame, column: str) -> DataFrame:
    """(month, n): 1 is January."""
    return _moments(df, column).groupBy(F.month("t").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def gap_counts(df: DataFrame, column: str) -> DataFrame:
    """(gap, n): milliseconds between moments in order, counted; repeats of a moment add gaps of zero.

    Distinct moments are told apart by their bits from below: those that agree in all but
    the lowest bits are neighbours in one group, a group leaves its first and its last
    moment, and the gaps between groups come in the next round.
    """
    times = _moments(df, column).groupBy(F.unix_millis("t").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    rows = times.select("t", F.col("t").alias("first"), F.col("t").alias("last"))
    merge = lambda held, group, at: held.groupBy(*group).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    gaps = times.where("n > 1").groupBy(F.lit(0).cast("long").alias("gap")).agg(F.sum(F.col("n") - 1).alias("n"))
    ends = _moments(df, column).agg(F.min(F.unix_millis("t")).alias("lo_t"), F.max(F.unix_millis("t")).alias("hi_t")).first().asDict()
    for placed, group, at in levels(rows, ["t"], merge, ends):
        between = placed.select((F.col("first") - before(F.col("last"), group, at)).alias("gap")).where("gap IS NOT NULL")
        gaps = gaps.unionByName(between.groupBy("gap").agg(F.count(F.lit(1)).alias("n")))
    return gaps.groupBy("gap").agg(F.sum("n").alias("n"))


def date_gaps(df: DataFrame, column: str) -> DataFrame:
    """One row (largest_gap_days, median_gap_days, gap_anomaly), nulls under two moments; the median is exact, by ranks among the counted gaps."""
    counts = gap_counts(df, column).select(F.lit(column).alias("column"), F.col("gap").cast("double").alias("x"), "n").persist()
    try:
        mid, most = quantiles_of_counts(counts, (0.5, 1.0)).get(column, [None, None])
    finally:
        counts.unpersist()
    out = small_frame(df.sparkSession, [(most, mid)], "most double, mid double").select((F.col("most") / DAY_MS).alias("most"), (F.col("mid") / DAY_MS).alias("mid"))
    return out.select(jsround(F.col("most"), 1).alias("largest_gap_days"), jsround(F.col("mid"), 1).alias("median_gap_days"), ((F.col("most") > 2 * F.col("mid")) & (F.col("mid") > 0)).alias("gap_anomaly"))


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: n, earliest, latest, range_days, commonest weekday and month (the lowest of equals); null dates take no part."""
    times = _moments(df, column)
    span = times.agg(F.count("t").alias("n"), F.min("t").alias("earliest"), F.max("t").alias("latest"))
    top_day = weekday_counts(df, column).agg(F.max_by("weekday", F.struct("n", -F.col("weekday"))).alias("mode_weekday"))
    top_month = month_counts(df, column).agg(F.max_by("month", F.struct("n", -F.col("month"))).alias("mode_month"))
    # Three frames of one row each.
    one = F.lit(1).alias("one")
    joined = span.select("*", one).join(top_day.select("*", one), "one").join(top_month.select("*", one), "one")
    days = jsround((F.unix_millis("latest") - F.unix_millis("earliest")) / DAY_MS, 0).cast("long")
    return joined.where("n >= 2").select(
        "n", F.date_format("earliest", "yyyy-MM-dd").alias("earliest"), F.date_format("latest", "yyyy-MM-dd").alias("latest"), days.alias("range_days"), "mode_weekday", "mode_month"
    )


def month_sums(df: DataFrame, date: str, measure: str) -> DataFrame:
    """(month, total, n): sums by month; missing numbers count as rows of nothing."""
    t, raw = moment(F.col(f"`{date}`"), _kind(df, date)), F.col(f"`{measure}`")
    x = number(raw, _kind(df, measure))
    rows = df.select(F.date_format(t, "yyyy-MM").alias("month"), x.alias("x"), raw.isNull().alias("missing")).where("month IS NOT NULL AND (x IS NOT NULL OR missing)")
    return rows.groupBy("month").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n"))


def monthly_series(df: DataFrame, date: str, measure: str) -> DataFrame:
    """(idx, month, value, n, mom_change, trend): sums by month with change on the month before and a fitted line.

    Missing numbers count as rows of nothing; months without rows do not appear.
    """
    return series_of_sums(month_sums(df, date, measure))


def series_of_sums(sums: DataFrame) -> DataFrame:
    """The series from (month, total, n)."""
    buckets = sums.select("month", jsround(F.col("total"), 2).alias("value"), "n")
    w = Window.orderBy("month")  # one row for each month
    before = F.lag("value").over(w)
    placed = buckets.withColumns({"idx": F.row_number().over(w) - 1, "mom_change": F.when(before != 0, jsround((F.col("value") - before) / F.abs(before) * 100, 2))})
    every = Window.partitionBy()
    slope, intercept = F.regr_slope("value", "idx").over(every), F.regr_intercept("value", "idx").over(every)
    return placed.select("idx", "month", "value", "n", "mom_change", jsround(intercept + slope * F.col("idx"), 2).alias("trend"))


def series_summary(series: DataFrame) -> DataFrame:
    """One row: periods, slope, direction, peak and trough (the first of equals) and their ratio; none under two periods."""
    out = series.agg(
        F.count(F.lit(1)).alias("periods"), F.regr_slope("value", "idx").alias("s"), F.avg("value").alias("mean"),
        F.max_by(F.struct("month", "value"), F.struct("value", -F.col("idx"))).alias("peak"), F.min_by(F.struct("month", "value"), F.struct("value", "idx")).alias("trough"),
    )
    relative = F.try_divide("s", F.abs("mean"))
    direction = F.when(relative > 0.02, "Upward trend").when(relative < -0.02, "Downward trend").otherwise("Flat")
    return out.where("periods >= 2").select(
        "periods", jsround(F.col("s"), 4).alias("slope"), direction.alias("direction"), F.col("peak.month").alias("peak_month"), F.col("peak.value").alias("peak_value"),
        F.col("trough.month").alias("trough_month"), F.col("trough.value").alias("trough_value"), jsround(F.try_divide("peak.value", "trough.value"), 2).alias("peak_to_trough"),
    )


def seasonality(series: DataFrame) -> DataFrame:
    """One row (top_month, bottom_month, excess_pct) where over twelve periods show a calendar month half above another."""
    named = F.element_at(F.array(*[F.lit(m) for m in SHORT_MONTHS]), F.substring("month", 6, 2).cast("int"))
    by_month = series.groupBy(F.substring("month", 6, 2).cast("int").alias("m"), named.alias("name")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("k"))
    out = by_month.agg(F.max_by(F.struct("name", "mean"), F.struct("mean", -F.col("m"))).alias("top"), F.min_by(F.struct("name", "mean"), F.struct("mean", "m")).alias("low"), F.sum("k").alias("periods"))
    return out.where("periods > 12 AND low.mean > 0 AND top.mean > 1.5 * low.mean").select(
        F.col("top.name").alias("top_month"), F.col("low.name").alias("bottom_month"), jsround((F.col("top.mean") / F.col("low.mean") - 1) * 100, 0).alias("excess_pct")
    )


#: Pairs that one generated aggregate takes; more columns go through block products.
PAIRS = 45
#: Columns of a block.
BLOCK = 256


def correlations(df: DataFrame, columns: list[str] | None = None, least: int = 5) -> DataFrame:
    """(col_a, col_b, n, r, abs_r, strength) of each pair of columns over the rows that have both; null under ``least`` rows."""
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    schema = "col_a string, col_b string, n long, r double, abs_r double, strength string"
    if not pairs:
        return small_frame(df.sparkSession, [], schema)
    rows = _pairwise(df, pairs) if len(pairs) <= PAIRS else blocked_moments(df, columns)
    r = F.when((F.col("n") >= least) & ~F.isnan("raw"), jsround(F.col("raw")))
    return rows.select("col_a", "col_b", "n", r.alias("r")).select("*", F.abs("r").alias("abs_r"), correlation_strength(F.col("r")).alias("strength"))


def _pairwise(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, n, raw) by one aggregate with a few sums for each pair."""
    cells = {c: number(F.col(f"`{c}`"), _kind(df, c)) for p in pairs for c in p}

    def measure(a: str, b: str) -> Column:
        x, y = cells[a], cells[b]
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        # corr() itself fails on a constant column where ANSI mode is on.
        raw = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        return F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.count(F.when(both, 1)).alias("n"), raw.alias("raw"))

    return df.agg(F.array(*[measure(a, b) for a, b in pairs]).alias("a")).select(F.inline("a"))


def _block_sums(left: list[str], right: list[str]):
    """Sums over a task's rows for pairs of two blocks of columns: rows with both, of each number, square and product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(left), len(right)))
        for b in batches:
            x, y = (np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in held]) for held in (left, right))
            m, k = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.where(m > 0, x, 0.0), np.where(k > 0, y, 0.0)
            for i, (u, v) in enumerate(((m, k), (x, k), (m, y), (x * x, k), (m, y * y), (x, y))):
                sums[i] += u.T @ v
        rows = {"a": pa.array(left)} | {f"s{i}": pa.array(list(sums[i]), pa.list_(pa.float64())) for i in range(6)}
        yield pa.RecordBatch.from_pydict(rows)

    return run


def _add_arrays(table: pa.Table) -> pa.Table:
    """The sums of one column's arrays, a row for each task that read rows."""
    sums = {f"s{i}": [np.sum(np.asarray(table.column(f"s{i}").to_pylist(), float), axis=0).tolist()] for i in range(6)}
    return pa.table({"a": [table.column("a")[0].as_py()]} | sums, pa.schema([("a", pa.string()), *[(f"s{i}", pa.list_(pa.float64())) for i in range(6)]]))


def blocked_moments(df: DataFrame, columns: list[str], block: int | None = None) -> DataFrame:
    """(col_a, col_b, n, raw) of all pairs by matrix products of blocks of columns, a scan for each pair of blocks.

    A batch's columns, zero where missing, and their masks are multiplied, so each pair
    sums over the rows that have both. Numbers are shifted by their column's mean, which
    keeps differences of large sums exact enough. A task sends six sums for each pair.
    """
    block = block or BLOCK
    means = df.agg(*[F.avg(number(F.col(f"`{c}`"), _kind(df, c))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shifted = df.select(*[(number(F.col(f"`{c}`"), _kind(df, c)) - F.lit(means[i] if means[i] is not None else 0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(columns))]
    blocks = [names[s : s + block] for s in range(0, len(names), block)]
    schema = "a string, " + ", ".join(f"s{i} array<double>" for i in range(6))
    out = []
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            held = shifted.select(*dict.fromkeys([*left, *right]))
            sums = held.mapInArrow(_block_sums(left, right), schema).groupBy("a").applyInArrow(_add_arrays, schema)
            each = sums.select("a", F.posexplode(F.arrays_zip(*[f"s{k}" for k in range(6)])).alias("place", "s"))
            named = each.withColumn("b", F.get(F.lit(right), F.col("place"))).select("a", "b", "s.*")
            out.append(named.where(F.substring("a", 2, 9).cast("int") < F.substring("b", 2, 9).cast("int")))
    rows = reduce(DataFrame.unionByName, out)
    n = F.col("s0")
    spread = lambda square, total: F.greatest(square / n - (total / n) ** 2, F.lit(0.0))
    raw = F.try_divide(F.col("s5") / n - (F.col("s1") / n) * (F.col("s2") / n), F.sqrt(spread(F.col("s3"), F.col("s1")) * spread(F.col("s4"), F.col("s2"))))
    name = lambda c: F.get(F.lit(columns), F.substring(c, 2, 9).cast("int"))
    return rows.select(name("a").alias("col_a"), name("b").alias("col_b"), n.cast("long").alias("n"), F.when(n > 0, raw).alias("raw"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, r) of every ordered pair, one on the diagonal."""
    columns = columns or numeric_columns(df)
    pairs = correlations(df, columns).select("col_a", "col_b", "r")
    mirrored = pairs.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    diagonal = small_frame(df.sparkSession, [(c, c, 1.0) for c in columns], "col_a string, col_b string, r double")
    return pairs.unionByName(mirrored).unionByName(diagonal)


def correlation_highlights(pairs: DataFrame, top: int = 3) -> DataFrame:
    """(kind, rank, col_a, col_b, r, strength): the strongest pairs, and the most negative below -0.2 if not among them."""
    known = pairs.where("r IS NOT NULL")
    w = Window.orderBy(F.desc("abs_r"), "col_a", "col_b")  # one row for each pair of columns
    ranked = known.withColumns({"rank": F.row_number().over(w), "low": F.row_number().over(Window.orderBy("r", "col_a", "col_b"))})
    strongest = F.col("rank") <= top
    opposed = (F.col("low") == 1) & (F.col("r") < -0.2) & ~strongest
    return ranked.where(strongest | opposed).select(F.when(strongest, "strongest").otherwise("most negative").alias("kind"), "rank", "col_a", "col_b", "r", "strength")
