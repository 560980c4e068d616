"""Per-column profiles: types, basics, numbers, categories and texts.

Functions take a DataFrame and return tidy DataFrames with a row for each column
or each of its values. Numbers come from one wide aggregate over one scan;
distinct values come from counts of (column, value) that are combined before
the shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import small_frame
from ..functions.semantics import HARDLY, ID_NAME, MOSTLY, MOSTLY_DISTINCT, is_numeric, is_scalar, is_temporal, jsround, number, present, text_date, text_number

#: Columns of one wide aggregate; wider tables take several.
WIDE = 40


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_scalar(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _per_column(df: DataFrame, columns: list[str], measures) -> DataFrame:
    """A row for each column of ``measures(column)``, a list of aliased aggregates, from wide aggregates."""
    frames = []
    for at in range(0, max(1, len(columns)), WIDE):
        part = columns[at : at + WIDE]
        if not part:
            continue
        structs = [F.struct(F.lit(at + i).alias("ordinal"), F.lit(c).alias("column"), *measures(c)) for i, c in enumerate(part)]
        frames.append(df.agg(F.array(*structs).alias("a")).select(F.inline("a")))
    return reduce(DataFrame.unionByName, frames)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of the cells that hold something, as text."""
    cells = df.select(*[F.when(present(F.col(f"`{c}`"), _kind(df, c)), F.col(f"`{c}`").cast("string")).alias(c) for c in columns])
    long = cells.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "value").where("value IS NOT NULL")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, column, type, n_rows, n_present, n_numeric, n_date, n_distinct): the semantic type of each column.

    Texts are tested once for each distinct value. Distinct values of native
    numbers are counted only where the name says identifier.
    """
    columns = columns or scalar_columns(df)
    named = small_frame(df.sparkSession, [(i, c, _native(_kind(df, c)), _hints_id(c)) for i, c in enumerate(columns)], "ordinal int, column string, native string, id_name boolean")
    counts = _per_column(
        df, columns, lambda c: [F.count(F.lit(1)).alias("n_rows"), F.count(F.when(present(F.col(f"`{c}`"), _kind(df, c)), 1)).alias("n_present"), F.count(number(F.col(f"`{c}`"), _kind(df, c))).alias("native_numbers")]
    ).drop("ordinal")
    asked = [c for c in columns if _native(_kind(df, c)) == "text" or (_native(_kind(df, c)) == "number" and _hints_id(c))]
    rows = named.join(counts, "column")
    if asked:
        values = value_counts(df, asked)
        is_number = text_number(F.col("value")).isNotNull()
        is_date = ~is_number & text_date(F.col("value")).isNotNull()
        found = values.groupBy("column").agg(
            F.sum(F.when(is_number, F.col("n")).otherwise(0)).alias("text_numbers"),
            F.sum(F.when(is_date, F.col("n")).otherwise(0)).alias("text_dates"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.countDistinct(F.lower("value")).alias("n_lower"),
        )
        rows = rows.join(found, "column", "left")
    else:
        rows = rows.withColumns({x: F.lit(None).cast("long") for x in ("text_numbers", "text_dates", "n_distinct", "n_lower")})
    text = F.col("native") == "text"
    numbers = F.when(text, F.coalesce("text_numbers", F.lit(0))).otherwise(F.col("native_numbers"))
    dates = F.when(text, F.coalesce("text_dates", F.lit(0))).when(F.col("native") == "date", F.col("n_present")).otherwise(0)
    rows = rows.withColumns({"n_numeric": numbers.cast("long"), "n_date": dates.cast("long")})
    return rows.select("ordinal", "column", type_of().alias("type"), "n_rows", "n_present", "n_numeric", "n_date")


def type_of() -> Column:
    """The semantic type by counts of a column: n_rows, n_present, n_numeric, n_date, n_distinct, n_lower, and whether its name says identifier."""
    share, dated = F.try_divide("n_numeric", "n_present"), F.try_divide("n_date", "n_present")
    return (
        F.when(F.col("n_present") == 0, "text")
        .when(dated > MOSTLY, "date")
        .when((share > MOSTLY) & F.col("id_name") & (F.try_divide("n_distinct", "n_rows") > MOSTLY_DISTINCT), "id")
        .when(share > MOSTLY, "numeric")
        .when((share < HARDLY) & (F.try_divide("n_lower", "n_rows") > MOSTLY_DISTINCT), "text")
        .when(share < HARDLY, "categorical")
        .otherwise("text")
    )


def cell_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of all cells as text, with a row for the cells of a column that hold nothing (a null value)."""
    cells = df.select(*[F.when(present(F.col(f"`{c}`"), _kind(df, c)), F.col(f"`{c}`").cast("string")).alias(c) for c in columns])
    return cells.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def summaries_of_counts(df: DataFrame, columns: list[str], counts: DataFrame) -> DataFrame:
    """(ordinal, column, type, n_rows, n_present, n_numeric, n_date, n_distinct, top_count) from counts of all cells of ``df``."""
    natives = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(_native(_kind(df, c))))])
    value, native = F.col("value"), F.col("native")
    is_number = F.when(native == "text", text_number(value).isNotNull()).otherwise((native == "number") & (value != "NaN"))
    tested = counts.withColumn("native", natives[F.col("column")]).withColumn("is_number", F.coalesce(is_number, F.lit(False)))
    tested = tested.withColumn("is_date", F.coalesce(F.when(native == "text", ~F.col("is_number") & text_date(value).isNotNull()).otherwise((native == "date") & value.isNotNull()), F.lit(False)))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    found = tested.groupBy("column").agg(
        F.sum("n").alias("n_rows"), total(value.isNotNull()).alias("n_present"), total(F.col("is_number")).alias("n_numeric"), total(F.col("is_date")).alias("n_date"), F.count("value").alias("n_distinct"),
        F.countDistinct(F.when(native == "text", F.lower("value"))).alias("n_lower"), F.coalesce(F.max(F.when(value.isNotNull(), F.col("n"))), F.lit(0)).alias("top_count"),
    )
    held = {r["column"]: r for r in found.collect()}  # a row for each column
    names = ("n_rows", "n_present", "n_numeric", "n_date", "n_distinct", "n_lower", "top_count")
    rows = [(i, c, _hints_id(c), *[held[c][n] if c in held else 0 for n in names]) for i, c in enumerate(columns)]
    schema = "ordinal int, column string, id_name boolean, " + ", ".join(f"{n} long" for n in names)
    return small_frame(df.sparkSession, rows, schema).select("ordinal", "column", type_of().alias("type"), *[n for n in names if n != "n_lower"])


def _native(kind: T.DataType) -> str:
    return "date" if is_temporal(kind) else "number" if is_numeric(kind) or isinstance(kind, T.BooleanType) else "text"


def _hints_id(name: str) -> bool:
    import re

    return re.search(ID_NAME.removeprefix("(?i)"), name, re.I) is not None


def column_basics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_rows, non_null, null_count, null_pct, distinct_count, uniqueness_pct, quality) of each column."""
    columns = columns or scalar_columns(df)
    counts = _per_column(df, columns, lambda c: [F.count(F.lit(1)).alias("n_rows"), F.count(F.when(present(F.col(f"`{c}`"), _kind(df, c)), 1)).alias("non_null")])
    distinct = value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    rows = counts.join(distinct, "column", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    return basics_of(rows)


def basics_of(rows: DataFrame) -> DataFrame:
    """The basics from (column, n_rows, non_null, distinct_count)."""
    nulls = F.col("n_rows") - F.col("non_null")
    share = nulls / F.nullif(F.col("n_rows"), F.lit(0))
    pct = F.coalesce(jsround(share * 100, 2), F.lit(0.0))
    quality = F.when(nulls == 0, "complete").when(pct > 20, "many missing").otherwise("some missing")
    return rows.select(
        "column", "n_rows", "non_null", nulls.alias("null_count"), pct.alias("null_pct"), "distinct_count",
        F.coalesce(jsround(F.try_divide(F.col("distinct_count").cast("double"), F.col("n_rows")) * 100, 2), F.lit(0.0)).alias("uniqueness_pct"), quality.alias("quality"),
    )


def _moments(df: DataFrame, columns: list[str], approximate: bool) -> DataFrame:
    """n, sum, extremes and population deviation of each column, unrounded; approximate quartiles if asked."""

    def measures(c: str) -> list[Column]:
        x = number(F.col(f"`{c}`"), _kind(df, c))
        quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).cast("array<double>").alias("q")] if approximate else []
        return [
            F.count(F.lit(1)).alias("n_rows"), F.count(x).alias("n"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("sd"), *quartiles,
        ]

    return _per_column(df, columns, measures)


def narrow_columns(df: DataFrame, columns: list[str], most: int) -> list[str]:
    """The columns that can have at most ``most`` distinct values, by estimates of one scan (far outside their error)."""
    estimates = [F.approx_count_distinct(F.col(f"`{c}`").cast("string"), 0.02).alias(f"c{i}") for i, c in enumerate(columns)]
    found = df.agg(*estimates).first() if columns else []
    return [c for i, c in enumerate(columns) if found[i] <= 1.5 * most + 10]


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> dict[str, list[float]]:
    """Exact interpolated quantiles of the numbers of columns; columns without numbers are left out."""
    if not columns:
        return {}
    cells = df.select(*[number(F.col(f"`{c}`"), _kind(df, c)).alias(c) for c in columns])
    long = cells.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "x").where("x IS NOT NULL")
    return quantiles_of_counts(long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("n")), shares)


def quantiles_of_counts(counts: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> dict[str, list[float]]:
    """Exact interpolated quantiles of each column from counts (column, x, n) of its numbers.

    Values are sorted by range; sums of the ranges, a row for each range and
    column, tell which range holds which rank. So no task holds a column, and only the
    values at the asked ranks come to the driver.
    """
    dealt = counts.repartitionByRange("column", "x").withColumn("part", F.spark_partition_id()).persist()
    try:
        sizes, offsets = {}, []
        for r in dealt.groupBy("column", "part").agg(F.sum("n").alias("n")).orderBy("column", "part").collect():
            offsets.append((r["column"], r["part"], sizes.get(r["column"], 0)))
            sizes[r["column"]] = sizes.get(r["column"], 0) + r["n"]
        if not sizes:
            return {}
        wanted = [(c, int(k)) for c in sizes for p in shares for k in {math.floor((sizes[c] - 1) * p), math.ceil((sizes[c] - 1) * p)}]
        spark = counts.sparkSession
        starts = small_frame(spark, offsets, "column string, part int, offset long")
        ranks = small_frame(spark, sorted(set(wanted)), "column string, place long")
        running = Window.partitionBy("column", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        placed = dealt.join(F.broadcast(starts), ["column", "part"]).withColumn("upto", F.col("offset") + F.sum("n").over(running))
        found = placed.join(F.broadcast(ranks), "column").where("place < upto AND place >= upto - n")
        at = {(r["column"], r["place"]): r["x"] for r in found.select("column", "place", "x").collect()}
    finally:
        dealt.unpersist()

    def value(c: str, p: float) -> float:
        place = (sizes[c] - 1) * p
        low, high = at[c, math.floor(place)], at[c, math.ceil(place)]
        return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high

    return {c: [value(c, p) for p in shares] for c in sizes}


def numeric_stats(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Descriptive statistics and both kinds of outliers of each numeric column with at least two numbers.

    Moments come from one scan, quartiles from sorted counts of the values, outliers
    from a scan against the fences, one small row for each column. ``approximate``
    takes quartiles from sketches of bounded size within the first scan.
    """
    columns = columns or numeric_columns(df)
    first = {r["column"]: r for r in _moments(df, columns, approximate).collect()}
    kept = [c for c in columns if first[c]["n"] >= 2]
    quartiles = {c: first[c]["q"] for c in kept} if approximate else exact_quantiles(df, kept)
    stats, fences = _described(df.sparkSession, first, kept, quartiles)

    def outside(c: str) -> list[Column]:
        x, (mean, sd, low, high) = number(F.col(f"`{c}`"), _kind(df, c)), fences[c]
        z = F.when(F.abs(x - mean) / sd > 3, x) if sd else F.lit(None).cast("double")
        q = F.when((x < low) | (x > high), x)
        return [F.count(z).alias("z_outliers"), F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.count(q).alias("iqr_outliers"), F.min(q).alias("iqr_min"), F.max(q).alias("iqr_max")]

    if not kept:
        return _without_outliers(stats)
    return stats.join(F.broadcast(_per_column(df, kept, outside).drop("ordinal")), "column").drop("ordinal")


def numeric_stats_of_counts(df: DataFrame, columns: list[str], counts: DataFrame, first: dict) -> DataFrame:
    """The same from counts (column, x, n) of the distinct numbers and the columns' moments: quartiles and outliers need no scan of the table."""
    kept = [c for c in columns if first[c]["n"] >= 2]
    if not kept:
        return _without_outliers(_described(df.sparkSession, first, [], {})[0])
    held = counts.where(F.col("column").isin(kept))
    stats, fences = _described(df.sparkSession, first, kept, quantiles_of_counts(held))
    limits = small_frame(df.sparkSession, [(c, *map(float, f)) for c, f in fences.items()], "column string, mean double, sd double, low double, high double")
    x, n = F.col("x"), F.col("n")
    z, q = (F.col("sd") > 0) & (F.abs(x - F.col("mean")) / F.col("sd") > 3), (x < F.col("low")) | (x > F.col("high"))
    of = lambda f, when: f(F.when(when, x))
    told = held.join(F.broadcast(limits), "column").groupBy("column").agg(  # a row for each column
        F.sum(F.when(z, n).otherwise(0)).alias("z_outliers"), of(F.min, z).alias("z_min"), of(F.max, z).alias("z_max"), F.sum(F.when(q, n).otherwise(0)).alias("iqr_outliers"), of(F.min, q).alias("iqr_min"), of(F.max, q).alias("iqr_max")
    )
    return stats.join(F.broadcast(told), "column").drop("ordinal")


def _without_outliers(stats: DataFrame) -> DataFrame:
    """The columns of outliers for a frame without rows."""
    return stats.drop("ordinal").withColumns({c: F.lit(None).cast("double" if "m" in c[2:] else "long") for c in ("z_outliers", "z_min", "z_max", "iqr_outliers", "iqr_min", "iqr_max")})


def _described(spark, first: dict, kept: list[str], quartiles: dict) -> tuple[DataFrame, dict]:
    """Statistics of columns from their moments and quartiles, rounded, and the unrounded (mean, deviation, low fence, high fence)."""
    schema = (
        "ordinal int, column string, n long, non_numeric long, sum double, mean double, median double, min double, max double, range double, std_dev double, variance double, q1 double, q3 double, "
        "iqr double, skewness double, cv double, lower_fence double, upper_fence double"
    )
    rows, fences = [], {}
    for i, c in enumerate(kept):
        r = first[c]
        q1, median, q3 = quartiles[c]
        iqr = q3 - q1
        low, high = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        fences[c] = (r["mean"], r["sd"], low, high)
        rows.append((
            i, c, r["n"], r["n_rows"] - r["n"], r["sum"], r["mean"], median, r["min"], r["max"], r["max"] - r["min"], r["sd"], r["sd"] ** 2, q1, q3, iqr,
            3 * (r["mean"] - median) / r["sd"] if r["sd"] else 0.0, abs(r["sd"] / r["mean"]) * 100 if r["mean"] else None, low, high,
        ))
    rows = [tuple(half_up(x, 2 if j == 16 else 4) if isinstance(x, float) else x for j, x in enumerate(r)) for r in rows]
    return small_frame(spark, rows, schema), fences


def half_up(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits if abs(x) < 1e15 / 10**digits else x


def outlier_disagreement(stats: DataFrame) -> DataFrame:
    """(column, z_outliers, iqr_outliers, disagree): whether the two methods differ by over half of the larger."""
    most = F.greatest("z_outliers", "iqr_outliers")
    gap = F.abs(F.col("z_outliers") - F.col("iqr_outliers"))
    return stats.select("column", "z_outliers", "iqr_outliers", ((most > 0) & (gap > 0.5 * most)).alias("disagree"))


def column_sheet(basics: DataFrame, stats: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """What is known of each column side by side: its basics, and its numbers and commonest value where it has them."""
    sheet = basics.join(F.broadcast(stats.drop("n")), "column", "left")  # a row for each column
    return sheet.join(F.broadcast(modes.select("column", "mode", "mode_count")), "column", "left") if modes is not None else sheet


def primary_column(stats: DataFrame, order: list[str]) -> DataFrame:
    """The column of the largest variance as a one-row frame; of equals the first in ``order``, that of the table."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("column"))
    return stats.orderBy(F.desc("variance"), place).limit(1).select(F.col("column").alias("primary_column"), "variance")


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 7) -> DataFrame:
    """(column, bin, low, high, count, is_mode) over equal widths; the last bin holds the maximum.

    Columns with under two numbers or a single value have none.
    """
    columns = columns or numeric_columns(df)
    cells = df.select(*[number(F.col(f"`{c}`"), _kind(df, c)).alias(c) for c in columns])
    long = cells.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "x").where("x IS NOT NULL")
    ends = long.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).where("n >= 2 AND hi > lo")
    # One row for each column.
    placed = long.join(F.broadcast(ends), "column").withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))).cast("int"))
    counted = placed.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rows = grid.join(counted, ["column", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    w = Window.partitionBy("column")
    width = (F.col("hi") - F.col("lo")) / bins
    first_most = F.min(F.when(F.col("count") == F.col("most"), F.col("bin"))).over(w)
    return (
        rows.withColumn("most", F.max("count").over(w))
        .withColumn("is_mode", F.col("bin") == first_most)
        .select("column", "bin", jsround(F.col("lo") + F.col("bin") * width).alias("low"), jsround(F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "count", "is_mode")
    )


def skew_direction(stats: DataFrame) -> DataFrame:
    label = F.when(F.col("skewness") > 0.5, "right-skewed").when(F.col("skewness") < -0.5, "left-skewed").otherwise("symmetric")
    return stats.select("column", "skewness", label.alias("direction"))


def _leaders(counts: DataFrame, top: int) -> DataFrame:
    """The most frequent values of each column, ranked, ties by value; every task sends on its own leaders only."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)


def _totals(counts: DataFrame) -> DataFrame:
    """(column, total, cardinality): a row for each column."""
    return counts.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cardinality"))


def category_counts(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """(column, rank, value, n, pct) of the most frequent values; ties by value."""
    return categories_of_counts(value_counts(df, columns), top)


def categories_of_counts(counts: DataFrame, top: int = 5) -> DataFrame:
    ranked = _leaders(counts, top).join(F.broadcast(_totals(counts)), "column")
    return ranked.select("column", "rank", "value", "n", jsround(F.col("n") / F.col("total") * 100, 2).alias("pct"))


def category_rollup(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(column, rank, value, n): the most frequent values and an ``Other`` row of the rest, if any."""
    counts = value_counts(df, columns)
    best = _leaders(counts, top).select("column", "rank", "value", "n")
    held = best.groupBy("column").agg(F.sum("n").alias("held"))
    rest = _totals(counts).join(F.broadcast(held), "column").where("total > held")
    return best.unionByName(rest.select("column", F.lit(top + 1).alias("rank"), F.lit("Other").alias("value"), (F.col("total") - F.col("held")).alias("n")))


def category_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mode, mode_count, cardinality, concentration_pct): the share is of all rows."""
    total = df.count()
    counts = value_counts(df, columns)
    ranked = _leaders(counts, 1).join(F.broadcast(_totals(counts)), "column")
    return ranked.select("column", F.col("value").alias("mode"), F.col("n").alias("mode_count"), "cardinality", jsround(F.col("n") / F.lit(float(total)) * 100, 2).alias("concentration_pct"))


def distribution(df: DataFrame, column: str, top: int = 10, bins: int = 7) -> DataFrame:
    """(place, label, n) of one column: its histogram where it has one, else its leading values."""
    if is_numeric(_kind(df, column)):
        bars = range_labels(histogram(df, [column], bins)).select(F.col("bin").alias("place"), "label", F.col("count").alias("n"))
        if not bars.isEmpty():
            return bars
    return category_rollup(df, [column], top).select((F.col("rank") - 1).alias("place"), F.col("value").alias("label"), "n")


def range_labels(bars: DataFrame, money: bool = False) -> DataFrame:
    """A histogram with the label of each bin's range; amounts of money have a dollar sign and two decimals."""
    shown = (lambda c: F.concat(F.lit("$"), F.format_number(c, 2))) if money else (lambda c: jsround(F.col(c), 2).cast("string"))
    return bars.withColumn("label", F.concat_ws(" \u2013 ", shown("low"), shown("high")))


def text_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, avg_length, avg_words, max_length, special_rows, space_rows); the word "null" is no text."""

    def measures(c: str) -> list[Column]:
        x = F.col(f"`{c}`")
        t = F.when((x != "") & (x != "null"), x)
        units = F.octet_length(F.encode(t, "UTF-16BE")) / 2
        words = F.regexp_count(t, F.lit(r"(?U)\S+"))
        odd = t.rlike(r"[<>{}\[\]\\]")
        spaced = t.rlike(r"(?U)^\s|\s$|\s{2,}")
        return [
            F.count(t).alias("n"), jsround(F.avg(units), 1).alias("avg_length"), jsround(F.avg(words), 1).alias("avg_words"), F.max(units).cast("long").alias("max_length"),
            F.count(F.when(odd, 1)).alias("special_rows"), F.count(F.when(spaced, 1)).alias("space_rows"),
        ]

    return _per_column(df, columns, measures).drop("ordinal")


def category_totals(df: DataFrame, category: str, measure: str, top: int = 5) -> DataFrame:
    """(rank, label, count, sum, mean, pct_of_total) of a number by category, largest sums first.

    Rows whose number is missing count: the mean is the sum over all rows of the
    category. Missing categories are the label "null".
    """
    x = F.coalesce(number(F.col(f"`{measure}`"), _kind(df, measure)), F.lit(0.0))
    label = F.coalesce(F.col(f"`{category}`").cast("string"), F.lit("null"))
    sums = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"), F.sum(x).alias("total"))
    pct = F.when(F.col("all") > 0, jsround(F.col("total") / F.col("all") * 100, 2)).otherwise(0.0)
    whole = sums.agg(F.sum("total").alias("all"))  # a single row
    shared = _first_labels(sums, top).crossJoin(F.broadcast(whole))
    return shared.select("rank", "label", "count", jsround(F.col("total"), 2).alias("sum"), jsround(F.col("total") / F.col("count"), 2).alias("mean"), pct.alias("pct_of_total"))


def _first_labels(sums: DataFrame, top: int) -> DataFrame:
    """The labels of the largest totals, ranked: tasks send on their own leaders, then one orders these few."""
    return sums.orderBy(F.desc("total"), "label").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "label")))


def donut(df: DataFrame, category: str, measure: str, top: int = 5) -> DataFrame:
    """(rank, label, value, share): the largest sums, and ``Other`` if the rest is positive; shares in whole per cent."""
    x = F.coalesce(number(F.col(f"`{measure}`"), _kind(df, measure)), F.lit(0.0))
    sums = df.groupBy(F.coalesce(F.col(f"`{category}`").cast("string"), F.lit("null")).alias("label")).agg(F.sum(x).alias("total"))
    best = _first_labels(sums, top).select("rank", "label", F.col("total").alias("value"))
    whole = sums.agg(F.sum("total").alias("all"))  # a single row, as is the sum of the leaders
    rest = whole.crossJoin(best.agg(F.sum("value").alias("held"))).select(F.lit(top + 1).alias("rank"), F.lit("Other").alias("label"), (F.col("all") - F.col("held")).alias("value"))
    others = sums.agg(F.count(F.lit(1)).alias("labels")).where(F.col("labels") > top)
    parts = best.unionByName(rest.join(F.broadcast(others), F.lit(True)).where(F.col("value") > 0).drop("labels"))
    return parts.select("rank", "label", jsround(F.col("value"), 2).alias("value"), jsround(F.col("value") / F.sum("value").over(Window.partitionBy()) * 100, 0).alias("share"))


def comparative(totals: DataFrame) -> DataFrame:
    """(top_by_sum, top_by_mean, differ) within the leading categories."""
    first = totals.agg(F.min_by("label", "rank").alias("top_by_sum"), F.max_by("label", F.struct("mean", -F.col("rank"))).alias("top_by_mean"))
    return first.withColumn("differ", F.col("top_by_sum") != F.col("top_by_mean"))
