"""Anomalies, quality flags, the health score, and cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import small_frame
from ..functions.semantics import (
    CLEAN_NULLS, CURRENCY, SCORE_NULLS, clean_date, clean_number, clean_text, jsround, looks_like_date, looks_like_money, number, present, text_date, text_number,
)
from ..sources.shared import written
from .columns import WIDE, _kind, _per_column, narrow_columns, numeric_columns, scalar_columns, value_counts
from .segments import before, levels, order_key

# Shares of first digits 1 to 9 by Benford's law, and the deviation that counts.
BENFORD = [0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046]
BENFORD_LIMIT = 0.04
# Distinct values of columns whose spellings are compared.
FUZZY_VALUES = (2, 199)
#: Rows at the start that the score and the preview look at, and those that decide on currency.
FIRST_ROWS, CURRENCY_ROWS = 500, 200


def with_row_ids(df: DataFrame, *order: str) -> DataFrame:
    """``_row_id`` from 0 in the given order, for rows that come from no file reader.

    Rows are sorted by range and written with their place in their range; a range's rows
    are numbered after those of the ranges before it, whose counts are one row each. So no
    task orders all rows, and the numbers do not change if part of the work is done again.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    held = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # a row for each range
    return held.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_row_id", F.col("_before") + nth).drop("_part", "_before", "_at")


def drop_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows in which any of the columns (all scalar ones) holds something."""
    held = [present(F.col(f"`{c}`"), _kind(df, c)) for c in (columns or scalar_columns(df))]
    return df.where(reduce(lambda a, b: a | b, held)) if held else df


# ---- anomalies --------------------------------------------------------------------------------


def near_constant(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    """(column, top_count, n_rows, top_share, near_constant): the share of the commonest value among all rows."""
    total = df.count()
    top = value_counts(df, columns).groupBy("column").agg(F.max("n").alias("top_count"))
    share = F.try_divide(F.col("top_count").cast("double"), F.lit(total))
    return top.select("column", "top_count", F.lit(total).cast("long").alias("n_rows"), jsround(share).alias("top_share"), (share > limit).alias("near_constant"))


def constant_columns(stats: DataFrame) -> DataFrame:
    """(column, std_dev, constant): whether the rounded deviation is zero."""
    return stats.select("column", "std_dev", (F.col("std_dev") == 0).alias("constant"))


def all_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, all_zero) for columns with a number."""
    return _per_column(df, columns, lambda c: [F.count(number(F.col(f"`{c}`"), _kind(df, c))).alias("n"), F.bool_and(number(F.col(f"`{c}`"), _kind(df, c)) == 0).alias("all_zero")]).where("n > 0").select("column", "all_zero")


def suspicious_rounding(df: DataFrame, columns: list[str] | None = None, limit: float = 0.8) -> DataFrame:
    """(column, n, n_round, round_share, suspicious): numbers that are non-zero multiples of ten."""
    columns = columns or numeric_columns(df)

    def measures(c: str):
        x = number(F.col(f"`{c}`"), _kind(df, c))
        return [F.count(x).alias("n"), F.count(F.when((x != 0) & (x % 10 == 0), 1)).alias("n_round")]

    return _rounded(_per_column(df, columns, measures), limit)


def rounding_of_counts(numbers: DataFrame, limit: float = 0.8) -> DataFrame:
    """The same from counts (column, x, n) of numbers."""
    x, n = F.col("x"), F.col("n")
    return _rounded(numbers.groupBy("column").agg(F.sum(n).alias("n"), F.sum(F.when((x != 0) & (x % 10 == 0), n).otherwise(0)).alias("n_round")), limit)


def _rounded(counts: DataFrame, limit: float) -> DataFrame:
    share = F.col("n_round") / F.col("n")
    return counts.where("n > 0").select("column", "n", "n_round", jsround(share).alias("round_share"), (share > limit).alias("suspicious"))


def monotonic(df: DataFrame, columns: list[str], order: str, least: int = 6, tie: str | None = None) -> DataFrame:
    """(column, n, direction) of columns that never fall or never rise in row order, null numbers left out.

    A segment of rows is summed up by how many numbers it has, whether they rise and
    fall, and the first and the last of them; neighbouring segments merge by comparing the
    ends that meet. Order is by exact whole-number (or time) keys; ``tie`` orders the rows
    of an equal key.
    """
    keys = ["_o", "_t"] if tie else ["_o"]
    found = []
    for start in range(0, len(columns), WIDE):
        part = columns[start : start + WIDE]

        def one(c: str) -> Column:
            x = number(F.col(f"`{c}`"), _kind(df, c))
            return F.struct(x.isNotNull().cast("long").alias("n"), F.lit(True).alias("up"), F.lit(True).alias("down"), x.alias("first"), x.alias("last"))

        ids = [order_key(df, order).alias("_o"), *([order_key(df, tie).alias("_t")] if tie else [])]
        rows = df.select(*ids, *[one(c).alias(f"s{i}") for i, c in enumerate(part)])

        def merge(rows: DataFrame, group: list[str], at: str) -> DataFrame:
            told = []
            for i in range(len(part)):
                s, prior = F.col(f"s{i}"), before(F.col(f"s{i}.last"), group, at)
                fine = lambda ok: F.coalesce(ok, F.lit(True))
                told.append(F.struct(s["n"].alias("n"), (s["up"] & fine(s["first"] >= prior)).alias("up"), (s["down"] & fine(s["first"] <= prior)).alias("down"), s["first"].alias("first"), s["last"].alias("last")).alias(f"s{i}"))
            held = rows.select(*group, at, *told)
            sums = []
            for i in range(len(part)):
                s = F.col(f"s{i}")
                here = F.when(s["first"].isNotNull(), F.col(at))
                sums.append(F.struct(F.sum(s["n"]).alias("n"), F.bool_and(s["up"]).alias("up"), F.bool_and(s["down"]).alias("down"), F.min_by(s["first"], here).alias("first"), F.max_by(s["last"], here).alias("last")).alias(f"s{i}"))
            return held.groupBy(*group).agg(*sums)

        last = None
        for placed, group, at in levels(rows, keys, merge):
            last = (placed, group, at)
        if last:
            whole = merge(*last)
            found.append(whole.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(part)]))))
    if not found:
        return small_frame(df.sparkSession, [], "column string, n long, direction string")
    out = reduce(DataFrame.unionByName, found).select("column", "s.n", "s.up", "s.down")
    return out.where((F.col("n") >= least) & (F.col("up") | F.col("down"))).select("column", "n", F.when(F.col("up"), "increasing").otherwise("decreasing").alias("direction"))


def benford(df: DataFrame, columns: list[str] | None = None, least: int = 50) -> DataFrame:
    """(column, digits, mad, deviates): mean absolute deviation of first digits from Benford's shares, over ``least`` digits."""
    columns = columns or numeric_columns(df)
    cells = df.select(*[number(F.col(f"`{c}`"), _kind(df, c)).alias(c) for c in columns])
    long = cells.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "x").where("x IS NOT NULL")
    return benford_of_counts(long.withColumn("n", F.lit(1)), least)


def benford_of_counts(numbers: DataFrame, least: int = 50) -> DataFrame:
    """The same from counts (column, x, n) of numbers."""
    digit = F.regexp_extract(F.abs("x").cast("string"), "[1-9]", 0)
    counts = numbers.groupBy("column", digit.alias("digit")).agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    by_column = counts.groupBy("column").agg(
        F.sum("n").alias("all"), (F.max("hi") > F.min("lo")).alias("varies"), F.sum(F.when(F.col("digit") != "", F.col("n")).otherwise(0)).alias("digits"),
        *[F.coalesce(F.sum(F.when(F.col("digit") == str(d), F.col("n"))), F.lit(0)).alias(f"d{d}") for d in range(1, 10)],
    )
    mad = reduce(lambda a, b: a + b, [F.abs(F.try_divide(F.col(f"d{d}").cast("double"), "digits") - BENFORD[d - 1]) for d in range(1, 10)]) / 9
    return by_column.where((F.col("all") > least) & F.col("varies") & (F.col("digits") > least)).select("column", "digits", jsround(mad).alias("mad"), (mad > BENFORD_LIMIT).alias("deviates"))


def fuzzy_duplicates(df: DataFrame, columns: list[str], groups: int = 3) -> DataFrame:
    """(column, key, values, n_values) of values that differ in case and punctuation only.

    Columns of 2 to 199 distinct values; keys of over two letters or digits; the
    first ``groups`` keys of a column. Estimates from one scan tell which columns can have
    so few values at all; only their values are counted and shuffled.
    """
    held = narrow_columns(df, columns, FUZZY_VALUES[1])
    if not held:
        return small_frame(df.sparkSession, [], "column string, key string, values string, n_values long")
    return fuzzy_values(value_counts(df, held), groups)


def fuzzy_values(counts: DataFrame, groups: int = 3) -> DataFrame:
    """The same from counts (column, value, n)."""
    few = counts.groupBy("column").agg(F.count(F.lit(1)).alias("cardinality")).where(F.col("cardinality").between(*FUZZY_VALUES))
    distinct = counts.join(F.broadcast(few), "column")  # a row for each column
    keyed = distinct.withColumn("key", F.regexp_replace(F.lower("value"), "[^a-z0-9]", "")).where(F.length("key") > 2)
    found = keyed.groupBy("column", "key").agg(F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("values"), F.count(F.lit(1)).alias("n_values")).where("n_values > 1")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("column").orderBy("key"))).where(F.col("nth") <= groups).drop("nth")


# ---- quality ----------------------------------------------------------------------------------


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: n_rows, duplicates (rows beyond the first of equals), duplicate_pct."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    out = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return out.select("n_rows", "duplicates", F.coalesce(jsround(F.try_divide(F.col("duplicates").cast("double"), F.col("n_rows")) * 100, 2), F.lit(0.0)).alias("duplicate_pct"))


def mark_duplicates(df: DataFrame, row_id: str = "_row_id", columns: list[str] | None = None, hashes: int = 2**62) -> DataFrame:
    """(row_id, is_duplicate, first_id) of every row: whether an earlier row is equal in the columns (all but the id), and the first such row.

    Rows are told apart by two hashes of some 63 bits: a count and the least id of each hash,
    combined before the shuffle, leave the rows whose hash repeats. Only these are compared
    whole, with the first row of their hash; a large group joins that one row, so its part
    may be split. Rows that a hash has by chance are grouped by all they hold.
    """
    columns = columns or [c for c in df.columns if c != row_id]
    # Zero has two signs in floating point.
    plain = lambda c: F.col(f"`{c}`") + F.lit(0.0) if isinstance(_kind(df, c), (T.FloatType, T.DoubleType)) else F.col(f"`{c}`")
    # A null changes no hash, so the places of nulls are hashed too.
    told = [x for c in columns for x in (plain(c), F.col(f"`{c}`").isNull())]
    rows = df.select(F.col(f"`{row_id}`").alias("_id"), (F.xxhash64(*told) % hashes).alias("_h"), (F.xxhash64(F.lit(1), *told) % hashes).alias("_g"), F.struct(*[plain(c).alias(c) for c in columns]).alias("_body"))
    groups = rows.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).where("_n > 1").drop("_n")
    again = rows.join(groups, ["_h", "_g"])
    firsts = again.where("_id = _first").select("_h", "_g", F.col("_body").alias("_kept"))
    judged = again.join(firsts, ["_h", "_g"]).withColumn("_same", F.col("_body").eqNullSafe(F.col("_kept")))
    same = judged.where("_same AND _id <> _first").select("_id", "_first")
    by_body = Window.partitionBy("_body")
    odd = judged.where("NOT _same").select("_id", F.min("_id").over(by_body).alias("_first")).where("_id <> _first")
    marked = rows.select("_id").join(same.unionByName(odd), "_id", "left")
    return marked.select(F.col("_id").alias(row_id), F.col("_first").isNotNull().alias("is_duplicate"), F.coalesce("_first", "_id").alias("first_id"))


def missing_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: missing cells, all cells, missing_pct, empty_rows."""
    columns = columns or scalar_columns(df)
    gone = [(~present(F.col(f"`{c}`"), _kind(df, c))).cast("long") for c in columns]
    out = df.select(reduce(lambda a, b: a + b, gone).alias("m")).agg(F.sum("m").alias("missing"), (F.count(F.lit(1)) * len(columns)).alias("cells"), F.count(F.when(F.col("m") == len(columns), 1)).alias("empty_rows"))
    return out.select("missing", "cells", F.coalesce(jsround(F.try_divide(F.col("missing").cast("double"), F.col("cells")) * 100, 2), F.lit(0.0)).alias("missing_pct"), "empty_rows")


def mixed_types(df: DataFrame, columns: list[str] | None = None, limit: float = 0.05) -> DataFrame:
    """(column, n_numeric, n_text, mixed): whether the rarer kind of cell has over ``limit`` of those present."""
    columns = columns or scalar_columns(df)

    def measures(c: str):
        kind, x = _kind(df, c), F.col(f"`{c}`")
        return [F.count(F.when(present(x, kind), 1)).alias("k"), F.count(number(x, kind)).alias("n_numeric")]

    text = F.col("k") - F.col("n_numeric")
    share = F.try_divide(F.least("n_numeric", text).cast("double"), "k")
    return _per_column(df, columns, measures).select("column", "n_numeric", text.alias("n_text"), F.coalesce(share > limit, F.lit(False)).alias("mixed"))


def first_rows(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ids, however the ids are spaced."""
    last = df.select(F.col(f"`{row_id}`").alias("i")).orderBy("i").limit(n).agg(F.max("i")).first()[0]
    return df.where(F.col(f"`{row_id}`") <= F.lit(last))


def dirty_cells(df: DataFrame, types: dict[str, str], row_id: str = "_row_id", first: int | None = FIRST_ROWS) -> DataFrame:
    """(column, n_seen, null_tokens, money, not_numeric) over the first rows, or over all with ``first=None``."""
    rows = df if first is None else first_rows(df, row_id, first)
    columns = list(types)
    if not columns:
        return small_frame(df.sparkSession, [], "column string, n_seen long, null_tokens long, money long, not_numeric long")
    # A cell that spells no number is a column of its own first, so that the tests below read it once.
    trimmed = [F.trim(F.col(f"`{c}`").cast("string")) for c in columns]
    texts = rows.select(*[F.when(text_number(t).isNull(), t).alias(f"t{i}") for i, t in enumerate(trimmed)])

    def measures(name: str):
        text, numeric = F.col(name), types[columns[int(name[1:])]] == "numeric"
        token, money = F.lower(text).isin(SCORE_NULLS), text.rlike(CURRENCY) & text.rlike(r"\d")
        wrong = ~token & ~money & (text != "") & F.lit(numeric)
        return [F.count(F.lit(1)).alias("n_seen"), F.count(F.when(token, 1)).alias("null_tokens"), F.count(F.when(~token & money, 1)).alias("money"), F.count(F.when(wrong, 1)).alias("not_numeric")]

    found = _per_column(texts, texts.columns, measures)
    return found.select(F.get(F.lit(columns), F.col("ordinal")).alias("column"), "n_seen", "null_tokens", "money", "not_numeric")


# Points that a per cent of missing cells, repeated rows, mixed columns and dirty cells costs.
WEIGHTS = (1.2, 1.0, 4.0, 2.0)


def quality_score(df: DataFrame, types: dict[str, str], row_id: str = "_row_id") -> DataFrame:
    """One row: missing, duplicate, mixed and dirty percentages and the score from 0 to 100."""
    columns = list(types)
    body = df.select(*[F.col(f"`{c}`") for c in columns])
    one = F.lit(1).alias("one")
    missing = missing_cells(body, columns).select("missing", "cells", one)
    duplicates = duplicate_rows(body).select("duplicates", "n_rows", one)
    mixed = mixed_types(body, columns).agg(F.count(F.when(F.col("mixed"), 1)).alias("mixed")).select("mixed", one)
    dirty = dirty_cells(df, types, row_id).agg(F.sum(F.col("null_tokens") + F.col("money") + F.col("not_numeric")).alias("dirty"), F.max("n_seen").alias("seen")).select("dirty", "seen", one)
    return score_of(missing.join(duplicates, "one").join(mixed, "one").join(dirty, "one"), len(columns))  # one row each


def score_of(counts: DataFrame, k: int) -> DataFrame:
    """The score from counts (missing, cells, duplicates, n_rows, mixed, dirty, seen) of ``k`` columns.

    Dirty cells are those among the rows seen, scaled up to all rows.
    """
    pct = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b) * 100, F.lit(0.0))
    whole = F.coalesce(F.try_divide(F.col("dirty").cast("double") * F.col("n_rows"), F.col("seen")), F.lit(0.0))
    out = counts.select(pct(F.col("missing"), F.col("cells")).alias("m"), pct(F.col("duplicates"), F.col("n_rows")).alias("d"), (F.col("mixed") / k * 100).alias("x"), pct(whole, F.col("cells")).alias("t"))
    lost = reduce(lambda a, b: a + b, [w * F.col(c) for w, c in zip(WEIGHTS, "mdxt")])
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - lost))
    return out.select(jsround(F.col("m"), 2).alias("missing_pct"), jsround(F.col("d"), 2).alias("duplicate_pct"), jsround(F.col("x"), 2).alias("mixed_pct"), jsround(F.col("t"), 2).alias("dirty_pct"), jsround(score, 0).cast("int").alias("score"))


# Characters that no clean number holds (the dollar sign is money anyway), and thousands with dots.
ODD_NUMBER, DOTTED = r"[€£¥₹,()%]", r"^\d{1,3}(\.\d{3})+(,\d+)?$"


def dirty_columns(df: DataFrame, types: dict[str, str], row_id: str = "_row_id", first: int = FIRST_ROWS, samples: int = 3) -> DataFrame:
    """(column, type, dirty, dirty_pct, samples) of columns with messy cells among the first rows, by the cleaner's own rule.

    A cell is messy if it is one of the cleaner's null tokens as written, an amount of
    money, in a numeric or identifier column a text with other than plain digits, or in a
    date column a text that is no date. Samples are the first such cells in row order.
    """
    rows = first_rows(df, row_id, first)

    def measures(c: str):
        raw, text = F.col(f"`{c}`"), _kind(df, c).simpleString() == "string"
        t = F.trim(raw.cast("string"))
        messy = t.isin(CLEAN_NULLS) | looks_like_money(t)
        if text and types[c] in ("numeric", "id"):
            messy = messy | t.rlike(ODD_NUMBER) | t.rlike(DOTTED)
        elif text and types[c] == "date":
            messy = messy | (text_date(t).isNull() & text_number(t).isNull())
        found = F.when(present(raw, _kind(df, c)) & messy, F.struct(F.col(f"`{row_id}`").alias("at"), t.alias("t")))
        # The rows seen are few, so all their messy cells may be gathered to take the first.
        shown = F.slice(F.transform(F.array_sort(F.collect_list(found)), lambda x: x["t"]), 1, samples)
        return [F.count(F.lit(1)).alias("n_seen"), F.count(found).alias("dirty"), F.array_join(shown, "; ").alias("samples")]

    kinds = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])
    found = _per_column(rows, list(types), measures).where("dirty > 0")
    return found.select("column", kinds[F.col("column")].alias("type"), "dirty", jsround(F.try_divide(F.col("dirty").cast("double"), "n_seen") * 100, 0).cast("int").alias("dirty_pct"), "samples")


# ---- cleaning ---------------------------------------------------------------------------------


#: What cleaning did to a cell: nothing counted, a number or a date read, a null token dropped, or another text changed.
KEPT, NUMBER, DATE, NULL, OTHER = "kept", "numbers", "dates", "nulls", "others"


def _effective(df: DataFrame, types: dict[str, str], row_id: str | None) -> dict[str, str]:
    """Types, with columns of over 20 % money texts at the start taken as numeric."""
    asked = [c for c, t in types.items() if t not in ("numeric", "id") and _kind(df, c).simpleString() == "string"]
    if not asked:
        return dict(types)
    rows = first_rows(df, row_id, CURRENCY_ROWS) if row_id else df.limit(CURRENCY_ROWS)
    seen = _per_column(rows, asked, lambda c: [F.count(F.when(F.col(f"`{c}`") != "", 1)).alias("n"), F.count(F.when(looks_like_money(F.col(f"`{c}`")), 1)).alias("k")]).collect()
    money = {r["column"] for r in seen if r["n"] and r["k"] > 0.2 * r["n"]}
    return {c: "numeric" if c in money else t for c, t in types.items()}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cell(text, number_, change) -> Column:
    return F.struct(text.cast("string").alias("text"), number_.cast("double").alias("number"), change.alias("change"))


def clean_cells(cells: Column, kind: str, legacy_european: bool = False) -> Column:
    """The clean values of an array of texts of a semantic type: (text, number, change) each.

    One expression serves all columns of a type, and a value that a rule needs twice is
    bound once, so generated code does not grow with the columns.
    """
    none = F.lit(None)

    def change(x: Column, done: Column, same: Column, kept: str) -> Column:
        dropped = F.when(F.trim(x).isin(CLEAN_NULLS), NULL).otherwise(OTHER)
        return F.when(x.isNull() | (x == "") | same, KEPT).when(done.isNull(), dropped).otherwise(kept)

    def as_number(x: Column) -> Column:
        return _let(clean_number(x, legacy_european), lambda n: _cell(none, n, change(x, n, F.coalesce(text_number(x) == n, F.lit(False)), NUMBER)))

    def as_date(x: Column) -> Column:
        return _let(clean_date(x), lambda d: _cell(d, none, change(x, d, F.coalesce(F.trim(x) == d, F.lit(False)), DATE)))

    def as_text(x: Column) -> Column:
        plain = lambda: _let(clean_text(x), lambda t: _cell(t, none, change(x, t, F.coalesce(x == t, F.lit(False)), OTHER)))
        amount = _let(clean_number(x, legacy_european), lambda n: F.when(n.isNotNull(), _cell(n, n, F.lit(NUMBER))).otherwise(plain()))
        day = _let(clean_date(x), lambda d: F.when(d.isNotNull(), _cell(d, none, change(x, d, F.trim(x) == d, DATE))).otherwise(plain()))
        spelled = _cell(F.trim(x), none, F.lit(KEPT))  # a number in a column of texts keeps its spelling
        return F.when(text_number(x).isNotNull(), spelled).when(looks_like_money(x), amount).when(looks_like_date(x), day).otherwise(plain())

    return F.transform(cells, as_number if kind in ("numeric", "id") else as_date if kind == "date" else as_text)


def _text_columns(df: DataFrame, types: dict[str, str]) -> list[str]:
    return [c for c in types if _kind(df, c).simpleString() == "string"]


def _families(df: DataFrame, effective: dict[str, str]) -> dict[str, list[str]]:
    """The text columns by the rule that cleans them."""
    out: dict[str, list[str]] = {}
    for c in _text_columns(df, effective):
        out.setdefault({"id": "numeric", "numeric": "numeric", "date": "date"}.get(effective[c], "text"), []).append(c)
    return out


def _with_cells(df: DataFrame, families: dict[str, list[str]], legacy_european: bool) -> DataFrame:
    """``df`` with an array ``_clean_<rule>`` of clean cells for each rule."""
    arrays = {f"_clean_{kind}": clean_cells(F.array(*[F.col(f"`{c}`") for c in columns]), kind, legacy_european) for kind, columns in families.items()}
    return df.withColumns(arrays) if arrays else df


def _places(families: dict[str, list[str]]) -> dict[str, Column]:
    """The clean cell of each column, in the arrays."""
    return {c: F.get(f"_clean_{kind}", F.lit(i)) for kind, columns in families.items() for i, c in enumerate(columns)}


def _finished(df: DataFrame, wide: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    kind = {c: k for k, columns in families.items() for c in columns}
    places = _places(families)
    return wide.select(*[places[c]["number" if kind[c] == "numeric" else "text"].alias(c) if c in places else F.col(f"`{c}`") for c in df.columns])


def cleanse(df: DataFrame, types: dict[str, str], row_id: str | None = None, legacy_european: bool = False) -> DataFrame:
    """``df`` with its text columns cleaned by type: numbers, ISO dates, or trimmed texts without null tokens."""
    families = _families(df, _effective(df, types, row_id))
    return _finished(df, _with_cells(df, families, legacy_european), families)


def cleanse_observed(df: DataFrame, types: dict[str, str], row_id: str | None = None, legacy_european: bool = False) -> tuple[DataFrame, Observation]:
    """The clean rows, and the counts of what changed, which the write or count of these rows fills in the same scan.

    The observation holds ``<kind>/<column>`` for each kind of change and text column. It
    counts rows as they pass, so an action that reads them twice (an order by range, which
    samples first) counts them twice.
    """
    families = _families(df, _effective(df, types, row_id))
    wide, seen = _with_cells(df, families, legacy_european), Observation("cleaning")
    counters = [F.count(F.when(cell["change"] == kind, 1)).alias(f"{kind}/{c}") for c, cell in _places(families).items() for kind in (NUMBER, DATE, NULL, OTHER)]
    return _finished(df, wide.observe(seen, F.count(F.lit(1)).alias("rows"), *counters), families), seen


def cleaning_report(df: DataFrame, types: dict[str, str], row_id: str | None = None, samples: int = 3) -> DataFrame:
    """(column, changed, numbers, dates, nulls, others, samples) of each text column.

    Cells that cleaning changes, by what it made of them: numbers and dates read, null
    tokens dropped, other changes (trimmed texts, and texts that are no value of their
    column). Samples are the first changed cells, from -> to, in row order (without row
    ids, the first of the distinct ones by text). A number in a column of texts keeps its
    spelling and does not count.
    """
    families = _families(df, _effective(df, types, row_id))
    columns = [c for held in families.values() for c in held]
    if not columns:
        return small_frame(df.sparkSession, [], "column string, changed long, numbers long, dates long, nulls long, others long, samples string")
    wide = _with_cells(df, families, False)
    at = F.col(f"`{row_id}`").cast("long") if row_id else F.lit(None).cast("long")
    cell = lambda c, p: F.struct(F.lit(c).alias("column"), at.alias("at"), F.col(f"`{c}`").alias("old"), F.coalesce(p["text"], p["number"].cast("string"), F.lit("null")).alias("new"), p["change"].alias("change"))
    long = wide.select(F.inline(F.array(*[cell(c, p) for c, p in _places(families).items()]))).where(F.col("change") != KEPT)
    counts = long.groupBy("column").agg(F.count(F.lit(1)).alias("changed"), *[F.count(F.when(F.col("change") == k, 1)).alias(k) for k in (NUMBER, DATE, NULL, OTHER)])
    shown = long.select("column", "at", F.concat_ws(" -> ", "old", "new").alias("sample"))
    shown = shown if row_id else shown.distinct()
    # Each task sends its own first cells only.
    shown = shown.withColumn("nth", F.row_number().over(Window.partitionBy("column").orderBy("at", "sample"))).where(F.col("nth") <= samples)
    texts = shown.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "sample"))), lambda x: x["sample"]), "; ").alias("samples"))
    named = small_frame(df.sparkSession, [(c,) for c in columns], "column string")
    out = named.join(F.broadcast(counts), "column", "left").join(F.broadcast(texts), "column", "left")  # a row for each column
    return out.select("column", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("changed", NUMBER, DATE, NULL, OTHER)], F.coalesce("samples", F.lit("")).alias("samples"))
