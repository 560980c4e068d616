"""Reading of delimited text whose rows may be structurally broken.

Lines are split, and rows with fields cut apart by unquoted thousands separators are
realigned to the header: neighbouring fields are merged, round by round, where that makes
most fields fit their columns' types. Types come from the first aligned rows. All of it
is local to a row and made of array expressions, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import DECIMAL
from .numbering import number_rows

# Rows at the start that types are taken from, the share that makes a type, the
# credit of a merge that mends a number cut at its thousands separator, and what a missing value is.
SAMPLE_ROWS, TYPE_SHARE = 30, 0.4
MEND = 3
NULLS = ["", "n/a", "na", "null", "none", "-", "--", "missing", "undefined", "nan"]
DATES = r"(?i)\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|[a-z] \d{1,2}[\s,]+\d{4}|^\d{1,2} [a-z]{3,9}\.? \d{4}"
HEAD, TAIL = r"^\d{1,4}$", r"^\d{3}([a-zA-Z%]+|\.\d+)?$"

_COMMA = "\x01"


def split_fields(line: Column) -> Column:
    """Fields of a line, trimmed; quotes may hold commas and doubled quotes.

    Cut at its quotes, a line's pieces are outside and inside of them in turn. Commas
    outside separate; nothing between two quotes that close and open is a quote itself.
    """
    pieces = F.split(line, '"', -1)

    def piece(p: Column, i: Column) -> Column:
        doubled = (p == "") & (i > 0) & (i < F.size(pieces) - 1)
        return F.when(i % 2 == 1, p).when(doubled, F.lit('"')).otherwise(F.translate(p, ",", _COMMA))

    # A control character of the line itself gives way to a space before it could separate.
    quoted = F.array_join(F.transform(F.split(F.translate(line, _COMMA, " "), '"', -1), piece), "")
    fields = F.when(line.contains('"'), F.split(quoted, _COMMA, -1)).otherwise(F.split(line, ",", -1))
    return F.transform(fields, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def is_number(value: Column) -> Column:
    return F.regexp_replace(value, r"[$€£¥₹,\s%()]", "").rlike(DECIMAL)


def fits(kind: Column, value: Column) -> Column:
    """1 where a field may stand in a column of a type, else 0; missing values may stand anywhere, nothing beyond the columns."""
    low = F.lower(F.trim(value))
    fit = F.when(kind.isNull(), False).when((kind == "text") | low.isin(NULLS), True).when(kind == "date", value.rlike(DATES)).otherwise(is_number(value))
    return fit.cast("int")


def column_types(fields: DataFrame, width: int) -> list[str]:
    """date, number or text for each column of the aligned rows of a small frame with an array ``fields``."""
    aligned = fields.where(F.size("fields") == width).select(F.posexplode("fields").alias("place", "x")).where(~F.lower("x").isin(NULLS))
    share = lambda kind: F.avg(fits(F.lit(kind), F.col("x")))
    kind = F.when(share("date") > TYPE_SHARE, "date").when(share("number") > TYPE_SHARE, "number").otherwise("text")
    found = {r["place"]: r["kind"] for r in aligned.groupBy("place").agg(kind.alias("kind")).collect()}
    return [found.get(i, "text") for i in range(width)]


def _merge_once(fields: Column, kinds: Column) -> Column:
    """The fields with the two neighbours merged whose merge fits best, the first of equals.

    A merge at i leaves what is before it and moves what is after it one column to the
    left. With stay(j) for the fit of field j in column j, and move(j) for that of its
    follower, a merge at i scores the sum of stay up to i, the merged field's fit, and the
    sum of move after i. Up to a constant that is a running sum of stay - move, so one
    pass over the fields finds the best.
    """
    none = F.lit(None).cast("int")
    begin = F.struct(F.lit(0).alias("lead"), none.alias("best"), none.alias("at"))

    def step(state: Column, i: Column) -> Column:
        a, b, kind = F.get(fields, i), F.get(fields, i + 1), F.get(kinds, i)
        mends = F.trim(a).rlike(HEAD) & F.trim(b).rlike(TAIL)
        move = fits(kind, b)
        score = state["lead"] - move + fits(kind, F.concat(F.trim(a), F.trim(b))) + F.when(mends, MEND).otherwise(0)
        better = state["best"].isNull() | (score > state["best"])
        return F.struct((state["lead"] + fits(kind, a) - move).alias("lead"), F.greatest(state["best"], score).alias("best"), F.when(better, i).otherwise(state["at"]).alias("at"))

    at = F.aggregate(F.sequence(F.lit(0), F.size(fields) - 2), begin, step, lambda state: state["at"])
    # The place is bound once, in an array of one.
    merged = lambda i: F.concat(F.slice(fields, 1, i), F.array(F.concat(F.trim(F.get(fields, i)), F.trim(F.get(fields, i + 1)))), F.slice(fields, i + 3, F.size(fields)))
    return F.get(F.transform(F.array(at), merged), F.lit(0))


def realigned(fields: Column, kinds: list[str]) -> Column:
    """As many fields as columns: short rows end in nulls, long ones are merged until they fit."""
    width, kinds = len(kinds), F.lit(kinds)
    surplus = F.size(fields) - width
    mended = F.aggregate(F.sequence(F.lit(1), surplus), fields, lambda held, _: _merge_once(held, kinds))
    return F.when(surplus > 0, mended).otherwise(fields)


def repaired(lines: DataFrame, header: list[str], kinds: list[str]) -> DataFrame:
    """Rows of lines (``value`` and any ids) as text columns of the header; blank cells are null."""
    keep = [c for c in lines.columns if c != "value"]
    rows = lines.withColumn("_fields", split_fields(F.col("value"))).withColumn("_cells", realigned(F.col("_fields"), kinds))
    return rows.select(*keep, *[F.nullif(F.get("_cells", F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(header)])


def _filled(line: Column) -> Column:
    """Whether a line has a field that is not blank."""
    return line.rlike(r'[^,\s"]') | F.exists(split_fields(line), lambda x: x != "")


def _text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).where(_filled(F.col("value")))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """``_row_id`` and a text column for each header field, from lines that may be misaligned; blank cells are null.

    Rows are numbered from 0 in the order of the files (by path) and of their lines; blank
    lines and a first line that repeats the header have no number. The header is the first
    line of the first file that has lines. Raises ValueError for a file without data lines
    or with a header name twice.
    """
    lines = _text_lines(spark, path)
    first: list[str] = []
    for file in sorted(lines.inputFiles()):
        first = [r[0] for r in _text_lines(spark, file).limit(SAMPLE_ROWS + 1).collect()]
        if first:
            break
    if not first or (len(first) < 2 and lines.limit(2).count() < 2):
        raise ValueError("a header and at least one line of data are needed")
    sample = spark.createDataFrame([(x,) for x in first], "value string").select(split_fields(F.col("value")).alias("fields")).collect()
    header = [h.lstrip("﻿") for h in sample[0]["fields"]]
    if len(set(header)) != len(header):
        raise ValueError(f"header names repeat: {header}")
    rows = spark.createDataFrame([(r["fields"],) for r in sample[1:]], "fields array<string>")
    numbered = number_rows(lines, F.col("value") == first[0])
    return repaired(numbered, header, column_types(rows, len(header)))


def read_aligned(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Well-formed delimited text by the built-in reader, all columns as text."""
    return spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=multi_line, escape='"')
