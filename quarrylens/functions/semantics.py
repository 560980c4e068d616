"""Scalar semantics of the profiler, as Column expressions.

A cell is raw text or a native value; whether it is a number or a date is asked
of each cell. All expressions are built in, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that stand for a missing value. The cleaner compares as
# written; the score compares in lower case; the repair accepts any case.
CLEAN_NULLS = [
    "n/a", "na", "N/A", "NA", "null", "NULL", "none", "None", "NONE", "-", "--", "---", ".", "..", "missing", "MISSING", "undefined",
    "#N/A", "#NA", "#REF!", "#VALUE!", "#DIV/0!", "#NULL!", "#NAME?", "NaN", "nan", "inf", "-inf",
]
SCORE_NULLS = ["n/a", "na", "null", "none", "-", "--", "missing", "undefined", "nan"]
CURRENCY = r"[$€£¥₹]"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_MONTH_NAME = "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"

#: Sharing of numeric cells above which a column is numeric, below which it is not; and the distinct share of identifiers.
MOSTLY, HARDLY, MOSTLY_DISTINCT = 0.7, 0.3, 0.9
# Fixed value: names of identifiers.
ID_NAME = r"(?i)id$|_id|^id|index|code|key|no$|number"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, _NUMERIC)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_scalar(kind: T.DataType) -> bool:
    """Whether columns of this type are profiled; nested and binary ones are not."""
    return is_numeric(kind) or is_temporal(kind) or isinstance(kind, (T.StringType, T.BooleanType))


def jsround(x: Column, digits: int = 4) -> Column:
    """Round half up (towards positive infinity); values too large for the digits are as they are."""
    scale = float(10**digits)
    return F.when(F.abs(x) < 1e15 / scale, F.floor(x * scale + 0.5) / scale).otherwise(x)


def blank(c: Column) -> Column:
    """Text without surrounding white space of any kind; null if nothing is left."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def present(c: Column, kind: T.DataType) -> Column:
    """Whether a cell holds anything."""
    return (c.isNotNull() & (c != "")) if isinstance(kind, T.StringType) else c.isNotNull()


def text_number(c: Column) -> Column:
    """The number that a text spells, else null."""
    t = F.trim(c)
    out = F.when(t.rlike(DECIMAL), t.try_cast("double"))
    for letter, digits, base, most in (("xX", "0-9a-fA-F", 16, 15), ("oO", "0-7", 8, 21), ("bB", "01", 2, 63)):
        out = out.when(t.rlike(f"^0[{letter}][{digits}]{{1,{most}}}$"), F.conv(F.substring(t, 3, most), base, 10).cast("double"))
    return out


def number(c: Column, kind: T.DataType) -> Column:
    """A cell as a number: native numbers and booleans, and texts that spell one; NaN is none."""
    if isinstance(kind, T.StringType):
        return text_number(c)
    if is_numeric(kind):
        d = c.cast("double")
        return F.when(~F.isnan(d), d) if isinstance(kind, (T.FloatType, T.DoubleType)) else d
    return c.cast("int").cast("double") if isinstance(kind, T.BooleanType) else F.lit(None).cast("double")


def text_date(c: Column) -> Column:
    """The day that a text spells in one of the known layouts, else null.

    The layouts are rewritten to year-month-day by pattern, so one cast decides;
    a time of day is left out. Where day and month could be either, the month
    comes first.
    """
    t = F.regexp_replace(F.trim(c), r"[T ]\d{1,2}:\d{2}\S*( ?[AaPp][Mm])?$", "")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(t, _MONTH_NAME, 1))).cast("string")
    numbers = F.regexp_replace(t, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3")
    numbers = F.regexp_replace(numbers, r"^(0?[1-9]|1[0-2])([-/])(\d{1,2})\2(\d{4})$", "$4-$1-$3")
    numbers = F.regexp_replace(numbers, r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$", "$4-$3-$1")
    named = F.concat_ws("-", F.regexp_extract(t, r"(\d{4})$", 1), month, F.regexp_extract(t, r"\b(\d{1,2})\b", 1))
    iso = F.when(t.rlike(rf"^{_MONTH_NAME} \d{{1,2}},? \d{{4}}$|^\d{{1,2}} {_MONTH_NAME} \d{{4}}$"), named).otherwise(numbers)
    return F.regexp_extract(iso, r"^((?:190[1-9]|19[1-9]\d|20\d\d)-\d{1,2}-\d{1,2})$", 1).try_cast("date")


def moment(c: Column, kind: T.DataType) -> Column:
    """A cell as a timestamp, else null."""
    if is_temporal(kind):
        return c.cast("timestamp")
    return text_date(c).cast("timestamp") if isinstance(kind, T.StringType) else F.lit(None).cast("timestamp")


def clean_number(c: Column, legacy_european: bool = False) -> Column:
    """Number of messy text: currency signs, percentages, accounting negatives, both thousands separators; else null.

    ``95,000`` is ninety-five thousand; with ``legacy_european`` it is 95.
    """
    t = F.trim(c)
    bare = F.regexp_replace(F.regexp_replace(t, r"^\(([\d,.\s$€£¥₹]+)\)(%?)$", "$1$2"), r"[$€£¥₹\s]|%$", "")
    # A comma after dotted thousands, or before other than three digits, is a decimal comma.
    european = r"^\d{1,3}(\.\d{3})*,\d+$" if legacy_european else r"^\d{1,3}((\.\d{3})+,\d+|,(\d{1,2}|\d{4,}))$"
    dotted = r"^\d{1,3}(\.\d{3})+$"  # digits alone in dotted thousands: only where the text is no number already
    plain = F.when(bare.rlike(european), F.translate(bare, ",.", ".")).when(bare.rlike(dotted), F.translate(bare, ".", "")).otherwise(F.translate(bare, ",", ""))
    size = F.when(t.endswith("%"), 100.0).otherwise(1.0) * F.when(t.startswith("("), -1.0).otherwise(1.0)
    return F.when(~t.isin(CLEAN_NULLS), F.when(t.rlike(DECIMAL), t.try_cast("double")).otherwise(text_number(plain) / size))


def clean_date(c: Column) -> Column:
    """ISO day of messy text, else null; numbers are no dates."""
    return F.date_format(F.when(text_number(c).isNull(), text_date(c)), "yyyy-MM-dd")


def clean_text(c: Column) -> Column:
    """Trimmed text; null for tokens of missing values."""
    t = F.trim(c)
    return F.when((t != "") & ~t.isin(CLEAN_NULLS), t)


def looks_like_money(c: Column) -> Column:
    return F.coalesce(c.rlike(CURRENCY) & c.rlike(r"\d"), F.lit(False))


def looks_like_date(c: Column) -> Column:
    """Whether text is written like a date other than an ISO one."""
    return F.coalesce(F.trim(c).rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$|^\d{4}/\d{1,2}/\d{1,2}$|^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}$|^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}$"), F.lit(False))


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """Label of the first step that x reaches (passes, if strict)."""
    out = None
    for least, label in steps:
        hit = (x > least) if strict else (x >= least)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


# Breaks of the labels.
GRADES = [(90, "Excellent"), (75, "Good"), (50, "Fair")]
SHORT_GRADES = [(80, "Excellent"), (50, "Moderate")]
STRENGTHS = [(0.9, "Very strong"), (0.7, "Strong"), (0.5, "Moderate"), (0.3, "Weak")]


def grade(x: Column, short: bool = False) -> Column:
    return ladder(x, SHORT_GRADES if short else GRADES, "Poor")


def correlation_strength(r: Column) -> Column:
    size = ladder(F.abs(r), STRENGTHS, "Negligible")
    return F.when(size == "Negligible", size).otherwise(F.concat(size, F.when(r >= 0, " positive").otherwise(" negative")))
