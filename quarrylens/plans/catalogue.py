"""Registry of the profiling queries and of their SQL twins."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import jsround
from ..operators import columns as C
from ..operators import quality as Q
from ..operators import series as S

QUERIES: dict = {}
ORACLES: dict = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def r(x: str, digits: int = 4) -> str:
    """SQL of rounding half up."""
    return f"(floor(({x}) * {10**digits}.0::DOUBLE + 0.5) / {10**digits}.0::DOUBLE)"


def each(parts, glue: str = "\nUNION ALL\n") -> str:
    return glue.join(parts)


# ---- numbers ----------------------------------------------------------------------------------


def _stats_sql(source: str, columns: list[str]) -> str:
    one = """
    SELECT '{c}' AS "column", any_value(n) AS n, any_value(total - n) AS non_numeric, {sum} AS sum, {mean} AS mean, {median} AS median, {min} AS min, {max} AS max,
      {range} AS range, {sd} AS std_dev, {var} AS variance, {q1} AS q1, {q3} AS q3, {iqr} AS iqr,
      CASE WHEN any_value(s) = 0 THEN 0.0 ELSE {skew} END AS skewness, CASE WHEN any_value(m) = 0 THEN NULL ELSE {cv} END AS cv,
      {lo} AS lower_fence, {hi} AS upper_fence,
      count(CASE WHEN s > 0 AND abs(x - m) / s > 3 THEN 1 END) AS z_outliers, min(CASE WHEN s > 0 AND abs(x - m) / s > 3 THEN x END) AS z_min, max(CASE WHEN s > 0 AND abs(x - m) / s > 3 THEN x END) AS z_max,
      count(CASE WHEN x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) THEN 1 END) AS iqr_outliers,
      min(CASE WHEN x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) THEN x END) AS iqr_min, max(CASE WHEN x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) THEN x END) AS iqr_max
    FROM (SELECT CAST("{c}" AS DOUBLE) AS x FROM ({source})),
         (SELECT count(*) AS total, count(v) AS n, sum(v) AS t, avg(v) AS m, median(v) AS d, min(v) AS mn, max(v) AS mx, stddev_pop(v) AS s, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b
          FROM (SELECT CAST("{c}" AS DOUBLE) AS v FROM ({source})))
    HAVING any_value(n) >= 2"""
    v = lambda x: f"any_value({x})"
    return each(
        one.format(
            c=c, source=source, sum=r(v("t")), mean=r(v("m")), median=r(v("d")), min=r(v("mn")), max=r(v("mx")), range=r(v("mx - mn")), sd=r(v("s")), var=r(v("s * s")), q1=r(v("a")), q3=r(v("b")),
            iqr=r(v("b - a")), skew=r(v("3 * (m - d) / nullif(s, 0)")), cv=r(v("abs(s / nullif(m, 0)) * 100"), 2), lo=r(v("a - 1.5 * (b - a)")), hi=r(v("b + 1.5 * (b - a)")),
        )
        for c in columns
    )


@query(_stats_sql("SELECT * FROM lineitem", MEASURES))
def numeric_profile(spark, sf_dir):
    return C.numeric_stats(load(spark, sf_dir, "lineitem"), MEASURES)


def _with_nulls(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.expr("nullif(l_quantity, 1D)").alias("l_quantity"), F.expr("CASE WHEN l_discount > 0.05D THEN l_tax END").alias("l_tax"))


_WITH_NULLS = "SELECT nullif(l_quantity, 1) AS l_quantity, CASE WHEN l_discount > 0.05 THEN l_tax END AS l_tax FROM lineitem"


@query(_stats_sql(_WITH_NULLS, ["l_quantity", "l_tax"]))
def numeric_profile_with_nulls(spark, sf_dir):
    return C.numeric_stats(_with_nulls(spark, sf_dir))


@query(_stats_sql("SELECT * FROM orders", ["o_totalprice"]))
def orders_outliers(spark, sf_dir):
    return C.numeric_stats(load(spark, sf_dir, "orders"), ["o_totalprice"])


_OUT = _stats_sql("SELECT * FROM events", ["value"]) + "\nUNION ALL\n" + _stats_sql("SELECT * FROM events", ["user_id"])


@query(f'SELECT "column", z_outliers, iqr_outliers, greatest(z_outliers, iqr_outliers) > 0 AND abs(z_outliers - iqr_outliers) > 0.5 * greatest(z_outliers, iqr_outliers) AS disagree FROM ({_OUT})')
def outlier_disagreement(spark, sf_dir):
    return C.outlier_disagreement(C.numeric_stats(load(spark, sf_dir, "events"), ["value", "user_id"]))


_TIED = "SELECT l_tax, l_extendedprice, -l_extendedprice AS a_refund FROM lineitem"


@query(
    f"""SELECT "column" AS primary_column, variance FROM ({_stats_sql(_TIED, ["l_tax", "l_extendedprice", "a_refund"])})
    ORDER BY variance DESC, list_position(['l_tax', 'l_extendedprice', 'a_refund'], "column") LIMIT 1"""
)
def primary_column(spark, sf_dir):
    columns = ["l_tax", "l_extendedprice", "a_refund"]  # the last two tie
    df = load(spark, sf_dir, "lineitem").select("l_tax", "l_extendedprice", (-F.col("l_extendedprice")).alias("a_refund"))
    return C.primary_column(C.numeric_stats(df, columns), columns)


@query(
    f"""SELECT "column", skewness, CASE WHEN skewness > 0.5 THEN 'right-skewed' WHEN skewness < -0.5 THEN 'left-skewed' ELSE 'symmetric' END AS direction
    FROM ({_stats_sql("SELECT * FROM events", ["value"])} UNION ALL {_stats_sql("SELECT * FROM lineitem", MEASURES)})"""
)
def skew_direction(spark, sf_dir):
    stats = C.numeric_stats(load(spark, sf_dir, "events"), ["value"]).unionByName(C.numeric_stats(load(spark, sf_dir, "lineitem"), MEASURES))
    return C.skew_direction(stats)


@query(f"""SELECT "column", std_dev, std_dev = 0 AS constant FROM ({_stats_sql("SELECT l_tax, 7.5 AS fixed FROM lineitem", ["l_tax", "fixed"])})""")
def constant_columns(spark, sf_dir):
    return Q.constant_columns(C.numeric_stats(load(spark, sf_dir, "lineitem").select("l_tax", F.lit(7.5).alias("fixed"))))


def _histogram_sql(source: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", bin, lo, hi, k FROM (
      SELECT g.bin, any_value(lo) AS lo, any_value(hi) AS hi, count(x) AS k
      FROM (SELECT unnest(range(7)) AS bin) g CROSS JOIN (SELECT min("{c}") AS lo, max("{c}") AS hi FROM ({s})) e
      LEFT JOIN (SELECT CAST("{c}" AS DOUBLE) AS x, least(6, floor(("{c}" - mn) / ((mx - mn) / 7.0))) AS b FROM ({s}), (SELECT min("{c}") AS mn, max("{c}") AS mx FROM ({s})) WHERE "{c}" IS NOT NULL) v ON v.b = g.bin
      GROUP BY g.bin)"""
    body = each(one.format(c=c, s=source) for c in columns)
    return f"""SELECT "column", CAST(bin AS INTEGER) AS bin, {r("lo + bin * ((hi - lo) / 7)")} AS low, {r("lo + (bin + 1) * ((hi - lo) / 7)")} AS high, k AS count,
      bin = min(CASE WHEN k = most THEN bin END) OVER (PARTITION BY "column") AS is_mode
      FROM (SELECT *, max(k) OVER (PARTITION BY "column") AS most FROM ({body}))"""


@query(_histogram_sql("SELECT * FROM lineitem", ["l_quantity", "l_extendedprice"]))
def histogram7(spark, sf_dir):
    return C.histogram(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


@query(f'SELECT "column", bin, low, high, count FROM ({_histogram_sql("SELECT * FROM orders", ["o_totalprice"])}) WHERE is_mode')
def histogram_mode_bin(spark, sf_dir):
    return C.histogram(load(spark, sf_dir, "orders"), ["o_totalprice"]).where("is_mode").drop("is_mode")


@query(
    f"""SELECT "column", bin, low, high, count, is_mode, CAST({r("low", 2)} AS VARCHAR) || ' \u2013 ' || CAST({r("high", 2)} AS VARCHAR) AS label
    FROM ({_histogram_sql("SELECT * FROM lineitem", ["l_quantity"])})"""
)
def histogram_labels(spark, sf_dir):
    return C.range_labels(C.histogram(load(spark, sf_dir, "lineitem"), ["l_quantity"]))


@query(
    f"""SELECT 'l_discount' AS source, CAST(bin AS INTEGER) AS place, CAST({r("low", 2)} AS VARCHAR) || ' \u2013 ' || CAST({r("high", 2)} AS VARCHAR) AS label, count AS n
    FROM ({_histogram_sql("SELECT * FROM lineitem", ["l_discount"])})
    UNION ALL
    SELECT 'l_returnflag', CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS INTEGER), l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag"""
)
def distribution_source(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    return C.distribution(df, "l_discount").select(F.lit("l_discount").alias("source"), "*").unionByName(C.distribution(df, "l_returnflag").select(F.lit("l_returnflag").alias("source"), "*"))


# ---- types and basics -------------------------------------------------------------------------

_TEXT_DATE = r"regexp_matches(v, '^\d{4}[-/]\d{1,2}[-/]\d{1,2}$')"
_TEXT_NUMBER = r"regexp_matches(v, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')"


def _types_sql(source: str, columns: dict[str, str]) -> str:
    """columns: number, text or date by name."""
    from ..operators.columns import _hints_id

    one = """SELECT {i} AS ordinal, '{c}' AS "column", {hint} AS id_name, count(*) AS n_rows, count(v) AS n_present, {num} AS n_numeric, {date} AS n_date, count(DISTINCT v) AS dv, count(DISTINCT lower(v)) AS dl
    FROM (SELECT nullif(CAST("{c}" AS VARCHAR), '') AS v FROM ({s}))"""
    num = {"number": "count(v)", "text": f"count(CASE WHEN {_TEXT_NUMBER} THEN 1 END)", "date": "0"}
    date = {"number": "0", "text": f"count(CASE WHEN {_TEXT_DATE} THEN 1 END)", "date": "count(v)"}
    body = each(one.format(i=i, c=c, s=source, hint=str(_hints_id(c)).lower(), num=num[k], date=date[k]) for i, (c, k) in enumerate(columns.items()))
    return f"""SELECT CAST(ordinal AS INTEGER) AS ordinal, "column",
      CASE WHEN n_present = 0 THEN 'text' WHEN n_date / n_present > 0.7 THEN 'date'
           WHEN n_numeric / n_present > 0.7 AND id_name AND dv / n_rows > 0.9 THEN 'id' WHEN n_numeric / n_present > 0.7 THEN 'numeric'
           WHEN n_numeric / n_present < 0.3 AND dl / n_rows > 0.9 THEN 'text' WHEN n_numeric / n_present < 0.3 THEN 'categorical' ELSE 'text' END AS type,
      n_rows, n_present, CAST(n_numeric AS BIGINT) AS n_numeric, CAST(n_date AS BIGINT) AS n_date
      FROM ({body})"""


_ORDERS = {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "date", "o_orderpriority": "text"}


@query(_types_sql("SELECT * FROM orders", _ORDERS))
def type_inference_orders(spark, sf_dir):
    return C.infer_types(load(spark, sf_dir, "orders"), list(_ORDERS))


_CUSTOMER = {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"}


@query(_types_sql("SELECT * FROM customer", _CUSTOMER))
def type_inference_customer(spark, sf_dir):
    return C.infer_types(load(spark, sf_dir, "customer"), list(_CUSTOMER))


_PART = {"p_partkey": "number", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "p_retailprice": "number"}


@query(_types_sql("SELECT * FROM part", _PART))
def type_inference_part(spark, sf_dir):
    return C.infer_types(load(spark, sf_dir, "part"), list(_PART))


_RAW = {"order_id": "text", "day": "text", "amount": "text", "half": "text", "none": "text"}
_RAW_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '12.5' END AS amount,
  CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '7' END AS half, CAST(NULL AS VARCHAR) AS none FROM orders"""


@query(_types_sql(_RAW_SQL, _RAW))
def type_inference_raw_text(spark, sf_dir):
    raw = load(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS order_id", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '12.5' END AS amount",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '7' END AS half", "CAST(NULL AS STRING) AS none",
    )
    return C.infer_types(raw, list(_RAW))


def _basics_sql(source: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", count(*) AS n_rows, count(v) AS non_null, count(*) - count(v) AS null_count, {pct} AS null_pct, count(DISTINCT v) AS distinct_count, {uniq} AS uniqueness_pct,
    CASE WHEN count(*) = count(v) THEN 'complete' WHEN {pct} > 20 THEN 'many missing' ELSE 'some missing' END AS quality FROM (SELECT nullif(CAST("{c}" AS VARCHAR), '') AS v FROM ({s}))"""
    return each(one.format(c=c, s=source, pct=r("(count(*) - count(v)) / count(*) * 100", 2), uniq=r("count(DISTINCT v) / count(*) * 100", 2)) for c in columns)


_PART_COLUMNS = ["p_name", "p_brand", "p_size", "gap"]


@query(_basics_sql("SELECT *, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 7 = 0 THEN '' ELSE p_brand END AS gap FROM part", _PART_COLUMNS))
def column_basics(spark, sf_dir):
    part = load(spark, sf_dir, "part").withColumn("gap", F.expr("CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 7 = 0 THEN '' ELSE p_brand END"))
    return C.column_basics(part, _PART_COLUMNS)


# ---- categories and texts ---------------------------------------------------------------------


def _counts_sql(source: str, columns: list[str]) -> str:
    body = each(f"""SELECT '{c}' AS "column", CAST("{c}" AS VARCHAR) AS value, count(*) AS n FROM ({source}) WHERE "{c}" IS NOT NULL AND CAST("{c}" AS VARCHAR) <> '' GROUP BY ALL""" for c in columns)
    return f'SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY "column") AS total, count(*) OVER (PARTITION BY "column") AS cardinality FROM ({body})'


@query(f'SELECT "column", CAST(rank AS INTEGER) AS rank, value, n, {r("n / total * 100", 2)} AS pct FROM ({_counts_sql("SELECT * FROM part", ["p_brand", "p_type"])}) WHERE rank <= 5')
def category_top5(spark, sf_dir):
    return C.category_counts(load(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query(
    f"""SELECT "column", CAST(least(rank, 11) AS INTEGER) AS rank, CASE WHEN rank <= 10 THEN value ELSE 'Other' END AS value, CAST(sum(n) AS BIGINT) AS n
    FROM ({_counts_sql("SELECT p_brand, p_type FROM part", ["p_brand", "p_type"])}) GROUP BY ALL"""
)
def category_top10_other(spark, sf_dir):
    return C.category_rollup(load(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query(
    f"""SELECT "column", value AS mode, n AS mode_count, cardinality, {r("n / (SELECT count(*) FROM events) * 100", 2)} AS concentration_pct
    FROM ({_counts_sql("SELECT * FROM events", ["event_type", "user_id"])}) WHERE rank = 1"""
)
def category_mode(spark, sf_dir):
    return C.category_modes(load(spark, sf_dir, "events"), ["event_type", "user_id"])


def _totals_sql(source: str, category: str, measure: str) -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY total DESC, label) AS rank, sum(total) OVER () AS everything
      FROM (SELECT coalesce(CAST("{category}" AS VARCHAR), 'null') AS label, count(*) AS k, sum(coalesce(CAST("{measure}" AS DOUBLE), 0)) AS total FROM ({source}) GROUP BY ALL)"""


_GAPPY = "SELECT nullif(o_orderpriority, '5-LOW') AS priority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders"


def _gappy(spark, sf_dir):
    return load(spark, sf_dir, "orders").selectExpr("nullif(o_orderpriority, '5-LOW') AS priority", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price")


_TOP_SQL = f"""SELECT CAST(rank AS INTEGER) AS rank, label, k AS count, {r("total", 2)} AS sum, {r("total / k", 2)} AS mean, CASE WHEN everything > 0 THEN {r("total / everything * 100", 2)} ELSE 0.0 END AS pct_of_total
  FROM ({_totals_sql(_GAPPY, "priority", "price")}) WHERE rank <= 5"""


@query(_TOP_SQL)
def category_by_primary(spark, sf_dir):
    return C.category_totals(_gappy(spark, sf_dir), "priority", "price")


@query(
    f"""SELECT CAST(rank AS INTEGER) AS rank, label, {r("value", 2)} AS value, {r("value / sum(value) OVER () * 100", 0)} AS share
    FROM (SELECT least(rank, 6) AS rank, CASE WHEN rank <= 5 THEN label ELSE 'Other' END AS label, sum(total) AS value FROM ({_totals_sql("SELECT * FROM part", "p_brand", "p_retailprice")}) GROUP BY ALL)
    WHERE rank <= 5 OR value > 0"""
)
def donut(spark, sf_dir):
    return C.donut(load(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query(f"SELECT min_by(label, rank) AS top_by_sum, arg_max(label, mean * 1000 - rank) AS top_by_mean, min_by(label, rank) <> arg_max(label, mean * 1000 - rank) AS differ FROM ({_TOP_SQL})")
def comparative(spark, sf_dir):
    return C.comparative(C.category_totals(_gappy(spark, sf_dir), "priority", "price"))


@query(
    f"""SELECT 'text' AS "column", count(t) AS n, {r("avg(length(t))", 1)} AS avg_length, {r(r"avg(len(regexp_extract_all(t, '\S+')))", 1)} AS avg_words, max(length(t)) AS max_length,
    count(CASE WHEN regexp_matches(t, '[<>{{}}\\[\\]\\\\]') THEN 1 END) AS special_rows, count(CASE WHEN regexp_matches(t, '^\\s|\\s$|\\s{{2,}}') THEN 1 END) AS space_rows
    FROM (SELECT CASE WHEN text NOT IN ('', 'null') THEN text END AS t FROM conversations)"""
)
def text_stats(spark, sf_dir):
    return C.text_stats(load(spark, sf_dir, "conversations"), ["text"])


# ---- dates and series -------------------------------------------------------------------------


@query("""SELECT (SELECT count(o_orderdate) FROM orders) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d') AS latest,
  CAST(floor((epoch_ms(max(o_orderdate)) - epoch_ms(min(o_orderdate))) / 86400000.0 + 0.5) AS BIGINT) AS range_days,
  (SELECT d FROM (SELECT CAST(dayofweek(o_orderdate) AS INTEGER) AS d, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)) AS mode_weekday,
  (SELECT m FROM (SELECT CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)) AS mode_month FROM orders""")
def date_profile(spark, sf_dir):
    return S.date_profile(load(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT CAST(dayofweek(l_shipdate) AS INTEGER) AS weekday, count(*) AS n FROM lineitem GROUP BY 1")
def weekday_hist(spark, sf_dir):
    return S.weekday_counts(load(spark, sf_dir, "lineitem"), "l_shipdate")


@query("SELECT CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS n FROM lineitem GROUP BY 1")
def month_hist(spark, sf_dir):
    return S.month_counts(load(spark, sf_dir, "lineitem"), "l_shipdate")


@query(
    f"""SELECT {r("max(g)", 1)} AS largest_gap_days, {r("median(g)", 1)} AS median_gap_days, max(g) > 2 * median(g) AND median(g) > 0 AS gap_anomaly
    FROM (SELECT (epoch_ms(ts) - epoch_ms(lag(ts) OVER (ORDER BY ts))) / 86400000.0 AS g FROM events) WHERE g IS NOT NULL"""
)
def date_gaps(spark, sf_dir):
    return S.date_gaps(load(spark, sf_dir, "events"), "ts")


_MONTHLY = f"""SELECT CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS idx, month, value, n,
  CASE WHEN before <> 0 THEN {r("(value - before) / abs(before) * 100", 2)} END AS mom_change, {r("ic + sl * (row_number() OVER (ORDER BY month) - 1)", 2)} AS trend
  FROM (SELECT *, lag(value) OVER (ORDER BY month) AS before FROM (
    SELECT strftime(o_orderdate, '%Y-%m') AS month, {r("coalesce(sum(price), 0)", 2)} AS value, count(*) AS n FROM (SELECT o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders) GROUP BY 1)),
  (SELECT regr_slope(value, i) AS sl, regr_intercept(value, i) AS ic FROM (
    SELECT value, row_number() OVER (ORDER BY month) - 1 AS i FROM (
      SELECT strftime(o_orderdate, '%Y-%m') AS month, {r("coalesce(sum(price), 0)", 2)} AS value FROM (SELECT o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders) GROUP BY 1)))"""


def _series(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").selectExpr("o_orderdate", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price")
    return S.monthly_series(rows, "o_orderdate", "price")


@query(_MONTHLY)
def monthly_series(spark, sf_dir):
    return _series(spark, sf_dir)


@query(
    f"""SELECT count(*) AS periods, {r("regr_slope(value, idx)")} AS slope,
    CASE WHEN regr_slope(value, idx) / abs(avg(value)) > 0.02 THEN 'Upward trend' WHEN regr_slope(value, idx) / abs(avg(value)) < -0.02 THEN 'Downward trend' ELSE 'Flat' END AS direction,
    (SELECT month FROM ({_MONTHLY}) ORDER BY value DESC, idx LIMIT 1) AS peak_month, max(value) AS peak_value, (SELECT month FROM ({_MONTHLY}) ORDER BY value, idx LIMIT 1) AS trough_month, min(value) AS trough_value,
    {r("max(value) / nullif(min(value), 0)", 2)} AS peak_to_trough FROM ({_MONTHLY})"""
)
def trend_peak_trough(spark, sf_dir):
    return S.series_summary(_series(spark, sf_dir))


_SEASON = "SELECT o_orderdate, CASE WHEN month(o_orderdate) = 12 THEN 3.0 * o_totalprice ELSE o_totalprice END AS price FROM orders"


@query(
    f"""WITH b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, {r("sum(price)", 2)} AS value FROM ({_SEASON}) GROUP BY 1),
    m AS (SELECT CAST(substr(month, 6, 2) AS INTEGER) AS m, avg(value) AS mean, count(*) AS k FROM b GROUP BY 1),
    t AS (SELECT * FROM m ORDER BY mean DESC, m LIMIT 1), l AS (SELECT * FROM m ORDER BY mean, m LIMIT 1)
    SELECT ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][t.m] AS top_month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][l.m] AS bottom_month,
    {r("(t.mean / l.mean - 1) * 100", 0)} AS excess_pct FROM t, l WHERE (SELECT sum(k) FROM m) > 12 AND l.mean > 0 AND t.mean > 1.5 * l.mean"""
)
def seasonality(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").selectExpr("o_orderdate", "CASE WHEN month(o_orderdate) = 12 THEN 3.0D * o_totalprice ELSE o_totalprice END AS price")
    return S.seasonality(S.monthly_series(rows, "o_orderdate", "price"))


# ---- correlations -----------------------------------------------------------------------------

_STRENGTH = """CASE WHEN r IS NULL THEN NULL WHEN abs(r) < 0.3 THEN 'Negligible' ELSE
  (CASE WHEN abs(r) >= 0.9 THEN 'Very strong' WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.5 THEN 'Moderate' ELSE 'Weak' END) || (CASE WHEN r >= 0 THEN ' positive' ELSE ' negative' END) END"""
_LINES = """SELECT CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price, CASE WHEN l_linenumber > 1 THEN CAST(l_tax AS DOUBLE) END AS tax,
  -CAST(l_quantity AS DOUBLE) + 100 * CAST(l_discount AS DOUBLE) AS opposed FROM lineitem"""
_LINE_COLUMNS = ["quantity", "price", "tax", "opposed"]


def _lines(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").selectExpr("l_quantity AS quantity", "l_extendedprice AS price", "CASE WHEN l_linenumber > 1 THEN l_tax END AS tax", "-l_quantity + 100 * l_discount AS opposed")


def _pairs_sql() -> str:
    raw = each(f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, {r(f'corr({a}, {b})')} AS r FROM ({_LINES})" for a, b in combinations(_LINE_COLUMNS, 2))
    return f"SELECT col_a, col_b, n, r, abs(r) AS abs_r, {_STRENGTH} AS strength FROM ({raw})"


@query(_pairs_sql())
def correlation_pairs(spark, sf_dir):
    return S.correlations(_lines(spark, sf_dir))


@query(f"""WITH p AS ({_pairs_sql()}) SELECT col_a, col_b, r FROM p UNION ALL SELECT col_b AS col_a, col_a AS col_b, r FROM p UNION ALL {each((f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in _LINE_COLUMNS), " UNION ALL ")}""")
def correlation_matrix(spark, sf_dir):
    return S.correlation_matrix(_lines(spark, sf_dir))


_WIDE = {f"x{i}": f"CASE WHEN (l_linenumber + {i}) % {i + 3} <> 0 THEN l_{['quantity', 'extendedprice', 'discount', 'tax'][i % 4]} * {1 + i % 5} + {i} * l_linenumber END" for i in range(12)}
_WIDE_SQL = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _WIDE.items())


@query(
    f"""WITH w AS (SELECT {_WIDE_SQL} FROM lineitem) SELECT col_a, col_b, n, r, abs(r) AS abs_r, {_STRENGTH} AS strength FROM (
      {each(f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, {r(f'corr({a}, {b})')} AS r FROM w" for a, b in combinations(_WIDE, 2))})"""
)
def correlation_blocks(spark, sf_dir):
    return S.correlations(load(spark, sf_dir, "lineitem").selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in _WIDE.items()]))


@query(
    f"""WITH k AS (SELECT *, row_number() OVER (ORDER BY abs_r DESC, col_a, col_b) AS rank, row_number() OVER (ORDER BY r, col_a, col_b) AS low FROM ({_pairs_sql()}) WHERE r IS NOT NULL)
    SELECT CASE WHEN rank <= 2 THEN 'strongest' ELSE 'most negative' END AS kind, CAST(rank AS INTEGER) AS rank, col_a, col_b, r, strength FROM k WHERE rank <= 2 OR (low = 1 AND r < -0.2)"""
)
def correlation_highlights(spark, sf_dir):
    return S.correlation_highlights(S.correlations(_lines(spark, sf_dir)), top=2)


# ---- anomalies --------------------------------------------------------------------------------

_FLAT = "SELECT CASE WHEN l_linenumber = 7 AND l_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS flat, l_returnflag FROM lineitem"


@query(
    f"""SELECT "column", n AS top_count, (SELECT count(*) FROM lineitem) AS n_rows, {r("n / (SELECT count(*) FROM lineitem)")} AS top_share, n / (SELECT count(*) FROM lineitem) > 0.95 AS near_constant
    FROM ({_counts_sql(_FLAT, ["flat", "l_returnflag"])}) WHERE rank = 1"""
)
def near_constant(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_linenumber = 7 AND l_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS flat", "l_returnflag")
    return Q.near_constant(rows, ["flat", "l_returnflag"])


_ROUND = {"price": "floor(p_retailprice / 10) * 10", "size": "CAST(p_size AS DOUBLE)"}


@query(each(f"""SELECT '{c}' AS "column", count(x) AS n, count(CASE WHEN x <> 0 AND x % 10 = 0 THEN 1 END) AS n_round, {r("count(CASE WHEN x <> 0 AND x % 10 = 0 THEN 1 END) / count(x)")} AS round_share,
  count(CASE WHEN x <> 0 AND x % 10 = 0 THEN 1 END) / count(x) > 0.8 AS suspicious FROM (SELECT {e} AS x FROM part)""" for c, e in _ROUND.items()))
def suspicious_rounding(spark, sf_dir):
    return Q.suspicious_rounding(load(spark, sf_dir, "part").selectExpr("CAST(floor(p_retailprice / 10) * 10 AS DOUBLE) AS price", "CAST(p_size AS DOUBLE) AS size"))


_TRENDS = "SELECT event_id, -event_id AS fall, value, floor(event_id / 100) AS steps, CASE WHEN event_id % 3 = 0 THEN event_id END AS gappy, CASE WHEN event_id % 997 = 5 THEN -1 ELSE event_id END AS broken, event_id * 1000000007 AS place FROM events"
_TREND_COLUMNS = ["event_id", "fall", "value", "steps", "gappy", "broken"]


def _trend_sql(source: str, columns: list[str], order: str) -> str:
    one = """SELECT '{c}' AS "column", count(*) AS n, bool_and(coalesce(x >= b, TRUE)) AS up, bool_and(coalesce(x <= b, TRUE)) AS down
      FROM (SELECT x, lag(x) OVER (ORDER BY {order}) AS b FROM (SELECT CAST({c} AS DOUBLE) AS x, {order} FROM ({source})) WHERE x IS NOT NULL)"""
    body = each(one.format(c=c, source=source, order=order) for c in columns)
    return f"""SELECT "column", n, CASE WHEN up THEN 'increasing' ELSE 'decreasing' END AS direction FROM ({body}) WHERE n >= 6 AND (up OR down)"""


@query(_trend_sql(_TRENDS, _TREND_COLUMNS, "place"))
def monotonic(spark, sf_dir):
    rows = load(spark, sf_dir, "events").selectExpr(
        "event_id", "-event_id AS fall", "value", "floor(event_id / 100) AS steps", "CASE WHEN event_id % 3 = 0 THEN event_id END AS gappy", "CASE WHEN event_id % 997 = 5 THEN -1 ELSE event_id END AS broken",
        "event_id * 1000000007 AS place",
    )
    return Q.monotonic(rows, _TREND_COLUMNS, "place")


@query(_trend_sql("SELECT o_orderkey, o_totalprice, CAST(epoch_ms(o_orderdate) AS DOUBLE) AS day, o_orderdate, o_orderstatus FROM orders", ["day", "o_totalprice"], "o_orderdate, o_orderkey"))
def monotonic_with_ties(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("double").alias("day"), "o_orderdate")
    return Q.monotonic(rows, ["day", "o_totalprice"], "o_orderdate", tie="o_orderkey")


_DIGIT = each(f"""SELECT '{c}' AS "column", CAST(regexp_extract(CAST(abs({c}) AS VARCHAR), '[1-9]') AS VARCHAR) AS d, CAST({c} AS DOUBLE) AS x FROM {t}""" for c, t in (("o_totalprice", "orders"),))


@query(
    f"""SELECT "column", digits, {r("mad")} AS mad, mad > 0.04 AS deviates FROM (
      SELECT "column", count(CASE WHEN d <> '' THEN 1 END) AS digits, count(*) AS n, max(x) > min(x) AS varies,
        ({" + ".join(f"abs(count(CASE WHEN d = '{i}' THEN 1 END) / count(CASE WHEN d <> '' THEN 1 END) - {b})" for i, b in enumerate(Q.BENFORD, 1))}) / 9 AS mad
      FROM ({_DIGIT}) GROUP BY 1) WHERE n > 50 AND digits > 50 AND varies"""
)
def benford(spark, sf_dir):
    return Q.benford(load(spark, sf_dir, "orders"), ["o_totalprice"])


_FUZZY = "SELECT CASE p_size % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_brand) WHEN 2 THEN replace(p_brand, '#', '-') ELSE p_brand END AS brand FROM part"


@query(
    f"""SELECT "column", key, "values", n_values FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY key) AS nth FROM (
      SELECT "column", regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS key, string_agg(value, ' | ' ORDER BY value) AS "values", count(*) AS n_values FROM ({_counts_sql(_FUZZY, ["brand"])})
      WHERE cardinality BETWEEN 2 AND 199 GROUP BY ALL HAVING count(*) > 1 AND length(regexp_replace(lower(any_value(value)), '[^a-z0-9]', '', 'g')) > 2)) WHERE nth <= 3"""
)
def fuzzy_duplicates(spark, sf_dir):
    rows = load(spark, sf_dir, "part").selectExpr("CASE p_size % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_brand) WHEN 2 THEN replace(p_brand, '#', '-') ELSE p_brand END AS brand")
    return Q.fuzzy_duplicates(rows, ["brand"])


_ZERO = {"nothing": "l_linenumber * 0", "some": "l_linenumber % 2", "gaps": "CASE WHEN l_linenumber > 3 THEN 0 END", "none": "CAST(NULL AS DOUBLE)"}


@query(each(f"""SELECT '{c}' AS "column", bool_and({e} = 0) AS all_zero FROM lineitem HAVING count({e}) > 0""" for c, e in _ZERO.items()))
def all_zero(spark, sf_dir):
    return Q.all_zero(load(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _ZERO.items()]), list(_ZERO))


# ---- quality ----------------------------------------------------------------------------------


@query(
    f"""SELECT CAST(sum(k) AS BIGINT) AS n_rows, CAST(sum(k - 1) AS BIGINT) AS duplicates, {r("sum(k - 1) / sum(k) * 100", 2)} AS duplicate_pct
    FROM (SELECT l_suppkey, l_linenumber, l_returnflag, count(*) AS k FROM lineitem GROUP BY ALL)"""
)
def duplicate_rows(spark, sf_dir):
    return Q.duplicate_rows(load(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag"))


_REPEATS = ["o_orderkey AS _row_id", "o_orderstatus", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS other", "month(o_orderdate) AS month", "CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 1.5 END AS weight"]


@query(f"SELECT _row_id, row_number() OVER w > 1 AS is_duplicate, min(_row_id) OVER w AS first_id FROM (SELECT {', '.join(_REPEATS)} FROM orders) WINDOW w AS (PARTITION BY o_orderstatus, priority, other, month, weight ORDER BY _row_id)")
def mark_duplicates(spark, sf_dir):
    return Q.mark_duplicates(load(spark, sf_dir, "orders").selectExpr(*_REPEATS))


# ---- sources and datasets ---------------------------------------------------------------------


@query("SELECT row_number() OVER () - 1 AS _row_id, o_orderkey, o_orderstatus FROM orders")
def source_row_numbers(spark, sf_dir):
    from ..sources.numbering import number_rows

    return number_rows(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))


@query("SELECT 7 * o_orderkey - 3 AS id, o_totalprice FROM orders ORDER BY 1 LIMIT 25 OFFSET 1000")
def page_of_rows(spark, sf_dir):
    from ..sources.dataset import PageIndex

    return PageIndex.build(load(spark, sf_dir, "orders").selectExpr("7 * o_orderkey - 3 AS id", "o_totalprice"), "id", 100).page(41, 25)


_LOG = """'d' || CAST(o_custkey AS STRING) AS name, o_orderkey AS version, 't' || CAST(o_orderkey AS STRING) AS token,
  CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'dropped' ELSE 'uploading' END ELSE 'failed' END AS state, o_orderkey AS at, CAST(o_totalprice AS STRING) AS path, CAST(NULL AS {kind}) AS facts"""


def _log(spark, sf_dir):
    return load(spark, sf_dir, "orders").selectExpr(*[x.strip() for x in _split_columns(_LOG.format(kind="MAP<STRING, STRING>"))])


def _split_columns(text: str) -> list[str]:
    """Select-list parts, cut at commas outside of parentheses and angles."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "(<") - (c in ")>")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return out


_STATES_SQL = f"SELECT name, max(version) AS version, arg_max(state, version) AS state FROM (SELECT {_LOG.format(kind='VARCHAR')} FROM orders) GROUP BY 1 HAVING arg_max(state, version) <> 'dropped'"


@query(_STATES_SQL)
def catalog_states(spark, sf_dir):
    from ..sources.dataset import latest_states

    return latest_states(_log(spark, sf_dir)).select("name", "version", "state")


@query(f"SELECT name FROM ({_STATES_SQL}) WHERE state = 'ready' AND name NOT IN (SELECT 'd' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey % 2 = 0)")
def catalog_sync(spark, sf_dir):
    from ..sources.dataset import latest_states, missing_names

    here = load(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").selectExpr("'d' || CAST(c_custkey AS STRING) AS name")
    return missing_names(here, latest_states(_log(spark, sf_dir))).select("name")


_MESSY = """SELECT o_orderkey AS _row_id,
  CASE o_orderkey % 8 WHEN 0 THEN '$' || CAST(o_orderkey AS VARCHAR) || ',500' WHEN 1 THEN CAST(o_orderkey % 90 AS VARCHAR) || '%' WHEN 2 THEN '(' || CAST(o_orderkey AS VARCHAR) || ')' WHEN 3 THEN 'N/A' ELSE CAST(o_orderkey * 3 AS VARCHAR) END AS amount,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '15-%m-%Y') WHEN 3 THEN 'missing' ELSE strftime(o_orderdate, '20/%m/%Y') END AS day,
  CASE o_orderkey % 4 WHEN 0 THEN '  ' || o_orderpriority WHEN 1 THEN 'null' WHEN 2 THEN NULL ELSE o_orderstatus END AS note FROM orders"""
_MESSY_TYPES = {"amount": "numeric", "day": "date", "note": "categorical"}


def _messy(spark, sf_dir):
    return load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS _row_id",
        "CASE o_orderkey % 8 WHEN 0 THEN '$' || o_orderkey || ',500' WHEN 1 THEN o_orderkey % 90 || '%' WHEN 2 THEN '(' || o_orderkey || ')' WHEN 3 THEN 'N/A' ELSE CAST(o_orderkey * 3 AS STRING) END AS amount",
        "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 2 THEN '15-' || date_format(o_orderdate, 'MM-yyyy') WHEN 3 THEN 'missing' ELSE '20/' || date_format(o_orderdate, 'MM/yyyy') END AS day",
        "CASE o_orderkey % 4 WHEN 0 THEN '  ' || o_orderpriority WHEN 1 THEN 'null' WHEN 2 THEN NULL ELSE o_orderstatus END AS note",
    )


_CLEAN_AMOUNT = """CASE o_orderkey % 8 WHEN 0 THEN CAST(CAST(o_orderkey AS VARCHAR) || '500' AS DOUBLE) WHEN 1 THEN (o_orderkey % 90) / 100.0 WHEN 2 THEN -o_orderkey WHEN 3 THEN NULL ELSE o_orderkey * 3 END"""
_CLEAN = f"""SELECT o_orderkey AS _row_id, CAST({_CLEAN_AMOUNT} AS DOUBLE) AS amount,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-15') WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-20') END AS day,
  CASE o_orderkey % 4 WHEN 0 THEN trim(o_orderpriority) WHEN 3 THEN o_orderstatus END AS note FROM orders"""


@query(_CLEAN)
def cleanse(spark, sf_dir):
    return Q.cleanse(_messy(spark, sf_dir), _MESSY_TYPES, "_row_id")


def _changes_sql() -> str:
    """Cells of the messy table that cleaning changes, by kind, with three samples in row order."""
    number = lambda x: f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 10000000 THEN format('{{:.1f}}', {x}) ELSE CAST({x} AS VARCHAR) END)"
    amount = f"CAST({_CLEAN_AMOUNT} AS DOUBLE)"
    changed = f"""
      SELECT 'amount' AS "column", m._row_id AS place, m.amount AS old, {number(amount)} AS new, CASE o_orderkey % 8 WHEN 3 THEN 'nulls' ELSE 'numbers' END AS change FROM ({_MESSY}) m JOIN orders ON o_orderkey = m._row_id WHERE o_orderkey % 8 < 4
      UNION ALL SELECT 'day', _row_id, m.day, c.day, CASE WHEN c.day IS NULL THEN 'nulls' ELSE 'dates' END FROM ({_MESSY}) m JOIN ({_CLEAN}) c USING (_row_id) WHERE m.day IS DISTINCT FROM c.day
      UNION ALL SELECT 'note', _row_id, m.note, c.note, CASE WHEN c.note IS NULL THEN 'nulls' ELSE 'others' END FROM ({_MESSY}) m JOIN ({_CLEAN}) c USING (_row_id) WHERE m.note IS NOT NULL AND m.note IS DISTINCT FROM c.note"""
    kinds = ", ".join(f"count(CASE WHEN change = '{k}' THEN 1 END) AS {k}" for k in ("numbers", "dates", "nulls", "others"))
    return f"""SELECT "column", count(*) AS changed, {kinds}, string_agg(CASE WHEN nth <= 3 THEN old || ' -> ' || coalesce(new, 'null') END, '; ' ORDER BY nth) AS samples
      FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY place) AS nth FROM ({changed})) GROUP BY 1"""


@query(_changes_sql())
def cleaning_report(spark, sf_dir):
    return Q.cleaning_report(_messy(spark, sf_dir), _MESSY_TYPES, "_row_id")


@query(
    f"""SELECT missing, cells, {r("missing / cells * 100", 2)} AS missing_pct, 0::BIGINT AS empty_rows
    FROM (SELECT CAST(sum(CASE WHEN note IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(*) * 3 AS cells FROM ({_MESSY}))"""
)
def missing_cells(spark, sf_dir):
    return Q.missing_cells(_messy(spark, sf_dir), list(_MESSY_TYPES))


_SPELLS = r"regexp_matches(trim(v), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')"


@query(
    each(
        f"""SELECT '{c}' AS "column", count(CASE WHEN {_SPELLS} THEN 1 END) AS n_numeric, count(CASE WHEN NOT {_SPELLS} THEN 1 END) AS n_text,
        least(count(CASE WHEN {_SPELLS} THEN 1 END), count(CASE WHEN NOT {_SPELLS} THEN 1 END)) / count(v) > 0.05 AS mixed FROM (SELECT nullif({c}, '') AS v FROM ({_MESSY}))"""
        for c in _MESSY_TYPES
    )
)
def mixed_types(spark, sf_dir):
    return Q.mixed_types(_messy(spark, sf_dir), list(_MESSY_TYPES))


def _first_sql(source: str, n: int) -> str:
    return f"(SELECT * FROM ({source}) ORDER BY _row_id LIMIT {n})"


def _dirty_sql(source: str, types: dict[str, str]) -> str:
    """Counts of messy cells by the score's rule, over the first 500 rows."""
    from ..functions.semantics import SCORE_NULLS

    token = f"NOT {_SPELLS} AND lower(trim(v)) IN ({', '.join(repr(x) for x in SCORE_NULLS)})"
    money = f"NOT {_SPELLS} AND regexp_matches(v, '[$€£¥₹]') AND regexp_matches(v, '[0-9]')"
    one = """SELECT '{c}' AS "column", count(*) AS n_seen, count(CASE WHEN {token} THEN 1 END) AS null_tokens, count(CASE WHEN NOT ({token}) AND {money} THEN 1 END) AS money,
      count(CASE WHEN {numeric} AND NOT {spells} AND trim(v) <> '' AND NOT ({token}) AND NOT ({money}) THEN 1 END) AS not_numeric FROM (SELECT {c} AS v FROM {rows})"""
    return each(one.format(c=c, token=token, money=money, spells=_SPELLS, numeric=str(t == "numeric").lower(), rows=_first_sql(source, 500)) for c, t in types.items())


_DIRTY = _dirty_sql(_MESSY, _MESSY_TYPES)


@query(_DIRTY)
def dirty_cells(spark, sf_dir):
    return Q.dirty_cells(_messy(spark, sf_dir), _MESSY_TYPES)


_ODD_TYPES = _MESSY_TYPES | {"code": "categorical"}


def _odd_sql() -> str:
    """Messy cells by the cleaner's rule."""
    from ..functions.semantics import CLEAN_NULLS

    token = f"trim(v) IN ({', '.join(repr(x) for x in CLEAN_NULLS)})"
    money = "(regexp_matches(v, '[$€£¥₹]') AND regexp_matches(v, '[0-9]'))"
    day = r"(regexp_matches(trim(v), '^\d{4}[-/]\d{1,2}[-/]\d{1,2}$') OR regexp_matches(trim(v), '^\d{1,2}[-/]\d{1,2}[-/]\d{4}$'))"
    rule = {"numeric": rf"{token} OR {money} OR regexp_matches(trim(v), '[€£¥₹,()%]') OR regexp_matches(trim(v), '^\d{{1,3}}(\.\d{{3}})+(,\d+)?$')", "date": f"{token} OR {money} OR (NOT {day} AND NOT {_SPELLS})", "categorical": f"{token} OR {money}"}
    one = """SELECT '{c}' AS "column", '{t}' AS type, count(CASE WHEN v <> '' AND ({rule}) THEN 1 END) AS dirty, CAST(floor(count(CASE WHEN v <> '' AND ({rule}) THEN 1 END) / count(*) * 100 + 0.5) AS INTEGER) AS dirty_pct,
      array_to_string(list(trim(v) ORDER BY _row_id) FILTER (v <> '' AND ({rule}))[1:3], '; ') AS samples FROM (SELECT _row_id, {c} AS v FROM {rows}) HAVING count(CASE WHEN v <> '' AND ({rule}) THEN 1 END) > 0"""
    return each(one.format(c=c, t=t, rule=rule[t], rows=_first_sql(_ODD, 500)) for c, t in _ODD_TYPES.items())


_ODD = f"SELECT 7 * _row_id - 40 AS _row_id, amount, CASE WHEN _row_id % 11 = 0 THEN 'some day' ELSE day END AS day, note, CASE _row_id % 6 WHEN 0 THEN '---' WHEN 1 THEN '#REF!' WHEN 2 THEN 'abc' WHEN 3 THEN 'NONE' WHEN 4 THEN 'nOnE' ELSE '€5' END AS code FROM ({_MESSY})"


def _odd(spark, sf_dir):
    return _messy(spark, sf_dir).selectExpr(
        "7 * _row_id - 40 AS _row_id", "amount", "CASE WHEN _row_id % 11 = 0 THEN 'some day' ELSE day END AS day", "note",
        "CASE _row_id % 6 WHEN 0 THEN '---' WHEN 1 THEN '#REF!' WHEN 2 THEN 'abc' WHEN 3 THEN 'NONE' WHEN 4 THEN 'nOnE' ELSE '€5' END AS code",
    )


@query(_odd_sql())
def dirty_columns(spark, sf_dir):
    return Q.dirty_columns(_odd(spark, sf_dir), _ODD_TYPES)


def _score_sql(source: str, types: dict[str, str]) -> str:
    """The score of a table whose rows have ids of any spacing."""
    k = len(types)
    gone = " + ".join(f"CASE WHEN {c} IS NULL OR {c} = '' THEN 1 ELSE 0 END" for c in types)
    numbers, held = (lambda c: f"count(CASE WHEN regexp_matches(trim({c}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN 1 END)"), (lambda c: f"count(nullif({c}, ''))")
    mixed = " + ".join(f"(SELECT CASE WHEN least({numbers(c)}, {held(c)} - {numbers(c)}) / {held(c)} > 0.05 THEN 1 ELSE 0 END FROM m)" for c in types)
    return f"""WITH m AS ({source}), d AS ({_dirty_sql(source, types)}),
    p AS (SELECT (SELECT sum({gone}) FROM m) / (count(*) * {k}) * 100 AS mi, (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM m GROUP BY {", ".join(types)})) / count(*) * 100 AS du, ({mixed}) / {k} * 100 AS mx,
      (SELECT sum(null_tokens + money + not_numeric) FROM d) * (count(*) / (SELECT max(n_seen) FROM d)) / (count(*) * {k}) * 100 AS di FROM m)
    SELECT {r("mi", 2)} AS missing_pct, {r("du", 2)} AS duplicate_pct, {r("mx", 2)} AS mixed_pct, {r("di", 2)} AS dirty_pct,
      CAST(floor(greatest(0, least(100, 100 - 1.2 * mi - du - 4 * mx - 2 * di)) + 0.5) AS INTEGER) AS score FROM p"""


@query(_score_sql(_MESSY, _MESSY_TYPES))
def quality_score(spark, sf_dir):
    return Q.quality_score(_messy(spark, sf_dir), _MESSY_TYPES)


_SPARSE = f"SELECT 7 * _row_id + 100 AS _row_id, CASE WHEN _row_id % 2 = 0 THEN amount ELSE CAST(_row_id AS VARCHAR) END AS amount, day FROM ({_MESSY})"
_SPARSE_TYPES = {"amount": "numeric", "day": "date"}


@query(_score_sql(_SPARSE, _SPARSE_TYPES))
def quality_score_sparse_ids(spark, sf_dir):
    rows = _messy(spark, sf_dir).selectExpr("7 * _row_id + 100 AS _row_id", "CASE WHEN _row_id % 2 = 0 THEN amount ELSE CAST(_row_id AS STRING) END AS amount", "day")
    return Q.quality_score(rows, _SPARSE_TYPES)


_HOLES = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 < 3 THEN '' ELSE 'note' END AS note FROM orders"


@query(f"SELECT * FROM ({_HOLES}) WHERE status <> '' OR price IS NOT NULL OR note <> ''")
def empty_rows_dropped(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status", "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS price", "CASE WHEN o_orderkey % 5 < 3 THEN '' ELSE 'note' END AS note"
    )
    return Q.drop_empty_rows(rows)


_SHEET = ["p_name", "p_brand", "p_size", "p_retailprice"]


@query(
    f"""SELECT b.*, s.* EXCLUDE ("column", n), m.value AS mode, m.n AS mode_count FROM ({_basics_sql("SELECT * FROM part", _SHEET)}) b
    LEFT JOIN ({_stats_sql("SELECT * FROM part", ["p_size", "p_retailprice"])}) s ON s."column" = b."column" LEFT JOIN (SELECT * FROM ({_counts_sql("SELECT * FROM part", ["p_brand"])}) WHERE rank = 1) m ON m."column" = b."column\""""
)
def column_sheet(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return C.column_sheet(C.column_basics(part, _SHEET), C.numeric_stats(part, ["p_size", "p_retailprice"]), C.category_modes(part, ["p_brand"]))


# ---- streams ----------------------------------------------------------------------------------


@query(
    f"""WITH b AS (SELECT strftime(ts, '%Y-%m') AS month, {r("coalesce(sum(value), 0)", 2)} AS value, count(*) AS n FROM events GROUP BY 1),
    i AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS idx, lag(value) OVER (ORDER BY month) AS before FROM b)
    SELECT CAST(idx AS INTEGER) AS idx, month, value, n, CASE WHEN before <> 0 THEN {r("(value - before) / abs(before) * 100", 2)} END AS mom_change,
      {r("(SELECT regr_intercept(value, idx) FROM i) + (SELECT regr_slope(value, idx) FROM i) * idx", 2)} AS trend FROM i"""
)
def streamed_monthly_series(spark, sf_dir):
    from ..sources.shared import shared_folder
    from ..streaming.monthly import keep_monthly, monthly_so_far

    path = shared_folder(spark, "monthly")
    events = load(spark, sf_dir, "events").select("ts", "value")
    events.repartition(2).write.parquet(f"{path}/arrived")  # what arrives, file by file
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arrived")
    keep_monthly(stream, "ts", "value", path, availableNow=True).awaitTermination()
    return monthly_so_far(spark, path)


# ---- repair and export ---------------------------------------------------------------------

_BROKEN_HEADER = ["id", "amount", "day", "status"]


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN '1' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS amount,
    strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 4 <> 0 OR o_orderkey % 3 = 0 THEN o_orderstatus END AS status FROM orders"""
)
def csv_repair(spark, sf_dir):
    from ..sources.delimited import column_types, repaired, split_fields

    lines = load(spark, sf_dir, "orders").selectExpr(
        """o_orderkey || ',' || CASE WHEN o_orderkey % 3 = 0 THEN '1,' || lpad(o_orderkey % 1000, 3, '0') ELSE CAST(o_orderkey % 1000 AS STRING) END || ',' || date_format(o_orderdate, 'yyyy-MM-dd')
        || CASE WHEN o_orderkey % 4 <> 0 OR o_orderkey % 3 = 0 THEN ',' || o_orderstatus ELSE '' END AS value"""
    )
    kinds = column_types(lines.limit(30).select(split_fields(F.col("value")).alias("fields")), len(_BROKEN_HEADER))
    return repaired(lines, _BROKEN_HEADER, kinds)


@query(
    '''SELECT regexp_replace(line, '^.*?,', '') AS rest, count(*) AS n FROM (
      SELECT CAST(p_partkey AS VARCHAR) || ',' || CASE WHEN p_size % 2 = 0 THEN '"' || p_brand || ', ""' || p_type || '"""' ELSE p_type END || ',' || coalesce(CAST(nullif(p_size, 1) AS VARCHAR), '') AS line FROM part) GROUP BY 1'''
)
def csv_export(spark, sf_dir):
    from ..sources.sinks import csv_lines

    rows = load(spark, sf_dir, "part").selectExpr("p_partkey", """CASE WHEN p_size % 2 = 0 THEN p_brand || ', "' || p_type || '"' ELSE p_type END AS kind""", "nullif(p_size, 1) AS size")
    return csv_lines(rows).select(F.regexp_replace("value", "^.*?,", "").alias("rest")).groupBy("rest").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["ORACLES", "QUERIES", "jsround", "load"]
