"""The queries whose results are sentences, and their SQL twins.

The twins take the facts from the table by SQL of their own and word them as the library does.
"""

from __future__ import annotations

from itertools import combinations

from ..functions.frames import small_frame
from ..operators import quality as Q
from . import profile as P
from .catalogue import _counts_sql, _score_sql, _stats_sql, _totals_sql, _trend_sql, each, load, query, r

# ---- the tables -------------------------------------------------------------------------------

ORDERS = {"o_orderkey": "id", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric", "o_orderdate": "date", "o_orderpriority": "categorical"}
_ORDERS_SQL = "SELECT row_number() OVER () - 1 AS _row_id, * FROM orders"


def _orders(spark, sf_dir):
    from ..sources.numbering import number_rows

    return number_rows(load(spark, sf_dir, "orders")), "_row_id"


#: Orders with a fault of every kind: empty cells, repeated rows, mixed and constant columns, spellings, gaps, round numbers, trends.
FAULTY = {"step": "numeric", "tens": "numeric", "flat": "numeric", "amount": "numeric", "mixed": "numeric", "day": "date", "city": "categorical", "empty": "text", "state": "categorical"}
_FAULTS = {
    "step": "CAST(o_orderkey // 40 AS DOUBLE)", "tens": "CAST(o_custkey % 50 * 10 + 10 AS DOUBLE)", "flat": "CAST(7 AS DOUBLE)", "amount": "CASE WHEN o_orderkey // 20 % 4 = 0 THEN NULL WHEN o_orderkey // 20 % 300 = 1 THEN 9000000.5 ELSE CAST(o_orderkey // 20 % 90 AS DOUBLE) + 0.5 END",
    "mixed": "CASE WHEN o_orderkey // 20 % 9 = 0 THEN 'n/a' WHEN o_orderkey // 20 % 9 = 1 THEN '€5' ELSE CAST(o_orderkey // 20 % 8 AS VARCHAR) END",
    "day": "DATE '1995-01-01' + CAST(o_orderkey // 20 % 60 + (CASE WHEN o_orderkey // 20 % 60 > 30 THEN 400 ELSE 0 END) AS INTEGER)",
    "city": "CASE o_orderkey // 20 % 3 WHEN 0 THEN 'New York' WHEN 1 THEN 'new-york' ELSE 'Oslo' END", "empty": "CAST(NULL AS VARCHAR)", "state": "CASE WHEN o_orderkey // 20 % 50 = 0 THEN 'odd' ELSE 'even' END",
}
_FAULTY_SQL = f"SELECT o_orderkey * 3 AS _row_id, {', '.join(f'{e} AS {c}' for c, e in _FAULTS.items())} FROM (SELECT o_orderkey, o_orderkey // 20 % 1500 AS o_custkey FROM orders)"


def _faulty(spark, sf_dir):
    spelled = lambda e: e.replace("//", "DIV").replace("VARCHAR", "STRING").replace("DATE '1995-01-01' +", "DATE '1995-01-01' + ")
    rows = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey DIV 20 % 1500 AS o_custkey")
    return rows.selectExpr("o_orderkey * 3 AS _row_id", *[f"{spelled(e)} AS {c}" for c, e in _FAULTS.items()]), "_row_id"


# ---- facts in SQL -----------------------------------------------------------------------------


def show(x: str) -> str:
    """A number with thousands separators and at most three decimals."""
    return f"(CASE WHEN ({x}) IS NULL THEN 'n/a' WHEN ({x}) = floor({x}) THEN format('{{:,}}', CAST({x} AS BIGINT)) ELSE rtrim(rtrim(format('{{:,.3f}}', CAST({x} AS DOUBLE)), '0'), '.') END)"


def fixed(x: str) -> str:
    return f"format('{{:.2f}}', {x})"


_SPELLS = r"regexp_matches(trim(v), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')"


def facts_sql(source: str, types: dict[str, str]) -> str:
    """Named tables of facts: rows, basics, stats, score, duplicates, missing, pairs, series, summary, leaders, tops, benford, rounding, gaps, trends, spellings."""
    columns, of = list(types), lambda kind: [c for c, t in types.items() if t == kind]
    place = lambda c: f"list_position({columns}, {c})"
    plain = "SELECT _row_id, " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns) + " FROM src"
    number = lambda c: f"TRY_CAST({c} AS DOUBLE)"
    numeric = "SELECT _row_id, " + ", ".join(f"{number(c)} AS {c}" for c in of("numeric")) + " FROM src"
    basics = each(f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) AS n_rows, count(v) AS held, count(DISTINCT v) AS kinds, count(CASE WHEN {_SPELLS} AND {str(t != "date").lower()} THEN 1 END) AS numbers FROM (SELECT nullif({c}, '') AS v FROM plain)""" for c, t in types.items())
    digits = each(f"""SELECT '{c}' AS "column", regexp_extract(CAST(abs({c}) AS VARCHAR), '[1-9]') AS d, {c} AS x FROM nums WHERE {c} IS NOT NULL""" for c in of("numeric"))
    deviation = " + ".join(f"abs(count(CASE WHEN d = '{i}' THEN 1 END) / count(CASE WHEN d <> '' THEN 1 END) - {b})" for i, b in enumerate(Q.BENFORD, 1))
    pairs = each(f"SELECT {i} AS nth, '{a}' AS a, '{b}' AS b, CASE WHEN count({a} + {b}) >= 5 AND NOT isnan(corr({a}, {b})) THEN {r(f'corr({a}, {b})')} END AS r FROM nums" for i, (a, b) in enumerate(combinations(of("numeric"), 2)))
    gaps = each(f"""SELECT '{c}' AS "column", {r("max(g)", 1)} AS largest, {r("median(g)", 1)} AS mid, max(g) > 2 * median(g) AND median(g) > 0 AS odd FROM (SELECT (epoch_ms(CAST({c} AS TIMESTAMP)) - epoch_ms(lag(CAST({c} AS TIMESTAMP)) OVER (ORDER BY {c}))) / 86400000.0 AS g FROM src WHERE {c} IS NOT NULL) WHERE g IS NOT NULL""" for c in of("date"))
    day, cats = of("date")[0], of("categorical")
    leaders = each(f"""SELECT '{c}' AS "column", label, CASE WHEN everything > 0 THEN {r("total / everything * 100", 2)} ELSE 0.0 END AS pct, rank FROM ({{totals_{i}}})""" for i, c in enumerate(cats))
    # The primary column is known to the SQL only, so its cells are picked by name in every row.
    measured = "SELECT *, CASE (SELECT c FROM prime) " + " ".join(f"WHEN '{c}' THEN {number(c)}" for c in of("numeric")) + " END AS measure FROM src"
    leaders = leaders.format(**{f"totals_{i}": _totals_sql("SELECT * FROM measured", c, "measure") for i, c in enumerate(cats)})
    spelled = f"""SELECT "column", key, string_agg(value, ' | ' ORDER BY value) AS spelled FROM (SELECT *, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS key FROM counts WHERE type = 'categorical') WHERE cardinality BETWEEN 2 AND 199 AND length(key) > 2 GROUP BY "column", key HAVING count(*) > 1
      QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY key) <= 3"""
    month = f"strftime(CAST({day} AS TIMESTAMP), '%Y-%m')"
    return f"""WITH src AS ({source}), plain AS ({plain}), nums AS ({numeric}),
    basics AS (SELECT *, {place('"column"')} AS place, n_rows - held AS gone, {r("(n_rows - held) / n_rows * 100", 2)} AS gone_pct FROM ({basics})),
    stats AS (SELECT *, {place('"column"')} AS place FROM ({_stats_sql("SELECT * FROM nums", of("numeric"))})),
    prime AS (SELECT arg_max("column", variance * 1.0 - place * 1e-9) AS c FROM stats), measured AS ({measured}),
    score AS (SELECT score AS s FROM ({_score_sql("SELECT * FROM plain", types)})),
    dup AS (SELECT CAST(sum(k - 1) AS BIGINT) AS n, {r("sum(k - 1) / sum(k) * 100", 2)} AS pct, sum(k) AS n_rows FROM (SELECT count(*) AS k FROM src GROUP BY {", ".join(columns)})),
    miss AS (SELECT CAST(sum(gone) AS BIGINT) AS n, {r("sum(gone) / sum(n_rows) * 100", 2)} AS pct FROM basics),
    mixed AS (SELECT "column", place FROM basics WHERE held > 0 AND least(numbers, held - numbers) / held > 0.05),
    pairs AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC, nth) AS rank FROM ({pairs}) WHERE r IS NOT NULL),
    months AS (SELECT row_number() OVER (ORDER BY month) - 1 AS i, month, value FROM (SELECT {month} AS month, {r("coalesce(sum(measure), 0)", 2)} AS value FROM measured WHERE {day} IS NOT NULL GROUP BY 1)),
    summary AS (SELECT count(*) AS periods, {r("regr_slope(value, i)")} AS slope, CASE WHEN regr_slope(value, i) / abs(nullif(avg(value), 0)) > 0.02 THEN 'Upward trend' WHEN regr_slope(value, i) / abs(nullif(avg(value), 0)) < -0.02 THEN 'Downward trend' ELSE 'Flat' END AS direction,
      (SELECT month FROM months ORDER BY value DESC, i LIMIT 1) AS peak, max(value) AS peak_value, (SELECT month FROM months ORDER BY value, i LIMIT 1) AS trough, min(value) AS trough_value FROM months HAVING count(*) >= 2),
    leaders AS ({leaders}),
    counts AS (SELECT c.*, type, place, n_rows FROM ({_counts_sql("SELECT * FROM plain", columns)}) c JOIN basics USING ("column")),
    tops AS (SELECT *, {r("n / total * 100", 2)} AS pct FROM counts WHERE type = 'categorical'),
    near AS (SELECT "column", place, {r("n / n_rows")} AS share FROM counts WHERE rank = 1 AND n / n_rows > 0.95),
    benford AS (SELECT "column", {place('"column"')} AS place, {r(f"({deviation}) / 9")} AS mad FROM ({digits}) GROUP BY 1 HAVING count(*) > 50 AND max(x) > min(x) AND count(CASE WHEN d <> '' THEN 1 END) > 50 AND ({deviation}) / 9 > 0.04),
    rounding AS (SELECT "column", {place('"column"')} AS place, {r("count(CASE WHEN x <> 0 AND x % 10 = 0 THEN 1 END) / count(x)")} AS share FROM ({digits}) GROUP BY 1 HAVING count(CASE WHEN x <> 0 AND x % 10 = 0 THEN 1 END) / count(x) > 0.8),
    gaps AS (SELECT *, {place('"column"')} AS place FROM ({gaps}) WHERE odd),
    trends AS (SELECT *, {place('"column"')} AS place FROM ({_trend_sql("SELECT * FROM nums", of("numeric"), "_row_id")})),
    spelled AS (SELECT *, {place('"column"')} AS place FROM ({spelled}))"""


def _kinds(types: dict[str, str], kinds: tuple[str, ...]) -> str:
    return ", ".join(f"{sum(t == k for t in types.values())} {k}" for k in kinds)


def flags_sql(types: dict[str, str]) -> str:
    """(ord, type, column, severity, detail)"""
    parts = [
        ("Duplicate rows", "warning", f"SELECT NULL AS c, 0 AS p, {show('n')} || ' rows repeat another (' || {show('pct')} || '%)' AS d FROM dup WHERE n > 0"),
        ("Missing values", "warning", f"SELECT NULL AS c, 0 AS p, {show('n')} || ' cells are empty (' || {show('pct')} || '%)' AS d FROM miss WHERE n > 0"),
        ("High null column", "danger", f"""SELECT "column" AS c, place AS p, {show('gone_pct')} || '% empty' AS d FROM basics WHERE held > 0 AND gone_pct > 20"""),
        ("All-null column", "danger", """SELECT "column" AS c, place AS p, 'no values at all' AS d FROM basics WHERE held = 0"""),
        ("Mixed type column", "warning", """SELECT "column" AS c, place AS p, 'numbers and texts together' AS d FROM mixed"""),
        ("Zero variance column", "info", """SELECT "column" AS c, place AS p, 'a single value' AS d FROM stats WHERE std_dev = 0"""),
        ("Low variance column", "info", f"""SELECT "column" AS c, place AS p, 'one value holds ' || {show('100 * share')} || '% of rows' AS d FROM near WHERE "column" NOT IN (SELECT "column" FROM stats WHERE std_dev = 0)"""),
        ("Outliers detected", "info", f"""SELECT "column" AS c, place AS p, {show('z_outliers')} || ' values beyond three deviations' AS d FROM stats WHERE z_outliers > 0"""),
        ("Monotonic column", "info", """SELECT "column" AS c, place AS p, 'always ' || direction AS d FROM trends"""),
        ("Date gaps detected", "warning", f"""SELECT "column" AS c, place AS p, 'a gap of ' || {show('largest')} || ' days against a median of ' || {show('mid')} AS d FROM gaps"""),
        ("Suspicious rounding", "info", f"""SELECT "column" AS c, place AS p, {show('100 * share')} || '% are multiples of ten' AS d FROM rounding"""),
        ("Benford Law Anomaly", "warning", f"""SELECT "column" AS c, place AS p, 'first digits deviate by ' || {show('mad')} || ' on average' AS d FROM benford"""),
        ("Category Consistency", "warning", """SELECT "column" AS c, place + row_number() OVER (ORDER BY key) / 1000.0 AS p, 'spellings of one value: ' || spelled AS d FROM spelled"""),
    ]
    body = each(f"SELECT {i} AS k, '{kind}' AS type, c, '{severity}' AS severity, p, d FROM ({sql})" for i, (kind, severity, sql) in enumerate(parts))
    return f"""SELECT CAST(row_number() OVER (ORDER BY k, p) - 1 AS INTEGER) AS ord, type, CAST(c AS VARCHAR) AS "column", severity, d AS detail FROM ({body})"""


def insights_sql(types: dict[str, str]) -> str:
    first = next((c for c, t in types.items() if t == "categorical"), "")
    parts = [
        ("overview", f"SELECT 100 AS s, {show('n_rows')} || ' rows by {len(types)} columns; quality score ' || (SELECT s FROM score) || ' of 100.' AS t FROM dup"),
        ("numeric", f"""SELECT 80 AS s, "column" || ' has a mean of ' || {show('mean')} || ' and runs from ' || {show('min')} || ' to ' || {show('max')} || '.' AS t FROM stats WHERE "column" = (SELECT c FROM prime)"""),
        ("correlation", f"SELECT CASE WHEN abs(r) > 0.8 THEN 95 ELSE 70 END AS s, a || ' and ' || b || ' move together with r = ' || {fixed('r')} || ' (' || lower({{strength}}) || ').' AS t FROM pairs WHERE rank = 1"),
        ("timeseries", f"SELECT CASE direction WHEN 'Flat' THEN 60 ELSE 90 END AS s, direction || '; the peak of ' || {show('peak_value')} || ' is in ' || peak || '.' AS t FROM summary"),
        ("category", f"""SELECT 75 AS s, label || ' leads ' || "column" || ' with ' || {show('pct')} || '% of ' || (SELECT c FROM prime) || '.' AS t FROM leaders WHERE rank = 1 AND "column" = '{first}'"""),
        ("outlier", f"""SELECT 85 AS s, "column" || ' has ' || {show('z_outliers')} || ' values far from the rest.' AS t FROM (SELECT * FROM stats WHERE z_outliers > 0 ORDER BY place LIMIT 1)"""),
        ("quality", f"SELECT CASE WHEN pct > 5 THEN 92 ELSE 40 END AS s, {show('n')} || ' rows (' || {show('pct')} || '%) repeat another row.' AS t FROM dup WHERE n > 0"),
        ("quality", f"""SELECT CASE WHEN gone_pct > 25 THEN 93 ELSE 50 END AS s, "column" || ' lacks ' || {show('gone_pct')} || '% of its values.' AS t FROM (SELECT * FROM basics WHERE gone_pct > 10 ORDER BY place LIMIT 1)"""),
    ]
    body = each(f"SELECT {i} AS k, '{kind}' AS category, s, t FROM ({sql})" for i, (kind, sql) in enumerate(parts)).replace("{strength}", _STRENGTH)
    return f"SELECT CAST(row_number() OVER (ORDER BY s DESC, k) AS INTEGER) AS rank, CAST(s AS INTEGER) AS score, category, t AS text FROM ({body}) QUALIFY row_number() OVER (ORDER BY s DESC, k) <= 6"


_STRENGTH = """(CASE WHEN abs(r) < 0.3 THEN 'Negligible' ELSE (CASE WHEN abs(r) >= 0.9 THEN 'Very strong' WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.5 THEN 'Moderate' ELSE 'Weak' END) || (CASE WHEN r >= 0 THEN ' positive' ELSE ' negative' END) END)"""


def stories_sql(types: dict[str, str]) -> str:
    first, day = (next((c for c, t in types.items() if t == k), "") for k in ("categorical", "date"))
    grade = "CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 75 THEN 'Good' WHEN s >= 50 THEN 'Fair' ELSE 'Poor' END"
    weight = "CASE WHEN pct > 10 THEN 'enough to bias results' WHEN pct > 3 THEN 'worth a look before drawing conclusions' ELSE 'unlikely to matter' END"
    word = "CASE WHEN abs(r) >= 0.8 THEN 'very strong' WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END"
    rows = "(SELECT n_rows FROM dup)"
    parts = [
        f"SELECT 0 AS p, 'Data health' AS title, 'health' AS category, lower({grade}) AS severity, 'The data score ' || s || ' of 100 (' || {grade} || '): ' || {show(rows)} || ' rows, {len(types)} columns, of which {_kinds(types, ('numeric', 'categorical', 'date'))}.' AS t FROM score",
        f"SELECT 0, 'Missing data', 'quality', CASE WHEN pct > 10 THEN 'error' WHEN pct > 3 THEN 'warning' ELSE 'info' END, {show('n')} || ' cells (' || {show('pct')} || '%) are empty, ' || {weight} || '.' FROM miss WHERE n > 0",
        f"""SELECT 0, 'Column: ' || "column", 'quality', 'warning', "column" || ' is the emptiest: ' || {show('gone')} || ' of ' || {show(rows)} || ' cells (' || {show('gone_pct')} || '%).' FROM (SELECT * FROM basics ORDER BY gone_pct DESC, place LIMIT 1) WHERE gone_pct > 5""",
        "SELECT 0, 'No missing data', 'quality', 'info', 'Every cell holds a value.' FROM miss WHERE n = 0",
        f"SELECT 0, 'Duplicate rows', 'quality', CASE WHEN n > 0.05 * n_rows THEN 'error' ELSE 'warning' END, {show('n')} || ' rows repeat others (' || {show('pct')} || '%); they weigh on means and counts.' FROM dup WHERE n > 0",
        f"SELECT rank, 'Correlation: r = ' || {fixed('r')}, 'correlation', 'info', a || ' and ' || b || ' have a ' || {word} || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END || ' correlation.' FROM pairs WHERE rank <= 3",
        f"SELECT 0, 'Trend: ' || direction, 'timeseries', 'info', (SELECT c FROM prime) || ' by month of {day}: ' || lower(direction) || ' over ' || periods || ' months, highest in ' || peak || ' (' || {show('peak_value')} || '), lowest in ' || trough || ' (' || {show('trough_value')} || ').' FROM summary",
        f"""SELECT 0, 'Outliers detected', 'outlier', 'warning', {show('z')} || ' values lie beyond three deviations, in ' || k || ' columns with outliers (' || names || CASE WHEN k > 4 THEN ', ...' ELSE '' END || ').'
          FROM (SELECT sum(z_outliers) AS z, count(*) AS k, array_to_string(list("column" ORDER BY place)[1:4], ', ') AS names FROM stats WHERE z_outliers > 0 OR iqr_outliers > 0) WHERE k > 0""",
        f"""SELECT 0, 'Dominant category', 'category', 'info', 'In ' || "column" || ', ' || label || ' holds ' || {show('pct')} || '% of all ' || (SELECT c FROM prime) || '.' FROM leaders WHERE rank = 1 AND "column" = '{first}'""",
        f"""SELECT 0, 'Skewed distribution', 'distribution', 'warning', "column" || ' leans to the ' || CASE WHEN skewness > 0 THEN 'right' ELSE 'left' END || ' (skewness ' || {show('skewness')} || '); its median says more than its mean.' FROM (SELECT * FROM stats WHERE abs(skewness) > 1 ORDER BY place LIMIT 1)""",
    ]
    body = each(f"SELECT {i} AS k, x.* FROM ({sql}) x(p, title, category, severity, t)" for i, sql in enumerate(parts))
    return f"SELECT CAST(row_number() OVER (ORDER BY k, p) - 1 AS INTEGER) AS ord, title, category, severity, t AS text FROM ({body})"


def kpis_sql(types: dict[str, str]) -> str:
    last = f"coalesce((SELECT 'Trend' FROM summary), 'Empty cells') AS name, coalesce((SELECT direction FROM summary), (SELECT {show('n')} FROM miss)) AS value"
    return f"SELECT 0 AS ord, 'Rows' AS name, {show('n_rows')} AS value FROM dup UNION ALL SELECT 1, 'Columns', '{len(types)}' UNION ALL SELECT 2, 'Quality score', CAST(s AS VARCHAR) FROM score UNION ALL SELECT 3, {last}"


def details_sql(types: dict[str, str]) -> str:
    empty = f"CASE WHEN gone > 0 THEN ', ' || {show('gone_pct')} || '% empty' ELSE '' END"
    detail = f"coalesce({show('s.min')} || CASE WHEN s.min IS NULL THEN NULL ELSE ' to ' END || {show('s.max')} || ', mean ' || {show('s.mean')}, {show('kinds')} || ' values, most often ' || t.value || ' (' || {show('t.pct')} || '%)', {show('kinds')} || ' distinct values') || {empty}"
    return f"""SELECT CAST(b.place - 1 AS INTEGER) AS ord, b."column", b.type, {detail} AS detail FROM basics b LEFT JOIN stats s USING ("column") LEFT JOIN (SELECT * FROM tops WHERE rank = 1) t USING ("column")""".replace("gone", "b.gone").replace("b.b.", "b.")


def answers_sql(types: dict[str, str], name: str) -> str:
    day = next((c for c, t in types.items() if t == "date"), "")
    label = "CASE WHEN s >= 80 THEN 'Excellent' WHEN s >= 50 THEN 'Moderate' ELSE 'Poor' END"
    n_numeric = sum(t == "numeric" for t in types.values())
    cats = [c for c, t in types.items() if t == "categorical"][: P.CATEGORIES]
    lines = {
        "overview": [
            f"SELECT 0 AS p, '{name}: ' || {show('n_rows')} || ' rows, {len(types)} columns.' AS line FROM dup", f"SELECT 0, 'Types: {_kinds(types, ('numeric', 'categorical', 'date', 'text'))}.'", f"SELECT 0, 'Quality score: ' || s || ' of 100 (' || {label} || ').' FROM score",
            f"SELECT 0, 'Empty cells: ' || {show('n')} || ' (' || {show('pct')} || '%).' FROM miss WHERE n > 0", f"SELECT 0, 'Repeated rows: ' || {show('n')} || '.' FROM dup WHERE n > 0",
        ],
        "key-metrics": [
            f"""SELECT place AS p, "column" || ': mean ' || {show('mean')} || ', median ' || {show('median')} || ', ' || {show('min')} || ' to ' || {show('max')} || ', deviation ' || {show('std_dev')} AS line FROM stats QUALIFY row_number() OVER (ORDER BY place) <= 6""",
            f"SELECT 0, 'and {n_numeric - 6} more' WHERE {n_numeric} > 6",
        ],
        "trends": [
            f"SELECT 0 AS p, (SELECT c FROM prime) || ' by month of {day}: ' || direction || ' (slope ' || {show('slope')} || ') over ' || periods || ' months.' AS line FROM summary", f"SELECT 0, 'Peak ' || {show('peak_value')} || ' in ' || peak || ', trough ' || {show('trough_value')} || ' in ' || trough || '.' FROM summary",
            f"""SELECT 0, t.name || ' is ' || {show(r("(t.mean / l.mean - 1) * 100", 0))} || '% above ' || l.name || '.' FROM (SELECT * FROM season ORDER BY mean DESC, m LIMIT 1) t, (SELECT * FROM season ORDER BY mean, m LIMIT 1) l WHERE (SELECT count(*) FROM months) > 12 AND l.mean > 0 AND t.mean > 1.5 * l.mean""",
        ],
        "correlations": [f"SELECT rank AS p, a || ' and ' || b || ': r = ' || {fixed('r')} || ', ' || lower({_STRENGTH}) AS line FROM pairs WHERE rank <= 5"],
        "outliers": [
            f"""SELECT place AS p, "column" || ': ' || {show('z_outliers')} || ' by deviation, ' || {show('iqr_outliers')} || ' by quartiles' AS line FROM stats WHERE z_outliers > 0 OR iqr_outliers > 0""",
            """SELECT place, "column" || ': first digits do not follow Benford''s law' FROM benford""", """SELECT place + row_number() OVER (ORDER BY place, key) / 1000.0, "column" || ': ' || spelled FROM spelled QUALIFY row_number() OVER (ORDER BY place, key) <= 3""",
            "SELECT 0, 'Nothing unusual was found.' WHERE (SELECT count(*) FROM stats WHERE z_outliers > 0 OR iqr_outliers > 0) + (SELECT count(*) FROM benford) + (SELECT count(*) FROM spelled) = 0",
        ],
        "quality": [
            "SELECT 0 AS p, 'Quality score: ' || s || ' of 100.' AS line FROM score", """SELECT ord, '[' || severity || '] ' || type || CASE WHEN "column" IS NULL THEN '' ELSE ' in ' || "column" END || ': ' || detail FROM flags WHERE ord < 8""",
            "SELECT 0, 'and ' || (count(*) - 8) || ' more' FROM flags HAVING count(*) > 8", "SELECT 0, 'No issues were found.' FROM flags HAVING count(*) = 0",
        ],
        "categories": [f"""SELECT place AS p, "column" || ': ' || string_agg(value || ' (' || {show('pct')} || '%)', ', ' ORDER BY rank) AS line FROM tops WHERE rank <= 3 AND "column" IN ({", ".join(repr(c) for c in cats)}) GROUP BY "column", place"""],
        "columns": [f"""SELECT place AS p, "column" || ': ' || type || ', ' || {show('kinds')} || ' distinct' || CASE WHEN gone > 0 THEN ', ' || {show('gone_pct')} || '% empty' ELSE '' END AS line FROM basics WHERE place <= 12"""],
    }
    body = each(f"SELECT '{topic}' AS topic, {i} AS k, x.p, x.line FROM ({sql}) x(p, line)" for topic, parts in lines.items() for i, sql in enumerate(parts))
    return f"SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY k, p) - 1 AS INTEGER) AS ord, line FROM ({body})"


_SEASON = "season AS (SELECT CAST(substr(month, 6, 2) AS INTEGER) AS m, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][CAST(substr(month, 6, 2) AS INTEGER)] AS name, avg(value) AS mean FROM months GROUP BY ALL)"


# ---- the queries ------------------------------------------------------------------------------


def _told(make, rows, name: str):
    """A query that profiles a table, tells something of it, and frees what the profile held."""

    def run(spark, sf_dir):
        df, row_id = rows(spark, sf_dir)
        p = P.profile(df, name, row_id)
        try:
            return make(p)
        finally:
            p.close()

    return run


def _answers(p: P.Profile):
    told = P.ask_all(p, list(P.TOPICS))
    return small_frame(p.df.sparkSession, [(topic, i, line) for topic, lines in told.items() for i, line in enumerate(lines)], "topic string, ord int, line string")


def _register() -> None:
    tables = {"": (_orders, _ORDERS_SQL, ORDERS, "orders"), "_faulty": (_faulty, _FAULTY_SQL, FAULTY, "faulty")}
    for suffix, (rows, source, types, name) in tables.items():
        facts = facts_sql(source, types)
        told = {
            "insights": (P.Profile.insights, insights_sql(types)), "stories": (P.Profile.stories, stories_sql(types)), "quality_flags": (P.Profile.flags, flags_sql(types)), "kpi_row": (P.kpis, kpis_sql(types)), "column_details": (P.column_details, details_sql(types)),
        }
        for key, (make, sql) in told.items():
            query(f"{facts}\n{sql}", key + suffix)(_told(make, rows, name))
        query(f"{facts}, {_SEASON}, flags AS ({flags_sql(types)})\n{answers_sql(types, name)}", "answers" + suffix)(_told(_answers, rows, name))


_register()
