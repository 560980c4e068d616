"""A whole profile of a table, and what is said about it: insights, stories and answers.

One scan counts the distinct cells of every column. Types come from these counts, and so do
all measures that do not depend on where a value stands: basics, mixed types, quartiles,
outliers, first digits, round numbers, leading values, spellings. A second scan takes the
moments of the numeric columns. What is left (duplicate rows, correlations, series, gaps,
trends) is a scan each, and every measure is taken once, when a sentence first asks for it
(:class:`Facts`). A section that needs several measures asks for them at once, so that
their jobs share the cluster instead of waiting for each other (:func:`together`).
Sentences are made from the small results. :meth:`Profile.close` frees the counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import RLock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import small_frame
from ..functions.semantics import text_number
from ..operators import columns as C
from ..operators import quality as Q
from ..operators import series as S
from ..sources.sinks import report

#: Insights shown; categories broken down; columns of a heat map.
INSIGHTS, CATEGORIES, HEAT_COLUMNS = 6, 5, 8
# The topics that may be asked, their titles, and the words that find them.
TOPICS = {
    "overview": ("Dataset overview", ["overview", "summary", "describe"]),
    "key-metrics": ("Key metrics", ["metrics", "mean", "average", "statistics"]),
    "trends": ("Trends over time", ["trend", "time", "series", "growth", "seasonal"]),
    "correlations": ("Correlations", ["correlation", "relationship", "related", "associated"]),
    "outliers": ("Outliers and anomalies", ["outlier", "anomaly", "unusual", "extreme"]),
    "quality": ("Data quality issues", ["quality", "missing", "null", "duplicate", "issues"]),
    "categories": ("Category breakdown", ["category", "categorical", "distribution", "segments"]),
    "columns": ("Column profiles", ["column", "field", "profile", "types"]),
}

#: Fixed value: names of columns that no chart offers.
IGNORED = re.compile(r"(s\.?no\.?|id|serial\s*no|uuid)", re.I)


#: What the sections ask for at once: facts that sentences are told from, and what flags and answers need.
TOLD_FACTS = ("score", "basics", "numeric", "pairs", "summary", "leader", "duplicates")
FLAG_FACTS = ("basics", "numeric", "duplicates")
FLAG_ANOMALIES = ("rounding", "monotonic", "benford", "fuzzy")
ANSWER_NEEDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "overview": (("score",), (), ()), "key-metrics": (("numeric",), (), ()), "trends": (("summary",), (), ("season",)), "correlations": (("pairs",), (), ()),
    "outliers": (("numeric",), ("benford", "fuzzy"), ()), "quality": (("score", *FLAG_FACTS), FLAG_ANOMALIES, ("gaps",)), "categories": ((), (), ("tops",)), "columns": (("basics",), (), ()),
}


def show(x) -> str:
    """A number with thousands separators and at most three decimals."""
    if x is None:
        return "n/a"
    if isinstance(x, int) or float(x).is_integer():
        return f"{int(x):,}"
    return f"{x:,.3f}".rstrip("0").rstrip(".")


def show_short(x: float) -> str:
    """A number in compact form: 1.2K, 3.4M, 5.6B."""
    for least, letter in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(x) >= least:
            return f"{x / least:.1f}".rstrip("0").rstrip(".") + letter
    return show(x)


def show_bytes(n: int) -> str:
    """A size in bytes, KB or MB."""
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB"


def chart_columns(names: list[str]) -> list[str]:
    """Columns worth a chart: serial numbers and bare identifiers are left out, each name comes once."""
    return [n for n in dict.fromkeys(names) if not IGNORED.fullmatch(n)]


def _rows(df: DataFrame | None) -> list[dict]:
    return [r.asDict() for r in df.collect()] if df is not None else []


def _first(df: DataFrame | None) -> dict | None:
    return next(iter(_rows(df)), None)


def together(spark: SparkSession, asks: list[Callable[[], object]]) -> list:
    """The results of independent questions, whose jobs run side by side; the first error is raised when all have ended."""
    if len(asks) < 2:
        return [ask() for ask in asks]
    with ThreadPoolExecutor(len(asks)) as pool:
        asked = [pool.submit(inheritable_thread_target(spark)(ask)) for ask in asks]
    return [x.result() for x in asked]


class Once:
    """Values that are found once each, whichever thread asks first; others wait for it."""

    def __init__(self):
        self._held: dict = {}
        self._locks: dict[str, RLock] = {}

    def get(self, name: str, find: Callable[[], object]):
        with self._locks.setdefault(name, RLock()):
            if name not in self._held:
                self._held[name] = find()
            return self._held[name]


def once(find):
    """A property of a profile that is found once."""
    return property(lambda self: self.found.get(find.__name__, lambda: find(self)), doc=find.__doc__)


class Facts(Once):
    """The few numbers that sentences are made from, each found when it is first asked for."""

    def __init__(self, p: Profile):
        super().__init__()
        self._p = p

    def __getitem__(self, name: str):
        return self.get(name, getattr(self, f"_{name}"))

    def _rows(self) -> int:
        return max((r["n_rows"] for r in self._p.counted.values()), default=0)

    def _basics(self) -> dict:
        return {r["column"]: r for r in _rows(self._p.basics)}

    def _numeric(self) -> list[dict]:
        return sorted(_rows(self._p.numeric), key=lambda r: list(self._p.types).index(r["column"])) if self._p.of("numeric") else []

    def _duplicates(self) -> dict:
        return _first(Q.duplicate_rows(self._p.body))

    def _missing(self) -> dict:
        counted = self._p.counted.values()
        missing, cells = sum(r["n_rows"] - r["n_present"] for r in counted), sum(r["n_rows"] for r in counted)
        return {"missing": missing, "cells": cells, "missing_pct": C.half_up(missing / cells * 100, 2) if cells else 0.0}

    def _mixed(self) -> list[str]:
        least = lambda r: min(r["n_numeric"], r["n_present"] - r["n_numeric"])
        return [c for c, r in self._p.counted.items() if r["n_present"] and least(r) / r["n_present"] > 0.05]

    def _score(self) -> int:
        p = self._p
        rows, first = (p.df, Q.FIRST_ROWS) if p.row_id else (p.df.limit(Q.FIRST_ROWS), None)
        dirty = _rows(Q.dirty_cells(rows, p.types, p.row_id or "", first))
        counts = (self["missing"]["missing"], self["missing"]["cells"], self["duplicates"]["duplicates"], self["rows"], len(self["mixed"]), sum(r["null_tokens"] + r["money"] + r["not_numeric"] for r in dirty), max((r["n_seen"] for r in dirty), default=0))
        frame = small_frame(p.df.sparkSession, [counts], "missing long, cells long, duplicates long, n_rows long, mixed long, dirty long, seen long")
        return _first(Q.score_of(frame, max(1, len(p.types))))["score"]

    def _pairs(self) -> list[dict]:
        return sorted((r for r in _rows(self._p.correlations) if r["r"] is not None), key=lambda r: -r["abs_r"])

    def _summary(self) -> dict | None:
        return _first(S.series_summary(self._p.series)) if self._p.series is not None else None

    def _leader(self) -> list[dict]:
        """The leading values of the first categorical column, with its name."""
        c = next(iter(self._p.of("categorical")), None)
        return [r | {"column": c} for r in _rows(self._p.totals.get(c))]

    def _leaders(self) -> dict:
        totals = self._p.totals
        return dict(zip(totals, together(self._p.df.sparkSession, [lambda t=t: _rows(t) for t in totals.values()])))


class Anomalies(Facts):
    """What looks odd, kind by kind."""

    def _constant(self) -> list[dict]:
        return [{"column": r["column"], "std_dev": r["std_dev"]} for r in self._p.facts["numeric"] if r["std_dev"] == 0]

    def _near_constant(self) -> list[dict]:
        found = ((c, r["top_count"] / r["n_rows"]) for c, r in self._p.counted.items() if r["n_rows"])
        return [{"column": c, "top_share": C.half_up(share, 4)} for c, share in found if share > 0.95]

    def _rounding(self) -> list[dict]:
        return [r for r in _rows(Q.rounding_of_counts(self._p.numbers)) if r["suspicious"]] if self._p.of("numeric") else []

    def _monotonic(self) -> list[dict]:
        p = self._p
        return _rows(Q.monotonic(p.df, p.of("numeric"), p.row_id)) if p.of("numeric") and p.row_id else []

    def _benford(self) -> list[dict]:
        return [r for r in _rows(Q.benford_of_counts(self._p.numbers)) if r["deviates"]] if self._p.of("numeric") else []

    def _fuzzy(self) -> list[dict]:
        groups = self._p.of("categorical")
        return _rows(Q.fuzzy_values(self._p.values.where(F.col("column").isin(groups)))) if groups else []

    def __getitem__(self, name: str):
        """In the order of the table's columns."""
        place = list(self._p.types).index
        return sorted(super().__getitem__(name), key=lambda r: (place(r["column"]), r.get("key", "")))


@dataclass
class Profile:
    """Sections of a profile as tidy frames; ``counts`` and ``counted`` are found when the profile is made."""

    df: DataFrame
    types: dict[str, str]
    name: str = "dataset"
    row_id: str | None = None
    counts: DataFrame | None = None  # (column, value, n) of all cells, kept until close()
    counted: dict[str, dict] | None = None
    found: Once = field(default_factory=Once, repr=False, compare=False)

    def gather(self, facts: tuple[str, ...] = (), anomalies: tuple[str, ...] = (), sections: tuple[str, ...] = ()) -> None:
        """Find several measures at once."""
        asks = [lambda n=n: self.facts[n] for n in facts] + [lambda n=n: self.anomalies[n] for n in anomalies] + [lambda n=n: getattr(self, n) for n in sections]
        together(self.df.sparkSession, asks)

    def of(self, kind: str) -> list[str]:
        return [c for c, t in self.types.items() if t == kind]

    @once
    def body(self) -> DataFrame:
        return self.df.select(*[F.col(f"`{c}`") for c in self.types])

    @property
    def values(self) -> DataFrame:
        """(column, value, n) of the cells that hold something."""
        return self.counts.where("value IS NOT NULL")

    @once
    def numbers(self) -> DataFrame:
        """(column, x, n) of the numbers in numeric columns; one number may come in several spellings."""
        value, texts = F.col("value"), [c for c in self.of("numeric") if self.body.schema[c].dataType.simpleString() == "string"]
        native = F.coalesce(value.try_cast("double"), value.try_cast("boolean").cast("int").cast("double"))  # a native value spells one
        x = F.when(F.col("column").isin(texts), text_number(value)).when(value != "NaN", native)
        return self.values.where(F.col("column").isin(self.of("numeric"))).select("column", x.alias("x"), "n").where("x IS NOT NULL")

    def close(self) -> None:
        """Free what the profile holds."""
        self.counts.unpersist()

    @once
    def facts(self) -> Facts:
        return Facts(self)

    @once
    def anomalies(self) -> Anomalies:
        return Anomalies(self)

    @once
    def basics(self) -> DataFrame:
        rows = [(c, r["n_rows"], r["n_present"], r["n_distinct"]) for c, r in self.counted.items()]
        return C.basics_of(small_frame(self.df.sparkSession, rows, "column string, n_rows long, non_null long, distinct_count long"))

    @once
    def moments(self) -> dict[str, dict]:
        """n, sum, mean, extremes and deviation of the numeric columns, from one scan."""
        return {r["column"]: r for r in _rows(C._moments(self.body, self.of("numeric"), False))} if self.of("numeric") else {}

    @once
    def numeric(self) -> DataFrame:
        return C.numeric_stats_of_counts(self.body, self.of("numeric"), self.numbers, self.moments)

    @once
    def categories(self) -> DataFrame | None:
        return C.categories_of_counts(self.values.where(F.col("column").isin(self.of("categorical")))) if self.of("categorical") else None

    @once
    def tops(self) -> list[dict]:
        return _rows(self.categories)

    @once
    def texts(self) -> DataFrame | None:
        held = [c for c in self.of("text") if self.body.schema[c].dataType.simpleString() == "string"]
        return C.text_stats(self.body, held) if held else None

    @once
    def histograms(self) -> DataFrame | None:
        return C.histogram(self.body, self.of("numeric")) if self.of("numeric") else None

    @once
    def correlations(self) -> DataFrame:
        return S.correlations(self.body, self.of("numeric"))

    @property
    def heat_map(self) -> DataFrame | None:
        """(col_a, col_b, r) of every ordered pair of the first eight numeric columns; None under two."""
        shown = self.of("numeric")[:HEAT_COLUMNS]
        return S.correlation_matrix(self.body, shown) if len(shown) > 1 else None

    @once
    def primary(self) -> str | None:
        """The numeric column of the largest variance, the first of equals, of those with two numbers."""
        spread = {c: C.half_up(r["sd"] ** 2, 4) for c, r in self.moments.items() if r["n"] >= 2}
        return max(spread, key=lambda c: (spread[c], -self.of("numeric").index(c))) if spread else None

    @once
    def series(self) -> DataFrame | None:
        if not (self.of("date") and self.primary):
            return None
        sums = S.month_sums(self.body, self.of("date")[0], self.primary)
        months = [tuple(r) for r in sums.select("month", "total", "n").collect()]  # a row for each month
        return S.series_of_sums(small_frame(self.df.sparkSession, months, "month string, total double, n long"))

    @once
    def season(self) -> dict | None:
        return _first(S.seasonality(self.series)) if self.series is not None else None

    @once
    def totals(self) -> dict[str, DataFrame]:
        return {c: C.category_totals(self.body, c, self.primary) for c in self.of("categorical")[:CATEGORIES]} if self.primary else {}

    @once
    def gaps(self) -> dict[str, dict]:
        days = self.of("date")
        found = together(self.df.sparkSession, [lambda c=c: _first(S.date_gaps(self.body, c)) for c in days])
        return {c: g for c, g in zip(days, found) if g}

    def lists(self) -> dict[str, list[str]]:
        """The columns by what is wrong with them."""
        f, a = self.facts, self.anomalies
        basics = f["basics"].values()
        return {
            "all_null": [b["column"] for b in basics if not b["non_null"]], "high_null": [b["column"] for b in basics if b["non_null"] and b["null_pct"] > 20], "mixed_type": f["mixed"],
            "constant": [r["column"] for r in a["constant"]], "near_constant": [r["column"] for r in a["near_constant"]],
        }

    def flags(self) -> DataFrame:
        """(ord, type, column, severity, detail) in a fixed order of kinds."""
        self.gather(FLAG_FACTS, FLAG_ANOMALIES, ("gaps",))
        # The names of the kinds, by which flags are looked up, and their severities.
        f, a, out = self.facts, self.anomalies, []
        add = lambda kind, severity, detail, column=None: out.append((len(out), kind, column, severity, detail))
        if f["duplicates"]["duplicates"]:
            add("Duplicate rows", "warning", f"{show(f['duplicates']['duplicates'])} rows repeat another ({show(f['duplicates']['duplicate_pct'])}%)")
        if f["missing"]["missing"]:
            add("Missing values", "warning", f"{show(f['missing']['missing'])} cells are empty ({show(f['missing']['missing_pct'])}%)")
        for c, b in f["basics"].items():
            if b["non_null"] and b["null_pct"] > 20:
                add("High null column", "danger", f"{show(b['null_pct'])}% empty", c)
        for c, b in f["basics"].items():
            if not b["non_null"]:
                add("All-null column", "danger", "no values at all", c)
        for c in f["mixed"]:
            add("Mixed type column", "warning", "numbers and texts together", c)
        constant = [r["column"] for r in a["constant"]]
        for c in constant:
            add("Zero variance column", "info", "a single value", c)
        for r in a["near_constant"]:
            if r["column"] not in constant:
                add("Low variance column", "info", f"one value holds {show(100 * r['top_share'])}% of rows", r["column"])
        for r in f["numeric"]:
            if r["z_outliers"]:
                add("Outliers detected", "info", f"{show(r['z_outliers'])} values beyond three deviations", r["column"])
        for r in a["monotonic"]:
            add("Monotonic column", "info", f"always {r['direction']}", r["column"])
        for c, g in self.gaps.items():
            if g["gap_anomaly"]:
                add("Date gaps detected", "warning", f"a gap of {show(g['largest_gap_days'])} days against a median of {show(g['median_gap_days'])}", c)
        for r in a["rounding"]:
            add("Suspicious rounding", "info", f"{show(100 * r['round_share'])}% are multiples of ten", r["column"])
        for r in a["benford"]:
            add("Benford Law Anomaly", "warning", f"first digits deviate by {show(r['mad'])} on average", r["column"])
        for r in a["fuzzy"]:
            add("Category Consistency", "warning", f"spellings of one value: {r['values']}", r["column"])
        return small_frame(self.df.sparkSession, out, "ord int, type string, column string, severity string, detail string")

    def insights(self) -> DataFrame:
        """(rank, score, category, text): the best of the candidate statements."""
        self.gather(TOLD_FACTS)
        f, out = self.facts, []
        add = lambda score, category, text: out.append((score, len(out), category, text))
        add(100, "overview", f"{show(f['rows'])} rows by {len(self.types)} columns; quality score {f['score']} of 100.")
        stats = {r["column"]: r for r in f["numeric"]}
        if self.primary in stats:
            s = stats[self.primary]
            add(80, "numeric", f"{self.primary} has a mean of {show(s['mean'])} and runs from {show(s['min'])} to {show(s['max'])}.")
        if f["pairs"]:
            p = f["pairs"][0]
            add(95 if p["abs_r"] > 0.8 else 70, "correlation", f"{p['col_a']} and {p['col_b']} move together with r = {p['r']:.2f} ({p['strength'].lower()}).")
        if f["summary"]:
            s = f["summary"]
            add(60 if s["direction"] == "Flat" else 90, "timeseries", f"{s['direction']}; the peak of {show(s['peak_value'])} is in {s['peak_month']}.")
        if f["leader"]:
            best = min(f["leader"], key=lambda r: r["rank"])
            add(75, "category", f"{best['label']} leads {best['column']} with {show(best['pct_of_total'])}% of {self.primary}.")
        odd = next((r for r in f["numeric"] if r["z_outliers"]), None)
        if odd:
            add(85, "outlier", f"{odd['column']} has {show(odd['z_outliers'])} values far from the rest.")
        if f["duplicates"]["duplicates"]:
            add(92 if f["duplicates"]["duplicate_pct"] > 5 else 40, "quality", f"{show(f['duplicates']['duplicates'])} rows ({show(f['duplicates']['duplicate_pct'])}%) repeat another row.")
        gappy = next((b for b in f["basics"].values() if b["null_pct"] > 10), None)
        if gappy:
            add(93 if gappy["null_pct"] > 25 else 50, "quality", f"{gappy['column']} lacks {show(gappy['null_pct'])}% of its values.")
        best = sorted(out, key=lambda x: (-x[0], x[1]))[:INSIGHTS]
        return small_frame(self.df.sparkSession, [(i + 1, s, c, t) for i, (s, _, c, t) in enumerate(best)], "rank int, score int, category string, text string")

    def stories(self) -> DataFrame:
        """(ord, title, category, severity, text): the state of the data in sentences."""
        self.gather(TOLD_FACTS)
        f, out = self.facts, []
        add = lambda title, category, severity, text: out.append((len(out), title, category, severity, text))
        score = f["score"]
        grade = next((g for least, g in ((90, "Excellent"), (75, "Good"), (50, "Fair")) if score >= least), "Poor")
        kinds = ", ".join(f"{len(self.of(k))} {k}" for k in ("numeric", "categorical", "date"))
        add("Data health", "health", grade.lower(), f"The data score {score} of 100 ({grade}): {show(f['rows'])} rows, {len(self.types)} columns, of which {kinds}.")
        if f["missing"]["missing"]:
            pct = f["missing"]["missing_pct"]
            weight = "enough to bias results" if pct > 10 else "worth a look before drawing conclusions" if pct > 3 else "unlikely to matter"
            add("Missing data", "quality", "error" if pct > 10 else "warning" if pct > 3 else "info", f"{show(f['missing']['missing'])} cells ({show(pct)}%) are empty, {weight}.")
            worst = max(f["basics"].values(), key=lambda b: b["null_pct"])
            if worst["null_pct"] > 5:
                add(f"Column: {worst['column']}", "quality", "warning", f"{worst['column']} is the emptiest: {show(worst['null_count'])} of {show(f['rows'])} cells ({show(worst['null_pct'])}%).")
        else:
            add("No missing data", "quality", "info", "Every cell holds a value.")
        if f["duplicates"]["duplicates"]:
            d = f["duplicates"]
            add("Duplicate rows", "quality", "error" if d["duplicates"] > 0.05 * f["rows"] else "warning", f"{show(d['duplicates'])} rows repeat others ({show(d['duplicate_pct'])}%); they weigh on means and counts.")
        for p in f["pairs"][:3]:
            # Breaks of the words for strength in stories.
            word = next((w for least, w in ((0.8, "very strong"), (0.6, "strong"), (0.4, "moderate")) if p["abs_r"] >= least), "weak")
            add(f"Correlation: r = {p['r']:.2f}", "correlation", "info", f"{p['col_a']} and {p['col_b']} have a {word} {'positive' if p['r'] > 0 else 'negative'} correlation.")
        if f["summary"]:
            s = f["summary"]
            add(f"Trend: {s['direction']}", "timeseries", "info", f"{self.primary} by month of {self.of('date')[0]}: {s['direction'].lower()} over {s['periods']} months, highest in {s['peak_month']} ({show(s['peak_value'])}), lowest in {s['trough_month']} ({show(s['trough_value'])}).")
        odd = [r for r in f["numeric"] if r["z_outliers"] or r["iqr_outliers"]]
        if odd:
            names = ", ".join(r["column"] for r in odd[:4]) + (", ..." if len(odd) > 4 else "")
            add("Outliers detected", "outlier", "warning", f"{show(sum(r['z_outliers'] for r in odd))} values lie beyond three deviations, in {len(odd)} columns with outliers ({names}).")
        if f["leader"]:
            best = min(f["leader"], key=lambda r: r["rank"])
            add("Dominant category", "category", "info", f"In {best['column']}, {best['label']} holds {show(best['pct_of_total'])}% of all {self.primary}.")
        skewed = next((r for r in f["numeric"] if abs(r["skewness"]) > 1), None)
        if skewed:
            add("Skewed distribution", "distribution", "warning", f"{skewed['column']} leans to the {'right' if skewed['skewness'] > 0 else 'left'} (skewness {show(skewed['skewness'])}); its median says more than its mean.")
        return small_frame(self.df.sparkSession, out, "ord int, title string, category string, severity string, text string")

    def ask(self, topic: str) -> list[str]:
        """Lines that answer one of the topics of :data:`TOPICS`."""
        f = self.facts
        if topic == "overview":
            label = "Excellent" if f["score"] >= 80 else "Moderate" if f["score"] >= 50 else "Poor"
            kinds = ", ".join(f"{len(self.of(k))} {k}" for k in ("numeric", "categorical", "date", "text"))
            lines = [f"{self.name}: {show(f['rows'])} rows, {len(self.types)} columns.", f"Types: {kinds}.", f"Quality score: {f['score']} of 100 ({label})."]
            lines += [f"Empty cells: {show(f['missing']['missing'])} ({show(f['missing']['missing_pct'])}%)."] if f["missing"]["missing"] else []
            return lines + ([f"Repeated rows: {show(f['duplicates']['duplicates'])}."] if f["duplicates"]["duplicates"] else [])
        if topic == "key-metrics":
            lines = [f"{r['column']}: mean {show(r['mean'])}, median {show(r['median'])}, {show(r['min'])} to {show(r['max'])}, deviation {show(r['std_dev'])}" for r in f["numeric"]]
            return (lines[:6] + ([f"and {len(lines) - 6} more"] if len(lines) > 6 else [])) or ["There are no numeric columns."]
        if topic == "trends":
            s = f["summary"]
            if not s:
                return ["A date column and a numeric column are needed for trends."]
            lines = [f"{self.primary} by month of {self.of('date')[0]}: {s['direction']} (slope {show(s['slope'])}) over {s['periods']} months.", f"Peak {show(s['peak_value'])} in {s['peak_month']}, trough {show(s['trough_value'])} in {s['trough_month']}."]
            season = self.season
            return lines + ([f"{season['top_month']} is {show(season['excess_pct'])}% above {season['bottom_month']}."] if season else [])
        if topic == "correlations":
            return [f"{p['col_a']} and {p['col_b']}: r = {p['r']:.2f}, {p['strength'].lower()}" for p in f["pairs"][:5]] or ["Two numeric columns are needed for correlations."]
        if topic == "outliers":
            lines = [f"{r['column']}: {show(r['z_outliers'])} by deviation, {show(r['iqr_outliers'])} by quartiles" for r in f["numeric"] if r["z_outliers"] or r["iqr_outliers"]]
            lines += [f"{r['column']}: first digits do not follow Benford's law" for r in self.anomalies["benford"]]
            return lines + [f"{r['column']}: {r['values']}" for r in self.anomalies["fuzzy"][:3]] or ["Nothing unusual was found."]
        if topic == "quality":
            flags = [f"[{r['severity']}] {r['type']}" + (f" in {r['column']}" if r["column"] else "") + f": {r['detail']}" for r in self.flags().orderBy("ord").collect()]
            return [f"Quality score: {f['score']} of 100."] + (flags[:8] + ([f"and {len(flags) - 8} more"] if len(flags) > 8 else []) or ["No issues were found."])
        if topic == "categories":
            tops = self.tops
            lines = [f"{c}: " + ", ".join(f"{r['value']} ({show(r['pct'])}%)" for r in sorted((r for r in tops if r["column"] == c), key=lambda r: r["rank"])[:3]) for c in self.of("categorical")[:CATEGORIES]]
            return lines or ["There are no categorical columns."]
        if topic == "columns":
            lines = [f"{c}: {t}, {show(f['basics'][c]['distinct_count'])} distinct" + (f", {show(f['basics'][c]['null_pct'])}% empty" if f["basics"][c]["null_count"] else "") for c, t in self.types.items()]
            return lines[:12] + ([f"and {len(lines) - 12} more"] if len(lines) > 12 else [])
        raise KeyError(topic)


def ask_all(p: Profile, topics: list[str]) -> dict[str, list[str]]:
    """Answers to topics, each asked once, in the order of the first asking."""
    needs = [ANSWER_NEEDS[t] for t in dict.fromkeys(topics)]
    p.gather(*(tuple(dict.fromkeys(n for need in needs for n in need[i])) for i in range(3)))
    return {t: p.ask(t) for t in dict.fromkeys(topics)}


def charts(p: Profile) -> list[str]:
    """Columns that charts offer: numbers and categories, without serial numbers."""
    return chart_columns(p.of("numeric") + p.of("categorical"))


def kpis(p: Profile) -> DataFrame:
    """(ord, name, value): rows, columns, score, and the trend, or empty cells where there is none."""
    p.gather(("score", "summary"))
    f = p.facts
    last = ("Trend", f["summary"]["direction"]) if f["summary"] else ("Empty cells", show(f["missing"]["missing"]))
    rows = [("Rows", show(f["rows"])), ("Columns", show(len(p.types))), ("Quality score", str(f["score"])), last]
    return small_frame(p.df.sparkSession, [(i, *r) for i, r in enumerate(rows)], "ord int, name string, value string")


def column_details(p: Profile) -> DataFrame:
    """(ord, column, type, detail): what matters of each column by its type."""
    p.gather(("numeric", "basics"), sections=("tops",))
    stats = {r["column"]: r for r in p.facts["numeric"]}
    tops = {r["column"]: r for r in p.tops if r["rank"] == 1}
    out = []
    for i, (c, kind) in enumerate(p.types.items()):
        b = p.facts["basics"][c]
        if c in stats:
            detail = f"{show(stats[c]['min'])} to {show(stats[c]['max'])}, mean {show(stats[c]['mean'])}"
        elif c in tops:
            detail = f"{show(b['distinct_count'])} values, most often {tops[c]['value']} ({show(tops[c]['pct'])}%)"
        else:
            detail = f"{show(b['distinct_count'])} distinct values"
        out.append((i, c, kind, detail + (f", {show(b['null_pct'])}% empty" if b["null_count"] else "")))
    return small_frame(p.df.sparkSession, out, "ord int, column string, type string, detail string")


def executive_summary(p: Profile) -> str:
    """One sentence on size and integrity, whose label breaks at 80 and 50."""
    f = p.facts
    label = "high" if f["score"] >= 80 else "moderate" if f["score"] >= 50 else "low"
    return f"{p.name} holds {show(f['rows'])} rows in {len(p.types)} columns; its integrity is {label} (score {f['score']} of 100, {show(f['missing']['missing'])} empty cells, {show(f['duplicates']['duplicates'])} repeated rows)."


def full_report(p: Profile) -> str:
    """Markdown with the summary, the insights, and tables of the schema, the numbers, the texts and the quality."""
    sections = {
        "Insights": p.insights().select("rank", "text"), "Schema": p.basics.select("column", "null_pct", "distinct_count"), "Columns": column_details(p).select("column", "type", "detail"),
        "Numbers": p.numeric.select("column", *[F.round(c, 2).alias(c) for c in ("mean", "min", "max", "std_dev", "skewness")]) if p.of("numeric") else None,
        "Texts": p.texts, "Quality": p.flags().select("severity", "type", "column", "detail"),
    }
    return report(p.name, {k: v for k, v in sections.items() if v is not None}, [executive_summary(p)])


def overview(catalog, row_id: str | None = None) -> DataFrame | None:
    """Key figures of the newest dataset that is ready, or None without any."""
    names = catalog.names(ready=True)
    return kpis(profile(catalog.load(names[0]), names[0], row_id)) if names else None


def find_topics(text: str) -> list[str]:
    """Topics whose label or keywords hold a text, in any case."""
    t = text.lower()
    return [k for k, (label, words) in TOPICS.items() if t in label.lower() or any(t in w for w in words)]


def profile(df: DataFrame, name: str = "dataset", row_id: str | None = None) -> Profile:
    """Count the cells of all columns, find the types from the counts, and make the profile."""
    body = df.drop(row_id) if row_id else df
    columns = C.scalar_columns(body)
    counts = C.cell_counts(body, columns).persist() if columns else small_frame(df.sparkSession, [], "column string, value string, n long")
    counted = {r["column"]: r.asDict() for r in C.summaries_of_counts(body, columns, counts).orderBy("ordinal").collect()} if columns else {}
    return Profile(df, {c: r["type"] for c, r in counted.items()}, name, row_id, counts, counted)
