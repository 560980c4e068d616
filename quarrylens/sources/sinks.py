"""Export of rows as delimited text and of profiles as reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_lines(df: DataFrame) -> DataFrame:
    """A line for each row: empty for null, quoted where a comma, quote or line break is held."""
    cells = []
    for c in df.columns:
        t = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        cells.append(F.when(t.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write delimited text with a header; one file only where asked, for small results."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")


def cleaned_name(name: str) -> str:
    """The name under which the clean rows of a file are exported."""
    base = re.split(r"[\\/]", name.rstrip("/"))[-1]
    return re.sub(r"\.[^.]*$", "", base) + "-cleaned.csv"


def export_cleaned(df: DataFrame, name: str, folder: str, single_file: bool = False) -> str:
    """Write clean rows, without their row ids, to ``<base>-cleaned.csv`` in a folder; returns the path."""
    path = f"{folder.rstrip('/')}/{cleaned_name(name)}"
    export_csv(df.drop("_row_id"), path, single_file)
    return path


def _table(df: DataFrame, limit: int) -> str:
    rows = [" | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) for r in df.limit(limit).collect()]
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *(f"| {r} |" for r in rows)])


def report(title: str, sections: dict[str, DataFrame], notes: list[str] = (), limit: int = 200) -> str:
    """A Markdown report of small result frames."""
    parts = [f"# {title}", *(f"- {n}" for n in notes)]
    for name, df in sections.items():
        parts += ["", f"## {name}", "", _table(df, limit)]
    return "\n".join(parts) + "\n"
