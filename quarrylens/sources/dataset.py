"""Datasets by name: reading by suffix, storing as tables, listing, paging and export."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import order_key
from .delimited import read_delimited
from .numbering import number_rows
from .spreadsheet import read_workbook

SUFFIXES = (".csv", ".xlsx", ".parquet", ".json")
PAGE_ROWS = 10


def read_dataset(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Rows of a file or folder by its suffix.

    Delimited text and workbooks have their row numbers as ``_row_id``; Parquet and JSON
    have them if asked, which counts the rows first.
    """
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return read_delimited(spark, path)
    if low.endswith(".xlsx"):
        return read_workbook(spark, path)
    if low.endswith(".parquet"):
        return number_rows(spark.read.parquet(path)) if numbered else spark.read.parquet(path)
    if low.endswith(".json"):
        return number_rows(spark.read.json(path)) if numbered else spark.read.json(path)
    raise ValueError(f"unsupported file type: {path} (one of {', '.join(SUFFIXES)})")


#: Ranges that a page index is built in at a time, and the rows of a range that is not split further.
RANGES, RANGE_ROWS = 1024, 50_000


@dataclass
class PageIndex:
    """Row counts of ranges of an exact whole-number id, so that a page reads and orders the ranges it lies in and no more.

    Ranges with many rows are split again, by a further count of these ranges alone, until
    none has over ``RANGE_ROWS`` rows or is a single id. The index is a list on the
    driver, a few numbers for each range.
    """

    df: DataFrame
    order: str
    ranges: list[tuple[int, int, int]]  # low, high (both included), rows

    @classmethod
    def build(cls, df: DataFrame, order: str = "_row_id", range_rows: int = RANGE_ROWS) -> PageIndex:
        ids = df.select(order_key(df, order).alias("i"))
        low, high, n = ids.agg(F.min("i"), F.max("i"), F.count("i")).first()
        if not n:
            return cls(df, order, [])
        done, large = [], [(low, high, n)]
        while large:
            done += [r for r in large if r[2] <= range_rows or r[0] == r[1]]
            large = [r for r in large if r[2] > range_rows and r[0] < r[1]]
            if not large:
                break
            # Every large range is cut into equal parts; a row finds its range by the ranges' starts.
            cuts = [(k, lo, hi, -(-(hi - lo + 1) // RANGES)) for k, (lo, hi, _) in enumerate(large)]
            held = df.sparkSession.createDataFrame([(k, lo, hi, min(w, (1 << 63) - 1)) for k, lo, hi, w in cuts], "k int, lo long, hi long, w long")
            inside = ids.join(F.broadcast(held), ids["i"].between(F.col("lo"), F.col("hi")))  # the list above
            part = F.expr("CAST((CAST(i AS DECIMAL(38, 0)) - lo) DIV w AS BIGINT)")
            counts = inside.groupBy("k", part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
            large = [(lo + r["p"] * w, min(hi, lo + (r["p"] + 1) * w - 1), r["n"]) for r in counts for _, lo, hi, w in [cuts[r["k"]]]]
        return cls(df, order, sorted(done))

    @property
    def rows(self) -> int:
        return sum(n for _, _, n in self.ranges)

    def pages(self, rows: int = PAGE_ROWS) -> int:
        return -(-self.rows // rows)

    def page(self, number: int, rows: int = PAGE_ROWS) -> DataFrame:
        """One page of rows in order."""
        first, before, held = (number - 1) * rows, 0, []
        for low, high, n in self.ranges:
            if before + n > first and before < first + rows:
                held.append((before, low, high))
            before += n
        if not held:
            return self.df.limit(0)
        id_ = order_key(self.df, self.order)
        inside = self.df.where(id_.between(F.lit(held[0][1]), F.lit(held[-1][2])))
        return inside.orderBy(self.order).offset(first - held[0][0]).limit(rows)


def page(df: DataFrame, number: int, rows: int = PAGE_ROWS, order: str = "_row_id") -> DataFrame:
    """One page of rows in order; for many pages of a table build one :class:`PageIndex`."""
    return PageIndex.build(df, order).page(number, rows)


def page_count(df: DataFrame, rows: int = PAGE_ROWS) -> int:
    return -(-df.count() // rows)


def page_window(current: int, pages: int, shown: int = 5) -> list[int]:
    """Page numbers around the current one."""
    first = max(1, min(current - shown // 2, pages - shown + 1))
    return list(range(first, min(pages, first + shown - 1) + 1))


UPLOADING, ANALYSING, READY, FAILED, DROPPED, ACTIVE = "uploading", "analysing", "ready", "failed", "dropped", "active"
_ENTRY = "name string, state string, at long, path string, facts map<string,string>"


class Conflict(RuntimeError):
    """Another writer has changed the dataset first."""


def latest_states(log: DataFrame) -> DataFrame:
    """(name, version, state, at, path, facts): the last entry of each name, ties by token; dropped names are left out.

    ``log`` has (name, version, token, state, at, path, facts).
    """
    last = log.groupBy("name").agg(F.max("version").alias("version"), F.max_by(F.struct("state", "at", "path", "facts"), F.struct("version", "token")).alias("last"))
    return last.select("name", "version", "last.*").where(F.col("state") != DROPPED)


def missing_names(here: DataFrame, there: DataFrame) -> DataFrame:
    """Ready entries of ``there`` whose names are not ``here``."""
    return there.where(F.col("state") == READY).join(here.select("name"), "name", "left_anti")


@dataclass
class Catalog:
    """Stored datasets by name, as a log of their states under the warehouse.

    A writer first claims the next version, by a folder ``<version>/<unique token>`` beside
    the log, and lists that version again: if another writer's claim is there too, this one
    is withdrawn and :class:`Conflict` raised. A version that is won is written as an entry
    of its own that nothing overwrites or deletes, so no entry is lost and none is read half
    written. Rows are written once for a version, so readers of older ones are not disturbed.
    """

    spark: SparkSession
    database: str = "default"

    @property
    def root(self) -> str:
        return f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{self.database}.catalog"

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _remove(self, path: str) -> None:
        files, target = self._files(path)
        files.delete(target, True)

    def log(self, name: str | None = None) -> DataFrame:
        """All entries, or those of a name: (name, state, at, path, facts, version, token)."""
        path = f"{self.root}/log" + (f"/key={_key(name)}" if name else "")
        files, target = self._files(path)
        if not files.exists(target):
            return self.spark.createDataFrame([], f"{_ENTRY}, version long, token string")
        schema = f"{_ENTRY}, version long, token string" + ("" if name else ", key string")
        return self.spark.read.schema(schema).json(path).select("name", "state", "at", "path", "facts", "version", "token")

    def _listed(self, path: str) -> list[str]:
        files, target = self._files(path)
        return [x.getPath().getName() for x in files.listStatus(target)] if files.exists(target) else []

    def version(self, name: str) -> int:
        """The last version of a name, 0 if it has none."""
        return max(map(int, self._listed(f"{self.root}/claims/{_key(name)}")), default=0)

    def append(self, name: str, state: str, follows: int | None = None, path: str | None = None, facts: dict[str, str] | None = None) -> int:
        """Add a state that follows a version (the last one, if none is named); returns the new version."""
        last = self.version(name)
        if follows is not None and follows != last:
            raise Conflict(f"{name} is at version {last}, not {follows}")
        version, token = last + 1, uuid.uuid4().hex
        claims = f"{self.root}/claims/{_key(name)}/{version}"
        files, claim = self._files(f"{claims}/{token}")
        files.mkdirs(claim)
        if self._listed(claims) != [token]:
            files.delete(claim, True)
            raise Conflict(f"{name}: another writer claimed version {version}")
        entry = f"{self.root}/log/key={_key(name)}/version={version}/token={token}"
        self.spark.createDataFrame([(name, state, time.time_ns(), path, facts or {})], _ENTRY).coalesce(1).write.json(entry)
        return version

    def save(self, name: str, df: DataFrame, follows: int | None = None, **facts: str) -> int:
        """Store rows: uploading, analysing (rows and columns are counted), ready with the facts; failed if that fails."""
        at = self.append(name, UPLOADING, follows)
        try:
            path = f"{self.root}/data/{_key(name)}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            at = self.append(name, ANALYSING, at, path)
            counts = {"rows": self.spark.read.parquet(path).count(), "columns": len(df.columns)}
            return self.append(name, READY, at, path, {k: str(v) for k, v in {**counts, **facts}.items()})
        except Conflict:
            raise
        except Exception as error:
            self.append(name, FAILED, at, facts={"error": str(error)[:500]})
            raise

    def states(self) -> DataFrame:
        """The last state of each dataset."""
        return latest_states(self.log().where(F.col("state") != ACTIVE))

    def _ready(self, name: str) -> dict:
        found = latest_states(self.log(name).where(F.col("state") == READY)).collect()
        gone = self.states().where(F.col("name") == name).isEmpty()
        if not found or gone:
            raise KeyError(name)
        return found[0].asDict()

    def load(self, name: str) -> DataFrame:
        """Rows of the last version that was ready."""
        return self.spark.read.parquet(self._ready(name)["path"])

    def facts(self, name: str) -> dict[str, str]:
        """What a dataset was stored with."""
        return self._ready(name)["facts"]

    def names(self, ready: bool = False) -> list[str]:
        """Stored datasets, newest first; only those that are ready, if asked."""
        held = self.states().where(F.col("state") == READY) if ready else self.states()
        return [r["name"] for r in held.orderBy(F.desc("at"), "name").select("name").collect()]

    def activate(self, name: str) -> None:
        self.append(name, ACTIVE, path=self._ready(name)["path"])

    def active(self) -> str | None:
        """The dataset that was last made active and is still there; else the newest that is ready."""
        alive = self.states().select("name")
        chosen = self.log().where(F.col("state") == ACTIVE).join(alive, "name", "left_semi").agg(F.max_by("name", "at")).first()[0]
        return chosen or next(iter(self.names(ready=True)), None)

    def drop(self, name: str) -> None:
        """Mark as dropped and delete the rows; dropping what is not there does nothing."""
        if not self.version(name):
            return
        self.append(name, DROPPED)
        for r in self.log(name).where("path IS NOT NULL").select("path").distinct().collect():
            self._remove(r["path"])

    def sync(self, other: Catalog) -> list[str]:
        """Store what is ready in another catalog and has no entry here; returns the names."""
        new = [r["name"] for r in missing_names(self.states(), other.states()).orderBy("name").select("name").collect()]
        for name in new:
            self.save(name, other.load(name), **{k: v for k, v in other.facts(name).items() if k not in ("rows", "columns")})
        return new

    def merge(self, remote: DataFrame, local: DataFrame, key: str = "id") -> DataFrame:
        """Remote entries and the local ones that are not among them."""
        return remote.unionByName(local.join(remote, key, "left_anti"))


def _key(name: str) -> str:
    """A name as a folder of any file system."""
    return name.encode().hex() or "empty"
