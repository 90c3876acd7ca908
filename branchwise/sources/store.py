"""Versioned table snapshots in the shared folder.

Parquet has no row-level UPDATE/DELETE, so a change job writes the new
version of every table it touches and then one small manifest naming the
versions (``publish``).  Readers resolve tables through the newest
manifest, so a half-written version is never visible and a failed job can
simply be re-run.  Fragmented tables are written ``partitionBy("branch_code")``:
reading one branch is a partition filter that prunes whole folders.

A table is a list of folders.  A change that says which rows it changed
(``Delta``) adds a folder with its new rows; only branches with changed or
removed rows are written anew, and the others keep the files they have.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from branchwise.session import configure, drop_tables, materialize, shared_dir, table_group
from branchwise.sources import adapter
from branchwise.sources.schemas import (
    FRAGMENTED, INVOICE_SUMMARY, PRODUCT_DAY_SUMMARY, SCHEMAS, TOTAL, Delta, Tables)

MANIFEST_SCHEMA = T.StructType([
    T.StructField("version", T.LongType(), False),
    T.StructField("table", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
])


SUMMARY = "invoice_summary"
PRODUCT_DAYS = "product_day_summary"

#: Every stored table; the order of the rows in the files of some.
STORED = {**SCHEMAS, SUMMARY: INVOICE_SUMMARY, PRODUCT_DAYS: PRODUCT_DAY_SUMMARY}
SORTED = {SUMMARY: ["created_at"], PRODUCT_DAYS: ["day"]}
BY_BRANCH = (*FRAGMENTED, "branch", SUMMARY, PRODUCT_DAYS)


def write_table(df: DataFrame, name: str, path: str) -> None:
    rows = df.select(*[f.name for f in STORED[name].fields])
    if name in BY_BRANCH:
        _together(rows, path, *SORTED.get(name, []))
    else:
        rows.write.parquet(path)


def _together(rows: DataFrame, path: str, *order: str) -> None:
    """Write fragments by branch, sorted by ``order`` inside each file.

    Rebalanced by branch: runtime re-planning splits a large branch by the
    measured size of its rows and puts small ones together, so files have the
    session's advisory size and their number grows with the data.  The sort
    begins with the branch as the partitioned write needs it, so the writer
    does not sort again."""
    rows = rows.hint("rebalance", "branch_code")
    rows.sortWithinPartitions("branch_code", *order).write.partitionBy("branch_code").parquet(path)


def read_table(spark: SparkSession, root: str, name: str, paths: list[str]) -> DataFrame:
    schema = STORED[name]
    # The declared schema also types the partition column (no inference).
    reader = spark.read.schema(schema).option("basePath", f"{root}/{name}")
    return reader.parquet(*paths).select(*[f.name for f in schema.fields])


def latest_manifest(spark: SparkSession, root: str) -> tuple[int, dict[str, list[str]]] | None:
    try:
        m = spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/_manifest/*")
    except AnalysisException:
        return None
    top = m.agg(F.max("version").alias("v")).first()
    if top is None or top.v is None:
        return None
    paths: dict[str, list[str]] = {}
    for r in m.where(F.col("version") == top.v).orderBy("table", "path").collect():  # one row per folder
        paths.setdefault(r.table, []).append(r.path)
    return int(top.v), paths


def read_tables(spark: SparkSession, root: str, paths: dict[str, list[str]]) -> Tables:
    """The tables at these folders, with the summaries that are among them."""
    return Tables(**{n: read_table(spark, root, n, paths[n]) for n in STORED if n in paths})


@dataclass
class Store:
    """A versioned store in the shared folder: ``root`` holds one folder per
    table version and one manifest per store version."""

    spark: SparkSession
    root: str
    version: int
    paths: dict[str, list[str]]
    tables: Tables

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "Store":
        """The newest published version (readers never see a half-written one)."""
        configure(spark)  # days and weeks are cut in UTC (Q12), whoever opens the store
        found = latest_manifest(spark, root)
        if found is None:
            raise FileNotFoundError(f"no published version under {root}")
        version, paths = found
        return cls(spark, root, version, paths, read_tables(spark, root, paths))

    def commit(self, new: Tables, whole: Iterable[str] = ()) -> "Store":
        """Publish ``new`` as the next version.

        Tables that did not change keep their folders.  Of a table whose
        change is known by its rows, only these are written, with the other
        rows of the branches that lost or changed some; other changed tables,
        and those named in ``whole`` (to bring the folders of many commits
        together), are written as a whole.  The summaries follow the same
        rows, or are built anew where invoices or lines were written whole.
        Data first, manifest last: a failure before the manifest leaves the
        previous version current, and a re-run writes fresh folders.
        """
        version, whole = self.version + 1, set(whole)
        paths, deltas, group = dict(self.paths), {}, f"commit-{uuid.uuid4().hex[:8]}"
        for name in SCHEMAS:
            if new.get(name) is self.tables.get(name) and name not in whole:
                continue
            delta = new.deltas.get(name)
            if name in whole or name not in BY_BRANCH or delta is None or delta.base is not self.tables.get(name):
                paths[name] = _write(self.root, version, name, new.get(name))
            else:
                # The rows are read for the table and for both summaries.
                with table_group(group):
                    deltas[name] = Delta(delta.base, *[d if d is None else materialize(d, f"commit: {name}")
                                                       for d in (delta.added, delta.removed)])
                paths[name] = self._changed(version, name, deltas[name])
        sales = {"invoice", "invoice_line"}
        changed = {n for n in sales if new.get(n) is not self.tables.get(n)}
        summaries = {SUMMARY, PRODUCT_DAYS}
        if changed - set(deltas) or whole & summaries or not summaries <= set(self.paths):
            t = read_tables(self.spark, self.root, {n: paths[n] for n in SCHEMAS})
            paths.update(_write_summaries(self.root, version, t))
        elif changed:
            with table_group(group):
                by_row = _summary_deltas(self.tables, deltas)
            for name, delta in zip((SUMMARY, PRODUCT_DAYS), by_row):
                paths[name] = self._changed(version, name, delta)
        drop_tables(self.spark, group)
        _write_manifest(self.spark, self.root, version, paths)
        return Store(self.spark, self.root, version, paths, read_tables(self.spark, self.root, paths))

    def _changed(self, version: int, name: str, delta: Delta) -> list[str]:
        """The folders of a table after a change of some rows."""
        branches = set()
        if delta.removed is not None:
            branches = {r.branch_code for r in delta.removed.select("branch_code").distinct().collect()}  # at most the registry
        parts = [delta.added] if delta.added is not None else []
        kept = self.paths[name]
        if branches:
            old = delta.base.where(F.col("branch_code").isin(*sorted(branches)))
            parts.append(old.join(delta.removed, delta.removed.columns, "left_anti"))
            kept = [f for p in kept for f in _branch_folders(self.spark, p) if _branch_of(f) not in branches]
        if not parts:
            return kept
        return kept + _write(self.root, version, name, reduce(DataFrame.unionByName, parts))


def _branch_folders(spark: SparkSession, path: str) -> list[str]:
    """The folder of each branch in a folder of a table."""
    if _branch_of(path) is not None:
        return [path]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f"{path}/{f.getPath().getName()}" for f in found if f.isDirectory())


def _branch_of(folder: str) -> str | None:
    """The branch of a folder that holds a single one."""
    key, _, value = folder.rsplit("/", 1)[-1].partition("=")
    return unquote(value) if key == "branch_code" else None


def _write(root: str, version: int, name: str, df: DataFrame) -> list[str]:
    path = f"{root}/{name}/v={version}-{uuid.uuid4().hex[:8]}"
    write_table(df, name, path)
    return [path]


def _write_manifest(spark: SparkSession, root: str, version: int, paths: dict[str, list[str]]) -> None:
    rows = [(int(version), n, p) for n in sorted(paths) for p in paths[n]]
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("errorifexists") \
        .json(f"{root}/_manifest/v={version}")


def _write_summaries(root: str, version: int, t: Tables) -> dict[str, list[str]]:
    """Derived tables of a snapshot, partitioned by branch like their sources
    and sorted by date inside each file (tight row-group min/max, so date
    filters skip data):

    * ``invoice_summary``: every invoice with its total, line count, units;
      the revenue reports scan it instead of aggregating lines and joining;
    * ``product_day_summary``: units and amount per (branch, day, product);
      the product reports read one week of it instead of every line.  A
      commit may add further rows of a key: their sums count.
    """
    from branchwise.operators.views import invoice_summary, product_day_summary

    return {name: _write(root, version, name, make(t))
            for name, make in ((SUMMARY, invoice_summary), (PRODUCT_DAYS, product_day_summary))}


def _summary_deltas(t: Tables, deltas: dict[str, Delta]) -> tuple[Delta, Delta]:
    """What changes of invoices and lines do to the summaries, from the rows
    of the change and the old rows of its invoices."""
    from branchwise.functions.exprs import amount

    key = ["invoice_id", "branch_code"]
    heads, lines = deltas.get("invoice", Delta(t.invoice)), deltas.get("invoice_line", Delta(t.invoice_line))

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*key, "product_code", (F.col("qty") * sign).cast("bigint").alias("units"),
                           (amount("qty", "unit_price") * sign).cast(TOTAL).alias("amount"), F.lit(sign).alias("n_lines"))

    came = signed(lines.base.limit(0) if lines.added is None else lines.added, 1)
    went = signed(lines.base.limit(0) if lines.removed is None
                  else lines.base.join(lines.removed, lines.removed.columns, "left_semi"), -1)
    moved = came.unionByName(went)
    touched = reduce(DataFrame.union, [d.select(*key) for d in (heads.added, heads.removed, moved) if d is not None]).distinct()
    old = materialize(t.invoice_summary.join(touched, key, "left_semi"), "commit: old totals")
    own = ["note", "created_at", "employee_id"]
    now = old.select(*key, *own)
    if heads.removed is not None:
        now = now.join(heads.removed, heads.removed.columns, "left_anti")
    if heads.added is not None:
        now = now.unionByName(heads.added.select(*key, *own))
    # Old totals are one more row to sum; an invoice without lines has none.
    sums = (old.select(*key, F.coalesce("total", F.lit(0)).cast(TOTAL).alias("amount"), "n_lines", "units")
            .unionByName(moved.select(*key, "amount", F.col("n_lines").cast("bigint").alias("n_lines"), "units"))
            .groupBy(*key).agg(F.sum("amount").alias("amount"), F.sum("n_lines").alias("n_lines"), F.sum("units").alias("units")))
    rows = now.join(sums, key, "left").select(
        *key, *own, F.when(F.col("n_lines") > 0, F.col("amount")).cast(TOTAL).alias("total"),
        F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce("units", F.lit(0)).cast("bigint").alias("units"))
    summary = Delta(t.invoice_summary, rows, old.select(*key))
    # A line counts on the day of its invoice: the old one where it went.
    day = F.to_date("created_at").alias("day")
    days = went.join(old.select(*key, day), key).unionByName(came.join(now.select(*key, day), key))
    per_day = days.groupBy("branch_code", "day", "product_code").agg(
        F.sum("units").alias("units"), F.sum("amount").cast(TOTAL).alias("amount"), F.sum("n_lines").alias("n_lines"))
    return summary, Delta(t.product_day_summary, per_day)


#: Tables that are built without the sales.
BASE = ("branch", "employee", "product", "inventory")

_STARTED: dict[tuple[str, str], tuple[str, dict[str, list[str]]]] = {}
_SOLD: dict[tuple[str, str], dict[str, list[str]]] = {}
_OPENED: dict[tuple[str, str], Store] = {}


def _start_store(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, list[str]]]:
    """The root of a driver folder's store and the folders of its base
    tables, written once per application."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _STARTED:
        root = f"{shared_dir(spark)}/store/{uuid.uuid4().hex[:12]}"
        lazy = adapter.canonical_tables(spark, sf_dir)
        _STARTED[key] = root, {n: _write(root, 0, n, lazy.get(n)) for n in BASE}
    return _STARTED[key]


def _sell(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, list[str]]]:
    """The root of a driver folder's store and the folders of all canonical
    tables: invoices and lines beside the base, written once per application."""
    root, base = _start_store(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _SOLD:
        def share(df: DataFrame) -> DataFrame:
            path = f"{root}/_staging/{uuid.uuid4().hex[:8]}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        lazy = adapter.canonical_tables(spark, sf_dir, share)
        _SOLD[key] = {**base, **{n: _write(root, 0, n, lazy.get(n)) for n in SCHEMAS if n not in base}}
    return root, _SOLD[key]


def open_store(spark: SparkSession, sf_dir: str) -> Store:
    """The store built from a driver data folder, once per application.

    The adapter output is written into the shared folder (partitioned by
    branch) as version 0 with its summary; later queries scan that snapshot,
    the way the reference's reports scan stored tables.
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _OPENED:
        root, paths = _sell(spark, sf_dir)
        paths = {**paths, **_write_summaries(root, 0, read_tables(spark, root, paths))}
        _write_manifest(spark, root, 0, paths)
        _OPENED[key] = Store.open(spark, root)
    configure(spark)
    return _OPENED[key]


def open_tables(spark: SparkSession, sf_dir: str, materialize: bool = True, sales: bool = True,
                summaries: bool = True, planned_sales: bool = False) -> Tables:
    """Canonical tables for a driver data folder (see ``open_store``);
    ``materialize=False`` returns the adapter's lazy plans instead.  With
    ``sales=False`` invoices, lines and their summaries are absent (None), and
    nothing is read or written for them; with ``summaries=False`` only the
    summaries are.  With ``planned_sales`` the base tables are written, and
    invoices and lines are the adapter's plans: for a change that reads a few
    columns of them, or each of them once."""
    if not materialize:
        return adapter.canonical_tables(spark, sf_dir)
    if not sales or planned_sales:
        root, base = _start_store(spark, sf_dir)
        lazy = adapter.canonical_tables(spark, sf_dir) if sales else None
        return Tables(invoice=lazy and lazy.invoice, invoice_line=lazy and lazy.invoice_line,
                      lines_of=lazy and (lambda ids: adapter.lines_of(spark, sf_dir, ids)),
                      **{n: read_table(spark, root, n, base[n]) for n in BASE})
    if not summaries:
        return read_tables(spark, *_sell(spark, sf_dir))
    return open_store(spark, sf_dir).tables
