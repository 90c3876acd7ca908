"""Canonical retail tables (the six tables of the chain) as Spark schemas.

Employee, invoice, invoice_line and inventory are fragmented by
``branch_code``; product is one replicated dimension.  ``invoice_line`` keeps
the fragment column of its invoice so each fragment holds its own lines.

A column that the chain's tables fill by default says so in its metadata;
``with_defaults`` applies that to rows on their way into a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)      # unit prices
AMOUNT = T.DecimalType(18, 2)     # one line: qty * price
TOTAL = T.DecimalType(28, 2)      # any SUM of amounts

# Defaults (Q-DF), as metadata of their columns.
ACTIVE = {"default": "active"}
NOW = {"default": "now"}
OWN_BRANCH = {"default": "own branch"}

BRANCH = T.StructType([
    T.StructField("branch_code", T.StringType(), False),
    T.StructField("branch_name", T.StringType(), False),
    T.StructField("address", T.StringType(), True),
    T.StructField("is_active", T.BooleanType(), False, ACTIVE),
])

EMPLOYEE = T.StructType([
    T.StructField("employee_id", T.StringType(), False),
    T.StructField("full_name", T.StringType(), False),
    T.StructField("job_title", T.StringType(), False),
    T.StructField("branch_code", T.StringType(), False, OWN_BRANCH),
])

PRODUCT = T.StructType([
    T.StructField("product_code", T.StringType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("unit_price", MONEY, False),
])

INVOICE = T.StructType([
    T.StructField("invoice_id", T.StringType(), False),
    T.StructField("note", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False, NOW),
    T.StructField("branch_code", T.StringType(), False, OWN_BRANCH),
    T.StructField("employee_id", T.StringType(), True),
])

INVENTORY = T.StructType([
    T.StructField("product_code", T.StringType(), False),
    T.StructField("branch_code", T.StringType(), False, OWN_BRANCH),
    T.StructField("qty", T.IntegerType(), False),
])

INVOICE_LINE = T.StructType([
    T.StructField("invoice_id", T.StringType(), False),
    T.StructField("product_code", T.StringType(), False),
    T.StructField("qty", T.IntegerType(), False),
    T.StructField("unit_price", MONEY, False),
    T.StructField("branch_code", T.StringType(), False),
])

INVOICE_SUMMARY = T.StructType([
    T.StructField("invoice_id", T.StringType(), False),
    T.StructField("note", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("branch_code", T.StringType(), False),
    T.StructField("employee_id", T.StringType(), True),
    T.StructField("total", TOTAL, True),
    T.StructField("n_lines", T.LongType(), False),
    T.StructField("units", T.LongType(), False),
])

PRODUCT_DAY_SUMMARY = T.StructType([
    T.StructField("day", T.DateType(), False),
    T.StructField("product_code", T.StringType(), False),
    T.StructField("units", T.LongType(), False),
    T.StructField("amount", TOTAL, False),
    T.StructField("n_lines", T.LongType(), False),
    T.StructField("branch_code", T.StringType(), False),
])

SCHEMAS = {
    "branch": BRANCH,
    "employee": EMPLOYEE,
    "product": PRODUCT,
    "invoice": INVOICE,
    "inventory": INVENTORY,
    "invoice_line": INVOICE_LINE,
}

# Primary keys (reference DDL) and fragment column per table.
PRIMARY_KEYS = {
    "branch": ["branch_code"],
    "employee": ["employee_id"],
    "product": ["product_code"],
    "invoice": ["invoice_id"],
    "inventory": ["product_code", "branch_code"],
    "invoice_line": ["invoice_id", "product_code"],
}
FRAGMENTED = ("employee", "invoice", "inventory", "invoice_line")


def with_defaults(rows: DataFrame, table: str, **given: Column) -> DataFrame:
    """``rows`` as rows of ``table``: a column that is missing or NULL gets its
    default.  ``given`` holds what the defaults are taken from: ``own_branch``,
    the branch that inserts, and ``now`` (the clock when left out)."""
    made = {"active": F.lit(True), "now": given.get("now", F.localtimestamp()), "own branch": given.get("own_branch")}

    def value(f: T.StructField) -> Column:
        default = made.get(f.metadata.get("default"))
        if f.name not in rows.columns:
            return (F.lit(None) if default is None else default).cast(f.dataType).alias(f.name)
        return F.col(f.name) if default is None else F.coalesce(F.col(f.name), default).alias(f.name)
    return rows.select(*[value(f) for f in SCHEMAS[table].fields])


@dataclass(frozen=True)
class Delta:
    """What a change did to a table: rows of ``base`` with a key in
    ``removed`` (its columns are the key, the branch among them) went, and
    ``added`` came.  An updated row is removed and added."""

    base: DataFrame
    added: DataFrame | None = None
    removed: DataFrame | None = None


@dataclass(frozen=True)
class Tables:
    """The chain's state: one DataFrame per canonical table."""

    branch: DataFrame
    employee: DataFrame
    product: DataFrame
    invoice: DataFrame
    inventory: DataFrame
    invoice_line: DataFrame
    # Derived per-invoice totals stored beside the snapshot (see
    # ``store.invoice_summary``); None when absent or out of date.
    invoice_summary: DataFrame | None = None
    product_day_summary: DataFrame | None = None
    # How changed tables came from the ones before, where the change says so:
    # ``Store.commit`` then writes the changed rows instead of whole tables.
    deltas: Mapping[str, Delta] = field(default_factory=dict)
    # Where the lines are a plan: the lines of the invoices in a table of
    # distinct ``invoice_id``, by a plan that filters them first.
    lines_of: Callable[[DataFrame], DataFrame] | None = None

    def names(self) -> list[str]:
        return list(SCHEMAS)

    def get(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_tables(self, **changed: DataFrame) -> "Tables":
        """New state; a change of invoices or lines drops the derived summary,
        so readers fall back to computing totals from the lines."""
        if "invoice" in changed or "invoice_line" in changed:
            changed.setdefault("invoice_summary", None)
            changed.setdefault("product_day_summary", None)
            changed.setdefault("lines_of", None)
        deltas = {n: d for n, d in self.deltas.items() if n not in changed}
        return replace(self, **changed, deltas=deltas)

    def with_deltas(self, **deltas: Delta) -> "Tables":
        """The same state, with what the last change did to some tables."""
        return replace(self, deltas={**self.deltas, **deltas})
