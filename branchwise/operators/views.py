"""Global views over the branch fragments.

In the reference each branch is its own database and the global views are
UNION ALL of the fragments.  Here a fragment is the ``branch_code``
partition of one dataset, so the global view is the dataset itself and a
fragment is a partition filter (pruned at the scan).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.functions.exprs import amount
from branchwise.sources.schemas import TOTAL, Tables


def fragment(df: DataFrame, branch_code: str) -> DataFrame:
    """Rows of one branch fragment (CHECK (ChiNhanh = code))."""
    return df.where(F.col("branch_code") == F.lit(branch_code))


def union_fragments(frags: list[DataFrame]) -> DataFrame:
    """UNION ALL of fragments with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frags)


SPREAD = 16


def with_every_branch(df: DataFrame, key: str, branches: DataFrame) -> DataFrame:
    """Each row of ``df`` once per row of ``branches`` (a stock row of a
    product in every branch): an equality join on one of ``SPREAD`` parts.
    A row belongs to the part of its key, every branch is in all parts, so
    neither side is limited or read to the driver."""
    parts = branches.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"))
    rows = df.withColumn("_part", F.pmod(F.hash(F.col(key)), F.lit(SPREAD)))
    return rows.join(parts, "_part").drop("_part")


def national_employees(t: Tables) -> DataFrame:
    """S4 v_NhanVien_ToanQuoc."""
    return t.employee.select("employee_id", "full_name", "job_title", "branch_code")


def national_inventory_raw(t: Tables) -> DataFrame:
    """S6 v_TonKho_ToanQuoc."""
    return t.inventory.select("product_code", "qty", "branch_code")


def global_invoice_lines(t: Tables, invoices: DataFrame | None = None) -> DataFrame:
    """S5 v_HoaDonChiTiet_ToanQuoc: invoice JOIN line inside each fragment.

    ``invoices`` lets a report pass an already filtered invoice side (a
    week, a branch) so the filter reaches the scan before the join.
    """
    inv = (invoices if invoices is not None else t.invoice).select(
        "invoice_id", "created_at", "branch_code", "employee_id")
    lines = t.invoice_line.select("invoice_id", "branch_code", "product_code", "qty", "unit_price")
    return (inv.join(lines, ["invoice_id", "branch_code"])
            .select("invoice_id", "created_at", "branch_code", "employee_id",
                    "product_code", "qty", "unit_price",
                    amount("qty", "unit_price").alias("amount")))


def invoice_summary(t: Tables) -> DataFrame:
    """Every invoice with its total, line count and units (NULL total and 0
    lines for an invoice without lines).  Lines are summed per invoice
    before the join (map-side partial aggregation)."""
    per_invoice = (t.invoice_line
                   .groupBy("invoice_id", "branch_code")
                   .agg(F.sum(amount("qty", "unit_price")).cast(TOTAL).alias("total"),
                        F.count(F.lit(1)).alias("n_lines"),
                        F.sum("qty").alias("units")))
    inv = t.invoice.select("invoice_id", "note", "created_at", "branch_code", "employee_id")
    return (inv.join(per_invoice, ["invoice_id", "branch_code"], "left")
            .select("invoice_id", "note", "created_at", "branch_code", "employee_id", "total",
                    F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
                    F.coalesce("units", F.lit(0)).cast("bigint").alias("units")))


def invoice_totals(t: Tables, cond: Column | None = None) -> DataFrame:
    """One row per invoice that has lines (optionally filtered by ``cond`` on
    invoice columns): total, line count, units.

    Reads the stored summary when the snapshot has one (a single scan, no
    join); otherwise sums lines per invoice before joining the headers, so
    every later join and grouping sees one row per invoice and COUNT
    (DISTINCT invoice) becomes a plain count.  Exact: amounts are decimals.
    """
    cols = ["invoice_id", "branch_code", "created_at", "employee_id", "total", "n_lines", "units"]
    if t.invoice_summary is not None:
        s = t.invoice_summary
        if cond is not None:
            s = s.where(cond)
        return s.where(F.col("n_lines") > 0).select(*cols)
    per_invoice = (t.invoice_line
                   .groupBy("invoice_id", "branch_code")
                   .agg(F.sum(amount("qty", "unit_price")).cast(TOTAL).alias("total"),
                        F.count(F.lit(1)).alias("n_lines"),
                        F.sum("qty").cast("bigint").alias("units")))
    inv = t.invoice if cond is None else t.invoice.where(cond)
    inv = inv.select("invoice_id", "branch_code", "created_at", "employee_id")
    return inv.join(per_invoice, ["invoice_id", "branch_code"]).select(*cols)


def product_day_summary(t: Tables) -> DataFrame:
    """Units, amount and line count per (branch, day, product): the lines
    rolled up to the grain of the product reports (partial aggregation
    before the shuffle)."""
    inv = t.invoice.select("invoice_id", "branch_code", F.to_date("created_at").alias("day"))
    lines = t.invoice_line.select("invoice_id", "branch_code", "product_code", "qty", "unit_price")
    return (lines.join(inv, ["invoice_id", "branch_code"])
            .groupBy("branch_code", "day", "product_code")
            .agg(F.sum("qty").cast("bigint").alias("units"),
                 F.sum(amount("qty", "unit_price")).cast(TOTAL).alias("amount"),
                 F.count(F.lit(1)).alias("n_lines")))
