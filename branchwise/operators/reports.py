"""Analytic reports of the chain (R1-R16) and top-k / top-1 reports.

Every report is a lazy DataFrame plan.  Common shape: lines are summed per
invoice first (``invoice_totals``), so joins and groupings downstream see
one row per invoice; week reports filter ``created_at`` on literal bounds
computed from ``as_of`` so the predicate reaches the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from branchwise.functions import exprs as X
from branchwise.operators.views import global_invoice_lines, invoice_totals
from branchwise.sources.schemas import TOTAL, Tables


def _active_branches(t: Tables) -> DataFrame:
    return t.branch.where(F.col("is_active")).select("branch_code")


def _branch_filter(df: DataFrame, branch: str | None) -> DataFrame:
    return df if branch is None else df.where(F.col("branch_code") == F.lit(branch))


def _branch_cond(branch: str | None):
    return None if branch is None else (F.col("branch_code") == F.lit(branch))


def _and(a, b):
    return b if a is None else (a if b is None else a & b)


# ------------------------------------------------------------------ revenue
def revenue_by_branch(t: Tables) -> DataFrame:
    """Revenue of the registered (active) branches, sorted by branch."""
    tot = invoice_totals(t).join(_active_branches(t), "branch_code", "left_semi")
    return (tot.groupBy("branch_code").agg(X.money_sum("total").alias("revenue"))
            .orderBy("branch_code"))


def revenue_by_branch_global(t: Tables) -> DataFrame:
    """R2: revenue per branch over the global view, no branch filter."""
    return invoice_totals(t).groupBy("branch_code").agg(X.money_sum("total").alias("revenue"))


def national_revenue(t: Tables) -> DataFrame:
    """National total, number of branches, leading branch.

    The leader is the highest revenue; on a tie the first in branch order
    wins (the reference keeps the first strictly greater value).
    """
    r = revenue_by_branch(t)
    lead = F.min(F.struct((-F.col("revenue")).alias("neg"), F.col("branch_code").alias("b")))
    return (r.agg(X.money_sum("revenue").alias("national_revenue"),
                  F.count(F.lit(1)).alias("branch_count"),
                  lead.alias("lead"))
            .select("national_revenue", "branch_count",
                    F.col("lead.b").alias("leading_branch"),
                    (-F.col("lead.neg")).cast(TOTAL).alias("leading_revenue")))


def revenue_share(t: Tables) -> DataFrame:
    """Each branch's share of the national revenue.

    The window without partition runs over the per-branch rows only (one
    row per branch of the registry), never over invoice data.
    """
    r = revenue_by_branch_global(t)
    total = F.sum("revenue").over(Window.partitionBy())
    return r.select("branch_code", "revenue",
                    (F.col("revenue").cast("double") / total.cast("double")).alias("share"))


def daily_revenue(t: Tables, branch: str | None = None) -> DataFrame:
    """Distinct orders and revenue by branch and day; day DESC, branch."""
    tot = invoice_totals(t, _branch_cond(branch))
    return (tot.groupBy("branch_code", F.to_date("created_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("order_count"), X.money_sum("total").alias("revenue"))
            .orderBy(F.desc("day"), "branch_code"))


def weekly_revenue(t: Tables, branch: str | None = None) -> DataFrame:
    """The same by branch, year and DATEPART(WEEK) (not ISO)."""
    tot = invoice_totals(t, _branch_cond(branch))
    return (tot.groupBy("branch_code",
                        X.sql_year("created_at").alias("year"),
                        X.sql_week("created_at").alias("week"))
            .agg(F.count(F.lit(1)).alias("order_count"), X.money_sum("total").alias("revenue"))
            .orderBy(F.desc("year"), F.desc("week"), "branch_code"))


def daily_revenue_last7(t: Tables) -> DataFrame:
    """All-branch revenue of the last 7 days that have sales, ascending."""
    d = (invoice_totals(t).groupBy(F.to_date("created_at").alias("day"))
         .agg(X.money_sum("total").alias("revenue")))
    return d.orderBy(F.desc("day")).limit(X.TREND_DAYS).orderBy("day")


def weekly_revenue_last8(t: Tables) -> DataFrame:
    """All-branch revenue per ``YYYY-Www`` label, last 8 labels by text."""
    tot = invoice_totals(t)
    w = (tot.groupBy(X.week_label(X.sql_year("created_at"), X.sql_week("created_at")).alias("week_label"))
         .agg(X.money_sum("total").alias("revenue")))
    return w.orderBy(F.desc("week_label")).limit(X.TREND_WEEKS).orderBy("week_label")


def week_compare(t: Tables, as_of, rolling: bool = False) -> DataFrame:
    """This week's and last week's revenue by branch.

    "Last week" is week-1 of the same year (empty in week 1, quirk Q1);
    ``rolling=True`` uses the true previous seven days instead.
    """
    as_of = X.as_date(as_of)
    this = X.week_bounds(as_of, 0)
    if rolling:
        prev = (this[0] - _dt.timedelta(days=7), this[0])
    else:
        prev = X.week_bounds(as_of, -1)
    is_this = X.in_days("created_at", *this)
    is_prev = X.in_days("created_at", *prev) if prev else F.lit(False)
    tot = invoice_totals(t, is_this | is_prev)
    zero = F.lit(0).cast(TOTAL)
    return (tot.groupBy("branch_code")
            .agg(X.money_sum(F.when(is_this, F.col("total")).otherwise(zero)).alias("this_week"),
                 X.money_sum(F.when(is_prev, F.col("total")).otherwise(zero)).alias("last_week"))
            .orderBy("branch_code"))


# ------------------------------------------------------------------ dashboards
def branch_dashboard_all(t: Tables, branch: str | None = None) -> DataFrame:
    """R10 for every branch: five per-branch aggregates joined to the registry.

    Each aggregate is grouped by branch (partial aggregation map-side), so
    the joins see one row per branch.  Missing values are 0 (ISNULL).
    """
    b = _branch_filter(t.branch, branch).select("branch_code")
    emp = (_branch_filter(t.employee, branch).groupBy("branch_code")
           .agg(F.count(F.lit(1)).alias("employee_count")))
    if t.invoice_summary is not None:
        # Invoice count and revenue in one pass over the stored summary (an
        # invoice without lines counts, its NULL total adds nothing).
        inv = (_branch_filter(t.invoice_summary, branch).groupBy("branch_code")
               .agg(F.count(F.lit(1)).alias("invoice_count"), X.money_sum("total").alias("revenue")))
        rev = None
    else:
        inv = (_branch_filter(t.invoice, branch).groupBy("branch_code")
               .agg(F.count(F.lit(1)).alias("invoice_count")))
        rev = (invoice_totals(t, _branch_cond(branch)).groupBy("branch_code")
               .agg(X.money_sum("total").alias("revenue")))
    stock = (_branch_filter(t.inventory, branch).groupBy("branch_code")
             .agg(X.int_sum("qty").alias("total_stock_units"),
                  X.int_sum(F.when(F.col("qty") < X.LOW_STOCK_BELOW, 1).otherwise(0))
                  .alias("low_stock_products")))
    out = b
    for part in (emp, inv, rev, stock):
        if part is not None:
            out = out.join(part, "branch_code", "left")
    return out.select(
        "branch_code",
        F.coalesce("employee_count", F.lit(0)).cast("bigint").alias("employee_count"),
        F.coalesce("invoice_count", F.lit(0)).cast("bigint").alias("invoice_count"),
        F.coalesce("revenue", F.lit(0).cast(TOTAL)).alias("revenue"),
        F.coalesce("total_stock_units", F.lit(0)).cast("bigint").alias("total_stock_units"),
        F.coalesce("low_stock_products", F.lit(0)).cast("bigint").alias("low_stock_products"))


def branch_dashboard(t: Tables, branch: str) -> DataFrame:
    """R10 for one branch: one row even if the branch has no data."""
    return branch_dashboard_all(t, branch).drop("branch_code")


def branch_revenue_7d(t: Tables, as_of, branch: str | None = None) -> DataFrame:
    """Revenue of each of the last 7 calendar days, zero-filled.

    The day spine is an explode over the (bounded) branch registry; the
    invoice side is filtered to the 7 days at the scan.
    """
    as_of = X.as_date(as_of)
    first = as_of - _dt.timedelta(days=X.TREND_DAYS - 1)
    spine = (_branch_filter(t.branch, branch)
             .select("branch_code",
                     F.explode(F.sequence(F.lit(first), F.lit(as_of))).alias("day")))
    cond = _and(_branch_cond(branch), X.in_days("created_at", first, as_of + _dt.timedelta(days=1)))
    per_day = (invoice_totals(t, cond)
               .groupBy("branch_code", F.to_date("created_at").alias("day"))
               .agg(X.money_sum("total").alias("revenue")))
    return (spine.join(per_day, ["branch_code", "day"], "left")
            .select("branch_code", "day",
                    F.coalesce("revenue", F.lit(0).cast(TOTAL)).alias("revenue"))
            .orderBy("branch_code", "day"))


def branch_revenue_7d_from_totals(t: Tables, as_of, branch: str | None = None) -> DataFrame:
    """The same trend built from invoice-list totals (client form).

    An invoice without lines has a NULL total, counted as 0; invoices
    outside the 7 day keys are dropped.  Must equal R11.
    """
    from branchwise.operators.listings import invoice_list

    as_of = X.as_date(as_of)
    first = as_of - _dt.timedelta(days=X.TREND_DAYS - 1)
    spine = (_branch_filter(t.branch, branch)
             .select("branch_code",
                     F.explode(F.sequence(F.lit(first), F.lit(as_of))).alias("day")))
    days = X.in_days("created_at", first, as_of + _dt.timedelta(days=1))
    if t.invoice_summary is not None:
        lst = _branch_filter(t.invoice_summary.where(days), branch)
    else:
        inv = t.invoice.where(days)
        lines = t.invoice_line.join(inv.select("invoice_id", "branch_code"), ["invoice_id", "branch_code"], "left_semi")
        lst = invoice_list(t.with_tables(invoice=inv, invoice_line=lines), branch)
    per_day = (lst.groupBy("branch_code", F.to_date(X.iso_day("created_at")).alias("day"))
               .agg(X.money_sum(X.to_number("total")).alias("revenue")))
    return (spine.join(per_day, ["branch_code", "day"], "left")
            .select("branch_code", "day",
                    F.coalesce("revenue", F.lit(0).cast(TOTAL)).alias("revenue"))
            .orderBy("branch_code", "day"))


def invoice_count_by_branch(t: Tables) -> DataFrame:
    """Row count of each branch's invoice list."""
    return t.invoice.groupBy("branch_code").agg(F.count(F.lit(1)).alias("row_count"))


def revenue_report_zero_filled(t: Tables) -> DataFrame:
    """R16 (mock report): every branch, revenue 0 when it sold nothing.

    Its ``invoice_count`` counts line rows, not invoices (kept as is).
    """
    per = (invoice_totals(t).groupBy("branch_code")
           .agg(X.money_sum("total").alias("revenue"),
                F.sum("n_lines").alias("invoice_count")))
    return (t.branch.select("branch_code").join(per, "branch_code", "left")
            .select("branch_code",
                    F.coalesce("revenue", F.lit(0).cast(TOTAL)).alias("revenue"),
                    F.coalesce("invoice_count", F.lit(0)).cast("bigint").alias("invoice_count")))


# ------------------------------------------------------------------ top-1 / top-k
def _top1(df: DataFrame, order: list) -> DataFrame:
    """ROW_NUMBER() per branch = 1.  Planned as WindowGroupLimit (partial
    top-1 before the shuffle, so a hot branch never lands whole in one task)."""
    w = Window.partitionBy("branch_code").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def best_employee_week(t: Tables, as_of) -> DataFrame:
    """Best employee per branch in as_of's week.

    Joins on employee id AND branch: an invoice whose employee belongs to
    another branch is dropped.  Revenue is summed per (branch, employee)
    before the join; ties go to the smaller employee id.
    """
    per = (invoice_totals(t, X.in_week("created_at", X.as_date(as_of))).groupBy("branch_code", "employee_id")
           .agg(X.money_sum("total").alias("revenue")))
    emp = t.employee.select("employee_id", "branch_code", "full_name")
    joined = per.join(emp, ["employee_id", "branch_code"])
    return _top1(joined, [F.desc("revenue"), "employee_id"]).select(
        "branch_code", "employee_id", "full_name", "revenue")


def best_product_week(t: Tables, as_of) -> DataFrame:
    """Best-selling product (units) per branch in as_of's week."""
    if t.product_day_summary is not None:
        # One week of the stored per-day product totals (pushed to the scan);
        # a product whose lines were all taken back is not sold.
        b = X.week_bounds(X.as_date(as_of))
        days = t.product_day_summary
        days = days.where((F.col("day") >= F.lit(b[0])) & (F.col("day") < F.lit(b[1]))) if b else days.where(F.lit(False))
        per = (days.groupBy("branch_code", "product_code")
               .agg(X.int_sum("units").alias("units"), F.sum("n_lines").alias("n_lines")).where("n_lines > 0"))
    else:
        inv = t.invoice.where(X.in_week("created_at", X.as_date(as_of)))
        per = (global_invoice_lines(t, inv).groupBy("branch_code", "product_code")
               .agg(X.int_sum("qty").alias("units")))
    joined = per.join(t.product.select("product_code", "product_name"), "product_code")
    return _top1(joined, [F.desc("units"), "product_code"]).select(
        "branch_code", "product_code", "product_name", "units")


def top_stock(t: Tables, n: int | None = X.DEFAULT_TOP_N, branch: str | None = None) -> DataFrame:
    """Top-N stock per branch with product name; N NULL or <= 0 -> 8.

    Order: quantity DESC, product code.  Per-branch top-N is a window
    limit (WindowGroupLimit), so each task keeps at most N rows per branch.
    """
    if n is None or n <= 0:
        n = X.DEFAULT_TOP_N
    inv = _branch_filter(t.inventory, branch).select("branch_code", "product_code", "qty")
    w = Window.partitionBy("branch_code").orderBy(F.desc("qty"), "product_code")
    top = inv.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return (top.join(t.product.select("product_code", "product_name"), "product_code", "left")
            .select("branch_code", "rank", "product_code", "product_name", "qty")
            .orderBy("branch_code", "rank"))


def daily_preview(t: Tables, rows: int = X.PREVIEW_ROWS) -> DataFrame:
    """First ``rows`` rows of the sorted daily report, plus has_more.

    Takes rows+1 with a top-k (TakeOrderedAndProject); the flag is the
    count of those few rows.
    """
    r = daily_revenue(t)
    head = r.orderBy(F.desc("day"), "branch_code").limit(rows + 1)
    w = Window.orderBy(F.desc("day"), "branch_code")
    return (head.withColumn("pos", F.row_number().over(w))
            .withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > rows)
            .where(F.col("pos") <= rows)
            .select("pos", "branch_code", "day", "order_count", "revenue", "has_more"))
