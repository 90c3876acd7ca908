"""Registry of runnable queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the driver tables of ``sf_dir`` (through the canonical
store) and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.operators import bundles as B
from branchwise.operators import listings as L
from branchwise.operators import quality as Q
from branchwise.operators import reports as R
from branchwise.operators import views as V
from branchwise.plans import requests as RQ
from branchwise.plans.params import AS_OF, AS_OF_WEEK1, BRANCH, TOP_N
from branchwise.session import configure
from branchwise.sources.schemas import Tables
from branchwise.sources.adapter import raw_invoice_lines, read
from branchwise.sources.store import open_tables

QueryFn = Callable[[SparkSession, str], DataFrame]

# name -> fn(tables) for queries that need only the canonical tables.
_ON_TABLES: dict[str, Callable[[Tables], DataFrame]] = {
    # scans, sources, sinks
    "scan_invoice_lines": L.scan_invoice_lines,
    "fragment_roundtrip": L.fragment_roundtrip,
    "global_invoice_lines": V.global_invoice_lines,
    "national_inventory_raw": V.national_inventory_raw,
    "parse_invoice_items": L.parse_invoice_items,
    "parse_text_items": lambda t: L.parse_invoice_items(t, F.col("invoice_id").cast("bigint") % 2 == 1),
    "invoice_list_no_employee": L.invoice_list_no_employee,
    "employees_by_branch": lambda t: L.employees_by_branch(t, BRANCH),
    "report_json_export": lambda t: _json_roundtrip(R.daily_revenue(t)),
    # listings
    "product_list": L.product_list,
    "national_employees": L.national_employees,
    "inventory_by_branch": lambda t: L.inventory_by_branch(t, BRANCH),
    "national_inventory": L.national_inventory,
    "inventory_enriched": L.inventory_enriched,
    "invoice_list": L.invoice_list,
    "invoice_details": L.invoice_details,
    "invoice_documents": L.invoice_documents,
    "invoice_document_items": L.invoice_document_items,
    # reports
    "revenue_by_branch": R.revenue_by_branch,
    "revenue_by_branch_global": R.revenue_by_branch_global,
    "national_revenue": R.national_revenue,
    "revenue_share": R.revenue_share,
    "daily_revenue": R.daily_revenue,
    "weekly_revenue": R.weekly_revenue,
    "daily_revenue_last7": R.daily_revenue_last7,
    "weekly_revenue_last8": R.weekly_revenue_last8,
    "week_compare": lambda t: R.week_compare(t, AS_OF),
    "week_compare_week1": lambda t: R.week_compare(t, AS_OF_WEEK1),
    "branch_dashboard": lambda t: R.branch_dashboard(t, BRANCH),
    "branch_dashboard_all": R.branch_dashboard_all,
    "branch_revenue_7d": lambda t: R.branch_revenue_7d(t, AS_OF),
    "branch_revenue_7d_from_totals": lambda t: R.branch_revenue_7d_from_totals(t, AS_OF),
    "invoice_count_by_branch": R.invoice_count_by_branch,
    "revenue_report_zero_filled": R.revenue_report_zero_filled,
    "best_employee_week": lambda t: R.best_employee_week(t, AS_OF),
    "best_product_week": lambda t: R.best_product_week(t, AS_OF),
    "top_stock": lambda t: R.top_stock(t, TOP_N),
    "top_stock_default_n": lambda t: R.top_stock(t, None),
    "daily_preview": R.daily_preview,
    "analytics_overview": lambda t: B.analytics_overview_long(t, AS_OF),
    "branch_dashboard_bundle": lambda t: B.branch_dashboard_bundle_long(t, BRANCH, AS_OF),
    # data quality
    "dq_orphans": Q.orphans,
    "dq_check_violations": Q.check_violations,
    "dq_null_counts": Q.null_counts,
    "dq_fragment_membership": Q.fragment_membership,
}

# name -> fn(spark, sf_dir, tables) for queries that also read source rows.
_ON_SOURCE: dict[str, Callable[[SparkSession, str, Tables], DataFrame]] = {
    "dq_duplicate_keys": lambda s, d, t: Q.duplicate_keys(
        t, {"invoice_line_raw": (raw_invoice_lines(s, d), ["invoice_id", "product_code"])}),
    "parse_event_props": lambda s, d, t: L.parse_event_props(read(s, d, "events")),
    "product_lookup": lambda s, d, t: L.product_lookup(t, RQ.product_lookups(s, d)),
    "inventory_lookup_default": lambda s, d, t: L.inventory_lookup(t, RQ.inventory_lookups(s, d)),
    "scalar_dates": lambda s, d, t: B.scalar_dates(read(s, d, "orders"), AS_OF),
    "scalar_text": lambda s, d, t: B.scalar_text(_customer_regions(s, d), t.branch.where("is_active"), BRANCH),
    "scalar_numeric": lambda s, d, t: B.scalar_numeric(
        read(s, d, "lineitem").join(read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))),
}


# Queries that read no sales: the store builds neither invoices nor lines for them.
_WITHOUT_SALES = {
    "product_list", "national_employees", "employees_by_branch", "inventory_by_branch", "national_inventory",
    "national_inventory_raw", "inventory_enriched", "top_stock", "top_stock_default_n", "product_lookup",
    "inventory_lookup_default", "parse_event_props", "scalar_dates", "scalar_text", "scalar_numeric",
}


# Queries over invoices and lines that read no summary of them.
_WITHOUT_SUMMARIES = {
    "scan_invoice_lines", "fragment_roundtrip", "global_invoice_lines", "parse_invoice_items", "parse_text_items",
    "invoice_details", "invoice_document_items", "dq_duplicate_keys", "dq_orphans", "dq_check_violations", "dq_null_counts",
    "dq_fragment_membership",
}


def _customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey)
    return c.join(geo, c.c_nationkey == geo.n_nationkey)


def _json_roundtrip(df: DataFrame) -> DataFrame:
    """Rows -> JSON documents -> rows (compared on contents)."""
    from pyspark.sql import functions as F

    docs = L.report_json_export(df)
    back = docs.select(F.from_json("json", df.schema).alias("r")).select("r.*")
    return back


def _wrap(name: str, fn: Callable[..., DataFrame], source: bool) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        t = open_tables(spark, sf_dir, sales=name not in _WITHOUT_SALES, summaries=name not in _WITHOUT_SUMMARIES)
        return fn(spark, sf_dir, t) if source else fn(t)
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {name: _wrap(name, fn, False) for name, fn in _ON_TABLES.items()}
    out.update({name: _wrap(name, fn, True) for name, fn in _ON_SOURCE.items()})
    from branchwise.plans import changesets
    out.update(changesets.queries())
    return out
