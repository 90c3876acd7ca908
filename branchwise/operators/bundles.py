"""Report bundles (R13, R14) and scalar-expression reports.

The reference's service runs several reports concurrently and returns them
as one answer.  Here a bundle is a dict of lazy DataFrames over the same
stored canonical tables (each part is an independent plan, so a caller can
run them concurrently); ``*_long`` puts the parts into one tagged
long-format table (``report`` column) for a single result set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchwise.functions import exprs as X
from branchwise.operators import reports as R
from branchwise.operators.views import invoice_totals
from branchwise.sources.schemas import MONEY, TOTAL, Tables

LONG_COLUMNS = ["report", "branch_code", "item_key", "item_label", "count_value", "amount", "amount2", "position"]


def _long(df: DataFrame, report: str, key=None, label=None, count=None, amount=None, amount2=None,
          pos=None) -> DataFrame:
    def col(x, typ):
        if x is None:
            return F.lit(None).cast(typ)
        return (F.col(x) if isinstance(x, str) else x).cast(typ)
    return df.select(F.lit(report).alias("report"), col("branch_code", "string").alias("branch_code"),
                     col(key, "string").alias("item_key"), col(label, "string").alias("item_label"),
                     col(count, "bigint").alias("count_value"), col(amount, TOTAL).alias("amount"),
                     col(amount2, TOTAL).alias("amount2"), col(pos, "int").alias("position"))


def _zero(x: str):
    """DTO mapping: NULL numbers become 0."""
    return F.coalesce(F.col(x), F.lit(0))


def analytics_overview(t: Tables, as_of) -> dict[str, DataFrame]:
    """Daily, weekly, best employee, best product, week comparison."""
    return {
        "daily": R.daily_revenue(t),
        "weekly": R.weekly_revenue(t),
        "best_employee": R.best_employee_week(t, as_of),
        "best_product": R.best_product_week(t, as_of),
        "week_compare": R.week_compare(t, as_of),
    }


def _revenue_sets(t: Tables, as_of) -> DataFrame:
    """Daily, weekly and week-compare rows of R13 from one scan of the totals.

    The totals are summed per branch and day first; the grouping sets then run
    over those rows, of which there is one per branch and day whatever the
    number of invoices.
    """
    as_of = X.as_date(as_of)
    zero = F.lit(0).cast(TOTAL)

    def in_week(offset: int):
        b = X.week_bounds(as_of, offset)
        return (F.col("day") >= F.lit(b[0])) & (F.col("day") < F.lit(b[1])) if b else F.lit(False)

    days = (invoice_totals(t).groupBy("branch_code", F.to_date("created_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("orders"), X.money_sum("total").alias("revenue"))
            .select("branch_code", "day", X.sql_year("day").alias("year"), X.sql_week("day").alias("week"),
                    (in_week(0) | in_week(-1)).alias("compared"), "orders", "revenue",
                    F.when(in_week(0), F.col("revenue")).otherwise(zero).alias("this_week"),
                    F.when(in_week(-1), F.col("revenue")).otherwise(zero).alias("last_week")))
    sets = [["branch_code", "day"], ["branch_code", "year", "week"], ["branch_code", "compared"]]
    rows = days.groupingSets(sets, "branch_code", "day", "year", "week", "compared").agg(
        F.grouping("day").alias("no_day"), F.grouping("week").alias("no_week"),
        X.int_sum("orders").alias("orders"), X.money_sum("revenue").alias("revenue"),
        X.money_sum("this_week").alias("this_week"), X.money_sum("last_week").alias("last_week"))
    daily, weekly = F.col("no_day") == 0, F.col("no_week") == 0
    revenue = daily | weekly
    return rows.where(revenue | F.col("compared")).select(
        F.when(daily, "daily").when(weekly, "weekly").otherwise("week_compare").alias("report"), "branch_code",
        F.when(daily, X.iso_day("day")).when(weekly, X.week_label("year", "week")).alias("item_key"),
        F.lit(None).cast("string").alias("item_label"),
        F.when(revenue, _zero("orders")).cast("bigint").alias("count_value"),
        F.when(revenue, _zero("revenue")).otherwise(_zero("this_week")).cast(TOTAL).alias("amount"),
        F.when(~revenue, _zero("last_week")).cast(TOTAL).alias("amount2"),
        F.lit(None).cast("int").alias("position"))


def analytics_overview_long(t: Tables, as_of) -> DataFrame:
    parts = [
        _revenue_sets(t, as_of),
        _long(R.best_employee_week(t, as_of), "best_employee", key="employee_id", label="full_name", amount=_zero("revenue")),
        _long(R.best_product_week(t, as_of), "best_product", key="product_code", label="product_name", count=_zero("units")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def branch_dashboard_bundle(t: Tables, branch: str, as_of, top_n: int = X.DEFAULT_TOP_N) -> dict[str, DataFrame]:
    """Dashboard numbers, 7-day zero-filled trend, top-N stock of a branch."""
    return {
        "summary": R.branch_dashboard_all(t, branch),
        "trend": R.branch_revenue_7d(t, as_of, branch),
        "top_stock": R.top_stock(t, top_n, branch),
    }


def branch_dashboard_bundle_long(t: Tables, branch: str, as_of, top_n: int = X.DEFAULT_TOP_N) -> DataFrame:
    b = branch_dashboard_bundle(t, branch, as_of, top_n)
    s = b["summary"]
    summary = s.select("branch_code", F.explode(F.array(
        F.struct(F.lit("employees").alias("k"), F.col("employee_count").alias("v")),
        F.struct(F.lit("invoices").alias("k"), F.col("invoice_count").alias("v")),
        F.struct(F.lit("stock_units").alias("k"), F.col("total_stock_units").alias("v")),
        F.struct(F.lit("low_stock_products").alias("k"), F.col("low_stock_products").alias("v")),
    )).alias("kv"), "revenue")
    parts = [
        _long(summary, "summary", key="kv.k", count="kv.v"),
        _long(s, "summary", key=F.lit("revenue"), amount="revenue"),
        _long(b["trend"], "trend", key=X.iso_day("day"), label=X.short_day("day"), amount="revenue"),
        _long(b["top_stock"], "top_stock", key="product_code", label="product_name", count="qty", pos="rank"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ scalar reports
def scalar_dates(orders: DataFrame, as_of) -> DataFrame:
    """Calendar expressions on every order date."""
    d = F.col("o_orderdate")
    as_of = X.as_date(as_of)
    return orders.select(
        "o_orderkey",
        X.sql_year(d).alias("year"), X.sql_week(d).alias("week"),
        X.week_label(X.sql_year(d), X.sql_week(d)).alias("week_label"),
        X.iso_day(d).alias("iso_day"), X.short_day(d).alias("short_day"),
        X.display_time(d).alias("display_time"),
        F.datediff(F.lit(as_of), F.to_date(d)).alias("days_before_as_of"))


def scalar_text(customers: DataFrame, branch_codes: DataFrame, default_branch: str) -> DataFrame:
    """Text rules: trim, blank test, patch, branch normalisation."""
    k = F.col("c_custkey")
    seg = F.when(k % 4 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    asked = F.when(k % 5 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit(" "), F.lower("r_name"), F.lit(" ")))
    reg = branch_codes.select(F.col("branch_code").alias("_norm"), F.lit(True).alias("_known"))
    c = customers.select("*", X.normalise_branch(asked).alias("_norm"), seg.alias("_seg"))
    c = c.join(reg, "_norm", "left")
    return c.select(
        "c_custkey",
        X.clean(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias("name_clean"),
        X.is_blank("_seg").alias("segment_blank"),
        X.patch_text("_seg", "c_name").alias("patched"),
        F.when(F.col("_known"), F.col("_norm")).alias("branch_or_null"),
        F.coalesce(F.when(F.col("_known"), F.col("_norm")), F.lit(default_branch)).alias("source_branch"))


def scalar_numeric(lines: DataFrame) -> DataFrame:
    """Money rules: decimal amount, price resolution, JS-style numbers."""
    k = F.col("l_partkey")
    qty = F.col("l_quantity").cast("int")
    cat = F.col("p_retailprice").cast(MONEY)
    given = F.when(k % 3 == 0, F.lit(0).cast(MONEY)).when(k % 3 == 1, F.lit(None).cast(MONEY)) \
        .otherwise((cat - F.lit(1)).cast(MONEY))
    text = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit("")) \
        .when(k % 4 == 2, F.lit("abc")).otherwise(qty.cast("string"))
    return lines.select(
        "l_orderkey", "l_partkey",
        X.amount(qty, cat).alias("amount"),
        X.resolve_price(given, cat).alias("resolved_price"),
        X.to_number(text).alias("number_value"))
