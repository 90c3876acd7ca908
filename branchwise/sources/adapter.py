"""Driver tables (TPC-H-like) -> the chain's canonical tables.

Rules (one per canonical table):

* branch     = region (``branch_code = r_name``)
* employee   = supplier; branch = the supplier nation's region
* product    = part; ``unit_price = CAST(p_retailprice AS DECIMAL(10,2))``
* invoice    = orders; branch = the customer nation's region; the seller
  (``employee_id``) is the smallest supplier key among the order's lines,
  NULL for an order without lines
* invoice_line = lineitem grouped by (order, part): the reference key is
  (invoice, product), so quantities of repeated pairs are added
* inventory  = one row per (part, branch) with
  ``qty = (p_partkey * 7 + r_regionkey * 13) % 240``

Every join is an equi-join and carries no broadcast hint: the planner
broadcasts a side only when its measured size (file statistics, then AQE's
runtime statistics) is below the broadcast threshold, so region and nation
are broadcast and the tables that grow with the data are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.sources.schemas import MONEY, Tables, with_defaults


_READS: dict[tuple[str, str, str], DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table as a DataFrame; the (lazy) relation is reused per session."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _READS:
        _READS[key] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return _READS[key]


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> branch code; 25 rows at every scale factor."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select("n_nationkey", F.col("r_name").alias("branch_code")))


def branch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region")
    return with_defaults(region.select(
        F.col("r_name").alias("branch_code"),
        F.initcap("r_name").alias("branch_name"),
    ), "branch")


def employee_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    geo = _geo(spark, sf_dir)
    return (supplier.join(geo, supplier.s_nationkey == geo.n_nationkey)
            .select(
                F.col("s_suppkey").cast("string").alias("employee_id"),
                F.col("s_name").alias("full_name"),
                F.when(F.col("s_suppkey") % 10 == 1, F.lit("Manager"))
                 .otherwise(F.lit("Cashier")).alias("job_title"),
                "branch_code"))


def product_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("product_code"),
        F.col("p_name").alias("product_name"),
        F.col("p_retailprice").cast(MONEY).alias("unit_price"))


def _line_pairs(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """lineitem summed per (order, part), with partial aggregation map-side.

    Grouped on both keys, so one huge order is spread over many tasks.
    ``ids``: only of the orders with these ``invoice_id``.
    """
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    if ids is not None:
        li = li.join(ids, li.l_orderkey.cast("string") == ids.invoice_id, "left_semi")
    return (li.groupBy("l_orderkey", "l_partkey")
            .agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("qty"),
                 F.min("l_suppkey").alias("seller")))


def _order_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    geo = _geo(spark, sf_dir)
    cust = (customer.join(geo, customer.c_nationkey == geo.n_nationkey)
            .select("c_custkey", "branch_code"))
    return orders.join(cust, orders.o_custkey == cust.c_custkey).drop("o_custkey", "c_custkey")


def invoice_table(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None,
                  ob: DataFrame | None = None) -> DataFrame:
    ob = ob if ob is not None else _order_branch(spark, sf_dir)
    pairs = pairs if pairs is not None else _line_pairs(spark, sf_dir)
    seller = (pairs.groupBy("l_orderkey")
              .agg(F.min("seller").alias("seller")))
    return (ob.join(seller, ob.o_orderkey == seller.l_orderkey, "left")
            .select(
                F.col("o_orderkey").cast("string").alias("invoice_id"),
                F.col("o_orderpriority").alias("note"),
                F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
                "branch_code",
                F.col("seller").cast("string").alias("employee_id")))


def invoice_line_table(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None,
                       ob: DataFrame | None = None) -> DataFrame:
    pairs = pairs if pairs is not None else _line_pairs(spark, sf_dir)
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    ob = (ob if ob is not None else _order_branch(spark, sf_dir)).select("o_orderkey", "branch_code")
    return (pairs.join(ob, pairs.l_orderkey == ob.o_orderkey)
            .join(part, pairs.l_partkey == part.p_partkey)
            .select(
                F.col("l_orderkey").cast("string").alias("invoice_id"),
                F.col("l_partkey").cast("string").alias("product_code"),
                "qty",
                F.col("p_retailprice").cast(MONEY).alias("unit_price"),
                "branch_code"))


def lines_of(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """The rows of ``invoice_line_table`` of the invoices ``ids`` (distinct
    ``invoice_id``): order lines are filtered before they are grouped."""
    return invoice_line_table(spark, sf_dir, _line_pairs(spark, sf_dir, ids))


def stock_rule(partkey, regionkey):
    return ((partkey * 7 + regionkey * 13) % 240).cast("int")


def inventory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stock row per (product, branch)."""
    from branchwise.operators.views import with_every_branch

    regions = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    grid = with_every_branch(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", regions)
    return grid.select(
        F.col("p_partkey").cast("string").alias("product_code"),
        F.col("r_name").alias("branch_code"),
        stock_rule(F.col("p_partkey"), F.col("r_regionkey")).alias("qty"))


def raw_invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source line rows keyed like invoice lines, before merging repeats."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return li.select(F.col("l_orderkey").cast("string").alias("invoice_id"),
                     F.col("l_partkey").cast("string").alias("product_code"))


def canonical_tables(spark: SparkSession, sf_dir: str, share=None) -> Tables:
    """Canonical tables as lazy plans.

    ``share`` (optional) materialises a DataFrame once and returns its
    stored form; it is applied to the two pieces both the invoice and the
    line table need (the merged line pairs and the order-to-branch map), so
    the big lineitem aggregation runs once, not once per table.
    """
    pairs, ob = _line_pairs(spark, sf_dir), _order_branch(spark, sf_dir)
    if share is not None:
        pairs, ob = share(pairs), share(ob)
    return Tables(
        branch=branch_table(spark, sf_dir),
        employee=employee_table(spark, sf_dir),
        product=product_table(spark, sf_dir),
        invoice=invoice_table(spark, sf_dir, pairs, ob),
        inventory=inventory_table(spark, sf_dir),
        invoice_line=invoice_line_table(spark, sf_dir, pairs, ob),
    )
