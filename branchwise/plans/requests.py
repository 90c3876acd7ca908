"""Change requests derived from the driver tables.

Every row of the source table becomes a request (no row is filtered out);
simple arithmetic rules on the row's key choose the request's content, so
that every guard of the operators is exercised: blank fields, unknown and
repeated keys, bad quantities, wrong branches.  The oracle SQL states the
same rules (``changesets.ORACLE``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.operators import ordered
from branchwise.operators.views import with_every_branch
from branchwise.session import materialize
from branchwise.sources.adapter import read
from branchwise.sources.schemas import MONEY


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(region, nation.n_regionkey == region.r_regionkey) \
        .select("n_nationkey", "r_regionkey", "r_name")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return s.join(_geo(spark, sf_dir), s.s_nationkey == F.col("n_nationkey"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select("r_regionkey", "r_name")


def _s(x) -> F.Column:
    return x.cast("string")


def employee_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _suppliers(spark, sf_dir).select(
        k.alias("seq"),
        F.when(k % 23 == 0, F.lit("CENTRAL"))
         .when(k % 4 == 1, F.concat(F.lit("  "), F.lower("r_name"))).otherwise(F.col("r_name"))
         .alias("branch_code"),
        F.when(k % 2 == 0, F.concat(F.lit("E"), _s(F.expr("s_suppkey div 4")))).otherwise(_s(k))
         .alias("employee_id"),
        F.col("s_name").alias("full_name"),
        F.when(k % 7 == 0, F.lit(" ")).otherwise(F.lit("Cashier")).alias("job_title"))


def employee_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = _suppliers(spark, sf_dir).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    i = F.col("i")
    return s.select(
        (k * 2 + i).alias("seq"),
        F.when(k % 11 == 0, F.lit("NOWHERE")).otherwise(F.col("r_name")).alias("branch_code"),
        F.when(k % 9 == 0, F.concat(F.lit("X"), _s(k))).otherwise(_s(k)).alias("employee_id"),
        F.when(i == 0, F.concat("s_name", F.lit(" X")))
         .when(k % 3 == 0, F.lit("  ")).otherwise(F.concat("s_name", F.lit(" Y"))).alias("full_name"),
        F.when((i == 1) & (k % 2 == 0), F.lit("Senior")).alias("job_title"))


def employee_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    reps = F.sequence(F.lit(0), F.when(k % 5 == 0, F.lit(1)).otherwise(F.lit(0)))
    s = _suppliers(spark, sf_dir).select("*", F.explode(reps).alias("i"))
    return s.select(
        (k * 2 + F.col("i")).alias("seq"),
        F.col("r_name").alias("branch_code"),
        F.when(k % 7 == 3, F.concat(F.lit("X"), _s(k))).otherwise(_s(k)).alias("employee_id"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")


def product_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _parts(spark, sf_dir).select(
        k.alias("seq"),
        F.when(k % 3 == 1, _s(k)).otherwise(F.concat(F.lit("N"), _s(F.expr("p_partkey div 3"))))
         .alias("product_code"),
        F.when(k % 13 == 0, F.lit("")).otherwise(F.col("p_name")).alias("product_name"),
        F.when(k % 5 == 0, F.lit(0).cast(MONEY)).when(k % 17 == 0, F.lit(None).cast(MONEY))
         .otherwise(F.col("p_retailprice").cast(MONEY)).alias("unit_price"))


def product_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _parts(spark, sf_dir).select(
        k.alias("seq"),
        F.when(k % 17 == 0, F.concat(F.lit("U"), _s(k))).otherwise(_s(k)).alias("product_code"),
        F.when(k % 2 == 0, F.lit("  ")).otherwise(F.concat("p_name", F.lit(" v2"))).alias("product_name"),
        F.when(k % 3 == 0, F.lit(None).cast(MONEY)).when(k % 7 == 0, F.lit(-1).cast(MONEY))
         .otherwise((F.col("p_retailprice").cast(MONEY) + F.lit(1.5).cast(MONEY)).cast(MONEY))
         .alias("unit_price"))


def product_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _parts(spark, sf_dir).select(
        k.alias("seq"),
        F.when(k % 13 == 0, F.concat(F.lit("U"), _s(k))).otherwise(_s(k)).alias("product_code"))


def _grid(spark: SparkSession, sf_dir: str, repeat=None) -> DataFrame:
    """part x region, each stock row once (``i`` = 0) plus once more (1)
    where ``repeat`` holds, numbered by part, region and ``i``."""
    grid = with_every_branch(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", _regions(spark, sf_dir))
    last = F.lit(0) if repeat is None else F.when(repeat, F.lit(1)).otherwise(F.lit(0))
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    return grid if repeat is None else ordered.numbered(grid, ["p_partkey", "r_regionkey", "i"])


def stock_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests per stock row (set and receive use the same rows)."""
    k, i = F.col("p_partkey"), F.col("i")
    return _grid(spark, sf_dir, F.lit(True)).select(
        "seq",
        F.when((k % 31 == 0) & (i == 1), F.lit("NOWHERE")).otherwise(F.col("r_name")).alias("branch_code"),
        F.when(k % 29 == 0, F.concat(F.lit("U"), _s(k))).when(k % 37 == 0, F.lit(" "))
         .otherwise(_s(k)).alias("product_code"),
        ((k + i * 7) % 50 - 5).cast("int").alias("qty"))


def stock_row_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delete per stock row (odd parts ask for unknown codes); parts
    divisible by 6 ask twice (the repeat is refused)."""
    k = F.col("p_partkey")
    return _grid(spark, sf_dir, k % 6 == 0).select(
        "seq",
        F.col("r_name").alias("branch_code"),
        F.when(k % 2 == 1, F.concat(F.lit("U"), _s(k))).otherwise(_s(k)).alias("product_code"),
        F.lit(None).cast("int").alias("qty"))


def stock_row_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One create per stock row; odd parts twice (the repeat is refused)."""
    k, rk = F.col("p_partkey"), F.col("r_regionkey")
    return _grid(spark, sf_dir, k % 2 == 1).select(
        "seq",
        F.col("r_name").alias("branch_code"),
        F.when(k % 19 == 0, F.concat(F.lit("U"), _s(k))).otherwise(_s(k)).alias("product_code"),
        ((k + rk) % 40).cast("int").alias("qty"))


def _order_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    cb = c.join(_geo(spark, sf_dir), c.c_nationkey == F.col("n_nationkey")) \
        .select("c_custkey", "r_name")
    return o.join(cb, o.o_custkey == cb.c_custkey).select("o_orderkey", "o_orderpriority", "r_name")


def invoice_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ob = _order_branch(spark, sf_dir)
    reps = F.sequence(F.lit(0), F.when(k % 11 == 0, F.lit(1)).otherwise(F.lit(0)))
    return ob.select("*", F.explode(reps).alias("i")).select(
        (k * 2 + F.col("i")).alias("seq"),
        F.when(k % 7 == 0, F.lit("NOWHERE")).otherwise(F.col("r_name")).alias("branch_code"),
        _s(k).alias("invoice_id"))


def _sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of every order line and the supplier's branch."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    # Written, so that the planner knows its size: joins are guessed too large to broadcast.
    sup = materialize(_suppliers(spark, sf_dir).select("s_suppkey", F.col("r_name").alias("s_branch")), "requests: suppliers")
    return li.join(sup, li.l_suppkey == sup.s_suppkey).select("l_orderkey", "l_suppkey", "s_branch")


def sale_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sale per order: seq, invoice id, seller, note, branch.

    The seller is a supplier of the order's branch when one of its lines
    has such a supplier, else the smallest supplier (a foreign seller, 50001).
    Every tenth order re-uses its own invoice id (Q6: lines appended or PK_LINE).
    """
    k = F.col("o_orderkey")
    # grouped on the key of the join: the rows are not shuffled again
    return (_order_branch(spark, sf_dir).join(_sale_lines(spark, sf_dir), k == F.col("l_orderkey"), "left")
            .groupBy("o_orderkey", "o_orderpriority", "r_name")
            .agg(F.min(F.when(F.col("s_branch") == F.col("r_name"), F.col("l_suppkey"))).alias("own"),
                 F.min("l_suppkey").alias("any_seller"))
            .select(k.alias("seq"),
                    F.when(k % 10 == 0, _s(k)).otherwise(F.concat(F.lit("N"), _s(k))).alias("invoice_id"),
                    _s(F.coalesce("own", "any_seller")).alias("employee_id"),
                    F.col("o_orderpriority").alias("note"),
                    F.col("r_name").alias("branch_code")))


def sale_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the sales: one row per order line.  The unit price is
    left out for even part keys (the catalogue price is used)."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    k = F.col("l_partkey")
    return li.join(part, k == part.p_partkey).select(
        F.col("l_orderkey").alias("seq"), _s(k).alias("item_code"), F.col("l_quantity").cast("int").alias("item_qty"),
        F.when(k % 2 == 1, F.col("p_retailprice").cast(MONEY)).alias("item_price"))


def priced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item rows at prices of their own, a few products per order, so that
    many come more than once: no price, 0, or one that depends on the line."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    price = F.when(k % 3 == 0, F.lit(0)).when(k % 3 == 1, (k % 4 + n).cast(MONEY) / 4)
    return li.select(F.col("l_orderkey").alias("seq"), n.cast("int").alias("item_pos"), _s(k % 3).alias("item_code"),
                     F.col("l_quantity").cast("int").alias("item_qty"),
                     F.when((k + n) % 4 > 0, price).cast(MONEY).alias("item_price"))


def sale_bodies(t) -> DataFrame:
    """An API request body per invoice line: its product in a list beside an
    empty item and with the quantity as text, alone in the body, or in a list
    beside an item that only gives a price of 0."""
    k, code = F.col("product_code").cast("bigint"), F.col("product_code")
    qty, price = F.col("qty"), F.col("unit_price")
    listed = F.to_json(F.struct(F.array(
        F.struct(F.lit(None).cast("string").alias("productCode"), F.lit(None).cast("string").alias("quantity")),
        F.struct(code.alias("productCode"), qty.cast("string").alias("quantity"))).alias("items")))
    single = F.to_json(F.struct(F.array().cast("array<string>").alias("items"), F.concat(F.lit(" "), code).alias("productCode"),
                                qty.alias("quantity"), price.alias("unitPrice")))
    beside = F.to_json(F.struct(F.array(
        F.struct(code.alias("productCode"), qty.alias("quantity"), price.alias("unitPrice")),
        F.struct(F.lit("").alias("productCode"), F.lit(0).alias("quantity"), F.lit(0).cast(MONEY).alias("unitPrice"))).alias("items")))
    return t.invoice_line.select("invoice_id", F.when(k % 3 == 0, listed).when(k % 3 == 1, single).otherwise(beside).alias("body"))


def single_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``single_line_requests`` in two tables: the lines (seq, head,
    product_code, qty) and their heads, one per order."""
    key = ["l_orderkey", "l_partkey"]
    # grouped inside the ranges that are numbered: the rows are shuffled once
    li = read(spark, sf_dir, "lineitem").select(*key, "l_quantity").repartitionByRange(*key)
    line = ordered.numbered(li.groupBy(*key).agg(F.sum("l_quantity").alias("qty")), key, dealt=True)
    line = line.select("seq", F.col("l_orderkey").alias("head"), _s(F.col("l_partkey")).alias("product_code"),
                       F.col("qty").cast("int").alias("qty"))
    return line, sale_requests(spark, sf_dir).withColumnRenamed("seq", "head")


def single_line_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One single-line sale per product of each order (quantities of repeated
    lines summed), numbered by order and product."""
    lines, heads = single_lines(spark, sf_dir)
    return lines.join(heads, "head").select("seq", "invoice_id", "employee_id", "product_code", "qty", "note", "branch_code")


def transfer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transfer per event: the user's product moves between two regions
    chosen from the user and event ids (same region -> refused)."""
    ev = read(spark, sf_dir, "events").select("event_id", "user_id")
    regs = ordered.numbered(_regions(spark, sf_dir), ["r_regionkey"], "pos").select(F.col("pos") - 1, "r_name").toDF("pos", "name")
    n = regs.count()
    side = lambda c: regs.select(F.col("pos").alias(f"{c}_pos"), F.col("name").alias(c))
    ev = ev.withColumn("from_branch_pos", F.pmod(F.col("user_id"), F.lit(n))).withColumn(
        "to_branch_pos", F.pmod(F.col("user_id") + F.col("event_id"), F.lit(n)))
    ev = ev.join(side("from_branch"), "from_branch_pos").join(side("to_branch"), "to_branch_pos")
    return ev.select(
        F.col("event_id").alias("seq"), "from_branch", "to_branch",
        _s(F.col("user_id")).alias("product_code"),
        (F.col("event_id") % 61).cast("int").alias("qty"))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replication feed: one change per event on the member ``user_id``."""
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    op = F.when(F.col("event_type") == "signup", F.lit("I")) \
        .when(F.col("event_type") == "error", F.lit("D")).otherwise(F.lit("U"))
    return ev.select(F.col("event_id").alias("seq"), op.alias("op"),
                     F.col("user_id").alias("member_id"), F.col("value").alias("balance"),
                     F.col("ts").alias("updated_at"))


def member_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicated table the feed applies to: one member per customer."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return c.select(F.col("c_custkey").alias("member_id"), F.col("c_acctbal").alias("balance"),
                    F.lit(None).cast("timestamp_ntz").alias("updated_at"))


def product_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup per part: padded, unknown or blank codes."""
    k = F.col("p_partkey")
    return _parts(spark, sf_dir).select(
        F.when(k % 11 == 0, F.concat(F.lit("U"), _s(k))).when(k % 13 == 0, F.lit("  "))
         .otherwise(F.concat(F.lit(" "), _s(k), F.lit(" "))).alias("requested_code"))


def inventory_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup per stock row: padded, unknown or blank codes."""
    k = F.col("p_partkey")
    return _grid(spark, sf_dir).select(
        F.col("r_name").alias("branch_code"),
        F.when(k % 11 == 0, F.concat(F.lit("U"), _s(k))).when(k % 13 == 0, F.lit(" "))
         .otherwise(F.concat(F.lit(" "), _s(k))).alias("requested_code"))


def invoice_replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replace per order, a second one for every third order; products
    are drawn from 50 codes so the catalogue rule chains across invoices."""
    k = F.col("o_orderkey")
    ob = _order_branch(spark, sf_dir)
    reps = F.sequence(F.lit(0), F.when(k % 3 == 0, F.lit(1)).otherwise(F.lit(0)))
    o = ob.select("*", F.explode(reps).alias("i"))
    i = F.col("i")
    q = (k + i) % 9
    return o.select(
        (k * 2 + i).alias("seq"),
        F.col("r_name").alias("branch_code"),
        F.when(k % 17 == 0, F.concat(F.lit("Z"), _s(k))).otherwise(_s(k)).alias("invoice_id"),
        F.when((i == 0) & (k % 2 == 0), F.lit(None).cast("string")).otherwise(_s((k + i) % 50)).alias("product_code"),
        F.when(k % 6 == 0, F.concat(F.lit("Renamed "), _s(k))).alias("product_name"),
        F.when(k % 5 == 0, F.lit(0)).otherwise(q).cast("int").alias("qty"),
        F.when(k % 4 == 0, (k % 100 + F.lit(0.5)).cast(MONEY)).alias("unit_price"),
        F.when((k % 7 == 0) & (q > 0), (q * 3).cast("decimal(12,2)")).alias("total_amount"),
        F.when(k % 8 == 0, F.concat(F.lit("E"), _s(k))).alias("employee_id"),
        F.when(k % 10 == 0, F.concat(F.lit("note "), _s(k))).alias("note"))
