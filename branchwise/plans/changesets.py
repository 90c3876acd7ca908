"""Registered change-set queries and their DuckDB oracle SQL.

Requests come from ``requests`` (every source row is a request).  Keys whose
result does not depend on replay order beyond "first valid request of a
key" have an oracle written directly in SQL here; the tables after a change
and the replays that can be stepped have theirs in ``states``.
Replays are also checked against a plain serial one in ``tests/test_replay.py``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.operators import changes as C
from branchwise.operators import sales as S
from branchwise.plans.params import AS_OF
from branchwise.plans import requests as RQ
from branchwise.session import configure
from branchwise.sources.store import open_tables

NOW = _dt.datetime(AS_OF.year, AS_OF.month, AS_OF.day, 12, 0, 0)


def _run(build, sales: bool, planned: bool):
    """No change reads the summaries; those of ``_WITHOUT_SALES`` read neither
    invoices nor lines, so the store builds none for them, and those of
    ``_PLANNED_SALES`` read them as plans."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return build(spark, sf_dir, open_tables(spark, sf_dir, sales=sales, summaries=False, planned_sales=planned))
    return run


def _invoice_item_merge(s, d, t):
    return S.merge_items(RQ.sale_items(s, d)).select(
        "seq", F.col("item_code").alias("product_code"), "qty", F.col("price").alias("given_price"))


def _item_price_policies(s, d, t):
    """The three price policies on the same items."""
    items = RQ.priced_items(s, d)
    by = {p: S.merge_items(items, p).withColumnRenamed("price", p) for p in S.PRICE_POLICIES}
    rows = by["max"].join(by["first_positive"].drop("qty"), ["seq", "item_code"]).join(by["error"].drop("qty"), ["seq", "item_code"])
    return rows.select("seq", F.col("item_code").alias("product_code"), "qty", F.col("max").alias("largest"), "first_positive", "conflict")


def _service_request_items(s, d, t):
    rows = S.service_items(RQ.sale_bodies(t))
    return rows.select("invoice_id", F.col("item_pos").alias("pos"), F.col("item_code").alias("product_code"),
                       F.col("item_qty").alias("qty"), F.col("item_price").alias("price"))


def _invoice_price_resolve(s, d, t):
    m = S.merge_items(RQ.sale_items(s, d))
    cat = t.product.select(F.col("product_code").alias("item_code"), F.col("unit_price").alias("_cat"))
    from branchwise.functions.exprs import resolve_price
    return m.join(cat, "item_code", "left").select(
        "seq", F.col("item_code").alias("product_code"),
        resolve_price("price", "_cat").alias("unit_price"))


def _invoice_stock_check(s, d, t):
    """Each sale document alone against the opening stock of its branch."""
    req = RQ.sale_requests(s, d)
    m = S.merge_items(RQ.sale_items(s, d)).join(req.select("seq", "branch_code"), "seq")
    inv = t.inventory.select(F.col("product_code").alias("item_code"), "branch_code", F.col("qty").alias("_on_hand"))
    j = m.join(inv, ["item_code", "branch_code"], "left")
    return j.groupBy("seq").agg(
        F.count(F.lit(1)).alias("product_count"),
        F.sum(F.when(F.col("_on_hand").isNull(), 1).otherwise(0)).cast("bigint").alias("missing_rows"),
        F.sum(F.when(F.col("_on_hand") < F.col("qty"), 1).otherwise(0)).cast("bigint").alias("short_rows"))


def _transfer_validate(s, d, t):
    """Static transfer guards plus the source row and stock of the opening state."""
    r = S.transfer_guards(t, RQ.transfer_requests(s, d))
    inv = t.inventory.select(F.col("product_code").alias("_code_in"), F.col("branch_code").alias("_from"),
                             F.col("qty").alias("_on_hand"))
    j = r.join(inv, ["_code_in", "_from"], "left")
    return j.select("seq", F.col("_code").alias("guard_code"), F.col("_on_hand").alias("source_qty"),
                    (F.col("_code").isNull() & F.col("_on_hand").isNotNull() & (F.col("_on_hand") >= F.col("qty")))
                    .alias("passes_alone"))


def _inventory_item_create(s, d, t):
    after_delete = C.delete_stock_rows(t, RQ.stock_row_deletes(s, d)).tables
    return C.create_stock_rows(after_delete, RQ.stock_row_creates(s, d)).outcome


def _apply_change_feed(s, d, t):
    from branchwise.streaming.replicate import apply_changes
    return apply_changes(RQ.member_snapshot(s, d), RQ.change_feed(s, d), ["member_id"],
                         ["balance", "updated_at"])


_DONE: dict[tuple, C.ChangeResult] = {}


def _once(name: str, change):
    """A change that several keys read the tables of, replayed once per
    application and data folder: its moves are written, its tables plans."""
    def run(s, d, t):
        key = (s.sparkContext.applicationId, d.rstrip("/"), name)
        if key not in _DONE:
            _DONE[key] = change(s, d, t)
        return _DONE[key]
    return run


_sales = _once("sales", lambda s, d, t: S.post_invoices(t, RQ.sale_requests(s, d), now=NOW, items=RQ.sale_items(s, d)))


def _post_single_lines(s, d, t):
    lines, heads = RQ.single_lines(s, d)
    return S.post_single_lines(t, lines, now=NOW, heads=heads)


_single_lines = _once("single lines", _post_single_lines)


def _created_rows(s, d, t):
    after_delete = C.delete_stock_rows(t, RQ.stock_row_deletes(s, d)).tables
    return C.create_stock_rows(after_delete, RQ.stock_row_creates(s, d)).tables.inventory


def _state(change, requests, table, *columns):
    """The new ``table`` after a change."""
    return lambda s, d, t: change(t, requests(s, d)).tables.get(table).select(*columns)


_STATES = {
    "employees_after_insert": _state(C.add_employees, RQ.employee_add, "employee",
                                     "employee_id", "full_name", "job_title", "branch_code"),
    "employees_after_patch": _state(C.patch_employees, RQ.employee_patch, "employee",
                                    "employee_id", "full_name", "job_title", "branch_code"),
    "employees_after_delete": _state(C.delete_employees, RQ.employee_delete, "employee",
                                     "employee_id", "full_name", "job_title", "branch_code"),
    "products_after_create": _state(C.create_products, RQ.product_create, "product",
                                    "product_code", "product_name", "unit_price"),
    "products_after_patch": _state(C.patch_products, RQ.product_patch, "product",
                                   "product_code", "product_name", "unit_price"),
    "products_after_delete": _state(C.delete_products, RQ.product_delete, "product",
                                    "product_code", "product_name", "unit_price"),
    "inventory_after_product_delete": _state(C.delete_products, RQ.product_delete, "inventory",
                                             "product_code", "branch_code", "qty"),
    "inventory_after_receipt": _state(C.receive_stock, RQ.stock_requests, "inventory",
                                      "product_code", "branch_code", "qty"),
    "inventory_after_row_delete": _state(C.delete_stock_rows, RQ.stock_row_deletes, "inventory",
                                         "product_code", "branch_code", "qty"),
    "invoices_after_delete": _state(C.delete_invoices, RQ.invoice_deletes, "invoice",
                                    "invoice_id", "note", "created_at", "branch_code", "employee_id"),
    "lines_after_delete": _state(C.delete_invoices, RQ.invoice_deletes, "invoice_line",
                                 "invoice_id", "product_code", "qty", "unit_price", "branch_code"),
    "invoices_after_replace": _state(C.replace_invoices, RQ.invoice_replaces, "invoice",
                                     "invoice_id", "note", "created_at", "employee_id", "branch_code"),
    "lines_after_replace": _state(C.replace_invoices, RQ.invoice_replaces, "invoice_line",
                                  "invoice_id", "product_code", "qty", "unit_price", "branch_code"),
    "products_after_replace": _state(C.replace_invoices, RQ.invoice_replaces, "product",
                                     "product_code", "product_name", "unit_price"),
    "inventory_after_set": _state(C.set_stock, RQ.stock_requests, "inventory", "product_code", "branch_code", "qty"),
    "inventory_after_row_create": lambda s, d, t: _created_rows(s, d, t).select("product_code", "branch_code", "qty"),
    **{f"{name}_after_{change}": (lambda s, d, t, run=run, name=table, columns=columns: run(s, d, t).tables.get(name).select(*columns))
       for change, run in (("sales", _sales), ("single_lines", _single_lines)) for name, table, columns in (
           ("invoices", "invoice", ("invoice_id", "note", "created_at", "branch_code", "employee_id")),
           ("lines", "invoice_line", ("invoice_id", "product_code", "qty", "unit_price", "branch_code")),
           ("inventory", "inventory", ("product_code", "branch_code", "qty")))},
    "inventory_after_transfer": _state(S.transfer_stock, RQ.transfer_requests, "inventory",
                                       "product_code", "branch_code", "qty"),
}


_BUILDERS = {
    "employee_insert": lambda s, d, t: C.add_employees(t, RQ.employee_add(s, d)).outcome,
    "employee_patch": lambda s, d, t: C.patch_employees(t, RQ.employee_patch(s, d)).outcome,
    "employee_delete": lambda s, d, t: C.delete_employees(t, RQ.employee_delete(s, d)).outcome,
    "product_create": lambda s, d, t: C.create_products(t, RQ.product_create(s, d)).outcome,
    "product_create_stock": lambda s, d, t: C.create_products(t, RQ.product_create(s, d)).created_stock,
    "product_patch": lambda s, d, t: C.patch_products(t, RQ.product_patch(s, d)).outcome,
    "product_delete": lambda s, d, t: C.delete_products(t, RQ.product_delete(s, d)).outcome,
    "inventory_set": lambda s, d, t: C.set_stock(t, RQ.stock_requests(s, d)).outcome,
    "stock_receipt": lambda s, d, t: C.receive_stock(t, RQ.stock_requests(s, d)).outcome,
    "inventory_item_delete": lambda s, d, t: C.delete_stock_rows(t, RQ.stock_row_deletes(s, d)).outcome,
    "inventory_item_create": _inventory_item_create,
    "invoice_delete": lambda s, d, t: C.delete_invoices(t, RQ.invoice_deletes(s, d)).outcome,
    "invoice_replace": lambda s, d, t: C.replace_invoices(t, RQ.invoice_replaces(s, d)).outcome,
    "invoice_item_merge": _invoice_item_merge,
    "item_price_policies": _item_price_policies,
    "service_request_items": _service_request_items,
    "employee_patch_service": lambda s, d, t: C.patch_employees(t, RQ.employee_patch(s, d), service_rules=True).outcome,
    "invoice_price_resolve": _invoice_price_resolve,
    "invoice_stock_check": _invoice_stock_check,
    "transfer_validate": _transfer_validate,
    "apply_change_feed": _apply_change_feed,
    "post_invoices": lambda s, d, t: S.post_invoices(t, RQ.sale_requests(s, d), now=NOW, items=RQ.sale_items(s, d)).outcome,
    "post_single_line": lambda s, d, t: _post_single_lines(s, d, t).outcome,
    "stock_transfer": lambda s, d, t: S.transfer_stock(t, RQ.transfer_requests(s, d)).outcome,
}


_WITHOUT_SALES = {
    "employee_insert", "employee_patch", "employee_patch_service", "product_create", "product_create_stock", "product_patch",
    "inventory_set", "stock_receipt", "inventory_item_delete", "inventory_item_create", "invoice_item_merge",
    "item_price_policies", "invoice_price_resolve", "invoice_stock_check", "transfer_validate", "apply_change_feed",
    "stock_transfer", "employees_after_insert", "employees_after_patch", "products_after_create", "products_after_patch",
    "inventory_after_receipt", "inventory_after_set", "inventory_after_row_delete", "inventory_after_row_create",
    "inventory_after_transfer",
}


#: Single lines ask the invoices for their branches and the lines of a few
#: invoices; the tables after them are read once, as results.
_PLANNED_SALES = {"post_single_line", "invoices_after_single_lines", "lines_after_single_lines", "inventory_after_single_lines"}


def queries():
    return {name: _run(fn, name not in _WITHOUT_SALES, name in _PLANNED_SALES) for name, fn in {**_BUILDERS, **_STATES}.items()}


# ---------------------------------------------------------------- oracle SQL
# The request rules again, in SQL.
REQ = """
sup AS (SELECT s_suppkey, s_name, r_name, r_regionkey FROM supplier
        JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
emp_add AS (SELECT s_suppkey AS seq,
  CASE WHEN s_suppkey % 23 = 0 THEN 'CENTRAL' WHEN s_suppkey % 4 = 1 THEN '  ' || lower(r_name) ELSE r_name END AS branch_code,
  CASE WHEN s_suppkey % 2 = 0 THEN 'E' || CAST(s_suppkey // 4 AS VARCHAR) ELSE CAST(s_suppkey AS VARCHAR) END AS employee_id,
  s_name AS full_name, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE 'Cashier' END AS job_title FROM sup),
emp_patch AS (SELECT s_suppkey * 2 + i AS seq,
  CASE WHEN s_suppkey % 11 = 0 THEN 'NOWHERE' ELSE r_name END AS branch_code,
  CASE WHEN s_suppkey % 9 = 0 THEN 'X' || CAST(s_suppkey AS VARCHAR) ELSE CAST(s_suppkey AS VARCHAR) END AS employee_id,
  CASE WHEN i = 0 THEN s_name || ' X' WHEN s_suppkey % 3 = 0 THEN '  ' ELSE s_name || ' Y' END AS full_name,
  CASE WHEN i = 1 AND s_suppkey % 2 = 0 THEN 'Senior' END AS job_title
  FROM sup, (VALUES (0), (1)) v(i)),
emp_del AS (SELECT s_suppkey * 2 + i AS seq, r_name AS branch_code,
  CASE WHEN s_suppkey % 7 = 3 THEN 'X' || CAST(s_suppkey AS VARCHAR) ELSE CAST(s_suppkey AS VARCHAR) END AS employee_id
  FROM sup, (VALUES (0), (1)) v(i) WHERE i = 0 OR s_suppkey % 5 = 0),
prod_add AS (SELECT p_partkey AS seq,
  CASE WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE 'N' || CAST(p_partkey // 3 AS VARCHAR) END AS product_code,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS product_name,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(0 AS DECIMAL(10,2)) WHEN p_partkey % 17 = 0 THEN NULL
       ELSE CAST(p_retailprice AS DECIMAL(10,2)) END AS unit_price FROM part),
prod_patch AS (SELECT p_partkey AS seq,
  CASE WHEN p_partkey % 17 = 0 THEN 'U' || CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS product_code,
  CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE p_name || ' v2' END AS product_name,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN CAST(-1 AS DECIMAL(10,2))
       ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) + CAST(1.5 AS DECIMAL(10,2)) AS DECIMAL(10,2)) END AS unit_price
  FROM part),
prod_del AS (SELECT p_partkey AS seq,
  CASE WHEN p_partkey % 13 = 0 THEN 'U' || CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS product_code
  FROM part),
grid AS (SELECT p_partkey, r_regionkey, r_name, i FROM part, region, (VALUES (0), (1)) v(i)),
stock_req AS (SELECT row_number() OVER (ORDER BY p_partkey, r_regionkey, i) AS seq,
  CASE WHEN p_partkey % 31 = 0 AND i = 1 THEN 'NOWHERE' ELSE r_name END AS branch_code,
  CASE WHEN p_partkey % 29 = 0 THEN 'U' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 37 = 0 THEN ' '
       ELSE CAST(p_partkey AS VARCHAR) END AS product_code,
  CAST((p_partkey + i * 7) % 50 - 5 AS INT) AS qty FROM grid),
row_del AS (SELECT row_number() OVER (ORDER BY p_partkey, r_regionkey, i) AS seq, r_name AS branch_code,
  CASE WHEN p_partkey % 2 = 1 THEN 'U' || CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS product_code
  FROM grid WHERE i = 0 OR p_partkey % 6 = 0),
row_add AS (SELECT row_number() OVER (ORDER BY p_partkey, r_regionkey, i) AS seq, r_name AS branch_code,
  CASE WHEN p_partkey % 19 = 0 THEN 'U' || CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS product_code,
  CAST((p_partkey + r_regionkey) % 40 AS INT) AS qty FROM grid WHERE i = 0 OR p_partkey % 2 = 1),
ord AS (SELECT o_orderkey, o_orderpriority, g.branch_code FROM orders
  JOIN customer ON c_custkey = o_custkey JOIN geo g ON g.n_nationkey = c_nationkey),
inv_del AS (SELECT o_orderkey * 2 + i AS seq,
  CASE WHEN o_orderkey % 7 = 0 THEN 'NOWHERE' ELSE branch_code END AS branch_code,
  CAST(o_orderkey AS VARCHAR) AS invoice_id FROM ord, (VALUES (0), (1)) v(i) WHERE i = 0 OR o_orderkey % 11 = 0),
sale_items AS (SELECT l_orderkey AS seq,
  CAST(l_partkey AS VARCHAR) AS product_code, CAST(l_quantity AS INT) AS qty,
  CASE WHEN l_partkey % 2 = 1 THEN CAST(p_retailprice AS DECIMAL(10,2)) END AS price
  FROM lineitem JOIN part ON p_partkey = l_partkey),
sale_merged AS (SELECT seq, product_code, CAST(sum(qty) AS BIGINT) AS qty, max(price) AS price
  FROM sale_items GROUP BY seq, product_code),
sale_branch AS (SELECT o_orderkey AS order_key, branch_code FROM ord),
repl AS (SELECT o_orderkey * 2 + i AS seq, branch_code,
  CASE WHEN o_orderkey % 17 = 0 THEN 'Z' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS invoice_id,
  CASE WHEN i = 0 AND o_orderkey % 2 = 0 THEN NULL ELSE CAST((o_orderkey + i) % 50 AS VARCHAR) END AS product_code,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Renamed ' || CAST(o_orderkey AS VARCHAR) END AS product_name,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey + i) % 9 END AS INT) AS qty,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 100 + 0.5 AS DECIMAL(10,2)) END AS unit_price,
  CASE WHEN o_orderkey % 7 = 0 AND (o_orderkey + i) % 9 > 0 THEN CAST(((o_orderkey + i) % 9) * 3 AS DECIMAL(12,2)) END AS total_amount,
  CASE WHEN o_orderkey % 8 = 0 THEN 'E' || CAST(o_orderkey AS VARCHAR) END AS employee_id,
  CASE WHEN o_orderkey % 10 = 0 THEN 'note ' || CAST(o_orderkey AS VARCHAR) END AS note
  FROM ord, (VALUES (0), (1)) v(i) WHERE i = 0 OR o_orderkey % 3 = 0),
ev_regions AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, count(*) OVER () AS n FROM region),
xfer AS (SELECT event_id AS seq, f.r_name AS from_branch, t.r_name AS to_branch,
  CAST(user_id AS VARCHAR) AS product_code, CAST(event_id % 61 AS INT) AS qty
  FROM events JOIN ev_regions f ON f.pos = user_id % f.n JOIN ev_regions t ON t.pos = (user_id + event_id) % t.n)
"""

ACTIVE = "EXISTS (SELECT 1 FROM branch x WHERE x.branch_code = {b} AND x.is_active)"


def _blank(x: str) -> str:
    return f"nullif(trim({x}), '') IS NULL"


def _q(select: str, extra: str = "") -> str:
    from branchwise.plans.oracle import BASE
    return BASE + ", " + REQ + (", " + extra if extra else "") + "\n" + select


def _first_valid(key: str, code_if_dup: str) -> str:
    return (f"CASE WHEN pre IS NOT NULL THEN pre "
            f"WHEN seq <> min(CASE WHEN pre IS NULL THEN seq END) OVER (PARTITION BY {key}) "
            f"THEN '{code_if_dup}' END")


ORACLE = {
    "employee_insert": _q("""SELECT seq, id AS employee_id, b AS branch_code, code IS NULL AS accepted, code AS reject_code
FROM (SELECT *, """ + _first_valid("id", "50001") + """ AS code FROM (
  SELECT *, CASE WHEN NOT """ + ACTIVE.format(b="b") + """ THEN 'BAD_BRANCH'
    WHEN """ + _blank("employee_id") + " OR " + _blank("full_name") + " OR " + _blank("job_title") + """ THEN '50000'
    WHEN EXISTS (SELECT 1 FROM employee e WHERE e.employee_id = id) THEN '50001' END AS pre
  FROM (SELECT *, upper(trim(branch_code)) AS b, trim(employee_id) AS id FROM emp_add) r) p) f"""),

    "employee_patch": _q("""SELECT r.seq, r.id AS employee_id, r.b AS branch_code, r.code IS NULL AS accepted,
  r.code AS reject_code, a.full_name_after, a.job_title_after
FROM rr r LEFT JOIN (
  SELECT x.seq,
    coalesce(last_value(CASE WHEN NOT """ + _blank("x.full_name") + """ THEN trim(x.full_name) END IGNORE NULLS) OVER w,
             e.full_name) AS full_name_after,
    coalesce(last_value(CASE WHEN NOT """ + _blank("x.job_title") + """ THEN trim(x.job_title) END IGNORE NULLS) OVER w,
             e.job_title) AS job_title_after
  FROM rr x LEFT JOIN employee e ON e.employee_id = x.id
  WHERE x.code IS NULL
  WINDOW w AS (PARTITION BY x.id ORDER BY x.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) a ON a.seq = r.seq""",
                         """rr AS (SELECT *, CASE WHEN NOT """ + ACTIVE.format(b="b") + """ THEN 'BAD_BRANCH'
    WHEN """ + _blank("employee_id") + """ THEN '50000'
    WHEN NOT EXISTS (SELECT 1 FROM employee e WHERE e.employee_id = id AND e.branch_code = b) THEN '50001' END AS code
  FROM (SELECT *, upper(trim(branch_code)) AS b, trim(employee_id) AS id FROM emp_patch) r0)"""),

    "employee_delete": _q("""SELECT seq, id AS employee_id, b AS branch_code, code IS NULL AS accepted, code AS reject_code
FROM (SELECT *, """ + _first_valid("id, b", "50001") + """ AS code FROM (
  SELECT *, CASE WHEN NOT """ + ACTIVE.format(b="b") + """ THEN 'BAD_BRANCH'
    WHEN """ + _blank("employee_id") + """ THEN '50000'
    WHEN NOT EXISTS (SELECT 1 FROM employee e WHERE e.employee_id = id AND e.branch_code = b) THEN '50001'
    WHEN EXISTS (SELECT 1 FROM invoice i WHERE i.employee_id = id) THEN 'FK_INVOICE' END AS pre
  FROM (SELECT *, upper(trim(branch_code)) AS b, trim(employee_id) AS id FROM emp_del) r) p) f"""),

    "product_patch": _q("""SELECT r.seq, r.code_in AS product_code, r.code IS NULL AS accepted, r.code AS reject_code,
  a.product_name_after, a.unit_price_after
FROM rr r LEFT JOIN (
  SELECT x.seq,
    coalesce(last_value(CASE WHEN NOT """ + _blank("x.product_name") + """ THEN trim(x.product_name) END IGNORE NULLS) OVER w,
             p.product_name) AS product_name_after,
    CAST(coalesce(last_value(x.unit_price IGNORE NULLS) OVER w, p.unit_price) AS DECIMAL(10,2)) AS unit_price_after
  FROM rr x LEFT JOIN product p ON p.product_code = x.code_in
  WHERE x.code IS NULL
  WINDOW w AS (PARTITION BY x.code_in ORDER BY x.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) a ON a.seq = r.seq""",
                        """rr AS (SELECT *, CASE WHEN """ + _blank("product_code") + """ THEN '50000'
    WHEN unit_price IS NOT NULL AND unit_price <= 0 THEN '50000'
    WHEN NOT EXISTS (SELECT 1 FROM product p WHERE p.product_code = code_in) THEN '50001' END AS code
  FROM (SELECT *, trim(product_code) AS code_in FROM prod_patch) r0)"""),

    "product_delete": _q("""SELECT seq, code_in AS product_code, code IS NULL AS accepted, code AS reject_code
FROM (SELECT *, """ + _first_valid("code_in", "50001") + """ AS code FROM (
  SELECT *, CASE WHEN """ + _blank("product_code") + """ THEN '50000'
    WHEN NOT EXISTS (SELECT 1 FROM product p WHERE p.product_code = code_in) THEN '50001'
    WHEN EXISTS (SELECT 1 FROM invoice_line l WHERE l.product_code = code_in) THEN '50002' END AS pre
  FROM (SELECT *, trim(product_code) AS code_in FROM prod_del) r) p) f"""),

    "inventory_set": _q("""SELECT r.seq, r.b AS branch_code, r.code_in AS product_code, r.code IS NULL AS accepted,
  r.code AS reject_code,
  CASE WHEN r.code IS NULL THEN r.qty END AS qty_after
FROM rr r""",
                        """rr AS (SELECT *, CASE WHEN NOT """ + ACTIVE.format(b="b") + """ THEN '50000'
    WHEN """ + _blank("product_code") + """ THEN '50000'
    WHEN qty < 0 THEN '50000'
    WHEN NOT EXISTS (SELECT 1 FROM inventory v WHERE v.product_code = code_in AND v.branch_code = b) THEN '50001'
    WHEN qty IS NULL THEN 'NOT_NULL' END AS code
  FROM (SELECT *, upper(trim(branch_code)) AS b, trim(product_code) AS code_in FROM stock_req) r0)"""),

    "stock_receipt": _q("""SELECT r.seq, r.b AS branch_code, r.code_in AS product_code, r.code IS NULL AS accepted,
  r.code AS reject_code,
  a.qty_after
FROM rr r LEFT JOIN (
  SELECT x.seq, CAST(v.qty + sum(x.qty) OVER (PARTITION BY x.code_in, x.b ORDER BY x.seq
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS qty_after
  FROM rr x JOIN inventory v ON v.product_code = x.code_in AND v.branch_code = x.b
  WHERE x.code IS NULL) a ON a.seq = r.seq""",
                        """rr AS (SELECT *, CASE WHEN NOT """ + ACTIVE.format(b="b") + """ THEN '50000'
    WHEN """ + _blank("product_code") + """ THEN '50000'
    WHEN qty <= 0 THEN '50000'
    WHEN NOT EXISTS (SELECT 1 FROM inventory v WHERE v.product_code = code_in AND v.branch_code = b) THEN '50001'
    WHEN qty IS NULL THEN 'NOT_NULL' END AS code
  FROM (SELECT *, upper(trim(branch_code)) AS b, trim(product_code) AS code_in FROM stock_req) r0)"""),

    "inventory_item_create": _q("""SELECT r.seq, r.b AS branch_code, r.code_in AS product_code, r.code IS NULL AS accepted,
  r.code AS reject_code, CASE WHEN r.code IS NULL THEN r.qty END AS qty_after
FROM (SELECT *, """ + _first_valid("code_in, b", "50000") + """ AS code FROM (
  SELECT *, CASE WHEN NOT """ + ACTIVE.format(b="b") + """ THEN 'BAD_BRANCH'
    WHEN NOT EXISTS (SELECT 1 FROM product p WHERE p.product_code = code_in) THEN '50001'
    WHEN EXISTS (SELECT 1 FROM inv2 v WHERE v.product_code = code_in AND v.branch_code = b) THEN '50000' END AS pre
  FROM (SELECT *, upper(trim(branch_code)) AS b, trim(product_code) AS code_in FROM row_add) r0) p) r""",
                                """inv2 AS (SELECT * FROM inventory v WHERE NOT EXISTS (
    SELECT 1 FROM rd WHERE rd.code IS NULL AND rd.code_in = v.product_code AND rd.b = v.branch_code))"""),

    "invoice_delete": _q("""SELECT r.seq, r.id AS invoice_id, r.b AS branch_code, r.code IS NULL AS accepted,
  r.code AS reject_code,
  CASE WHEN r.code IS NULL THEN CAST((SELECT count(*) FROM invoice_line l WHERE l.invoice_id = r.id
                                      AND l.branch_code = r.b) AS BIGINT) END AS lines_deleted
FROM (SELECT *, """ + _first_valid("id, b", "50001") + """ AS code FROM (
  SELECT *, CASE WHEN NOT """ + ACTIVE.format(b="b") + """ THEN 'BAD_BRANCH'
    WHEN NOT EXISTS (SELECT 1 FROM invoice i WHERE i.invoice_id = id AND i.branch_code = b) THEN '50001' END AS pre
  FROM (SELECT *, upper(trim(branch_code)) AS b, trim(invoice_id) AS id FROM inv_del) r0) p) r"""),

    "invoice_replace": _q("""SELECT g.seq, g.id AS invoice_id, g.b AS branch_code, g.code IS NULL AS accepted,
  g.code AS reject_code, a2.product_code_after, a2.qty_after, a2.unit_price_after, a2.product_name_after,
  a2.employee_id_after, a2.note_after
FROM g LEFT JOIN a2 ON a2.seq = g.seq""", """pre AS (SELECT *, CASE WHEN NOT """ + ACTIVE.format(b="b") + """ THEN 'BAD_BRANCH'
    WHEN NOT EXISTS (SELECT 1 FROM invoice i WHERE i.invoice_id = id AND i.branch_code = b) THEN '50001' END AS code
  FROM (SELECT *, upper(trim(branch_code)) AS b, trim(invoice_id) AS id FROM repl) r0),
fl AS (SELECT invoice_id, branch_code, min(product_code) AS p0, arg_min(qty, product_code) AS q0
  FROM invoice_line GROUP BY 1, 2),
st AS (SELECT id, b, min(seq) AS s0 FROM pre WHERE code IS NULL AND trim(product_code) <> '' AND qty > 0 GROUP BY 1, 2),
g AS (SELECT pre.* EXCLUDE (code), fl.p0, fl.q0,
    CASE WHEN code IS NOT NULL THEN code WHEN p0 IS NULL AND (s0 IS NULL OR seq < s0) THEN 'NOT_NULL' END AS code
  FROM pre LEFT JOIN fl ON fl.invoice_id = pre.id AND fl.branch_code = pre.b
  LEFT JOIN st ON st.id = pre.id AND st.b = pre.b),
ok AS (SELECT g.*, i.employee_id AS e0, i.note AS n0 FROM g
  JOIN invoice i ON i.invoice_id = g.id AND i.branch_code = g.b WHERE g.code IS NULL),
a1 AS (SELECT ok.*,
  coalesce(last_value(nullif(trim(product_code), '') IGNORE NULLS) OVER w, p0) AS product_code_after,
  CAST(coalesce(last_value(CASE WHEN qty > 0 THEN qty END IGNORE NULLS) OVER w, q0) AS INT) AS qty_after,
  coalesce(last_value(nullif(trim(employee_id), '') IGNORE NULLS) OVER w, e0) AS employee_id_after,
  coalesce(last_value(note IGNORE NULLS) OVER w, n0) AS note_after
  FROM ok WINDOW w AS (PARTITION BY id, b ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a2 AS (SELECT a1.*,
  CAST(coalesce(last_value(CAST(CASE WHEN a1.unit_price > 0 THEN a1.unit_price
                                     WHEN a1.total_amount > 0 AND a1.qty > 0 THEN a1.total_amount / a1.qty END
                                AS DECIMAL(10,2)) IGNORE NULLS) OVER w2, p.unit_price, 0) AS DECIMAL(10,2)) AS unit_price_after,
  coalesce(last_value(nullif(trim(a1.product_name), '') IGNORE NULLS) OVER w2, p.product_name, a1.product_code_after)
    AS product_name_after
  FROM a1 LEFT JOIN product p ON p.product_code = a1.product_code_after
  WINDOW w2 AS (PARTITION BY a1.product_code_after ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""),

    "invoice_item_merge": _q("SELECT seq, product_code, qty, price AS given_price FROM sale_merged"),

    "invoice_price_resolve": _q("""SELECT m.seq, m.product_code,
  CAST(coalesce(nullif(m.price, 0), p.unit_price, 0) AS DECIMAL(10,2)) AS unit_price
FROM sale_merged m LEFT JOIN product p ON p.product_code = m.product_code"""),

    "invoice_stock_check": _q("""SELECT m.seq, count(*) AS product_count,
  CAST(count(*) FILTER (WHERE v.qty IS NULL) AS BIGINT) AS missing_rows,
  CAST(count(*) FILTER (WHERE v.qty < m.qty) AS BIGINT) AS short_rows
FROM sale_merged m JOIN sale_branch sb ON sb.order_key = m.seq
LEFT JOIN inventory v ON v.product_code = m.product_code AND v.branch_code = sb.branch_code
GROUP BY m.seq"""),

    "transfer_validate": _q("""SELECT seq, guard_code, source_qty,
  (guard_code IS NULL AND source_qty IS NOT NULL AND source_qty >= qty) AS passes_alone
FROM (SELECT x.seq, x.qty,
  CASE WHEN NOT """ + ACTIVE.format(b="upper(trim(x.from_branch))") + " OR NOT " + ACTIVE.format(b="upper(trim(x.to_branch))") + """ THEN '50000'
    WHEN upper(trim(x.from_branch)) = upper(trim(x.to_branch)) THEN '50000'
    WHEN """ + _blank("x.product_code") + """ THEN '50000'
    WHEN x.qty IS NULL OR x.qty <= 0 THEN '50001' END AS guard_code,
  v.qty AS source_qty
FROM xfer x LEFT JOIN inventory v ON v.product_code = trim(x.product_code)
  AND v.branch_code = upper(trim(x.from_branch))) z"""),

    "apply_change_feed": """WITH feed AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'I' WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op,
         user_id AS member_id, value AS balance, ts AS updated_at FROM events),
last AS (SELECT member_id, arg_max(op, seq) AS op, arg_max(balance, seq) AS balance,
                arg_max(updated_at, seq) AS updated_at FROM feed GROUP BY member_id),
snap AS (SELECT c_custkey AS member_id, c_acctbal AS balance, CAST(NULL AS TIMESTAMP) AS updated_at FROM customer)
SELECT s.member_id, s.balance, s.updated_at FROM snap s WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.member_id = s.member_id)
UNION ALL
SELECT member_id, balance, updated_at FROM last WHERE op <> 'D'""",
}

# CTEs shared by several oracle queries (appended to the request CTEs).
_PC = """pc AS (SELECT *, """ + _first_valid("code_in", "50000") + """ AS code FROM (
  SELECT *, CASE WHEN """ + _blank("product_code") + " OR " + _blank("product_name") + """ THEN '50000'
    WHEN unit_price <= 0 THEN '50000'
    WHEN EXISTS (SELECT 1 FROM product p WHERE p.product_code = code_in) THEN '50000'
    WHEN unit_price IS NULL THEN 'NOT_NULL' END AS pre
  FROM (SELECT *, trim(product_code) AS code_in FROM prod_add) r) p)"""
_RD = """rd AS (SELECT *, """ + _first_valid("code_in, b", "50001") + """ AS code FROM (
  SELECT *, CASE WHEN NOT """ + ACTIVE.format(b="b") + """ THEN 'BAD_BRANCH'
    WHEN NOT EXISTS (SELECT 1 FROM inventory v WHERE v.product_code = code_in AND v.branch_code = b) THEN '50001' END AS pre
  FROM (SELECT *, upper(trim(branch_code)) AS b, trim(product_code) AS code_in FROM row_del) r0) p)"""

ORACLE["employee_patch_service"] = ORACLE["employee_patch"].replace(
    "WHEN NOT EXISTS (SELECT 1 FROM employee e WHERE e.employee_id = id",
    "WHEN " + _blank("full_name") + " AND " + _blank("job_title") + """ THEN 'NO_FIELDS'
    WHEN NOT EXISTS (SELECT 1 FROM employee e WHERE e.employee_id = id""", 1)
ORACLE["item_price_policies"] = """WITH i AS (SELECT l_orderkey AS seq, l_linenumber AS pos, CAST(l_partkey % 3 AS VARCHAR) AS product_code,
    CAST(l_quantity AS BIGINT) AS qty, CAST(CASE WHEN (l_partkey + l_linenumber) % 4 > 0 THEN CASE l_partkey % 3 WHEN 0 THEN 0
      WHEN 1 THEN (l_partkey % 4 + l_linenumber) / 4.0 END END AS DECIMAL(10,2)) AS price FROM lineitem)
SELECT seq, product_code, CAST(sum(qty) AS BIGINT) AS qty, max(price) AS largest,
  first(price ORDER BY pos, price) FILTER (WHERE price > 0) AS first_positive,
  min(coalesce(price, 0)) <> max(coalesce(price, 0)) AS conflict
FROM i GROUP BY seq, product_code"""
ORACLE["service_request_items"] = _q("""SELECT invoice_id, CAST(CASE WHEN CAST(product_code AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS INT) AS pos,
  product_code, qty, CAST(CASE WHEN CAST(product_code AS BIGINT) % 3 = 0 THEN 0 ELSE unit_price END AS DECIMAL(10,2)) AS price
FROM invoice_line""")
ORACLE["product_create"] = _q("SELECT seq, code_in AS product_code, code IS NULL AS accepted, code AS reject_code FROM pc", _PC)
ORACLE["product_create_stock"] = _q("""SELECT pc.code_in AS product_code, b.branch_code, CAST(0 AS INT) AS qty
FROM pc JOIN branch b ON b.is_active
WHERE pc.code IS NULL
  AND NOT EXISTS (SELECT 1 FROM inventory v WHERE v.product_code = pc.code_in AND v.branch_code = b.branch_code)""", _PC)
ORACLE["inventory_item_delete"] = _q("""SELECT seq, b AS branch_code, code_in AS product_code, code IS NULL AS accepted,
  code AS reject_code FROM rd""", _RD)
ORACLE["inventory_item_create"] = ORACLE["inventory_item_create"].replace(
    "inv2 AS (", _RD + ",\ninv2 AS (", 1)
#: The stock rows before P14's creates: those left by its deletes.
INV_AFTER_DELETES = _RD + """,
inv2 AS (SELECT * FROM inventory v WHERE NOT EXISTS (
    SELECT 1 FROM rd WHERE rd.code IS NULL AND rd.code_in = v.product_code AND rd.b = v.branch_code))"""
