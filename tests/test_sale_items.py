"""Items of sales: typed JSON, request bodies, price policies; one-pass foreign keys."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from branchwise.operators import changes as C
from branchwise.operators import listings as L
from branchwise.operators import quality as Q
from branchwise.operators import sales as S

# (document, items as (code, quantity, price)); None: no items at all.
DOCUMENTS = [
    ('[{"MaSP":"A","SoLuong":2,"DonGia":1.5}]', [("A", 2, Decimal("1.50"))]),
    ('[{"MaSP":" A ","SoLuong":" 2 ","DonGia":"1.5"}]', [("A", 2, Decimal("1.50"))]),
    ('[{"MaSP":7,"SoLuong":"-3"}]', [("7", -3, None)]),
    ('[{"MaSP":"A","SoLuong":"two","DonGia":"x"}]', [("A", None, None)]),
    ('[{"MaSP":"A","SoLuong":2.5}]', [("A", None, None)]),
    ('[{"MaSP":"A","SoLuong":true}]', [("A", None, None)]),
    ('[{"MaSP":"A","SoLuong":99999999999}]', [("A", None, None)]),
    ('[{"MaSP":null,"SoLuong":null},{}]', [(None, None, None)] * 2),
    ('[1, null, "x"]', [(None, None, None)] * 3),
    ('{"MaSP":"A","SoLuong":1}', [("A", 1, None)]),
    ('[]', None), ('3', None), ('null', None), ('[{"MaSP":', None), ("", None), (None, None),
]


def test_items_are_typed_as_the_procedure_types_them(spark):
    docs = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DOCUMENTS)], "seq BIGINT, items_json STRING")
    got = {}
    for r in L.explode_items(docs).where("item_pos IS NOT NULL").orderBy("seq", "item_pos").collect():
        got.setdefault(r.seq, []).append((r.item_code, r.item_qty, r.item_price))
    assert got == {i: items for i, (_, items) in enumerate(DOCUMENTS) if items}


def test_request_bodies(spark):
    bodies = [
        ({"items": [{"productCode": " A ", "quantity": "2", "unitPrice": 3}, {}, {"productCode": "", "quantity": 0}]}, [(0, "A", 2, 3)]),
        ({"items": [{}, {"quantity": 4}]}, [(1, "", 4, 0)]),
        ({"items": [], "productCode": "B", "quantity": 1}, [(0, "B", 1, 0)]),
        ({"items": [{}], "productCode": "B", "unitPrice": "2.5"}, [(0, "B", 0, Decimal("2.5"))]),
        ({"items": [{"productCode": "C", "quantity": 1}], "productCode": "B"}, [(0, "C", 1, 0)]),
        ({"items": "none", "productCode": "B", "quantity": "x"}, [(0, "B", 0, 0)]),
        ({"items": [{"quantity": "x"}], "productCode": " "}, []),
        ({}, []),
    ]
    rows = [(i, json.dumps(b)) for i, (b, _) in enumerate(bodies)] + [(90, "{"), (91, None)]
    got = S.service_items(spark.createDataFrame(rows, "seq BIGINT, body STRING")).orderBy("seq", "item_pos").collect()
    assert [tuple(r) for r in got] == [(i, *x) for i, (_, items) in enumerate(bodies) for x in items]


@pytest.fixture(scope="module")
def shop(tables):
    """A branch, one of its employees and two products well in stock."""
    emp = tables.employee.first()
    stock = [r.product_code for r in tables.inventory.where((F.col("branch_code") == emp.branch_code) & (F.col("qty") > 100))
             .orderBy("product_code").limit(2).collect()]
    return emp.branch_code, emp.employee_id, stock


@pytest.mark.parametrize("policy", ["max", "first_positive", "error"])
def test_price_policies_of_sales(spark, tables, shop, policy):
    branch, emp, (a, b) = shop
    cat = {r.product_code: r.unit_price for r in tables.product.where(F.col("product_code").isin(a, b)).collect()}
    items = [
        (1, 0, a, 1, None), (1, 1, a, 2, Decimal("0")), (1, 2, a, 1, Decimal("3")), (1, 3, a, 1, Decimal("5")),
        (2, 0, b, 1, Decimal("4")), (2, 1, b, 1, Decimal("4")),
        (3, 0, a, 1, None), (3, 1, a, 1, Decimal("0")),
    ]
    items = spark.createDataFrame(items, "seq BIGINT, item_pos INT, item_code STRING, item_qty INT, item_price DECIMAL(10,2)")
    req = spark.createDataFrame([(i, f"X{i}", emp, None, branch) for i in (1, 2, 3)],
                                "seq BIGINT, invoice_id STRING, employee_id STRING, note STRING, branch_code STRING")
    res = S.post_invoices(tables, req, items=items, price_policy=policy)
    got = {r.seq: (r.reject_code, r.total) for r in res.outcome.collect()}
    assert got[2] == (None, Decimal("8.00")) and got[3] == (None, 2 * cat[a])
    assert got[1] == {"max": (None, Decimal("25.00")), "first_positive": (None, Decimal("15.00")),
                      "error": (S.PRICE_CONFLICT, None)}[policy]


def test_a_patch_needs_a_field_by_the_service_rule(spark, tables, shop):
    branch, emp, _ = shop
    req = spark.createDataFrame([(1, branch, emp, " ", None), (2, branch, "nobody", None, ""), (3, branch, emp, "N", None),
                                 (4, branch, " ", None, None)],
                                "seq BIGINT, branch_code STRING, employee_id STRING, full_name STRING, job_title STRING")
    plain = {r.seq: r.reject_code for r in C.patch_employees(tables, req).outcome.collect()}
    strict = {r.seq: r.reject_code for r in C.patch_employees(tables, req, service_rules=True).outcome.collect()}
    assert plain == {1: None, 2: "50001", 3: None, 4: "50000"}
    assert strict == {1: C.NO_FIELDS, 2: C.NO_FIELDS, 3: None, 4: "50000"}


def test_foreign_keys_read_each_table_once(spark, tables):
    plan = Q.orphans(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 6                      # one per table
    physical = Q.orphans(tables)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("hashpartitioning(constraint_name") <= 2 and "SortMergeJoin" not in physical


def test_orphans_are_counted(spark, tables):
    lost = tables.invoice_line.limit(1).select(F.lit("none").alias("invoice_id"), "product_code", "qty", "unit_price", "branch_code")
    odd = tables.invoice.limit(2).select(F.concat(F.lit("q"), "invoice_id").alias("invoice_id"), "note", "created_at",
                                         F.lit("NOWHERE").alias("branch_code"), F.lit(None).cast("string").alias("employee_id"))
    t = tables.with_tables(invoice_line=tables.invoice_line.unionByName(lost).unionByName(lost), invoice=tables.invoice.unionByName(odd))
    before = {r.constraint_name: (r.checked_rows, r.orphan_rows) for r in Q.orphans(tables).collect()}
    after = {r.constraint_name: (r.checked_rows, r.orphan_rows) for r in Q.orphans(t).collect()}
    change = {k: (after[k][0] - before[k][0], after[k][1] - before[k][1]) for k in after}
    assert change == {"employee_branch": (0, 0), "invoice_branch": (2, 2), "invoice_employee": (0, 0), "inventory_product": (0, 0),
                      "inventory_branch": (0, 0), "line_invoice": (2, 2), "line_product": (2, 0)}
    none = tables.with_tables(**{n: tables.get(n).limit(0) for n in ("branch", "employee", "product", "invoice", "inventory", "invoice_line")})
    assert [(r.checked_rows, r.orphan_rows) for r in Q.orphans(none).collect()] == [(0, 0)] * 7
