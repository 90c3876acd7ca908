"""Golden values: the reference's own smoke scenarios on its seed rows.

Fixed values: the seed catalogue, stock rows and a few employees of the
reference's seed script, re-typed as literals; expected numbers are the
ones computed from them in FIXTURES.md section 2.
"""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest

from branchwise.functions.exprs import py_week, week_bounds
from branchwise.operators import changes as C
from branchwise.operators import reports as R
from branchwise.operators import sales as S
from branchwise.sources.schemas import SCHEMAS, Tables

# Fixed values (seed rows).
PRODUCTS = [("MI_GOI", "Mi goi", 12000), ("SUA_HOP", "Sua hop", 12000), ("NUOC_SUOI", "Nuoc suoi", 7000),
            ("BANH_SNACK", "Banh snack", 15000), ("CA_PHE_LON", "Ca phe lon", 18000),
            ("TRA_XANH", "Tra xanh", 10000)]
STOCK = {"HUE": [220, 80, 140, 95, 75, 130], "SAIGON": [110, 120, 160, 100, 90, 145],
         "HANOI": [170, 60, 150, 105, 85, 120]}
EMPLOYEES = [("H001", "Nguyen Van A", "Thu ngan", "HUE"), ("H003", "Pham Thi C", "Ban hang", "HUE"),
             ("S005", "Pham Thi H", "Thu ngan", "SAIGON"), ("N006", "Nguyen Van M", "Quan ly kho", "HANOI")]


@pytest.fixture(scope="module")
def seed(spark):
    data = {
        "branch": [(b, b.title(), None, True) for b in STOCK],
        "employee": EMPLOYEES,
        "product": [(c, n, Decimal(p)) for c, n, p in PRODUCTS],
        "invoice": [],
        "inventory": [(PRODUCTS[i][0], b, q) for b, qs in STOCK.items() for i, q in enumerate(qs)],
        "invoice_line": [],
    }
    return Tables(**{n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()})


def stock_of(t: Tables, branch: str) -> dict:
    return {r.product_code: r.qty for r in t.inventory.where(f"branch_code = '{branch}'").collect()}


def test_sale_from_json(spark, seed):
    items = json.dumps([{"MaSP": "MI_GOI", "SoLuong": 3}, {"MaSP": "NUOC_SUOI", "SoLuong": 3},
                        {"MaSP": "SUA_HOP", "SoLuong": 4}])
    req = spark.createDataFrame([(1, "INV-NEW-1", "H003", "test", "HUE", items)],
                                "seq BIGINT, invoice_id STRING, employee_id STRING, note STRING, "
                                "branch_code STRING, items_json STRING")
    res = S.post_invoices(seed, req, now=dt.datetime(2025, 1, 1))
    o = res.outcome.first()
    assert o.accepted and o.total == Decimal("105000.00") and o.line_count == 3
    st = stock_of(res.tables, "HUE")
    assert (st["MI_GOI"], st["NUOC_SUOI"], st["SUA_HOP"]) == (217, 137, 76)


def test_transfer_hue_to_saigon(spark, seed):
    req = spark.createDataFrame([(1, "HUE", "SAIGON", "MI_GOI", 3)],
                                "seq BIGINT, from_branch STRING, to_branch STRING, product_code STRING, qty INT")
    o = S.transfer_stock(seed, req).outcome.first()
    assert (o.from_before, o.from_after, o.to_before, o.to_after) == (220, 217, 110, 113)


def test_set_stock(spark, seed):
    req = spark.createDataFrame([(1, "HUE", "MI_GOI", 150)],
                                "seq BIGINT, branch_code STRING, product_code STRING, qty INT")
    assert C.set_stock(seed, req).outcome.first().qty_after == 150


def test_product_life_cycle(spark, seed):
    add = spark.createDataFrame([(1, "P-NEW", "Probe item", Decimal(25000))],
                                "seq BIGINT, product_code STRING, product_name STRING, unit_price DECIMAL(10,2)")
    r1 = C.create_products(seed, add)
    assert r1.outcome.first().accepted
    assert r1.created_stock.count() == 3          # a 0-stock row in each branch
    patch = spark.createDataFrame([(2, "P-NEW", "Probe item, second", Decimal(30000))],
                                  "seq BIGINT, product_code STRING, product_name STRING, unit_price DECIMAL(10,2)")
    r2 = C.patch_products(r1.tables, patch)
    o = r2.outcome.first()
    assert o.unit_price_after == Decimal("30000.00") and o.product_name_after == "Probe item, second"
    dele = spark.createDataFrame([(3, "P-NEW")], "seq BIGINT, product_code STRING")
    r3 = C.delete_products(r2.tables, dele)
    assert r3.outcome.first().accepted
    assert r3.tables.inventory.where("product_code = 'P-NEW'").count() == 0


def test_employee_life_cycle(spark, seed):
    schema = "seq BIGINT, branch_code STRING, employee_id STRING, full_name STRING, job_title STRING"
    r1 = C.add_employees(seed, spark.createDataFrame([(1, "HUE", "E-NEW", "Ada Probe", "Clerk")],
                                                     schema))
    assert r1.outcome.first().accepted
    r2 = C.patch_employees(r1.tables, spark.createDataFrame(
        [(2, "HUE", "E-NEW", "Ada Probe the Second", "Storekeeper")], schema))
    assert r2.outcome.first().job_title_after == "Storekeeper"
    r3 = C.delete_employees(r2.tables, spark.createDataFrame([(3, "HUE", "E-NEW")],
                                                             "seq BIGINT, branch_code STRING, employee_id STRING"))
    assert r3.outcome.first().accepted
    assert r3.tables.employee.where("employee_id = 'E-NEW'").count() == 0


def test_top_stock_default_and_three(seed):
    top3 = [(r.product_code, r.qty) for r in R.top_stock(seed, 3, "HUE").collect()]
    assert top3 == [("MI_GOI", 220), ("NUOC_SUOI", 140), ("TRA_XANH", 130)]
    assert R.top_stock(seed, None, "HUE").count() == 6   # N NULL -> 8, only 6 rows exist
    assert R.top_stock(seed, 0, "HUE").count() == 6


def test_dashboard_stock_units(seed):
    d = {r.branch_code: r for r in R.branch_dashboard_all(seed).collect()}
    assert (d["HUE"].total_stock_units, d["SAIGON"].total_stock_units, d["HANOI"].total_stock_units) == (740, 725, 690)
    assert d["HUE"].low_stock_products == 0 and d["HUE"].revenue == 0


@pytest.mark.parametrize("day,week", [(dt.date(2023, 1, 1), 1), (dt.date(2023, 1, 8), 2),
                                      (dt.date(2024, 12, 31), 53), (dt.date(2000, 12, 31), 54)])
def test_week_rule(spark, day, week):
    from pyspark.sql import functions as F
    from branchwise.functions.exprs import sql_week
    assert py_week(day) == week
    got = spark.range(1).select(sql_week(F.lit(day)).alias("w")).first().w
    assert got == week


def test_week_bounds_cut_at_year():
    assert week_bounds(dt.date(2023, 1, 1)) == (dt.date(2023, 1, 1), dt.date(2023, 1, 8))
    assert week_bounds(dt.date(2023, 1, 3), -1) is None          # week 1 has no "last week" (Q1)
    assert week_bounds(dt.date(2024, 12, 31)) == (dt.date(2024, 12, 29), dt.date(2025, 1, 1))
