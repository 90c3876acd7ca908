"""Opt-in key folding: ids match ignoring case and surrounding blanks."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest

from branchwise.functions.keys import fold_keys, fold_tables
from branchwise.operators import changes as C
from branchwise.operators import sales as S
from branchwise.sources.schemas import SCHEMAS, Tables


@pytest.fixture(scope="module")
def chain(spark):
    data = {
        "branch": [("HUE", "Hue", None, True)],
        "employee": [("H003", "Pham Thi C", "Ban hang", "HUE")],
        "product": [("MI_GOI", "Mi goi", Decimal("12000")), ("NUOC_SUOI", "Nuoc suoi", Decimal("7000"))],
        "invoice": [("HD_taomoi ", "x", dt.datetime(2024, 1, 2), "HUE", "H003")],
        "inventory": [("MI_GOI", "HUE", 220), ("NUOC_SUOI", "HUE", 140)],
        "invoice_line": [("HD_taomoi ", "MI_GOI", 3, Decimal("12000"), "HUE")],
    }
    return Tables(**{n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()})


def _sale(spark, invoice_id, code):
    items = json.dumps([{"MaSP": code, "SoLuong": 1}])
    return spark.createDataFrame([(1, invoice_id, "h003", "n", "HUE", items)],
                                 "seq BIGINT, invoice_id STRING, employee_id STRING, note STRING, "
                                 "branch_code STRING, items_json STRING")


def test_exact_ids_by_default(spark, chain):
    assert S.post_invoices(chain, _sale(spark, "HD_Taomoi", "mi_goi")).outcome.first().reject_code == "50001"


def test_folded_ids_match_like_the_reference(spark, chain):
    t = fold_tables(chain)
    out = S.post_invoices(t, fold_keys(_sale(spark, "HD_Taomoi", "mi_goi")), fold_item_codes=True).outcome.first()
    assert out.reject_code == "PK_LINE"          # same invoice, same product
    res = S.post_invoices(t, fold_keys(_sale(spark, "HD_Taomoi", "nuoc_suoi")), fold_item_codes=True)
    out = res.outcome.first()
    assert out.accepted and out.invoice_id == "HD_TAOMOI"
    assert res.tables.invoice_line.where("invoice_id = 'HD_TAOMOI'").count() == 2
    emp = spark.createDataFrame([(1, "HUE", "h003 ", "Dup", "Ban hang")],
                                "seq BIGINT, branch_code STRING, employee_id STRING, full_name STRING, job_title STRING")
    assert C.add_employees(t, fold_keys(emp)).outcome.first().reject_code == "50001"
