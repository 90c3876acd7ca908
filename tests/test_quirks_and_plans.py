"""Quirks of the reference and the shape of physical plans."""

from __future__ import annotations

import datetime as dt
import io
import contextlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from branchwise.operators import changes as C
from branchwise.operators import listings as L
from branchwise.operators import reports as R
from branchwise.operators import sales as S
from branchwise.plans.params import AS_OF
from branchwise.sources.schemas import SCHEMAS, Tables
from tests.conftest import SF001


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def tiny(spark):
    data = {
        "branch": [("HUE", "Hue", None, True), ("SAIGON", "Saigon", None, True)],
        "employee": [("H1", "A", "Cashier", "HUE"), ("S1", "B", "Cashier", "SAIGON")],
        "product": [("P1", "One", Decimal("10.00")), ("P2", "Two", Decimal("0.00"))],
        "invoice": [("I1", None, dt.datetime(2024, 1, 2), "HUE", "H1"),
                    ("I2", "no lines", dt.datetime(2024, 1, 2), "HUE", "H1")],
        "inventory": [("P1", "HUE", 5), ("P2", "HUE", 5)],
        "invoice_line": [("I1", "P1", 2, Decimal("10.00"), "HUE")],
    }
    return Tables(**{n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()})


def test_q4_invoice_without_lines(tiny):
    rows = {r.invoice_id: r for r in L.invoice_list(tiny).collect()}
    assert rows["I2"].total is None and rows["I2"].line_count == 0
    assert rows["I1"].total == Decimal("20.00")
    trend = {r.day: r.revenue for r in R.branch_revenue_7d(tiny, dt.date(2024, 1, 3), "HUE").collect()}
    assert len(trend) == 7 and trend[dt.date(2024, 1, 2)] == Decimal("20.00") and trend[dt.date(2024, 1, 3)] == 0


def test_q1_last_week_of_week_one_is_zero(tiny):
    r = {x.branch_code: x for x in R.week_compare(tiny, dt.date(2024, 1, 3)).collect()}
    assert r["HUE"].this_week == Decimal("20.00") and r["HUE"].last_week == 0


def test_q5_missing_stock_row_strict_and_not(spark, tiny):
    req = spark.createDataFrame([(1, "N1", "S1", "P1", 1, None, "SAIGON")],
                                "seq BIGINT, invoice_id STRING, employee_id STRING, product_code STRING, qty INT, "
                                "note STRING, branch_code STRING")
    assert S.post_single_lines(tiny, req).outcome.first().reject_code == "50003"
    assert S.post_single_lines(tiny, req, strict=False).outcome.first().accepted


def test_q6_existing_invoice_same_product_is_pk_line(spark, tiny):
    req = spark.createDataFrame([(1, "I1", "H1", "P1", 1, None, "HUE"), (2, "I1", "H1", "P2", 1, None, "HUE")],
                                "seq BIGINT, invoice_id STRING, employee_id STRING, product_code STRING, qty INT, "
                                "note STRING, branch_code STRING")
    out = {r.seq: r.reject_code for r in S.post_single_lines(tiny, req).outcome.collect()}
    assert out[1] == "PK_LINE"
    assert out[2] == "50001"            # catalogue price 0 is not a valid price


def test_q13_null_transfer_quantity(spark, tiny):
    req = spark.createDataFrame([(1, "HUE", "SAIGON", "P1", None), (2, "HUE", "HUE", "P1", 1)],
                                "seq BIGINT, from_branch STRING, to_branch STRING, product_code STRING, qty INT")
    out = {r.seq: r.reject_code for r in S.transfer_stock(tiny, req).outcome.collect()}
    assert out == {1: "50001", 2: "50000"}


def test_q7_employee_with_invoices_cannot_be_deleted(spark, tiny):
    req = spark.createDataFrame([(1, "HUE", "H1")], "seq BIGINT, branch_code STRING, employee_id STRING")
    assert C.delete_employees(tiny, req).outcome.first().reject_code == "FK_INVOICE"


def test_q15_patch_price_zero_rejected_null_keeps(spark, tiny):
    req = spark.createDataFrame([(1, "P1", "  ", Decimal("0.00")), (2, "P1", None, None)],
                                "seq BIGINT, product_code STRING, product_name STRING, unit_price DECIMAL(10,2)")
    out = {r.seq: r for r in C.patch_products(tiny, req).outcome.collect()}
    assert out[1].reject_code == "50000"
    assert out[2].accepted and out[2].unit_price_after == Decimal("10.00") and out[2].product_name_after == "One"


def test_transfer_creates_destination_row_then_it_can_be_sold_from(spark, tiny):
    req = spark.createDataFrame([(1, "HUE", "SAIGON", "P1", 3), (2, "SAIGON", "HUE", "P1", 2),
                                 (3, "SAIGON", "HUE", "P1", 2)],
                                "seq BIGINT, from_branch STRING, to_branch STRING, product_code STRING, qty INT")
    out = {r.seq: (r.accepted, r.reject_code, r.to_before) for r in S.transfer_stock(tiny, req).outcome.collect()}
    assert out == {1: (True, None, None), 2: (True, None, 2), 3: (False, "50003", None)}


# ---------------------------------------------------------------- plans
def test_fragment_read_prunes_partitions(spark, tables):
    df = tables.invoice.where(F.col("branch_code") == "ASIA").select("invoice_id")
    assert "PartitionFilters: [isnotnull(branch_code" in plan_text(df)


def test_week_filter_reaches_the_scan(spark, tables):
    plan = plan_text(R.best_product_week(tables, AS_OF))
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(day" in line and "LessThan(day" in line for line in pushed), pushed
    assert "WindowGroupLimit" in plan
    plan = plan_text(R.best_employee_week(tables, AS_OF))
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(created_at" in line for line in pushed), pushed


def test_no_python_udf_in_any_registered_plan(spark):
    from branchwise.plans import registry
    qs = registry.queries()
    for name in qs:
        plan = plan_text(qs[name](spark, SF001))
        for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
            assert node not in plan, (name, node)


def test_scan_reads_only_needed_columns(spark, tables):
    plan = plan_text(R.revenue_by_branch(tables))
    # the invoice scan of this report needs neither note nor created_at
    scans = [line for line in plan.splitlines() if line.strip().startswith("ReadSchema")]
    assert scans and not any("note" in s for s in scans)


def test_product_create_service_rules(spark, tiny):
    req = spark.createDataFrame([(1, "P7", "", Decimal("3.00")), (2, "P8", "  ", Decimal("3.00")),
                                 (3, "P9", "Nine", None)],
                                "seq BIGINT, product_code STRING, product_name STRING, unit_price DECIMAL(10,2)")
    proc = {r.seq: r.reject_code for r in C.create_products(tiny, req).outcome.collect()}
    assert proc == {1: "50000", 2: "50000", 3: "NOT_NULL"}
    res = C.create_products(tiny, req, service_rules=True)
    svc = {r.seq: r.reject_code for r in res.outcome.collect()}
    assert svc == {1: None, 2: "50000", 3: "50000"}
    assert res.tables.product.where("product_code = 'P7'").first().product_name == "P7"


def test_json_sink_roundtrip(spark, tables):
    import os
    import tempfile
    report = R.daily_revenue(tables)
    path = os.path.join(tempfile.mkdtemp(prefix="bw-json-", dir=os.environ.get("BRANCHWISE_TMP", "/tmp")), "out")
    L.export_json(report, path)
    back = spark.read.schema(report.schema).json(path)
    from tests.compare import canon
    assert canon(back.columns, back.collect()) == canon(report.columns, report.collect())


def test_generated_ids_are_deterministic_and_unique(spark, tiny):
    import json
    items = json.dumps([{"MaSP": "P1", "SoLuong": 1}])
    req = spark.createDataFrame([(1, None, "H1", "a", "HUE", items), (2, "X", "H1", "b", "HUE", items)],
                                "seq BIGINT, invoice_id STRING, employee_id STRING, note STRING, "
                                "branch_code STRING, items_json STRING")
    out = {r.seq: (r.invoice_id, r.accepted) for r in S.post_invoices(tiny, req, generate_ids="B7").outcome.collect()}
    assert out == {1: ("HD_B7_1", True), 2: ("HD_B7_2", True)}
    emp = spark.createDataFrame([(5, "hue", " ", "New", "Cashier")],
                                "seq BIGINT, branch_code STRING, employee_id STRING, full_name STRING, job_title STRING")
    o = C.add_employees(tiny, emp, generate_ids="B7").outcome.first()
    assert (o.employee_id, o.accepted) == ("HB7_5", True)


def test_s10_replication_columns_are_hidden(spark, tiny):
    emp = tiny.employee.withColumn("RowGuid", F.lit("x")).withColumn("rowid", F.lit(1))
    cols = L.employees_by_branch(tiny.with_tables(employee=emp), "HUE").columns
    assert cols == ["employee_id", "full_name", "job_title", "branch_code"]


def test_central_only_operations_refuse_other_callers(spark, tiny):
    req = spark.createDataFrame([(1, "P1", "X", None, " central "), (2, "P1", "Y", None, "HUE"), (3, "P1", "Z", None, None)],
                                "seq BIGINT, product_code STRING, product_name STRING, unit_price DECIMAL(10,2), "
                                "caller STRING")
    out = {r.seq: r.reject_code for r in C.patch_products(tiny, req).outcome.collect()}
    assert out == {1: None, 2: "CENTRAL_ONLY", 3: "CENTRAL_ONLY"}
    tr = spark.createDataFrame([(1, "HUE", "SAIGON", "P1", 1, "SAIGON")],
                               "seq BIGINT, from_branch STRING, to_branch STRING, product_code STRING, qty INT, caller STRING")
    assert S.transfer_stock(tiny, tr).outcome.first().reject_code == "CENTRAL_ONLY"


def test_packed_documents_hold_whole_invoices(tables, monkeypatch):
    """One document per invoice, or pages that are full but the last."""
    from branchwise.operators import listings as L
    lines = tables.invoice_line.groupBy("invoice_id", "branch_code").count().collect()
    n = {(r.invoice_id, r.branch_code): r["count"] for r in lines}
    assert max(n.values()) > 3
    for most in (L.PAGE_ITEMS, 3):
        monkeypatch.setattr(L, "PAGE_ITEMS", most)
        got = {}
        for r in L.pack_invoice_items(tables).collect():
            got.setdefault((r.invoice_id, r.branch_code), {})[r.page] = len(json.loads(r.items_json))
        assert got == {k: {p: min(most, c - p * most) for p in range(-(-c // most))} for k, c in n.items()}


def test_overview_scans_the_totals_at_most_twice(spark, tables):
    from branchwise.operators import bundles as B
    # a pruning subquery reads only what a join has broadcast
    plan = plan_text(B.analytics_overview_long(tables, AS_OF)).partition("===== Subqueries")[0]
    scans = [line for line in plan.splitlines() if line.strip().startswith("Location") and "invoice_summary" in line]
    assert 1 <= len(scans) <= 2, plan


def test_overview_equals_its_reports(spark, tables):
    """Also in week 1, where there is no last week."""
    from branchwise.operators import bundles as B
    for as_of in (AS_OF, "2001-01-03"):
        got = {}
        for r in B.analytics_overview_long(tables, as_of).collect():
            got.setdefault(r.report, set()).add((r.branch_code, r.item_key, r.count_value, r.amount, r.amount2))
        want = B.analytics_overview(tables, as_of)
        assert got["daily"] == {(r.branch_code, r.day.isoformat(), r.order_count, r.revenue, None) for r in want["daily"].collect()}
        assert {(b, n, a) for b, _, n, a, _ in got["weekly"]} == {(r.branch_code, r.order_count, r.revenue) for r in want["weekly"].collect()}
        assert len(got["weekly"]) == want["weekly"].count()
        assert got.get("week_compare", set()) == {(r.branch_code, None, None, r.this_week, r.last_week) for r in want["week_compare"].collect()}
