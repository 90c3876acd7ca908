"""Spark's ordered replay (bounds iteration) equals a plain serial replay.

Registered keys are checked on the whole sf0.001 tables; random mixes on a
small hand-made chain cover transfers that create stock rows which later
requests then consume.
"""

from __future__ import annotations

import random
from decimal import Decimal

import pytest

from branchwise.operators import sales as S
from branchwise.plans import requests as RQ
from branchwise.plans.changesets import NOW
from branchwise.sources.schemas import SCHEMAS, Tables
from tests import replay
from tests.conftest import SF001


def state_of(t: Tables) -> replay.State:
    return replay.State(
        branches=[r.branch_code for r in t.branch.where("is_active").collect()],
        employees=[(r.employee_id, r.branch_code) for r in t.employee.collect()],
        products={r.product_code: r.unit_price for r in t.product.collect()},
        inventory={(r.product_code, r.branch_code): r.qty for r in t.inventory.collect()},
        invoices={r.invoice_id: r.branch_code for r in t.invoice.collect()},
        lines=[(r.invoice_id, r.product_code) for r in t.invoice_line.collect()],
    )


def test_post_invoices_equals_serial_replay(spark, tables):
    req, items = RQ.sale_requests(spark, SF001), RQ.sale_items(spark, SF001)
    res = S.post_invoices(tables, req, now=NOW, items=items)
    got = {r.seq: (r.accepted, r.reject_code, r.line_count, r.total) for r in res.outcome.collect()}
    st, rows = state_of(tables), replay.with_documents([r.asDict() for r in req.collect()], [r.asDict() for r in items.collect()])
    want = replay.post_invoices(st, rows)
    assert got == want
    codes = {v[1] for v in want.values()}
    assert {None, "50001", "50005", "PK_LINE"} <= codes, codes
    # stock after the batch equals the replay's
    new_stock = {(r.product_code, r.branch_code): r.qty for r in res.tables.inventory.collect()}
    assert new_stock == st.stock


def test_a_failed_sale_leaves_its_invoice_id_free(spark):
    """HUE's sale of a new id fails on stock, so SAIGON's sale of it passes;
    then the id is SAIGON's."""
    data = {
        "branch": [("HUE", "Hue", None, True), ("SAIGON", "Saigon", None, True)],
        "employee": [("H1", "a", "x", "HUE"), ("S1", "b", "x", "SAIGON")],
        "product": [("P", "p", Decimal("2.00"))], "invoice": [], "invoice_line": [],
        "inventory": [("P", "HUE", 5), ("P", "SAIGON", 5)],
    }
    t = Tables(**{n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()})
    sales = [(1, "A", "H1", "HUE", 9), (2, "A", "S1", "SAIGON", 3), (3, "A", "H1", "HUE", 1), (4, "B", "H1", "HUE", 2)]
    req = spark.createDataFrame([(s, i, e, "n", b) for s, i, e, b, _ in sales],
                                "seq BIGINT, invoice_id STRING, employee_id STRING, note STRING, branch_code STRING")
    items = spark.createDataFrame([(s, "P", q, None) for s, _, _, _, q in sales],
                                  "seq BIGINT, item_code STRING, item_qty INT, item_price DECIMAL(10,2)")
    got = {r.seq: r.reject_code for r in S.post_invoices(t, req, items=items).outcome.collect()}
    assert got == {1: "50005", 2: None, 3: "PK_INVOICE", 4: None}
    one = req.join(items.selectExpr("seq", "item_code AS product_code", "item_qty AS qty"), "seq")
    got = {r.seq: r.reject_code for r in S.post_single_lines(t, one).outcome.collect()}
    assert got == {1: "50003", 2: None, 3: "PK_INVOICE", 4: None}


def test_post_single_lines_equals_serial_replay(spark, tables):
    req = RQ.single_line_requests(spark, SF001)
    rows = [r.asDict() for r in req.collect()]
    for strict in (True, False):
        res = S.post_single_lines(tables, req, strict=strict, now=NOW)
        got = {r.seq: (r.accepted, r.reject_code) for r in res.outcome.collect()}
        assert got == replay.post_single_lines(state_of(tables), rows, strict=strict)


def test_transfers_equal_serial_replay(spark, tables):
    req = RQ.transfer_requests(spark, SF001)
    res = S.transfer_stock(tables, req)
    got = {r.seq: (r.accepted, r.reject_code, r.from_before, r.to_before) for r in res.outcome.collect()}
    st = state_of(tables)
    want = replay.transfers(st, [r.asDict() for r in req.collect()])
    assert got == want
    assert res.rounds >= 1
    new_stock = {(r.product_code, r.branch_code): r.qty for r in res.tables.inventory.collect()}
    assert new_stock == st.stock


def _small_chain(spark, rng):
    branches = ["HUE", "SAIGON", "HANOI"]
    products = [f"P{i}" for i in range(8)]
    data = {
        "branch": [(b, b.title(), None, True) for b in branches],
        "employee": [(f"{b[0]}{i}", f"Name {b}{i}", "Cashier", b) for b in branches for i in range(2)],
        "product": [(p, f"Product {p}", Decimal(rng.choice(["0.00", "5.00", "12.50"]))) for p in products],
        "invoice": [],
        "inventory": [(p, b, rng.randint(0, 12)) for p in products for b in branches if rng.random() < 0.7],
        "invoice_line": [],
    }
    return Tables(**{n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_transfers_match_replay(spark, seed):
    rng = random.Random(seed)
    t = _small_chain(spark, rng)
    codes = [f"P{i}" for i in range(8)] + [" P1 ", "", "P99"]
    bs = ["HUE", "SAIGON", "HANOI", " hue", "CENTRAL"]
    rows = [(i * 3 + 1, rng.choice(bs), rng.choice(bs), rng.choice(codes), rng.choice([None, -1, 0, 1, 2, 3, 5, 8]))
            for i in range(120)]
    req = spark.createDataFrame(rows, "seq BIGINT, from_branch STRING, to_branch STRING, product_code STRING, qty INT")
    res = S.transfer_stock(t, req)
    got = {r.seq: (r.accepted, r.reject_code, r.from_before, r.to_before) for r in res.outcome.collect()}
    want = replay.transfers(state_of(t), [r.asDict() for r in req.collect()])
    assert got == want


@pytest.mark.parametrize("seed", [4, 5])
def test_random_sales_match_replay(spark, seed):
    import json
    rng = random.Random(seed)
    t = _small_chain(spark, rng)
    emps = ["H0", "H1", "S0", "N1", "X9", " H0 ", ""]
    rows = []
    for i in range(80):
        items = [{"MaSP": rng.choice([f"P{j}" for j in range(8)] + [" P2", ""]),
                  "SoLuong": rng.choice([1, 2, 3, 4, 0, None])} for _ in range(rng.randint(0, 3))]
        for it in items:
            if rng.random() < 0.4:
                it["DonGia"] = rng.choice([0, 3.5, 9])
        doc = rng.choice([json.dumps(items), json.dumps(items), "not json", None])
        rows.append((i * 2 + 1, rng.choice(["INV1", "INV2", f"INV{i}", " "]), rng.choice(emps), "n",
                     rng.choice(["HUE", "SAIGON", "HANOI", "hue "]), doc))
    req = spark.createDataFrame(rows, "seq BIGINT, invoice_id STRING, employee_id STRING, note STRING, "
                                      "branch_code STRING, items_json STRING")
    res = S.post_invoices(t, req, now=NOW)
    got = {r.seq: (r.accepted, r.reject_code, r.line_count, r.total) for r in res.outcome.collect()}
    want = replay.post_invoices(state_of(t), [r.asDict() for r in req.collect()])
    assert got == want


def test_lines_that_cannot_collide_make_no_move(spark, monkeypatch):
    """Only lines of existing invoices and repeated ones are moves of the
    replay; the others cannot be on their invoice already."""
    data = {
        "branch": [("HUE", "Hue", None, True)], "employee": [("H1", "a", "x", "HUE")],
        "product": [("P", "p", Decimal("2.00")), ("Q", "q", Decimal("2.00"))],
        "invoice": [("OLD", "n", NOW, "HUE", "H1")], "invoice_line": [("OLD", "P", 1, Decimal("2.00"), "HUE")],
        "inventory": [("P", "HUE", 9), ("Q", "HUE", 9)],
    }
    t = Tables(**{n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()})
    sales = [(1, "A", "P"), (2, "A", "Q"), (3, "A", "Q"), (4, "OLD", "P"), (5, "OLD", "Q"), (6, "B", "P")]
    req = spark.createDataFrame([(s, i, "H1", p, 1, "n", "HUE") for s, i, p in sales],
                                "seq BIGINT, invoice_id STRING, employee_id STRING, product_code STRING, qty INT, note STRING, "
                                "branch_code STRING")
    seen, settle = [], S.A.settle
    monkeypatch.setattr(S.A, "settle", lambda moves, *a, **k: seen.append(moves) or settle(moves, *a, **k))
    got = {r.seq: r.reject_code for r in S.post_single_lines(t, req).outcome.collect()}
    assert got == {1: None, 2: None, 3: "PK_LINE", 4: "PK_LINE", 5: None, 6: None}
    assert sorted(r.seq for r in seen[0].where("kind = 'L'").collect()) == [2, 3, 4, 5]
