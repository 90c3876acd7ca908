"""Random ordered batches of P1-P3, P5, P7, P8 equal a plain serial replay."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest

from branchwise.operators import changes as C
from branchwise.sources.schemas import SCHEMAS, Tables

BRANCHES = ["HUE", "SAIGON"]


def _blank(x):
    return x is None or x.strip(" ") == ""


def _tables(spark, rng):
    emps = [(f"E{i}", f"Name{i}", "Cashier", rng.choice(BRANCHES)) for i in range(6)]
    prods = [(f"P{i}", f"Prod{i}", Decimal(rng.choice(["1.00", "5.50"]))) for i in range(5)]
    inv = [(f"P{i}", b, rng.randint(0, 9)) for i in range(5) for b in BRANCHES if rng.random() < 0.8]
    invoices = [("I1", None, None, "HUE", "E0")]
    data = {"branch": [(b, b, None, True) for b in BRANCHES], "employee": emps, "product": prods,
            "invoice": [(i, n, __import__("datetime").datetime(2024, 1, 1), b, e) for i, n, _, b, e in invoices],
            "inventory": inv, "invoice_line": []}
    return Tables(**{n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()}), emps, prods, inv


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_employee_batches(spark, seed):
    rng = random.Random(seed)
    t, emps, _, _ = _tables(spark, rng)
    ids = ["E0", "E1", "E5", "E9", " E9", "X1", "", None]
    names = ["A", "  ", None, "B"]
    rows = [(i * 3 + 1, rng.choice(BRANCHES + ["hue", "NOPE"]), rng.choice(ids), rng.choice(names),
             rng.choice(names)) for i in range(60)]
    schema = "seq BIGINT, branch_code STRING, employee_id STRING, full_name STRING, job_title STRING"
    req = spark.createDataFrame(rows, schema)

    # P1 add: serial replay
    table = {e[0]: e[3] for e in emps}
    want = {}
    for seq, b, i, n, j in sorted(rows):
        bb = (b or "").strip(" ").upper()
        if bb not in BRANCHES:
            want[seq] = "BAD_BRANCH"
        elif _blank(i) or _blank(n) or _blank(j):
            want[seq] = "50000"
        elif i.strip(" ") in table:
            want[seq] = "50001"
        else:
            table[i.strip(" ")] = bb
            want[seq] = None
    got = {r.seq: r.reject_code for r in C.add_employees(t, req).outcome.collect()}
    assert got == want

    # P2 patch: serial replay with the row right after each request
    state = {e[0]: [e[1], e[2], e[3]] for e in emps}
    want = {}
    for seq, b, i, n, j in sorted(rows):
        bb = (b or "").strip(" ").upper()
        if bb not in BRANCHES:
            want[seq] = ("BAD_BRANCH", None, None)
        elif _blank(i):
            want[seq] = ("50000", None, None)
        elif i.strip(" ") not in state or state[i.strip(" ")][2] != bb:
            want[seq] = ("50001", None, None)
        else:
            row = state[i.strip(" ")]
            row[0] = row[0] if _blank(n) else n.strip(" ")
            row[1] = row[1] if _blank(j) else j.strip(" ")
            want[seq] = (None, row[0], row[1])
    got = {r.seq: (r.reject_code, r.full_name_after, r.job_title_after)
           for r in C.patch_employees(t, req).outcome.collect()}
    assert got == want

    # P3 delete
    dreq = req.select("seq", "branch_code", "employee_id")
    alive = {e[0]: e[3] for e in emps}
    used = {"E0"}
    want = {}
    for seq, b, i, _, _ in sorted(rows):
        bb = (b or "").strip(" ").upper()
        if bb not in BRANCHES:
            want[seq] = "BAD_BRANCH"
        elif _blank(i):
            want[seq] = "50000"
        elif alive.get(i.strip(" ")) != bb:
            want[seq] = "50001"
        elif i.strip(" ") in used:
            want[seq] = "FK_INVOICE"
        else:
            del alive[i.strip(" ")]
            want[seq] = None
    got = {r.seq: r.reject_code for r in C.delete_employees(t, dreq).outcome.collect()}
    assert got == want


@pytest.mark.parametrize("seed", [21, 22])
def test_product_and_stock_batches(spark, seed):
    rng = random.Random(seed)
    t, _, prods, inv = _tables(spark, rng)
    codes = ["P0", "P1", "P4", " P2 ", "P9", "", None]
    prices = [None, Decimal("0"), Decimal("-1"), Decimal("2.25"), Decimal("7")]
    rows = [(i * 2 + 1, rng.choice(codes), rng.choice(["New", "  ", None]), rng.choice(prices)) for i in range(50)]
    req = spark.createDataFrame(rows, "seq BIGINT, product_code STRING, product_name STRING, unit_price DECIMAL(10,2)")
    cat = {p[0]: [p[1], p[2]] for p in prods}
    want = {}
    for seq, c, n, p in sorted(rows):
        if _blank(c) or (p is not None and p <= 0):
            want[seq] = ("50000", None, None)
        elif c.strip(" ") not in cat:
            want[seq] = ("50001", None, None)
        else:
            row = cat[c.strip(" ")]
            row[0] = row[0] if _blank(n) else n.strip(" ")
            row[1] = row[1] if p is None else p
            want[seq] = (None, row[0], row[1])
    got = {r.seq: (r.reject_code, r.product_name_after, r.unit_price_after)
           for r in C.patch_products(t, req).outcome.collect()}
    assert got == want

    srows = [(i * 2 + 1, rng.choice(BRANCHES + ["saigon ", "NOPE"]), rng.choice(codes),
              rng.choice([None, -2, 0, 1, 4])) for i in range(60)]
    sreq = spark.createDataFrame(srows, "seq BIGINT, branch_code STRING, product_code STRING, qty INT")
    for op in ("set", "receive"):
        stock = {(p, b): q for p, b, q in inv}
        want = {}
        for seq, b, c, q in sorted(srows):
            bb = (b or "").strip(" ").upper()
            key = ((c or "").strip(" "), bb)
            bad_qty = (q is not None) and (q < 0 if op == "set" else q <= 0)
            if bb not in BRANCHES or _blank(c) or bad_qty:
                want[seq] = ("50000", None)
            elif key not in stock:
                want[seq] = ("50001", None)
            elif q is None:
                want[seq] = ("NOT_NULL", None)
            else:
                stock[key] = q if op == "set" else stock[key] + q
                want[seq] = (None, stock[key])
        fn = C.set_stock if op == "set" else C.receive_stock
        got = {r.seq: (r.reject_code, r.qty_after) for r in fn(t, sreq).outcome.collect()}
        assert got == want, op
