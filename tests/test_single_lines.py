"""One-line sales at scale: heads beside lines, requests decided on the row
of their only move, crowded keys, and tables that are read as plans."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest

from branchwise.operators import ordered
from branchwise.operators import sales as S
from branchwise.plans.changesets import NOW
from branchwise.sources import adapter, store
from branchwise.sources.schemas import SCHEMAS, Tables
from tests import replay
from tests.test_replay import state_of

HEAD = "head BIGINT, invoice_id STRING, employee_id STRING, note STRING, branch_code STRING"
LINE = "seq BIGINT, head BIGINT, product_code STRING, qty INT"


def _chain(spark):
    data = {
        "branch": [("HUE", "Hue", None, True), ("SAIGON", "Saigon", None, True), ("OFF", "Off", None, False)],
        "employee": [("H1", "a", "x", "HUE"), ("S1", "b", "x", "SAIGON")],
        "product": [(p, p, Decimal(price)) for p, price in (("P", "2.00"), ("Q", "3.50"), ("R", "1.00"), ("Z", "0.00"))],
        "invoice": [("OLD", "n", NOW, "HUE", "H1"), ("OLD2", "n", NOW, "SAIGON", "S1")],
        "invoice_line": [("OLD", "P", 1, Decimal("2.00"), "HUE"), ("OLD2", "Q", 1, Decimal("3.50"), "SAIGON")],
        "inventory": [("P", "HUE", 20), ("Q", "HUE", 8), ("P", "SAIGON", 12), ("Z", "HUE", 9)],
    }
    return Tables(**{n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()})


def _requests(spark, seed, n=110):
    rng = random.Random(seed)
    ids = [f"N{i}" for i in range(30)] + ["OLD", "OLD2", "OLD", " ", None]
    heads = [(h, rng.choice(ids), *rng.choice([("H1", "HUE"), ("S1", "saigon"), ("H1", " hue"), ("S1", "HUE"), ("H1", "OFF")]))
             for h in range(60)]
    heads = [(h, i, e, f"note {h}", b) for h, i, e, b in heads]
    lines = [(s, rng.randrange(60), rng.choice(["P", "P", "Q", "R", "Z", "X", ""]), rng.choice([1, 2, 3, 9, 0, None]))
             for s in rng.sample(range(1, 10_000), n)]
    return spark.createDataFrame(lines, LINE), spark.createDataFrame(heads, HEAD)


@pytest.mark.parametrize("strict, crowd", [(True, 2), (False, None)])
def test_lines_with_heads_equal_the_serial_replay(spark, monkeypatch, strict, crowd):
    if crowd is not None:  # most keys go the way of crowded ones
        monkeypatch.setattr(ordered, "CROWD", crowd)
    t, (lines, heads) = _chain(spark), _requests(spark, 5)
    rows = [r.asDict() for r in lines.join(heads, "head").collect()]
    state = state_of(t)
    want = replay.post_single_lines(state, rows, strict=strict)
    res = S.post_single_lines(t, lines, strict=strict, now=NOW, heads=heads)
    assert {r.seq: (r.accepted, r.reject_code) for r in res.outcome.collect()} == want
    assert {None, "50000", "50001", "50002", "PK_LINE"} <= {c for _, c in want.values()}
    assert {(r.product_code, r.branch_code): r.qty for r in res.tables.inventory.collect()} == state.stock
    assert {r.invoice_id: r.branch_code for r in res.tables.invoice.collect()} == state.invoices
    first = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        if want[r["seq"]][0]:
            first.setdefault(r["invoice_id"].strip(" "), r["note"])
    notes = {r.invoice_id: r.note for r in res.tables.invoice.collect() if not r.invoice_id.startswith("OLD")}
    assert notes == {i: n for i, n in first.items() if not i.startswith("OLD")}


def test_requests_of_one_move_are_decided_on_its_row(spark, monkeypatch):
    """Only requests of several moves are grouped by request."""
    t = _chain(spark)
    lines = spark.createDataFrame([(s, s % 7, "P", 9) for s in range(1, 30)], LINE)
    heads = spark.createDataFrame([(h, "OLD" if h == 0 else f"N{h}{s}", "H1", "n", "HUE") for h in range(7) for s in [0]], HEAD)
    lines = lines.unionByName(spark.createDataFrame([(100, 1, "Q", 1), (101, 2, "Q", 1)], LINE))
    seen, first = [], S.A._first_round
    monkeypatch.setattr(S.A, "_first_round", lambda m, *a: seen.append(m) or first(m, *a))
    res = S.post_single_lines(t, lines, now=NOW, heads=heads)
    want = replay.post_single_lines(state_of(t), [r.asDict() for r in lines.join(heads, "head").collect()])
    assert {r.seq: (r.accepted, r.reject_code) for r in res.outcome.collect()} == want
    grouped = {r.seq for m in seen for r in m.select("seq").collect()}
    assert not grouped & {100, 101} and grouped <= {*range(1, 30)}


def test_requests_of_one_number_are_decided_together(spark):
    """Whatever their moves: requests of one move have a number of their own."""
    lines = spark.createDataFrame([(1, 1, "Q", 1), (2, 2, "P", 3), (3, 3, "P", 70), (3, 4, "Q", 1)], LINE)
    heads = spark.createDataFrame([(h, f"N{h}", "H1", "n", "HUE") for h in range(1, 5)], HEAD)
    got = [(r.seq, r.product_code, r.reject_code) for r in S.post_single_lines(_chain(spark), lines, now=NOW, heads=heads).outcome.collect()]
    assert sorted(got, key=str) == sorted([(1, "Q", None), (2, "P", None), (3, "P", "50003"), (3, "Q", "50003")], key=str)


def test_few_rows_of_a_key_are_not_spread(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CROWD", 50)
    df = spark.range(1000).selectExpr("id AS seq", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE string(id) END AS k")
    few, crowd = ordered.by_crowd(df, ["k"])
    assert "hot" in {r.k for r in crowd.collect()} and "hot" not in {r.k for r in few.collect()}
    assert few.count() + crowd.count() == 1000
    assert ordered.by_crowd(df.where("k <> 'hot'"), ["k"])[1] is None


def _driver_tables(spark, folder, orders=40):
    """A small driver folder of rows of its own."""
    rng = random.Random(3)
    tables = {
        "region": ([(i, n) for i, n in enumerate(("ASIA", "EUROPE"))], "r_regionkey INT, r_name STRING"),
        "nation": ([(i, i % 2) for i in range(4)], "n_nationkey INT, n_regionkey INT"),
        "customer": ([(i, i % 4) for i in range(9)], "c_custkey BIGINT, c_nationkey INT"),
        "supplier": ([(i, f"s{i}", i % 4) for i in range(6)], "s_suppkey BIGINT, s_name STRING, s_nationkey INT"),
        "part": ([(i, f"p{i}", Decimal("2.50")) for i in range(12)], "p_partkey BIGINT, p_name STRING, p_retailprice DECIMAL(12,2)"),
        "orders": ([(i, i % 9, dt.datetime(2024, 1, 1), f"prio {i % 3}") for i in range(1, orders)],
                   "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
        "lineitem": ([(rng.randrange(1, orders), rng.randrange(12), rng.randrange(6), n % 7 + 1, Decimal(rng.randrange(1, 40)))
                      for n in range(200)],
                     "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DECIMAL(12,2)"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_single_lines_write_neither_invoices_nor_lines(spark, tmp_path, monkeypatch):
    """Only the base tables are written; results are those of written ones."""
    import __spark_entry__ as entry
    from branchwise.plans import requests as RQ

    d = _driver_tables(spark, tmp_path / "driver")
    written = store.open_tables(spark, d, summaries=False)
    want = S.post_single_lines(written, RQ.single_line_requests(spark, d), now=NOW)
    monkeypatch.setattr(store, "_sell", lambda *a: pytest.fail("invoices and lines were written"))
    rows = lambda df: sorted(map(str, df.collect()))
    q = entry.queries()
    assert rows(q["post_single_line"](spark, d)) == rows(want.outcome)
    for name, table in (("invoices", "invoice"), ("lines", "invoice_line"), ("inventory", "inventory")):
        got = q[f"{name}_after_single_lines"](spark, d)
        assert rows(got) == rows(want.tables.get(table).select(*got.columns))


def test_lines_of_some_invoices_are_filtered_first(spark, tmp_path):
    d = _driver_tables(spark, tmp_path / "driver")
    ids = spark.createDataFrame([("3",), ("8",), ("none",)], "invoice_id STRING")
    whole = adapter.canonical_tables(spark, d).invoice_line.join(ids, "invoice_id", "left_semi")
    some = adapter.lines_of(spark, d, ids)
    assert sorted(map(str, some.collect())) == sorted(str(r) for r in whole.select(*some.columns).collect()) != []
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftSemi")


def test_numbers_need_one_shuffle_of_the_rows(spark):
    """The offsets of the partitions are broadcast."""
    plan = ordered.numbered(spark.range(100).toDF("a"), ["a"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
