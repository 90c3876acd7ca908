"""Columns that are filled by default (Q-DF)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from branchwise.sources.schemas import SCHEMAS, with_defaults


def test_which_columns_have_defaults():
    found = {(t, f.name): f.metadata["default"] for t, s in SCHEMAS.items() for f in s.fields if "default" in f.metadata}
    assert found == {("branch", "is_active"): "active", ("invoice", "created_at"): "now", ("employee", "branch_code"): "own branch",
                     ("invoice", "branch_code"): "own branch", ("inventory", "branch_code"): "own branch"}


def test_missing_and_null_values_get_them(spark):
    rows = spark.createDataFrame([("B1", "One", None), ("B2", "Two", False)], "branch_code string, branch_name string, is_active boolean")
    assert [tuple(r) for r in with_defaults(rows, "branch").orderBy("branch_code").collect()] == [
        ("B1", "One", None, True), ("B2", "Two", None, False)]
    heads = spark.createDataFrame([("I1", "E1", "HUE"), ("I2", None, "HUE")], "invoice_id string, employee_id string, own string")
    now = dt.datetime(2001, 2, 3, 4, 5)
    got = with_defaults(heads, "invoice", own_branch=F.col("own"), now=F.lit("2001-02-03 04:05:00").cast("timestamp_ntz"))
    assert got.columns == SCHEMAS["invoice"].names
    assert [tuple(r) for r in got.orderBy("invoice_id").collect()] == [("I1", None, now, "HUE", "E1"), ("I2", None, now, "HUE", None)]
    before = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(minutes=1)
    clock = with_defaults(heads, "invoice", own_branch=F.lit("X")).first().created_at
    assert before < clock < before + dt.timedelta(minutes=10)
