"""Snapshot publishing: a change batch becomes the next store version."""

from __future__ import annotations


import glob
import os
import tempfile

from pyspark.sql import functions as F

from branchwise.operators import changes as C
from branchwise.operators import quality as Q
from branchwise.operators import reports as R
from branchwise.operators import sales as S
from branchwise.operators.views import invoice_summary, invoice_totals, product_day_summary
from branchwise.plans import requests as RQ
from branchwise.plans.changesets import NOW
from branchwise.sources.schemas import SCHEMAS
from branchwise.sources.store import STORED, Store, _together, open_store
from tests.compare import canon
from tests.conftest import SF001


def test_commit_publishes_a_consistent_next_version(spark):
    store = open_store(spark, SF001)
    res = S.post_invoices(store.tables, RQ.sale_requests(spark, SF001), now=NOW, items=RQ.sale_items(spark, SF001))
    accepted = res.outcome.where("accepted").count()
    new = store.commit(res.tables)
    assert new.version == store.version + 1
    # untouched tables are carried over, not rewritten
    assert new.paths["employee"] == store.paths["employee"]
    assert new.paths["inventory"] != store.paths["inventory"]
    again = Store.open(spark, store.root)
    assert again.version == new.version
    t = again.tables
    # integrity holds on the published snapshot
    assert Q.duplicate_keys(t).count() == 0
    viol = {r.constraint_name: r.violations for r in Q.check_violations(t).collect()}
    assert viol["inventory_qty_nonneg"] == 0
    assert t.invoice_line.count() > store.tables.invoice_line.count()
    assert accepted > 0
    # the rebuilt summary equals totals computed from the lines
    from_summary = invoice_totals(t).select("invoice_id", "total", "n_lines")
    from_lines = invoice_totals(t.with_tables(invoice_summary=None)).select("invoice_id", "total", "n_lines")
    assert canon(from_summary.columns, from_summary.collect()) == canon(from_lines.columns, from_lines.collect())
    # the registered queries still read version 0
    assert open_store(spark, SF001).version == 0


def test_days_are_cut_in_utc_whatever_the_session_zone(spark):
    root = open_store(spark, SF001).root
    base = R.daily_revenue(Store.open(spark, root).tables)      # newest version, UTC session
    want = canon(base.columns, base.collect())
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        t = Store.open(spark, root).tables             # opening resets the session to UTC
        got = R.daily_revenue(t)
        assert canon(got.columns, got.collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_files_of_a_branch_grow_with_its_rows(spark):
    """A large branch is written by several tasks, a small one by one; rows of
    a file follow the date."""
    base = tempfile.mkdtemp(prefix="bw-files-", dir=os.environ.get("BRANCHWISE_TMP", "/tmp"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        counts = {}
        for n in (20_000, 400_000):
            rows = spark.range(0, n, 1, n // 5000).select(  # input splits grow with the data
                F.when(F.col("id") % 20 == 0, "SMALL").otherwise("LARGE").alias("branch_code"),
                F.xxhash64("id").alias("created_at"), F.sha2(F.col("id").cast("string"), 256).alias("note"))
            _together(rows, f"{base}/{n}", "created_at")
            counts[n] = {b: len(glob.glob(f"{base}/{n}/branch_code={b}/*.parquet")) for b in ("SMALL", "LARGE")}
        assert counts[20_000]["LARGE"] <= 8 < 40 <= counts[400_000]["LARGE"]
        assert counts[400_000]["SMALL"] < counts[400_000]["LARGE"] / 8
        assert spark.read.parquet(f"{base}/400000").distinct().count() == 400_000
        for f in glob.glob(f"{base}/400000/branch_code=LARGE/*.parquet")[:5]:
            dates = [r.created_at for r in spark.read.parquet(f).collect()]
            assert dates == sorted(dates)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def _same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got.columns, got.collect()) == canon(got.columns, want.select(*got.columns).collect())


def _holds(t, state):
    """The tables hold the rows of ``state``, their summaries those of the lines."""
    for name in SCHEMAS:
        _same(t.get(name), state.get(name).select(*t.get(name).columns))
    _same(t.invoice_summary, invoice_summary(t))
    days = t.product_day_summary.groupBy("branch_code", "day", "product_code").agg(
        F.sum("units").alias("units"), F.sum("amount").alias("amount"), F.sum("n_lines").alias("n_lines")).where("n_lines > 0")
    want = product_day_summary(t)
    _same(days, want.withColumn("amount", F.col("amount").cast(days.schema["amount"].dataType)))


def _files(t, name, branch=None):
    rows = t.get(name) if branch is None else t.get(name).where(F.col("branch_code") == branch)
    return {f for f in rows.inputFiles() if branch is None or f"/branch_code={branch.replace(' ', '%20')}/" in f}


def _own_store(spark):
    """A store of the same data in which a test publishes."""
    tables = open_store(spark, SF001).tables
    mine = Store(spark, tempfile.mkdtemp(prefix="bw-store-", dir=os.environ.get("BRANCHWISE_TMP", "/tmp")), -1, {}, tables)
    return mine.commit(tables, whole=SCHEMAS)


def test_ten_sales_rewrite_no_other_partition(spark):
    store = _own_store(spark)
    assert store.version == 0
    t = store.tables
    every = RQ.sale_requests(spark, SF001)
    ten = S.post_invoices(t, every, now=NOW, items=RQ.sale_items(spark, SF001)).outcome \
        .where("accepted AND branch_code = 'ASIA'").orderBy("seq").limit(10).select("seq")
    assert ten.count() == 10
    res = S.post_invoices(t, every.join(ten, "seq"), now=NOW, items=RQ.sale_items(spark, SF001).join(ten, "seq"))
    sold = {r.invoice_id for r in res.outcome.where("accepted").collect()}
    new = store.commit(res.tables)
    _holds(new.tables, res.tables)
    assert new.paths["product"] == store.paths["product"]
    for name in ("invoice", "invoice_line", "product_day_summary"):    # rows are added beside the old files
        assert _files(t, name) < _files(new.tables, name)
    fresh = not t.invoice.where(F.col("invoice_id").isin(*sold)).count()
    assert fresh == (_files(t, "invoice_summary") < _files(new.tables, "invoice_summary"))
    for name in ("inventory", "invoice_summary"):                      # other branches keep theirs
        for r in t.branch.where("branch_code <> 'ASIA'").collect():
            assert _files(t, name, r.branch_code) == _files(new.tables, name, r.branch_code) != set()
    assert not _files(t, "inventory", "ASIA") & _files(new.tables, "inventory", "ASIA")


def test_commits_of_rows_follow_one_another(spark):
    """Sales, deleted and replaced invoices and transfers, published one after
    the other, then written whole."""
    store = _own_store(spark)
    steps = [
        lambda t: S.post_invoices(t, RQ.sale_requests(spark, SF001), now=NOW, items=RQ.sale_items(spark, SF001)),
        lambda t: C.delete_invoices(t, t.invoice.where("branch_code IN ('ASIA', 'MIDDLE EAST') AND hash(invoice_id) % 3 = 0").select(
            F.xxhash64("invoice_id").alias("seq"), "branch_code", "invoice_id")),
        lambda t: C.replace_invoices(t, t.invoice.where("branch_code = 'EUROPE' AND hash(invoice_id) % 5 = 0").select(
            F.xxhash64("invoice_id").alias("seq"), "branch_code", "invoice_id", F.lit("1").alias("product_code"),
            F.lit(None).cast("string").alias("product_name"), F.lit(3).alias("qty"), F.lit(7).cast("decimal(10,2)").alias("unit_price"),
            F.lit(None).cast("decimal(18,2)").alias("total_amount"), F.lit(None).cast("string").alias("employee_id"),
            F.lit("new").alias("note"))),
        lambda t: S.transfer_stock(t, RQ.transfer_requests(spark, SF001)),
    ]
    for k, step in enumerate(steps):
        res = step(store.tables)
        before, store = store, store.commit(res.tables)
        assert store.version == before.version + 1 == k + 1
        _holds(store.tables, res.tables)
        for name in ("invoice", "invoice_line", "invoice_summary") if 0 < k < 3 else ():
            assert _files(before.tables, name, "AFRICA") == _files(store.tables, name, "AFRICA") != set()
            assert _files(before.tables, name) - _files(store.tables, name)
        _same(R.best_product_week(store.tables, NOW), R.best_product_week(store.tables.with_tables(invoice=store.tables.invoice), NOW))
    again = Store.open(spark, store.root)
    _holds(again.tables, store.tables)
    whole = again.commit(again.tables, whole=STORED)
    assert all(len(p) == 1 for p in whole.paths.values())
    _holds(whole.tables, again.tables)


def test_listings_build_no_sales(spark):
    """Listings of products, staff and stock read and write no invoices or
    lines; the whole store then takes up the tables they built."""
    from branchwise.plans import catalog
    from branchwise.sources import store
    where = f"{SF001}/."                                               # a folder no other test opens
    qs = catalog.queries()
    want = {name: qs[name](spark, SF001) for name in sorted(catalog._WITHOUT_SALES)}
    for name, df in want.items():
        _same(qs[name](spark, where), df)
    root, base = store._start_store(spark, where)
    assert sorted(os.path.basename(p) for p in glob.glob(f"{root}/*")) == sorted(store.BASE)
    whole = open_store(spark, where)
    assert whole.root == root and {n: whole.paths[n] for n in store.BASE} == base
    _holds(whole.tables, open_store(spark, SF001).tables)


def test_members_of_fragments_are_checked_in_one_pass(spark):
    t = open_store(spark, SF001).tables
    report = Q.fragment_membership(t)
    scans = [x for x in report._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" in x]
    assert len(scans) == 3, scans                                      # lines, invoices, employees
    before = {r.table_name: (r.checked_rows, r.misplaced_rows) for r in report.collect()}
    one = t.invoice_line.orderBy("invoice_id", "product_code").limit(1).withColumn("branch_code", F.lit("ELSEWHERE"))
    lost = t.invoice_line.limit(1).withColumn("invoice_id", F.lit("none"))
    after = Q.fragment_membership(t.with_tables(invoice_line=t.invoice_line.unionByName(one).unionByName(lost)))
    after = {r.table_name: (r.checked_rows, r.misplaced_rows) for r in after.collect()}
    n, bad = before["invoice_line"]
    assert after == {**before, "invoice_line": (n + 2, bad + 2)}


def test_changes_build_only_the_tables_they_read(spark):
    """Changes of staff, products and stock build no invoices or lines, and no
    change builds the summaries."""
    from branchwise.plans import changesets
    from branchwise.sources import store
    where = f"{SF001}/./."                                             # a folder no other test opens
    qs = changesets.queries()
    for name in ("employees_after_patch", "products_after_create", "stock_transfer", "stock_receipt", "inventory_after_row_delete"):
        qs[name](spark, where)
    root, _ = store._start_store(spark, where)
    built = lambda: {os.path.basename(p) for p in glob.glob(f"{root}/[!_]*")}
    assert built() == set(store.BASE)
    qs["service_request_items"](spark, where)
    assert built() == set(store.SCHEMAS)
