"""T1 streaming shell: file-source stream + foreachBatch into versioned snapshots."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from branchwise.plans import requests as RQ
from branchwise.streaming.replicate import _marked, _versions, apply_batch, apply_changes, read_snapshot, start_replication
from tests.compare import canon
from tests.conftest import SF001

KEYS, VALUES = ["member_id"], ["balance", "updated_at"]


def test_stream_restarts_and_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="bw-stream-", dir=os.environ.get("BRANCHWISE_TMP", "/tmp"))
    feed_dir, root, ck = f"{base}/feed", f"{base}/snap", f"{base}/ck"
    feed = RQ.change_feed(spark, SF001)
    snapshot = RQ.member_snapshot(spark, SF001)
    # Two drops of change files; the second one arrives after a restart and
    # holds the later half of the feed.
    mid = feed.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seq)")).first()[0]
    feed.where(F.col("seq") <= mid).write.parquet(f"{feed_dir}/part=1")
    q = start_replication(spark, feed_dir, feed.schema, root, snapshot, KEYS, VALUES, ck)
    q.awaitTermination()
    feed.where(F.col("seq") > mid).write.parquet(f"{feed_dir}/part=2")
    q = start_replication(spark, feed_dir, feed.schema, root, snapshot, KEYS, VALUES, ck)
    q.awaitTermination()
    got = read_snapshot(spark, root)
    want = apply_changes(snapshot, feed, KEYS, VALUES)
    assert canon(got.columns, got.collect()) == canon(want.columns, want.collect())


def test_late_older_change_does_not_win(spark):
    base = tempfile.mkdtemp(prefix="bw-stream-", dir=os.environ.get("BRANCHWISE_TMP", "/tmp"))
    schema = "seq BIGINT, op STRING, member_id BIGINT, balance DOUBLE, updated_at TIMESTAMP"
    snap = spark.createDataFrame([(1, 1.0, None)], "member_id BIGINT, balance DOUBLE, updated_at TIMESTAMP")
    spark.createDataFrame([(10, "D", 1, None, None)], schema).write.parquet(f"{base}/feed/drop=a")
    q = start_replication(spark, f"{base}/feed", spark.createDataFrame([], schema).schema, f"{base}/snap", snap,
                          KEYS, VALUES, f"{base}/ck")
    q.awaitTermination()
    spark.createDataFrame([(5, "U", 1, 9.0, None)], schema).write.parquet(f"{base}/feed/drop=b")
    q = start_replication(spark, f"{base}/feed", spark.createDataFrame([], schema).schema, f"{base}/snap", snap,
                          KEYS, VALUES, f"{base}/ck")
    q.awaitTermination()
    assert read_snapshot(spark, f"{base}/snap").count() == 0


SCHEMA = "seq BIGINT, op STRING, member_id BIGINT, balance DOUBLE, updated_at TIMESTAMP"


def _started(spark, members, **options):
    """A replica of ``members`` rows, and what applies a batch to it."""
    base = tempfile.mkdtemp(prefix="bw-stream-", dir=os.environ.get("BRANCHWISE_TMP", "/tmp"))
    snap = spark.range(members).selectExpr("id AS member_id", "CAST(id AS DOUBLE) AS balance", "CAST(NULL AS TIMESTAMP) AS updated_at")
    os.mkdir(f"{base}/feed")
    start_replication(spark, f"{base}/feed", spark.createDataFrame([], SCHEMA).schema, f"{base}/snap", snap, KEYS, VALUES, f"{base}/ck",
                      **options).awaitTermination()

    def apply(batch_id, *changes):
        rows = [(seq, op, member, balance, None) for seq, op, member, balance in changes]
        apply_batch(spark, f"{base}/snap", spark.createDataFrame(rows, SCHEMA), batch_id, KEYS, VALUES, **options)
    return f"{base}/snap", apply


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/data")
            for f in names if f.endswith(".parquet")}


def test_a_change_writes_its_bucket_alone(spark):
    root, apply = _started(spark, 500, buckets=16)
    before = _files(root)
    assert len(before) >= 16
    apply(0, (1, "U", 7, 70.0))
    after = _files(root)
    assert {f: t for f, t in after.items() if f in before} == before
    assert len({f.split("_bucket=")[1].split("/")[0] for f in set(after) - set(before)}) == 1
    rows = {r.member_id: r.balance for r in read_snapshot(spark, root).collect()}
    assert rows == {**{i: float(i) for i in range(500)}, 7: 70.0}
    # A replayed batch changes nothing; a later version drops what two versions ago replaced.
    apply(0, (1, "U", 7, 71.0))
    assert _files(root) == after
    apply(1, (2, "U", 7, 72.0))
    apply(2, (3, "U", 7, 73.0))
    folders, _ = _marked(spark, root, 2)
    mine = next(b for b, f in folders.items() if f == 2)
    assert {f.split("_folder=")[1].split("/")[0] for f in _files(root) if f"_bucket={mine}/" in f} == {"1", "2"}
    assert {r.member_id: r.balance for r in read_snapshot(spark, root).collect()}[7] == 73.0


def test_tombstones_leave_below_the_watermark(spark):
    root, apply = _started(spark, 4, buckets=1, lateness=10)
    stored = lambda: {r.member_id: r._deleted for r in spark.read.parquet(f"{root}/data/_bucket=0/_folder={_versions(spark, root)[-1]}").collect()}
    apply(0, (100, "D", 1, None), (101, "U", 2, 5.0))
    assert stored()[1] is True
    apply(1, (95, "U", 1, 9.0), (102, "U", 3, 6.0))     # late, but above the watermark: older than the delete
    assert stored()[1] is True and read_snapshot(spark, root).where("member_id = 1").count() == 0
    apply(2, (120, "U", 2, 7.0))
    assert 1 not in stored()
    apply(3, (99, "U", 1, 9.0), (105, "I", 9, 1.0))     # below the watermark (110): refused
    assert {r.member_id: r.balance for r in read_snapshot(spark, root).collect()} == {0: 0.0, 2: 7.0, 3: 6.0}


def test_a_bucket_may_lose_all_its_rows(spark):
    root, apply = _started(spark, 1, buckets=4, lateness=0)
    apply(0, (5, "D", 0, None))
    apply(1, (6, "D", 0, None))
    assert read_snapshot(spark, root).count() == 0
    apply(2, (9, "I", 0, 3.0))
    assert read_snapshot(spark, root).first().balance == 3.0
