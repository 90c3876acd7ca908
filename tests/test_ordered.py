"""Skew-safe ordered scans equal a Python fold per key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from branchwise.operators import ordered


def _data(spark, seed, spread):
    rng = random.Random(seed)
    rows = []
    for s in spread(rng):
        key = rng.choice(["hot"] * 18 + ["a", None])       # one key holds 90% of the rows
        rows.append((s, key, rng.choice([None, 1, 2, 5]), rng.choice([None, "x", "y"])))
    return rows, spark.createDataFrame(rows, "seq BIGINT, k STRING, v INT, t STRING")


SPREADS = {
    "uniform": lambda rng: rng.sample(range(1, 100_000), 400),
    "wide": lambda rng: [s * 2_000_000_000_000_003 for s in rng.sample(range(1, 4000), 400)],
    "far outlier": lambda rng: [*range(1, 400), 9_000_000_000_000_000_000],
}


@pytest.mark.parametrize("spread", SPREADS)
def test_scans_match_python(spark, spread):
    rows, df = _data(spark, 7, SPREADS[spread])
    b = ordered.bucketize(df, ["k"], partitions=25).cache()
    # The hot key is split by rank, so no bucket holds much more than its share.
    assert max(r["count"] for r in b.groupBy("k", "bucket").count().collect()) <= 2 * 400 / 25
    sums = {r.seq: r.p_v for r in ordered.running_sums(b.fillna(0, ["v"]), ["k"], ["v"]).collect()}
    last = {r.seq: r.lt for r in ordered.running_last(b, ["k"], {"lt": F.col("t")}).collect()}
    # Python fold per key in seq order (NULL is a key of its own).
    acc, seen = {}, {}
    for s, k, v, t in sorted(rows):
        assert sums[s] == acc.get(k, 0)                        # strictly earlier rows
        acc[k] = acc.get(k, 0) + (v or 0)
        if t is not None:
            seen[k] = t
        assert last[s] == seen.get(k)                          # up to and including this row


def test_numbers_follow_the_order(spark):
    rows = [(i * 37 % 501, i % 3) for i in range(501)]
    got = ordered.numbered(spark.createDataFrame(rows, "a INT, b INT").repartition(5), ["b", "a"], "n").collect()
    assert [(r.b, r.a) for r in sorted(got, key=lambda r: r.n)] == sorted((b, a) for a, b in rows)
    assert sorted(r.n for r in got) == list(range(1, 502))


def test_only_keys_of_several_buckets_are_summarised(spark):
    """Rows are scanned with one shuffle; summaries are of keys that span buckets."""
    df = spark.range(4000).selectExpr("id AS seq", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE string(id % 500) END AS k", "1 AS v")
    b = ordered.bucketize(df, ["k"], partitions=20)
    of = {r.k: (r.n, r.spans) for r in b.groupBy("k").agg(F.countDistinct("bucket").alias("n"), F.max("spans").alias("spans")).collect()}
    assert all(spans == (n > 1) for n, spans in of.values()) and of["hot"][1]
    assert sum(spans for _, spans in of.values()) <= 20 < len(of)
    plan = ordered.running_sums(b, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
