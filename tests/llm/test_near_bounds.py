"""The bounds that keep hopeless pairs out of the near-duplicate join."""

from __future__ import annotations

import numpy as np

from branchwise.llm import minhash as M


def _pairs():
    """Sets of many sizes and overlaps, with the places of a shared item."""
    rng = np.random.default_rng(11)
    for n in (1, 2, 5, 9, 10, 40, 300, 2000):
        for share in (0.0, 0.5, 0.75, 0.88, 0.889, 0.9, 0.95, 1.0):
            items = rng.integers(-2**63, 2**63 - 1, 3 * n, dtype=np.int64)
            k = int(n * share)
            a, b = items[:n], np.concatenate([items[:k], items[n:2 * n - k]])
            common = np.intersect1d(a, b)
            if not len(common):
                continue
            # one order for all sets: by value; from the first shared item on
            place = [int(np.searchsorted(np.sort(s), common[0])) for s in (a, b)]
            yield len(a), len(b), *place, M.sketch(a).tolist(), M.sketch(b).tolist(), len(common), len(np.union1d(a, b))


def test_no_pair_that_reaches_the_threshold_is_left_out(spark):
    rows = list(_pairs())
    s = "STRUCT<n_shingles: BIGINT, place: BIGINT, sketch: ARRAY<BIGINT>>"
    df = spark.createDataFrame([((a, p, i), (b, q, j), c, u) for a, b, p, q, i, j, c, u in rows], f"x {s}, y {s}, c INT, u INT")
    got = df.select("c", "u", M._may_link("x", "y").alias("may")).collect()
    linked = [r for r in got if 100 * r.c >= M.THRESHOLD_PERCENT * r.u]
    assert linked and all(r.may for r in linked)
    far = [r for r in got if 100 * r.c < 50 * r.u and r.u > 100]
    assert far and not any(r.may for r in far)


def test_a_sketch_is_compared_once_and_after_its_first_words(spark):
    s = "STRUCT<n_shingles: BIGINT, place: BIGINT, sketch: ARRAY<BIGINT>>"
    df = spark.createDataFrame([], f"x {s}, y {s}")
    plan = df.where(M._may_link("x", "y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_count") == M.SKETCH + M.SKETCH // 4
