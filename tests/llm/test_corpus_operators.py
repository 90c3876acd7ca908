"""Mixing, sharding, near dedup, the pipeline and the registry."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from branchwise.llm import components, exact, html, lines, minhash, mixing, pieces, quality, sharding
from branchwise.llm.queries import tokenizer_model
from tests.compare import same_as_sql
from tests.conftest import SF001
from tests.llm.conftest import docs_table, prose, words
from tests.llm.test_chat_html_pieces import by_hand
from tests.llm.test_text_operators import measured


def targets(sizes):
    """Water filling by resharing the excess until no source is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        level = left / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def check_mix(docs):
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want, got, took = targets(sizes), mixing.taken(docs).collect(), Counter()
    source_of = defaultdict(set)
    for r in rows:
        source_of[(r.doc_id, len(words(r.text)))].add(r.source)
    assert Counter((g.doc_id, g.size) for g in got) == Counter((r.doc_id, len(words(r.text))) for r in rows)
    ids = {i: s for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    for g in got:
        s = ids[g.source_id]
        assert s in source_of[(g.doc_id, g.size)] and g.source_size == sizes[s]
        assert g.target == pytest.approx(want[s]) and 0 <= g.taken <= 3 * g.size
        took[s] += g.taken
    for s, t in want.items():
        assert abs(took[s] - t) <= 1
    return got


def test_mix_reaches_targets(spark, awkward, empty):
    check_mix(awkward)
    assert mixing.taken(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    rng = random.Random(3)
    many = docs_table(spark, [(i, prose(rng, rng.randrange(0, 90)), rng.choice(["a", "a", "a", "b", "c", None, "ü"]))
                              for i in range(900)] + [(1000, "only five words in here", "zz")])
    one, two = check_mix(many), check_mix(many.repartition(7))
    assert sorted((g.doc_id, g.taken) for g in one) == sorted((g.doc_id, g.taken) for g in two)


def test_schedule_is_even(spark):
    """Every stretch of slots holds each source in proportion to its blocks."""
    sources = spark.createDataFrame([(0, 700, 0), (1, 250, 700), (2, 73, 950), (3, 1, 1023)],
                                    "source_id bigint, blocks bigint, first_block bigint")
    rows = sorted((r.slot, r.source_id, r.block) for r in mixing.schedule(sources).collect())
    assert Counter((s, b) for _, s, b in rows) == Counter((s, b) for s, n in ((0, 700), (1, 250), (2, 73), (3, 1)) for b in range(n))
    assert len({slot for slot, _, _ in rows}) == len(rows)
    for n in range(50, 1000, 50):
        assert abs(sum(s == 0 for _, s, _ in rows[:n]) - n * 700 / 1024) < 8
    assert [b for _, s, b in rows if s == 1] == list(range(250))


def test_mixed_documents_are_whole(awkward):
    got = mixing.mixed_documents(awkward)
    assert got.columns == awkward.columns
    texts = {r.text for r in awkward.collect()}
    assert all(r.text in texts for r in got.collect())


def test_shards(awkward, empty):
    n = awkward.count()
    got = sharding.assign(awkward).collect()
    per = Counter(r.shard for r in got)
    assert len(got) == n and set(per) <= set(range(16))
    assert max(per.values()) - min(per[s] for s in range(16)) <= 1
    for s in per:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    assert sharding.assign(empty).count() == 0
    by_bytes = sharding.assign(awkward, shards=4, unit="bytes", slack=0.1)
    loads = by_bytes.groupBy("shard").agg(F.sum("size").alias("n"), F.max("size").alias("m")).collect()
    assert sum(r.n for r in loads) == sum(len((r.text or "").encode()) + 1 for r in awkward.collect())


def test_few_keys_move(spark):
    """With slack, one more shard takes rows about in proportion."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    at = lambda shards: {r.doc_id: r.shard for r in sharding.assign(docs, shards=shards, slack=0.25).collect()}
    a, b = at(16), at(17)
    assert max(Counter(a.values()).values()) <= 1.25 * 4000 / 16 + 1
    assert sum(a[i] != b[i] for i in a) < 0.25 * 4000


def test_marks_cover_all_loads():
    points, loads = sharding.ring_points(5, 8), {3: 1000, 17: 4, 39: 11}
    caps = sharding.capacities(1015, 5, 0.0)
    marks = sharding.fill(points, loads, caps)
    for a, n in loads.items():
        own = sorted(m[1:3] for m in marks if m[0] == a)
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    assert Counter({s: sum(m[2] - m[1] for m in marks if m[3] == s) for s in range(5)}) == Counter(dict(enumerate(caps)))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400, i) for i in range(401, 470)] + [
        (500 + i, 501 + i) for i in range(40)]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def near(rows, n):
    sets = []
    for r in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(r.text)]
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r.doc_id)
    return Counter((r.doc_id, len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i, r in enumerate(rows))


def test_near_groups(spark, awkward, empty):
    rng = random.Random(9)
    rows = [(i, prose(rng, 80)) for i in range(30)]
    for k in range(4):  # groups of near copies, chains among them
        text = prose(rng, 150, 4000).split()
        for i in range(25):
            text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * (k + 1) + i, " ".join(text)))
    passage = prose(rng, 60)
    rows += [(9000 + i, passage + " " + prose(rng, 50, 5000)) for i in range(40)]
    for docs in (docs_table(spark, rows), awkward):
        for n in (4, 5):
            got = minhash.near_groups(docs, n).collect()
            assert Counter((g.doc_id, g.n_shingles, g.component_id) for g in got) == near(docs.collect(), n)
            assert all(g.kept == (g.doc_id == g.component_id) for g in got)
    assert minhash.near_groups(empty).count() == 0 and minhash.one_of_each(empty).columns == empty.columns
    kept = minhash.one_of_each(docs_table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(g.doc_id for g in minhash.near_groups(docs_table(spark, rows)).collect() if g.kept)


def test_one_row_of_each_group_stays(spark):
    """Ids that repeat or are null name no group."""
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60, 5000) for _ in range(4))
    rows = [(7, a), (7, a + " more"), (3, b), (None, b), (None, b + " more"), (None, c), (None, c + " end"), (3, d), (9, d), (5, None), (5, "")]
    kept = minhash.one_of_each(docs_table(spark, rows)).collect()
    # Of group c either row may stay: both ids are null.
    assert Counter((r.doc_id, (r.text or "")[:60]) for r in kept) == Counter(
        (i, (t or "")[:60]) for i, t in [(7, a), (3, b), (None, c), (3, d), (5, None), (5, "")])


def test_long_text_hashes_like_short_segments(monkeypatch):
    text = prose(random.Random(2), 5000)
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "SEGMENT", 100)
    assert (minhash.word_hashes(text) == whole).all() and len(whole) == 5000


ORACLE = [k for k in E.oracle_sql() if k.startswith("op")]


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_sql(spark, duck001, name):
    same_as_sql(E.queries()[name](spark, SF001), duck001, E.oracle_sql()[name])


def test_registry():
    names = E.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


def test_pipeline(spark, awkward, empty):
    """Stage by stage on one small table, and against the operators' contracts."""
    rng = random.Random(4)
    good = [(i, prose(rng, 60, 5000), "ab"[i % 2]) for i in range(40)]
    bad = [(100, "too short"), (101, "a b c d e " * 30), (102, None)]
    same = [(200 + i, good[3][1], "a") for i in range(3)] + [(300, good[5][1] + " more", "b")]
    docs, seen = docs_table(spark, good + bad + same), []
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, SF001).cache()
        seen.append(docs.count())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert seen[:3] == [44, 41, 40]
    last = docs.collect()
    assert all(r.exact for r in last) and {r.doc_id for r in last} <= {r[0] for r in good + same}
    for rows in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF001)
        assert rows.count() >= 0


def good_by_hand(text):
    n, chars, symbols, n_lines, n_dup, repeated = measured(text)
    return not (n < 10 or 100 * repeated > 20 * n or 10 * symbols > n or 3 * n_dup > n_lines or chars < 3 * n or chars > 10 * n)


def one_of_near(rows):
    """Smallest id of each group linked by 5-word Jaccard similarity."""
    sets = {}
    for i, t, _ in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return [r for r in rows if group[r[0]] == r[0]]


def test_pipeline_rows_equal_brute_force(spark, tmp_path):
    """Rules, exact groups, near groups, the whole-document mix and the ids."""
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randrange(20, 70), 5000), "abbbbbbbc"[i % 9]) for i in range(36)]
    rows += [(100, "too short", "a"), (101, "a b c d e " * 30, "b"), (102, None, "a"), (103, " ".join(f"*word{i}$" for i in range(40)), "c")]
    rows += [(200 + i, rows[3][1], "ac"[i % 2]) for i in range(3)] + [(300, rows[20][1] + " more", "c"), (301, rows[20][1].upper() + " more or", "a")]
    path = str(tmp_path / "documents.parquet")
    docs_table(spark, rows).write.parquet(path)
    left = [r for r in rows if good_by_hand(r[1])]
    assert len(left) == len(rows) - 4
    left = one_of_near([r for r in left if r[0] == max(x[0] for x in left if x[1] == r[1])])
    assert len(left) == 36
    hashed = spark.read.parquet(path).select("doc_id", F.xxhash64(F.lit("mix"), "doc_id", "text").alias("h")).collect()
    place = {r.doc_id: r.h for r in hashed}
    sizes = Counter()
    for _, t, s in left:
        sizes[s] += len(words(t))
    copies = Counter()
    for s, target in targets(sizes).items():
        quota, at = min(int(target + 0.5), 3 * sizes[s]), 0
        for _ in range(3):
            for i, t, _ in sorted((r for r in left if r[2] == s), key=lambda r: place[r[0]]):
                n = len(words(t))
                copies[i] += 2 * max(0, min(quota - at, n)) >= n
                at += n
    assert len(set(copies.values())) > 1
    vocabulary = pieces.Vocabulary(*pieces.load_vocabulary(tokenizer_model()))
    ids = {i: tuple(by_hand(t, vocabulary)) for i, t, _ in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.exact and r.n_ids == len(r.ids) for r in got)
    source = {i: s for i, _, s in left}
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in got) == Counter(
        {(i, source[i], ids[i]): n for i, n in copies.items() if n})


def test_columns_of_any_name_come_through(spark, empty):
    """Columns named like the operators' own, and with dots, keep their values."""
    rng = random.Random(2)
    rows = [(i, prose(rng, 60, 5000), "s", f"r{i}", f"d{i}") for i in range(12)]
    rows += [(50, rows[0][1], "s", "copy", "copy"), (51, rows[1][1] + " more", "t", "near", "near")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _rid string, `a.b` string").repartition(2)
    want = {(r[0], r[3], r[4]) for r in rows}
    for stage in (quality.keep_good, exact.deduplicated, minhash.one_of_each, mixing.mixed_documents, lines.without_repeats):
        got = stage(docs)
        assert got.columns[:5] == docs.columns
        assert {(r.doc_id, r["_rid"], r["a.b"]) for r in got.collect()} <= want
    assert {r["a.b"] for r in exact.deduplicated(docs).collect()} == {r[4] for r in rows} - {"d0"}
    pages = docs.withColumnRenamed("text", "html")
    assert {(r["_rid"], r["a.b"], r.text) for r in html.extract(pages).collect()} == {(r[3], r[4], r[1]) for r in rows}
    assert html.extract(empty.withColumnRenamed("text", "html")).count() == 0


def test_sketches_bound_what_sets_share():
    rng = random.Random(6)
    for _ in range(200):
        a = np.unique(np.array([rng.randrange(2**63) for _ in range(rng.randrange(1, 400))], np.int64))
        b = np.unique(np.concatenate([rng.sample(a.tolist(), rng.randrange(len(a) + 1)), [rng.randrange(2**63) for _ in range(rng.randrange(60))]]).astype(np.int64))
        differ = sum(int(x).bit_count() for x in (minhash.sketch(a) ^ minhash.sketch(b)).view(np.uint64))
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) / 2


def test_a_large_group_of_copies_that_hardly_link(spark):
    """Near copies of one text, most of them short of the threshold to each other."""
    rng = random.Random(12)
    base = prose(rng, 120, 5000).split()
    rows = []
    for i in range(160):
        text = base.copy()
        for k in rng.sample(range(120), rng.choice([1, 2, 4, 5, 6])):
            text[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    docs = docs_table(spark, rows)
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(116)} for i, t in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert {r.doc_id: r.component_id for r in minhash.near_groups(docs).collect()} == group
    assert 20 < len(set(group.values())) < 160
