"""Source divergence, byte-level BPE and periodic runs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from branchwise.llm import bytepairs, divergence, oracle, periods, queries
from tests.compare import canon
from tests.conftest import SF001, SF01, duck
from tests.llm.conftest import prose, words

PATH, PATTERN = queries.byte_ranks()


@pytest.fixture(scope="module")
def ranks():
    return bytepairs.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- source divergence ---------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, least, top):
    """(lang, source, part, item, value, rank) by the definition."""
    texts = [(a or "", b or "", [t for t in TERM.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))]) for a, b, t in rows]
    out, utf8 = [], lambda s: s.encode()
    for lang in {a for a, _, _ in texts}:
        own = [(s, w) for a, s, w in texts if a == lang]
        docs = Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in docs.items() if n >= least}
        counts = {s: Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(t for t in w if t in kept)
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        diff = lambda p, q: (p - q) ** 2 // (p + q)
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(sum(diff(share(c, t), share(d, t)) for t in kept), o) for o, d in counts.items() if o != s]
            terms = [(diff(share(c, t), share(whole, t)), t) for t in c if c[t] and share(c, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], utf8(x[1])))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found[:most])]
    return sorted(out)


def test_transducer_numbers_sorted_terms():
    rng = random.Random(1)
    for _ in range(100):
        terms = sorted({bytes(rng.choice(b"ab\xc3z") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 50))})
        t = divergence.Transducer.load(divergence.Transducer.build(iter(terms)))
        asked = [*terms, b"", b"y", *[x + b"a" for x in terms], *[x[:-1] for x in terms]]
        assert t.ordinals(asked).tolist() == [terms.index(x) if x in terms else -1 for x in asked]
    # Minimal: the words over {a, b} of length 9 need ten states.
    every = sorted(bytes(97 + (k >> i & 1) for i in range(9)) for k in range(512))
    assert len(divergence.Transducer.load(divergence.Transducer.build(iter(every))).final) == 10


@pytest.mark.parametrize(("most", "shard_terms"), [(divergence.MOST_BYTES, divergence.SHARD_TERMS), (150, 7), (400, 5)])
def test_divergence_by_definition(spark, most, shard_terms):
    rng = random.Random(9)
    vocabulary = ["a", "b", "É", "é", "zz", "Ab", "日本", "x_y", "q1r", "ﬀ", "😀", "İ"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s", "t", "é", None, "Z"]),
             " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))) for _ in range(90)]
    rows += [("en", "only", None), ("xx", "s", ""), ("xx", "t", "1 2 3"), ("yy", "s", "rare words"), ("en", "s", "a a\x00a-a")]
    docs = spark.createDataFrame([(*r, "d", 1) for r in rows], "lang string, source string, text string, ordinal string, n int").repartition(4)
    got = divergence.audit(docs, least=4, top=3, most=most, shard_terms=shard_terms)
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, 4, 3)


def test_divergence_of_awkward_tables(spark, awkward, empty):
    rows = [(r.lang, r.source, r.text) for r in awkward.select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in divergence.audit(awkward, least=2).collect()) == audited(rows, 2, 10)
    assert divergence.audit(empty).count() == 0


def test_divergence_equals_sql(spark):
    df = queries.op11_source_divergence(spark, SF001)
    cur = duck(SF001).execute(oracle.SQL["op11_source_divergence"])
    assert canon(df.columns, df.collect()) == canon([d[0] for d in cur.description], cur.fetchall())


# --- byte-level BPE ------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from("ab's \n\t1é")), max_size=60))
def test_words_merge_like_the_library(ranks, library, text):
    cut = bytepairs.regex.compile(PATTERN)
    ids = [i for a, b in bytepairs._segments(text) for w in cut.findall(text, a, b) for i in bytepairs.merged(w.encode(), ranks)]
    assert ids == library.encode_ordinary(text)


def _as_library(docs, got, library):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id, np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()] += 1
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(4 * r.n_ids == len(r.ids) for r in got)


@pytest.mark.parametrize("block_words", [bytepairs.BLOCK_WORDS, 100])
def test_bpe_of_awkward_tables(spark, awkward, empty, library, monkeypatch, block_words):
    encode = lambda d: bytepairs.decode(bytepairs.encode(d, PATH, PATTERN, block_words), PATH)
    got = encode(awkward).collect()
    _as_library(awkward, got, library)
    assert [c for c in awkward.columns if c != "text"] == [c for c in got[0].asDict() if c not in ("ids", "n_ids", "decoded")]
    assert encode(empty).count() == 0


def test_bpe_joins_texts_cut_into_parts(spark, library):
    """A text longer than a block, beside others; and a very long word."""
    rng = random.Random(4)
    texts = ["\n".join(prose(rng, 60000) for _ in range(5)), "ab" * 200_000, None, "x", " ".join(["the"] * 700_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    got = bytepairs.decode(bytepairs.encode(docs, PATH, PATTERN, block_words=200_000), PATH)
    _as_library(docs, got.collect(), library)


def test_ids_as_arrays_and_odd_columns(spark):
    docs = spark.createDataFrame([("a b", "t", 5)], "text string, `x.y` string, ids int")
    rows = bytepairs.unpacked(bytepairs.encode(docs, PATH, PATTERN))
    r = rows.first()
    assert r["x.y"] == "t" and r.id_list == np.frombuffer(r.ids, "<u4").tolist() and r.n_ids == len(r.id_list)
    with pytest.raises(Exception, match="has no token"):
        bytepairs.decode(rows.withColumn("ids", F.lit(b"\xff\xff\xff\x7f")), PATH).collect()


def test_bpe_query_equals_the_library(spark, library):
    want = {}
    for i, t in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF01}/documents.parquet'").fetchall():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = queries.op12_byte_bpe(spark, SF01).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


# --- periodic runs -------------------------------------------------------


def all_runs(w):
    """(start, length, period) by trying every period at every place."""
    n, best = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > s and i - s + p >= max(12, 2 * p):
                best.setdefault((s, i - s + p), p)
            i += i == s
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9), st.integers(1, 60), st.integers(0, 2**32)), min_size=1, max_size=6))
def test_runs_by_definition(shapes):
    texts = []
    for letters, period, n, seed in shapes:
        rng = random.Random(seed)
        loop = [rng.randrange(letters + 1) for _ in range(period)]
        texts.append(np.array([rng.randrange(letters + 1) for _ in range(n // 3)] + [loop[i % period] for i in range(n)]
                              + [rng.randrange(letters + 1) for _ in range(n // 4)], np.int64))
    rows = periods.runs_of(texts)
    for k, t in enumerate(texts):
        assert [tuple(r[1:]) for r in rows.tolist() if r[0] == k] == all_runs(t.tolist())


def test_runs_beyond_one_piece_of_the_grid(monkeypatch):
    rng = random.Random(2)
    texts = [np.array([rng.randrange(2) for _ in range(300)] + [0, 1, 1] * 40, np.int64), np.zeros(200, np.int64), np.arange(150)]
    want = [tuple(r) for r in periods.runs_of(texts).tolist()]
    monkeypatch.setattr(periods, "GRID_WORDS", 64)
    monkeypatch.setattr(periods, "BATCH_QUESTIONS", 50)
    periods._first_grid.cache_clear()
    assert [tuple(r) for r in periods.runs_of(texts).tolist()] == want
    assert want == [(k, *r) for k, t in enumerate(texts) for r in all_runs(t.tolist())]
    periods._first_grid.cache_clear()


def test_runs_of_awkward_tables(spark, awkward, empty):
    docs = awkward.withColumn("runs", F.lit(1)).withColumn("a.b", F.lit("c"))
    got = periods.find_runs(docs).collect()
    assert [c for c in got[0].asDict()] == [c for c in docs.columns if c not in ("text", "runs")] + ["runs", "collapsed"]
    want = Counter()
    for r in awkward.select("doc_id", "text").collect():
        w = words(r.text)
        if len(w) < 3000:
            runs = all_runs(w)
            want[r.doc_id, tuple(runs), collapsed(w, runs)] += 1
    have = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in got)
    assert all(have[k] == n for k, n in want.items()) and len(got) == awkward.count()
    assert periods.find_runs(empty).count() == 0


def test_long_texts_of_one_word_and_of_none_alike(spark):
    texts = ["a " * 400_000, " ".join(str(bin(i).count("1") % 2) for i in range(100_000)), " ".join(map(str, range(100_000)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in periods.find_runs(docs).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 400_000, 1)] and got[0].collapsed == "a"
    assert got[2].runs == [] and got[2].collapsed == texts[2]
    assert len(got[1].runs) > 1000 and all(r.length < 3 * r.period for r in got[1].runs)


def test_runs_query_by_definition(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF001).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF001}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, t in rows:
        w, h = words(t), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = all_runs(w)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert tuple(got[i]) == (i, len(runs), *top, runs and 1000 * top[1] // top[2] or None,
                                 hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
