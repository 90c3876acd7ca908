"""Near-duplicates by MinHash with tensored banding.

Two small collections of partial keys, ``LEFT`` of one minhash each and
``RIGHT`` of two, are combined pairwise into ``LEFT * RIGHT`` table keys: 26
minhashes give 60 tables of three, where separate ones would need 180.
Documents at the threshold share a table with probability 0.9999.

Candidates are verified on the full shingle sets.  Equal sets are one class,
so copies cost nothing.  In each table a class is first compared with the
smallest class there; this joins the groups.  Classes that met in a table but
are still in different groups are then compared with each other where the
rarest shingles and the sketches of both allow it: exact bounds, so no link
that the tables show is lost, and a large group of near copies is not expanded
into its pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchwise.llm.common import bounded_batches, own_columns, packed, text_of
from branchwise.llm.components import components
from branchwise.session import materialize

LEFT, LEFT_HASHES, RIGHT, RIGHT_HASHES = 6, 1, 10, 2
HASHES = LEFT * LEFT_HASHES + RIGHT * RIGHT_HASHES
THRESHOLD_PERCENT = 80
SEGMENT = 1 << 20
HEAD = 64
#: 64-bit words of a set's sketch.
SKETCH = 16

_SPACE = re.compile(rb"[\x09-\x0D\x20]")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) words, segment by segment."""
    data, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        cut = _SPACE.search(data, at + SEGMENT)
        end = cut.start() if cut else len(data)
        words = data[at:end].lower().split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``words`` words; with fewer
    words, of the whole sequence; empty without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    span = min(words, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - span + 1 + k])
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:HASHES] | np.uint64(1), seeds[HASHES:]


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes, one row per set; the sets are not empty."""
    flat, factor, offset = np.concatenate(sets), *_permutations()
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(_mixed(flat * factor[k] + offset[k]), starts)
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """doc_id, h, g, text -> doc_id, h, g, n_shingles, key of the set, signature."""
    for batch in batches:
        sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        sig: list = [None] * len(sets)
        if full:
            for i, row in zip(full, signature([sets[i] for i in full]), strict=True):
                sig[i] = row
        keys = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
        keys = keys.reshape(len(sets), 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), batch.column("g"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sig, pa.list_(pa.int64()))],
            ["doc_id", "h", "g", "n_shingles", "k1", "k2", "sig"])


def sketch(items: np.ndarray) -> np.ndarray:
    """Parities of how many of a set's items fall on each of ``SKETCH * 64``
    bits.  An item that only one of two sets has flips one bit, so the sets
    differ in at least as many items as their sketches in bits."""
    counts = np.bincount((items.view(np.uint64) >> np.uint64(7)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


def _with_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """cid, text -> cid, the sorted set, its sketch."""
    for batch in batches:
        sets = [shingles(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("cid"), pa.array(sets, pa.list_(pa.int64())), pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))],
            ["cid", "items", "sketch"])


def _row_key() -> list[Column]:
    """Two hashes that find a row's text again (96 bits in all)."""
    return [F.xxhash64("doc_id", text_of()).alias("h"), F.hash(F.lit("g"), text_of()).alias("g")]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, h and g, n_shingles, k1 and k2
    (which name the set), sig."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_row_key(), text_of().alias("text"))
    made = rows.mapInArrow(lambda b: _signed(b, words),
                           "doc_id bigint, h bigint, g int, n_shingles bigint, k1 bigint, k2 bigint, sig array<bigint>")
    return materialize(made, "minhash: signatures")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, cid, n_shingles): the keys of each class in all tables."""
    sig, left = F.col("sig"), LEFT * LEFT_HASHES
    a = [[sig[i * LEFT_HASHES + k] for k in range(LEFT_HASHES)] for i in range(LEFT)]
    b = [[sig[left + j * RIGHT_HASHES + k] for k in range(RIGHT_HASHES)] for j in range(RIGHT)]
    keys = F.array(*[F.xxhash64(F.lit(i * RIGHT + j), *a[i], *b[j]) for i in range(LEFT) for j in range(RIGHT)])
    return classes.select("cid", "n_shingles", F.explode(keys).alias("key"))


def _like_sizes(a: str, b: str) -> Column:
    """Sets whose sizes differ by more cannot reach the threshold."""
    return 100 * F.least(a, b) >= THRESHOLD_PERCENT * F.greatest(a, b)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.col("cid").alias("a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("cid").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - common
    return both.where(100 * common >= THRESHOLD_PERCENT * union).select("a", "b")


def linked_classes(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(node, root) of the classes that are linked with others."""
    keys, n_of = table_keys(classes), classes.select(F.col("cid").alias("first"), F.col("n_shingles").alias("n_first"))
    tables = keys.groupBy("key").agg(F.min("cid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tables = materialize(tables.join(n_of, "first"), "minhash: tables")
    crowded = materialize(keys.join(tables, "key").select("key", "cid", "n_shingles", "first", "n_first", "n"), "minhash: members")
    to_first = crowded.where((F.col("cid") != F.col("first")) & _like_sizes("n_shingles", "n_first"))
    to_first = materialize(to_first.select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct(), "minhash: first candidates")
    edges = materialize(verified(to_first, _sets(docs, classes, _both(to_first), words)), "minhash: first links")
    groups = materialize(components(edges), "minhash: first groups")

    # Classes of one table that are still apart; those of size two are settled.
    of = groups.select(F.col("node").alias("cid"), "root")
    apart = crowded.where("n > 2 AND cid <> first").join(of, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    apart = apart.select("key", "cid", "root", "n_shingles")
    apart = _open(apart).select("cid", "root", "n_shingles").distinct()
    apart = materialize(apart, "minhash: still apart")
    sets = _sets(docs, classes, apart.select("cid"), words)
    tokens = materialize(_rarest(sets, apart), "minhash: rarest shingles")
    x, y = tokens.alias("x"), tokens.alias("y")
    earlier = lambda t: F.slice(F.col(f"{t}.head"), F.lit(1), F.least(F.col(f"{t}.rank"), F.lit(HEAD)))
    rest = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.cid") < F.col("y.cid"))
                  & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y")
                  & ~F.arrays_overlap(earlier("x"), earlier("y")))
    rest = rest.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    rest = materialize(rest.join(to_first, ["a", "b"], "left_anti"), "minhash: other candidates")
    if rest.isEmpty():
        return groups
    return components(edges.unionByName(verified(rest, sets)))


def _may_link(x: str, y: str) -> Column:
    """Whether two sets that meet in a shingle can share enough.

    What they share is at most what both still have from that shingle on, and
    half of what is left of both without the items that their sketches show
    to be in one of them only.  Each bound is a condition of its own, and the
    first words of the sketches one before all of them: most pairs end there.
    """
    both = F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles")
    # shared / (both - shared) reaches the threshold
    enough = lambda shared: (100 + THRESHOLD_PERCENT) * shared >= THRESHOLD_PERCENT * both

    def differ(words: range) -> Column:
        return sum((F.bit_count(F.get(F.col(f"{x}.sketch"), F.lit(k)).bitwiseXOR(F.get(F.col(f"{y}.sketch"), F.lit(k))))
                    for k in words), F.lit(0))

    # Twice the shared items, so that nothing is rounded.
    apart = lambda words: (100 + THRESHOLD_PERCENT) * (both - differ(words)) >= 2 * THRESHOLD_PERCENT * both
    return (enough(F.col(f"{x}.n_shingles") - F.col(f"{x}.place")) & enough(F.col(f"{y}.n_shingles") - F.col(f"{y}.place"))
            & apart(range(SKETCH // 4)) & apart(range(SKETCH)))


def _open(members: DataFrame) -> DataFrame:
    """The members (key, root, ...) of tables that hold more than one group."""
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return members.join(mixed, "key")


def _rarest(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(item, cid, root, n_shingles, place, rank, head, sketch): the rarest shingles of each class
    that others of ``classes`` have too.

    All sets are put in one order, from rare to frequent among these classes;
    ``place`` counts from 0 in it.  Two sets that reach the threshold share
    one of their first ``n - ceil(0.8 n) + 1`` shingles, and from the first
    one they share on, each still has all of what they share.  Shingles that
    only one class has take part in the order, but meet nothing.  ``rank``
    counts the shared ones, and ``head`` has the first ``HEAD`` of them: two
    rows whose heads show an earlier meeting need not meet again.
    """
    items = sets.select("cid", F.explode("items").alias("item"))
    shared = materialize(items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash: shared shingles")
    of = items.join(shared, "item").join(classes, "cid")
    rare = Window.partitionBy("cid").orderBy("n", "item")
    alone = F.col("n_shingles") - F.count(F.lit(1)).over(Window.partitionBy("cid"))
    of = of.withColumn("rank", F.row_number().over(rare) - 1).withColumn("place", alone + F.col("rank"))
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * THRESHOLD_PERCENT / 100) + 1
    whole = rare.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.collect_list(F.when(F.col("rank") < HEAD, F.col("item"))).over(whole)
    of = of.where(F.col("place") < first).select("item", "cid", "root", "n_shingles", "place", "rank", head.alias("head"))
    return of.join(sets.select("cid", "sketch"), "cid")


def _both(pairs: DataFrame) -> DataFrame:
    """The classes (cid) in pairs (a, b)."""
    return pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The shingle sets of the classes ``wanted``, made again from the text of
    one document of each class."""
    wanted = wanted.join(classes.select("cid", "h", "g"), "cid")
    texts = docs.select(*_row_key(), text_of().alias("text")).join(wanted, ["h", "g"]).select("cid", "text")
    made = texts.dropDuplicates(["cid"]).mapInArrow(lambda b: _with_sets(b, words), "cid bigint, items array<bigint>, sketch array<bigint>")
    return materialize(made, "minhash: sets")


def near_groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z).  A document's set holds its distinct runs of
    ``words`` words; with fewer words, the whole sequence.  Documents of equal
    sets, or with 100 * intersection >= 80 * union, are linked; component_id
    is the smallest doc_id that links reach.  A document without words (null
    and empty texts too) has an empty set and is alone.  A null doc_id counts
    as largest; kept is whether the two ids are the same (null equals null).
    Repeated rows are documents with equal sets.  An empty table gives none.
    """
    rows = signatures(docs, words)
    classes = rows.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("h", "g", "sig")).alias("one"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "n_shingles", "least",
                                         F.col("one.h").alias("h"), F.col("one.g").alias("g"), F.col("one.sig").alias("sig")), "minhash: classes")
    groups = linked_classes(docs, classes, words)
    root = classes.join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(root.select("k1", "k2", "n_shingles", "root").join(names, "root").drop("root"), "minhash: names")
    full = rows.where("n_shingles > 0").join(named, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    out = full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The documents that stay: one row of each group, with all columns.  Of a
    group the smallest doc_id stays (null is the largest); of rows that also
    share that id, one."""
    numbered = materialize(packed(docs, F.monotonically_increasing_id().alias("rid")), "minhash: documents")
    groups = near_groups(numbered.select(F.col("rid").alias("doc_id"), "doc.text"), words)
    of = groups.select(F.col("doc_id").alias("rid"), "component_id").join(numbered.select("rid", "doc.doc_id"), "rid")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    stay = of.groupBy("component_id").agg(least.alias("s")).select(F.col("s.rid").alias("rid"))
    return own_columns(numbered.join(stay, "rid", "left_semi"), docs.columns)
