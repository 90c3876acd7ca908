"""How far the sources of a language differ in their words.

The vocabulary of each language is a minimal acyclic transducer: built from
the sorted kept terms, it reads a term byte by byte and adds up, on the way,
the number of kept terms before it.  That ordinal names the term from then
on: the texts are streamed through the transducer to be counted, counts move
as integers, and ties are broken by ordinals, which follow the UTF-8 order.

Scale.  Terms are counted per task before any shuffle, so neither a hot
source nor a frequent term makes a hot key.  Transducers hold at most
``SHARD_TERMS`` terms each.  Tasks get as many as fit ``MOST_BYTES``; a larger
vocabulary takes more passes over the texts, each with the next transducers.
Pairs of sources meet once per block of ``BLOCK_TERMS`` ordinals.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchwise.llm.common import bounded_batches, sorted_names, text_of
from branchwise.session import materialize, materialize_observed

LEAST_DOCS = 10
TOP_TERMS = 10
#: Terms of one transducer, and bytes of the transducers of one pass.
SHARD_TERMS = 1 << 17
MOST_BYTES = 32 << 20
BLOCK_TERMS = 256
#: Distinct terms that a task counts before it hands the counts on.
HELD_TERMS = 1 << 19
SCALE = 1_000_000_000

#: ASCII letters (A-Z lower-cased) and every byte of a longer
#: code point belong to terms; all else parts them.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_ZSTD = pa.Codec("zstd", compression_level=3)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text: runs of letters of ASCII and of other code points."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Transducer:
    """A minimal acyclic transducer from sorted, distinct terms to ordinals.

    States are numbered from the ends up; the last one is the start.  Arcs lie
    sorted by state and byte, with their target and what they add.
    """

    def __init__(self, arcs: np.ndarray, final: np.ndarray):
        self.keys = arcs[0].astype(np.int64) * 256 + arcs[1]
        self.target, self.adds, self.final = arcs[2].astype(np.int64), arcs[3].astype(np.int64), final
        self.start = len(final) - 1

    @classmethod
    def build(cls, terms: Iterator[bytes]) -> bytes:
        """The packed transducer of sorted terms: what is shared with the term
        before stays open, the rest of that one is minimised."""
        register: dict[tuple, int] = {}
        counts, finals, arcs = [], [], []  # by state
        path: list[list] = [[False, []]]  # open nodes: final, [(byte, state)]
        before = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, out = path.pop()
                path[-1][1].append((before[len(path) - 1], state(final, tuple(out))))

        def state(final: bool, out: tuple) -> int:
            if (found := register.get((final, out))) is not None:
                return found
            name, held = len(finals), int(final)
            for byte, to in out:
                arcs.append((name, byte, to, held))
                held += counts[to]
            counts.append(held)
            finals.append(final)
            register[(final, out)] = name
            return name

        for term in terms:
            shared = 0
            while shared < min(len(term), len(before)) and term[shared] == before[shared]:
                shared += 1
            close(shared)
            path.extend([False, []] for _ in range(len(term) - shared))
            path[-1][0], before = True, term
        close(0)
        state(path[0][0], tuple(path[0][1]))  # the start; no state below it reads as long a term
        flat = np.array(arcs, np.uint32).reshape(-1, 4).T
        data = np.packbits(np.array(finals, bool)).tobytes() + flat.tobytes()
        head = np.array([len(finals), flat.shape[1], len(data)], "<u8").tobytes()
        return head + _ZSTD.compress(data, asbytes=True)

    @classmethod
    def load(cls, packed: bytes) -> Transducer:
        states, arcs, size = (int(x) for x in np.frombuffer(packed[:24], "<u8"))
        data, bits = _ZSTD.decompress(packed[24:], size, asbytes=True), (states + 7) // 8
        final = np.unpackbits(np.frombuffer(data[:bits], np.uint8), count=states).astype(bool)
        return cls(np.frombuffer(data[bits:], np.uint32).reshape(4, arcs), final)

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """The ordinal of each term, -1 for one that was not built in.  All
        terms advance together, a byte per step."""
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        data, start = np.frombuffer(b"".join(terms) + b"\0", np.uint8), np.cumsum(size) - size
        state, total = np.full(len(terms), self.start), np.zeros(len(terms), np.int64)
        out, live, k = np.full(len(terms), -1, np.int64), np.arange(len(terms)), 0
        while len(live):
            ended = live[size[live] == k]
            ended = ended[self.final[state[ended]]]
            out[ended] = total[ended]
            live = live[size[live] > k]
            if not len(live) or not len(self.keys):
                break
            key = state[live] * 256 + data[start[live] + k]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            live, arc = live[hit], arc[hit]
            total[live] += self.adds[arc]
            state[live] = self.target[arc]
            k += 1
        return out


def _doc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, term, n_docs, counted per task as far as memory allows."""
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            terms = pa.array([t.decode("utf-8", "surrogatepass") for t in counts], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), terms,
                                              pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n_docs"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held[lang].update(set(terms_of(text)))
        if sum(map(len, held.values())) > HELD_TERMS:
            yield from out()
    yield from out()


def _built(table: pa.Table) -> pa.Table:
    """The terms of one shard -> lang, base, first, packed."""
    table = table.sort_by("ordinal")
    terms = table.column("term").to_pylist()
    packed = Transducer.build(t.encode("utf-8", "surrogatepass") for t in terms)
    return pa.table([table.column("lang").slice(0, 1), table.column("ordinal").slice(0, 1), pa.array([terms[0]], pa.string()),
                     pa.array([packed], pa.binary())], names=["lang", "base", "first", "packed"])


_LOADED: dict[str, dict] = {}


def _transducers(shards: list[tuple], key: str) -> dict[str, list[tuple]]:
    """By language: (first term, base, transducer), sorted; loaded once per worker."""
    if key not in _LOADED:
        _LOADED.clear()
        by_lang = defaultdict(list)
        for lang, base, first, packed in shards:
            by_lang[lang].append((first.encode("utf-8", "surrogatepass"), base, Transducer.load(packed)))
        _LOADED[key] = {lang: sorted(own, key=lambda s: s[1]) for lang, own in by_lang.items()}
    return _LOADED[key]


def _recounted(batches: Iterator[pa.RecordBatch], shards: list[tuple], key: str) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> lang, source, ordinal, n; ordinal -1 says that the group occurs."""
    by_lang, held = _transducers(shards, key), defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            own = by_lang.get(lang, [])
            terms, firsts = sorted(counts) if len(own) > 1 else list(counts), [s[0] for s in own]
            cuts = [0, *[bisect.bisect_left(terms, f) for f in firsts[1:]], len(terms)]
            ordinals, n = [np.array([-1])], [np.array([0])]
            for (_, base, transducer), a, b in zip(own, cuts[:-1], cuts[1:], strict=False):
                found = transducer.ordinals(terms[a:b])
                hit = np.flatnonzero(found >= 0)
                ordinals.append(found[hit] + base)
                n.append(np.array([counts[terms[a + i]] for i in hit.tolist()], np.int64))
            ordinal = np.concatenate(ordinals)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(ordinal), pa.string()), pa.array([source] * len(ordinal), pa.string()),
                 pa.array(ordinal, pa.int64()), pa.array(np.concatenate(n), pa.int64())], ["lang", "source", "ordinal", "n"])
        held.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("lang", "source", "text")]
        for lang, source, text in zip(*columns, strict=True):
            held[lang, source].update(terms_of(text) if lang in by_lang else ())
        if sum(map(len, held.values())) > HELD_TERMS:
            yield from out()
    yield from out()


def vocabulary(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, ordinal): the terms in at least ``least`` documents of a
    language.  Ordinals number all languages' terms on, in the order of
    language and term."""
    counted = docs.select("lang", "text").mapInArrow(_doc_counts, "lang string, term string, n_docs bigint")
    kept = counted.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least)
    kept, seen = materialize_observed(kept.select("lang", "term"), "divergence: kept terms", n=F.count(F.lit(1)))
    return materialize(sorted_names(kept, ["lang", "term"], seen["n"], "ordinal"), "divergence: ordinals")


def recount(docs: DataFrame, names: DataFrame, most: int = MOST_BYTES, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of the kept terms in each group,
    and a row of ordinal -1 for every group that occurs."""
    shard = F.floor(F.col("ordinal") / shard_terms).alias("shard")
    built = materialize(names.select("lang", "term", "ordinal", shard).groupBy("lang", "shard").applyInArrow(
        _built, "lang string, base bigint, first string, packed binary"), "divergence: transducers")
    passes: list[tuple[int, int]] = []  # ranges of ordinals whose transducers fit together
    held = 0
    for base, size in built.select("base", F.octet_length("packed")).orderBy("base").toLocalIterator():
        if passes and held + size <= most:
            passes[-1], held = (passes[-1][0], base), held + size
        else:
            passes, held = [*passes, (base, base)], size
    made = []
    for low, high in passes or [(0, -1)]:
        shards = [tuple(r) for r in built.where(F.col("base").between(low, high)).collect()]
        key = hashlib.sha256(b"".join(s[3] for s in shards)).hexdigest()
        counts = docs.mapInArrow(lambda b, s=shards, k=key: _recounted(b, s, k), "lang string, source string, ordinal bigint, n bigint")
        made.append(materialize(counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "divergence: counts"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more.where("ordinal >= 0"))
    return out


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * terms)))


def _difference(p: str, q: str) -> Column:
    p, q = F.col(p), F.col(q)
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(table: pa.Table) -> pa.Table:
    """The rows of one block of ordinals: lang, source, none (the share of a
    term that the source lacks), ordinal, p -> lang, a, b, value for a < b."""
    sources = table.column("source").dictionary_encode().combine_chunks()
    row, names = sources.indices.to_numpy(), sources.dictionary.to_pylist()
    ordinal, none = table.column("ordinal").to_numpy(), table.column("none").to_numpy()
    terms, column = np.unique(ordinal[ordinal >= 0], return_inverse=True)
    shares = np.empty((len(names), len(terms)), np.int64)
    shares[row] = none[:, None]
    some = ordinal >= 0
    shares[row[some], column] = table.column("p").to_numpy()[some]
    order = sorted(range(len(names)), key=lambda i: names[i].encode("utf-8", "surrogatepass"))
    a, b, value = [], [], []
    for k, i in enumerate(order[:-1]):
        others = order[k + 1:]
        d = shares[others] - shares[i]
        value.append((d * d // (shares[others] + shares[i])).sum(axis=1))
        a += [names[i]] * len(others)
        b += [names[j] for j in others]
    lang = table.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()),
                     pa.array(np.concatenate(value or [np.empty(0, np.int64)]), pa.int64())], names=["lang", "a", "b", "value"])


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, most: int = MOST_BYTES,
          shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank).

    - part ``pair``: each other source of the language, with the summed
      difference of the two sources' shares of all kept terms;
    - part ``term``: the ``top`` kept terms that a source has more of than its
      language, with the difference.

    Ranks go from 1 per group and part, by value descending, then by the item
    in UTF-8 order.  Null text, language and source count as ''.  A document
    without terms still makes its group occur; a language without kept terms
    has pairs of value 0.  Repeated rows count as documents of their own.  An
    empty table gives none.  Other columns take no part.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], text_of().alias("text"))
    names = vocabulary(rows, least)
    counted = recount(rows, names, most, shard_terms)
    counts = counted.where("ordinal >= 0")
    sizes = names.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(sizes, "lang", "left")
    none = _share(F.lit(0), F.col("total"), F.col("v")).alias("none")
    groups = materialize(totals.select("lang", "source", "total", F.coalesce("v", F.lit(0)).alias("v")).select("*", none),
                         "divergence: groups")
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "ordinal", "n", "none", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"))

    # Pairs: every block of ordinals sees all sources of its language.
    block = F.floor(F.col("ordinal") / BLOCK_TERMS).alias("block")
    blocks = names.select("lang", block).distinct().join(groups.select("lang", "source", "none"), "lang")
    met = shares.select("lang", "source", "none", "ordinal", "p", block).unionByName(
        blocks.withColumn("ordinal", F.lit(-1).cast("bigint")).withColumn("p", F.col("none")))
    sums = met.groupBy("lang", "block").applyInArrow(_pair_sums, "lang string, a string, b string, value bigint")
    sums = materialize(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence: pairs")
    one_way = lambda a, b: sums.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "value")
    sums = one_way("a", "b").unionByName(one_way("b", "a"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    ranked = lambda *order: F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked(F.desc("value"), "item"))

    # Terms: ordinals break the ties; only the winners' names are looked up.
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n_lang"))
    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("v").alias("lang_v"))
    whole = whole.join(lang_totals, "lang").select(
        "lang", "ordinal", _share(F.col("n_lang"), F.col("lang_total"), F.col("lang_v")).alias("q"))
    over = shares.join(whole, ["lang", "ordinal"]).where("p > q").withColumn("value", _difference("p", "q"))
    best = over.select("lang", "source", "ordinal", "value", ranked(F.desc("value"), "ordinal")).where(F.col("rank") <= top)
    terms = best.join(names.select("ordinal", F.col("term").alias("item")), "ordinal").select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
