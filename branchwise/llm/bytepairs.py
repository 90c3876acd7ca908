"""Byte-level BPE by a shuffle of distinct words.

Texts are cut into pre-tokens, which are encoded apart from each other.  A
task gathers its texts into blocks of at most ``BLOCK_WORDS`` pre-tokens; a
block holds its distinct words once and, for each document, the positions:
the number of the word at every place.  The words go out by hash to buckets,
where those of all blocks meet, and each distinct one is encoded once.  The
ids go back to the blocks they came from, and every document is put together
by position.  What is shuffled is one row per (block, bucket), so a word that
makes up a third of all texts counts once per block, and no key is hot.

Decoding joins ids with the table of the bytes of each token.  That table has
as many rows as the vocabulary, whose size is checked, so every task holds it
and no id moves.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchwise.llm.common import bounded_batches, materialize_bucketed, nullable, quoted, text_of, with_arrow_column
from branchwise.session import materialize

#: Pre-tokens and distinct words that a block holds at most.
BLOCK_WORDS = 1 << 21
#: Characters of a text that are cut into pre-tokens at once.
SEGMENT = 1 << 20
#: The ranks are read on the driver and sent to the tasks.
MOST_MODEL_BYTES = 64 << 20
#: Ids that one row of output batches holds about.
BATCH_IDS = 1 << 21

#: A single space between two other characters always starts a pre-token, so
#: texts can be cut there.
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_ZSTD = pa.Codec("zstd", compression_level=3)


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines: token in base64, space, rank."""
    if os.path.getsize(path) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} is too large to send to every task")
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def neighbours_merged(word: bytes | str, ranks: dict) -> list[int]:
    """Where the symbols of a word end, one character each at first, after the
    neighbours of the lowest rank have merged, the leftmost first, until none
    can.  A heap of candidates, so long words take near-linear time."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(ranks[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        right = after[i]
        if not 0 < right < n or after[right] != end:
            continue  # one of the two has merged meanwhile
        after[i], after[right] = end, 0
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i:after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        i = after[i]
        out.append(i)
    return out


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word.  A word that is a token is that token."""
    if word in ranks:
        return [ranks[word]]
    ends = neighbours_merged(word, ranks)
    return [ranks[word[a:b]] for a, b in zip([0, *ends], ends, strict=False)]


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _pack(a: np.ndarray) -> bytes:
    """An array of unsigned 32-bit integers: its number, then the bytes of all
    by significance, compressed."""
    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(a).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(data[8:], 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _pack_ranks(a: np.ndarray) -> bytes:
    """Numbers of which the small ones are frequent: a byte each, where 255
    stands for the next one of the large numbers, which follow."""
    large = _pack(a[a >= 255] - 255)
    return len(large).to_bytes(8, "little") + large + len(a).to_bytes(8, "little") + _ZSTD.compress(
        np.minimum(a, 255).astype(np.uint8).tobytes(), asbytes=True)


def _unpack_ranks(data: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    out = np.frombuffer(_ZSTD.decompress(data[cut + 8:], int.from_bytes(data[cut:cut + 8], "little"), asbytes=True), np.uint8).astype(np.uint32)
    out[out == 255] = _unpack(data[8:cut]) + 255
    return out


def _pack_words(words: list[bytes]) -> bytes:
    sizes = _pack(np.fromiter(map(len, words), np.uint32, len(words)))
    joined = b"".join(words)
    head = len(sizes).to_bytes(8, "little") + len(joined).to_bytes(8, "little")
    return head + sizes + _ZSTD.compress(joined, asbytes=True)


def _unpack_words(data: bytes) -> list[bytes]:
    cut, size = int.from_bytes(data[:8], "little") + 16, int.from_bytes(data[8:16], "little")
    ends = np.cumsum(_unpack(data[16:cut]), dtype=np.int64).tolist()
    joined = _ZSTD.decompress(data[cut:], size, asbytes=True)
    return [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _segments(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of a text that are cut into pre-tokens apart; one for an empty text."""
    at = 0
    while True:
        cut = _CUT.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
        yield at, cut.start() if cut else len(text)
        if not cut:
            return
        at = cut.start()


class _Block:
    """Words of a block and the documents' parts in it."""

    def __init__(self):
        self.numbers, self.at, self.docs, self.parts, self.held = _Numbers(), [], [], [], 0

    def add(self, doc: pa.Array, of: int, part: int, words: list[str]) -> None:
        """The block's next part: a piece of document number ``of``."""
        self.at.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.docs.append(doc)
        self.parts.append((of, part, len(words)))
        self.held += len(words)

    def row(self, name: int, buckets: int, schema: pa.Schema) -> pa.RecordBatch:
        at = np.concatenate(self.at)
        order = np.argsort(-np.bincount(at, minlength=len(self.numbers)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        words = [w.encode("utf-8", "surrogatepass") for w in self.numbers]
        words = [words[i] for i in order.tolist()]
        bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        out = [{"bucket": int(bucket[own[0]]), "words": _pack_words([words[i] for i in own.tolist()])}
               for own in np.split(order, cuts) if len(own)]
        of, part, n = zip(*self.parts, strict=True)
        docs = pa.concat_arrays(self.docs)
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([name], pa.int64()),
            pa.array([of], schema.field("of").type), pa.array([part], schema.field("part").type),
            pa.array([n], schema.field("n").type),
            pa.array([_pack_ranks(rank[at])], pa.binary()),
            pa.array([_pack(bucket.astype(np.uint32))], pa.binary()),
            pa.array([out], schema.field("words").type)], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """doc, text -> blocks."""
    cut, first = regex.compile(pattern), TaskContext.get().partitionId() << 33
    of, name, block, schema = first - 1, first, _Block(), None
    for batch in batches:
        docs = batch.column("doc")
        schema = schema or pa.schema([
            ("docs", pa.list_(docs.type)), ("block", pa.int64()), ("of", pa.list_(pa.int64())), ("part", pa.list_(pa.int32())),
            ("n", pa.list_(pa.int64())), ("at", pa.binary()), ("bucket_of", pa.binary()),
            ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))])
        for i, text in enumerate(batch.column("text").to_pylist()):
            of += 1
            for part, (start, end) in enumerate(_segments(text)):
                words = cut.findall(text, start, end)
                if block.parts and block.held + len(words) > most:
                    yield block.row(name, buckets, schema)
                    name, block = name + 1, _Block()
                block.add(docs.slice(i, 1), of, part, words)
    if block.parts:
        yield block.row(name, buckets, schema)


def _encoded_bucket(table: pa.Table, ranks: dict[bytes, int]) -> pa.Table:
    """The words of one bucket from all blocks: each distinct one encoded
    once, the ids in the order of each block's words."""
    seen: dict[bytes, list[int]] = {}
    out = []
    for packed in table.column("words").to_pylist():
        ids = []
        for word in _unpack_words(packed):
            if word not in seen:
                seen[word] = merged(word, ranks)
            ids.append(seen[word])
        sizes = _pack(np.fromiter(map(len, ids), np.uint32, len(ids)))
        flat = _pack(np.fromiter((x for w in ids for x in w), np.uint32))
        out.append(len(sizes).to_bytes(8, "little") + sizes + flat)
    return pa.table([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start + size]`` end to end."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the ids of their words -> doc, of, part, ids."""
    for batch in batches:
        for b in range(batch.num_rows):
            take = lambda c, b=b: batch.column(c)[b]
            order = np.argsort(_unpack(take("bucket_of").as_py()), kind="stable")
            sizes, flat = [], []
            for packed in sorted(take("ids").as_py() or [], key=lambda x: x["bucket"]):
                cut = int.from_bytes(packed["ids"][:8], "little") + 8
                sizes.append(_unpack(packed["ids"][8:cut]))
                flat.append(_unpack(packed["ids"][cut:]))
            in_order = np.concatenate(sizes or [np.empty(0, np.uint32)]).astype(np.int64)
            flat = np.concatenate(flat or [np.empty(0, np.uint32)])
            size, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            size[order], start[order] = in_order, np.cumsum(in_order) - in_order
            at = _unpack_ranks(take("at").as_py())
            ends = np.cumsum(take("n").values.to_numpy())
            per_place = np.concatenate([[0], np.cumsum(size[at])])
            ids_until = np.concatenate([[0], per_place[ends]])
            docs, of, part = take("docs").values, take("of").values, take("part").values
            i = 0
            while i < len(ends):
                j = max(i + 1, int(np.searchsorted(ids_until, ids_until[i] + BATCH_IDS)) - 1)
                own = at[ends[i - 1] if i else 0:ends[j - 1]]
                ids = _gathered(flat, start[own], size[own]).astype("<u4").tobytes()
                cuts = 4 * (ids_until[i:j + 1] - ids_until[i])
                column = pa.array([ids[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([docs.slice(i, j - i), of.slice(i, j - i), part.slice(i, j - i), column],
                                                 ["doc", "of", "part", "ids"])
                i = j


def _joined(table: pa.Table) -> pa.Table:
    """The parts of one document, in order."""
    parts = sorted(zip(table.column("part").to_pylist(), table.column("ids").to_pylist(), strict=True))
    return pa.table([table.column("doc").slice(0, 1), pa.array([b"".join(x for _, x in parts)], pa.binary())], names=["doc", "ids"])


def _fields(ddl: str, **first: T.DataType) -> T.StructType:
    """A schema: the fields ``first``, then those of ``ddl``."""
    return T.StructType([*[T.StructField(n, t) for n, t in first.items()], *T.StructType.fromDDL(ddl)])


def encode(docs: DataFrame, ranks: str, pattern: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``, repeated rows too: its columns except the
    text, and ``ids`` and ``n_ids``.

    ``ids`` is binary, each id as a little-endian unsigned 32-bit integer
    (``unpacked`` makes arrays of them).  Matches of ``pattern`` are encoded
    apart; what lies between matches is dropped.  Special tokens do not exist:
    their strings are ordinary text.  A null or empty text has no ids.  An
    empty table gives none.  Own columns named ``ids`` or ``n_ids`` give way.
    ``ranks`` is the path of a rank file on the driver.  A text is never cut
    short; it may lie in several blocks.
    """
    spark, table = docs.sparkSession, load_ranks(ranks)
    bounded_batches(spark)
    own = [c for c in docs.columns if c not in ("text", "ids", "n_ids")]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *quoted(own)).alias("doc"), text_of().alias("text"))
    doc = nullable(rows.schema["doc"].dataType)
    buckets = 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Bucketed by block, so that the positions stay where they are when the ids come back.
    blocks = materialize_bucketed(rows.mapInArrow(lambda b: _blocks(b, pattern, buckets, block_words), _fields(
        "block bigint, of array<bigint>, part array<int>, n array<bigint>, at binary, bucket_of binary, "
        "words array<struct<bucket:int,words:binary>>", docs=T.ArrayType(doc))), "block", "byte pairs: blocks")
    words = blocks.select("block", F.inline("words"))
    encoded = words.groupBy("bucket").applyInArrow(lambda t: _encoded_bucket(t, table), "block bigint, bucket int, ids binary")
    back = encoded.groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("ids"))
    parts = blocks.drop("words").join(back, "block", "left").mapInArrow(
        _assembled, _fields("of bigint, part int, ids binary", doc=doc))
    split = blocks.select(F.explode(F.arrays_zip("of", "part")).alias("p")).where("p.part > 0").select("p.of").distinct()
    several = materialize(split, "byte pairs: texts in parts")
    if several.isEmpty():
        whole = parts.select("doc", "ids")
    else:
        parts = materialize(parts, "byte pairs: parts")
        apart = parts.join(several, "of", "left_semi").groupBy("of").applyInArrow(_joined, _fields("ids binary", doc=doc))
        whole = parts.join(several, "of", "left_anti").select("doc", "ids").unionByName(apart)
    return whole.select(*[F.col("doc").getField(c).alias(c) for c in own], "ids",
                        F.floor(F.octet_length("ids") / 4).alias("n_ids"))


def unpacked(rows: DataFrame, column: str = "ids", out: str = "id_list") -> DataFrame:
    """``rows`` with ``out``, the ids as an array of integers; null gives an empty one."""
    made = lambda ids: pa.array([np.frombuffer(x or b"", "<i4") for x in ids.to_pylist()], pa.list_(pa.int32()))
    return with_arrow_column(rows, column, out, T.ArrayType(T.IntegerType()), made)


def _decoded(ids: pa.Array, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    texts = []
    for packed in ids.to_pylist():
        of = np.frombuffer(packed or b"", "<u4")
        if len(of) and of.max() >= len(sizes):
            raise ValueError(f"id {of.max()} has no token")
        texts.append(_gathered(data, starts[of], sizes[of]).tobytes())
    return pa.array(texts, pa.binary())


def decode(rows: DataFrame, ranks: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the bytes of each row's ids, in place of a column
    of that name.  Null and empty ids give no bytes; an id beyond the table is
    an error."""
    table = load_ranks(ranks)
    tokens = [b""] * (max(table.values(), default=-1) + 1)
    for token, rank in table.items():
        tokens[rank] = token
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(tokens), np.uint8)
    return with_arrow_column(rows, column, out, T.BinaryType(), lambda ids: _decoded(ids, data, starts, sizes))
