"""Shards by consistent hashing with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring.  A key hashes to a place and
belongs to the next point clockwise.  No shard takes more than its capacity:
what overflows continues clockwise to the next point whose shard has room, so
balance is guaranteed, and a key moves only when a shard on its way is full.

Only DataFrame functions over the documents.  What the driver sees is one
load per arc of the ring (``shards * vnodes`` numbers, whatever the size of
the corpus): from these it follows how far each arc fills which shard.  The
rows of an arc are then cut at those marks by their running load.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import hash_chunk, running_sum, text_of
from branchwise.session import materialize_observed

RING = 1 << 40
CELLS = 4096


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, in ring order."""
    def place(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % RING
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Loads that the shards may take.  Without slack they add up to the total
    exactly and are at most one apart."""
    if slack:
        return [ceil((1 + slack) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def fill(points: list[tuple[int, int]], loads: dict[int, int], caps: list[int]) -> list[tuple[int, int, int, int]]:
    """Marks (arc, from, to, shard) on each arc's running load.

    In wave 0 every arc offers its load to its own point, in wave 1 what is
    left goes to the next point, and so on.  A shard takes what it has room
    for, so keys near a shard come before keys that overflowed elsewhere.
    """
    room, done, marks = list(caps), dict.fromkeys(loads, 0), []
    for wave in range(len(points)):
        left = [a for a in sorted(loads) if done[a] < loads[a]]
        if not left:
            break
        for a in left:
            shard = points[(a + wave) % len(points)][1]
            take = min(room[shard], loads[a] - done[a])
            if take > 0:
                marks.append((a, done[a], done[a] + take, shard))
                done[a] += take
                room[shard] -= take
    return marks


def _arcs_by_cell(spark: SparkSession, points: list[tuple[int, int]]) -> DataFrame:
    """Which arc covers which places, cut at the borders of equal cells, so
    that a place finds its arc by an equality join on its cell."""
    places, width, rows = [p for p, _ in points], RING // CELLS, []
    for cell in range(CELLS):
        lo, end = cell * width, (cell + 1) * width
        while lo < end:
            i = bisect_left(places, lo)  # the point at or after lo, the first one past the end
            hi = min(end, places[i] + 1) if i < len(places) else end
            rows.append((cell, lo, hi, i % len(places)))
            lo = hi
    return spark.createDataFrame(rows, "cell int, place_from bigint, place_to bigint, arc int")


def assign(docs: DataFrame, shards: int = 16, vnodes: int = 64, unit: str = "rows", slack: float = 0.0,
           key: str = "doc_id") -> DataFrame:
    """One row per document, repeated rows too: its columns except the text,
    ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``shard`` and
    ``slot`` (gapless from 0 within the shard).

    ``unit`` says what the capacity counts: ``rows`` or ``bytes`` (there a
    shard may exceed its capacity by less than one document per arc that it
    serves).  ``slack`` is the share above the mean that a shard may take;
    more slack, fewer keys that overflow.

    A null text is empty.  A null key hashes like any other value.  Rows with
    one key share a place; if they overflow, the hash of key and text orders
    them.  Own columns of the documents named like a result column give way.
    """
    spark, added = docs.sparkSession, ("size", "text_crc32", "shard", "slot")
    own = [c for c in docs.columns if c != "text" and c not in added]
    size = (F.octet_length(text_of()) + 1).cast("bigint")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), size.alias("size"),
                       F.crc32(text_of()).alias("text_crc32"),
                       F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(RING)).alias("place"),
                       F.xxhash64(F.col(f"`{key}`"), text_of()).alias("h"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id()).withColumn(
        "load", F.col("size") if unit == "bytes" else F.lit(1).cast("bigint"))
    points = ring_points(shards, vnodes)
    cells = F.broadcast(_arcs_by_cell(spark, points))  # CELLS + shards * vnodes rows at most
    cell = F.floor(F.col("place") / (RING // CELLS)).cast("int")
    within = (F.col("place") >= F.col("place_from")) & (F.col("place") < F.col("place_to"))
    rows = rows.withColumn("cell", cell).join(cells, "cell").where(within).drop("cell", "place_from", "place_to")
    rows, seen = materialize_observed(rows, "sharding: rows on the ring", n=F.count(F.lit(1)), total=F.sum("load"))

    loads = {r["arc"]: r["s"] for r in rows.groupBy("arc").agg(F.sum("load").alias("s")).collect()}
    marks = fill(points, loads, capacities(seen["total"] or 0, shards, slack))
    cuts = spark.createDataFrame(marks, "arc int, cut_from bigint, cut_to bigint, shard int")

    # The share of rows in the fullest arc and shard sets the size of a chunk.
    fullest = seen["n"] * max(loads.values(), default=0) // max(1, seen["total"] or 0)
    rows = running_sum(rows.withColumn("chunk", hash_chunk("h", fullest)), "arc", "chunk", ["h", "rid"], "load", "start")
    rows = rows.join(F.broadcast(cuts), "arc").where(
        (F.col("start") >= F.col("cut_from")) & (F.col("start") < F.col("cut_to")))
    rows = rows.withColumn("chunk", hash_chunk("h", ceil(seen["n"] / shards))).withColumn("one", F.lit(1).cast("bigint"))
    rows = running_sum(rows, "shard", "chunk", ["h", "rid"], "one", "slot")
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in own], *added)
