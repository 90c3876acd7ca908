"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are counted in words.  Every source gets a target; its documents, in
shuffled order, form a stream of words that repeats; the stream is cut into
blocks of equal size.  A schedule of slots says which source each block of
the mix comes from: van der Corput points, mapped through the cumulative
weights, hit every source evenly along the whole schedule.  The slots of a
source are ranked, and rank ``r`` takes block ``r`` of its stream.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.llm.common import hash_chunk, own_columns, packed, running_sum, sorted_names, text_of, words_in
from branchwise.session import materialize, materialize_observed

# Weights given to the sources in their order, repeating, and
# how often a source may be taken at most.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BLOCK_WORDS = 512
SLOT_CHUNK = 1 << 14


def cycle(values: tuple[int, ...]):
    """Weight of a source from its position, repeating ``values``."""
    return lambda position: F.element_at(F.array(*[F.lit(v) for v in values]),
                                         (position % len(values) + 1).cast("int")).cast("bigint")


def water_level(sources: DataFrame, most: int = MOST_EPOCHS) -> float:
    """The words each unit of weight gets, so that targets of ``level *
    weight``, stopped at ``most`` times a source's size, add up to all words.

    Reshares the excess of stopped sources until none is above: one small
    aggregate over the sources per step.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while total and level != before:
        stopped = most * F.col("source_size") <= F.lit(level) * F.col("weight")
        full, weight = sources.agg(
            F.coalesce(F.sum(F.when(stopped, most * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0))).first()
        before, level = level, (total - full) / weight
    return level


def plan_sources(rows: DataFrame, weight_of=None, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: ``source_id`` (its place by code point, null last),
    size, weight, target, ``quota`` (the target in whole words) and the first
    number of its blocks among all blocks."""
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"))
                        .withColumn("unnamed", F.col("source").isNull()), "mixing: sources")
    named = sorted_names(sizes, ["unnamed", "source"], sizes.count(), "source_id")
    weighed = materialize(named.withColumn("weight", (weight_of or cycle(WEIGHTS))(F.col("source_id"))),
                          "mixing: weights")
    level, cap = water_level(weighed, most), (most * F.col("source_size")).cast("double")
    out = weighed.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap))
    out = out.withColumn("quota", F.least(F.floor(F.col("target") + 0.5), most * F.col("source_size")))
    out = out.withColumn("blocks", F.ceil(F.col("quota") / BLOCK_WORDS).cast("bigint"))
    out = out.withColumn("all", F.lit(0)).withColumn("chunk", F.floor(F.col("source_id") / 4096))
    out = running_sum(out, "all", "chunk", ["source_id"], "blocks", "first_block")
    return materialize(out.drop("all", "chunk", "unnamed"), "mixing: plan")


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, source_id, block): slots in the order of the mix.

    Point j is the bit reversal of j, scaled to the number of blocks; the
    source whose range of blocks holds it gets the slot.  Sources that the
    points leave short of their last blocks (fewer than the logarithm of all
    slots) get these in slots after the others; points beyond a source's last
    block are not used.
    """
    spark = sources.sparkSession
    n, count = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count(F.lit(1))).first()
    bits, width = max(1, math.ceil(math.log2(max(2, n)))), max(1, math.ceil(n / max(1, count)))
    turned = F.conv(F.reverse(F.lpad(F.bin(F.col("id")), bits, "0")), 2, 10).cast("double")
    points = spark.range(n).select(F.col("id").alias("slot"),
                                   F.least(F.floor(turned * (n / 2.0**bits)), F.lit(max(0, n - 1))).alias("x"))
    # Ranges and points meet in bins as wide as the mean range.
    bin_of = lambda c: F.floor(c / width)
    ranges = sources.where("blocks > 0").withColumn("last_block", F.col("first_block") + F.col("blocks") - 1).select(
        "source_id", "blocks", "first_block", "last_block",
        F.explode(F.sequence(bin_of(F.col("first_block")), bin_of(F.col("last_block")))).alias("bin"))
    hit = points.withColumn("bin", bin_of(F.col("x"))).join(ranges, "bin").where(
        F.col("x").between(F.col("first_block"), F.col("last_block")))
    hit = hit.select("slot", "source_id", "blocks", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"),
                     F.lit(1).cast("bigint").alias("one"))
    hit = materialize(running_sum(hit, "source_id", "chunk", ["slot"], "one", "block")
                      .select("slot", "source_id", "block", "blocks"), "mixing: slots")
    got = hit.groupBy("source_id").agg(F.count(F.lit(1)).alias("got"))
    short = sources.join(got, "source_id", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < blocks")
    late = short.select("source_id", "first_block", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("block"))
    return hit.where("block < blocks").select("slot", "source_id", "block").unionByName(
        late.select((F.lit(n) + F.col("first_block") + F.col("block")).alias("slot"), "source_id", "block"))


def pieces(rows: DataFrame, sources: DataFrame, n_rows: int, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix: (slot, source_id, rid, epoch, from_word, to_word), the words of
    a document that a slot takes.  Documents of a source follow each other by
    the hash of id and text, the same in every run."""
    plan = sources.select("source", "source_id", "source_size", "quota")
    own = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"]).where("size > 0")
    own = running_sum(own.withColumn("chunk", hash_chunk("h", n_rows)), "source_id", "chunk", ["h", "rid"], "size", "start")
    turns = own.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    turns = turns.withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size"))
    turns = turns.withColumn("end", F.least(F.col("at") + F.col("size"), "quota")).where("at < end")
    block = lambda c: F.floor(c / BLOCK_WORDS)
    cut = turns.withColumn("block", F.explode(F.sequence(block(F.col("at")), block(F.col("end") - 1))))
    cut = cut.select("source_id", "block", "rid", "epoch",
                     (F.greatest("at", F.col("block") * BLOCK_WORDS) - F.col("at")).alias("from_word"),
                     (F.least("end", (F.col("block") + 1) * BLOCK_WORDS) - F.col("at")).alias("to_word"))
    return cut.join(schedule(sources), ["source_id", "block"])


def sized(docs: DataFrame, rid: Column) -> tuple[DataFrame, int]:
    """A written table of the documents' sizes and places in the shuffle, with
    the number ``rid`` of each row, and how many they are."""
    rows = docs.select("doc_id", "source", words_in(text_of()).alias("size"),
                       F.xxhash64(F.lit("mix"), "doc_id", text_of()).alias("h"), rid.alias("rid"))
    rows, seen = materialize_observed(rows, "mixing: sizes", n=F.count(F.lit(1)))
    return rows, seen["n"]


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, mix) of a table of documents.

    - null or empty text: size 0, never taken; null source: the last source;
    - repeated rows are documents of their own;
    - no document is taken more than ``MOST_EPOCHS`` times its size;
    - an empty table gives an empty mix.
    """
    rows, n = sized(docs, F.monotonically_increasing_id())
    sources = plan_sources(rows)
    return rows, sources, pieces(rows, sources, n)


def taken(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken."""
    rows, sources, parts = mix(docs)
    words = parts.groupBy("rid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    plan = sources.select(F.col("source").alias("s"), "source_size", "target", "source_id")
    out = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).join(words, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole, each as often as the mix takes it: a
    copy per epoch that takes at least half its words."""
    numbered = materialize(packed(docs, F.monotonically_increasing_id().alias("rid")), "mixing: documents")
    rows, n = sized(numbered.select("doc.doc_id", "doc.source", "doc.text", "rid"), F.col("rid"))
    sources = plan_sources(rows)
    words = pieces(rows, sources, n).groupBy("rid", "epoch").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    copies = (words.join(rows.select("rid", "size"), "rid").where("2 * taken >= size")
              .groupBy("rid").agg(F.count(F.lit(1)).cast("int").alias("n")))
    out = numbered.join(copies, "rid").select("doc", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return own_columns(out, docs.columns)
