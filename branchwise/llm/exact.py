"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size.  The distinct blocks are sorted into
integer names; then adjacent names are paired and the distinct pairs named
again, level by level, until every document has one name.  Two documents of
as many blocks have the same name exactly if their texts are identical: a name
stands for one block or one pair, never for a hash of it.

Text is shuffled once, to find the distinct blocks.  The documents look up
their blocks' names by a 64-bit hash; blocks of different content that share
a hash are found among the names, and those are looked up by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.llm.common import own_columns, packed, text_of
from branchwise.session import materialize, materialize_observed

BLOCK_CHARS = 4096
#: Stands for the missing right half of a last, unpaired name.
NOTHING = -(1 << 63)


def _blocks(chars: int) -> Column:
    """The text in blocks; an empty text is one empty block."""
    return F.when(text_of() == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text_of(), F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))


def _named(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` with an integer ``name`` each: the sorted values of a
    partition get consecutive numbers, partitions have ranges of their own.
    Written at once, so the names stay what they are."""
    return values.groupBy(*keys).agg(F.lit(1).alias("_")).sortWithinPartitions(*reversed(keys)).select(
        *keys, F.monotonically_increasing_id().alias("name"))


def _level_0(docs: DataFrame, rows: DataFrame, chars: int, hashed) -> DataFrame:
    """(rid, n_blocks, idx, name) of every block of every row."""
    blocks = docs.select(F.explode_outer(_blocks(chars)).alias("b")).select(hashed(F.col("b")).alias("h"), "b")
    names = materialize(_named(blocks, ["h", "b"]).select("h", "name"), "exact: names of blocks")
    places = rows.select("rid", "text_sha256", F.size("hs").alias("n_blocks"), F.posexplode("hs").alias("idx", "h"))
    shared = names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    if shared.isEmpty():
        return places.join(names, "h").select("rid", "n_blocks", "idx", "name")
    shared = materialize(shared, "exact: hashes of several blocks")
    apart = docs.select(F.sha2(text_of(), 256).alias("text_sha256"), F.posexplode(_blocks(chars)).alias("idx", "b"))
    apart = materialize(apart.withColumn("h", hashed(F.col("b"))).join(shared, "h", "left_semi").distinct(),
                        "exact: blocks that share a hash")
    by_content = materialize(_named(apart, ["b"]), "exact: names by content")
    apart = apart.join(by_content, "b").select("text_sha256", "idx", (-1 - F.col("name")).alias("name"))
    plain = places.join(names.join(shared, "h", "left_anti"), "h").select("rid", "n_blocks", "idx", "name")
    rest = places.join(shared, "h", "left_semi").join(apart, ["text_sha256", "idx"])
    return plain.unionByName(rest.select("rid", "n_blocks", "idx", "name"))


def identities(docs: DataFrame, rid: Column, chars: int = BLOCK_CHARS, hashed=F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(rows, identity): ``rows`` has rid, doc_id, text_sha256 of every row of
    ``docs``; ``identity`` has rid, n_blocks, name.  ``hashed`` is only used to
    look names up; any function of the block gives the same result."""
    rows = docs.select(rid.alias("rid"), "doc_id", F.sha2(text_of(), 256).alias("text_sha256"), _blocks(chars).alias("b"))
    rows = rows.select("rid", "doc_id", "text_sha256", F.transform("b", lambda x: hashed(x)).alias("hs"))
    rows, seen = materialize_observed(rows, "exact: block hashes", longest=F.max(F.size("hs")))
    left = materialize(_level_0(docs, rows, chars, hashed), "exact: level 0")
    done, length = left.where("n_blocks = 1").select("rid", "n_blocks", "name"), seen["longest"] or 0
    left, level = left.where("n_blocks > 1"), 0
    while length > 1:
        level += 1
        length = (length + 1) // 2
        half = F.floor(F.col("idx") / 2).cast("int")
        side = lambda odd: F.max(F.when(F.col("idx") % 2 == odd, F.col("name")))
        pairs = left.groupBy("rid", "n_blocks", half.alias("idx")).agg(
            side(0).alias("a"), F.coalesce(side(1), F.lit(NOTHING)).alias("b"))
        pairs = materialize(pairs, f"exact: pairs {level}")
        names = materialize(_named(pairs, ["a", "b"]), f"exact: names {level}")
        left = materialize(pairs.join(names, ["a", "b"]).select("rid", "n_blocks", "idx", "name"), f"exact: level {level}")
        # After this level a document of up to 2**level blocks has one name.
        top = F.col("n_blocks") <= (1 << level)
        done = done.unionByName(left.where(top).select("rid", "n_blocks", "name"))
        left = left.where(~top)
    return rows, done


def decide(docs: DataFrame, rid: Column | None = None, chars: int = BLOCK_CHARS, hashed=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; null counts as empty, and
    empty texts are equal.  Of equal texts the row with the largest doc_id
    stays (null is the smallest); of rows that also share that id, one stays.
    ``group_size`` counts rows.  An empty table gives an empty result.
    """
    rows, identity = identities(docs, F.monotonically_increasing_id() if rid is None else rid, chars, hashed)
    members = materialize(identity.join(rows.drop("hs"), "rid"), "exact: members")
    # Written, so that the join below is one of plain shuffles and a group
    # with many rows can be split in it.
    groups = materialize(members.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "rid")).alias("stays"), F.count(F.lit(1)).alias("group_size")), "exact: groups")
    return members.join(groups, ["n_blocks", "name"]).select(
        "rid", "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("stays.rid")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    numbered = materialize(packed(docs, F.monotonically_increasing_id().alias("rid")), "exact: documents")
    stay = decide(numbered.select("doc.doc_id", "doc.text", "rid"), F.col("rid")).where("kept").select("rid")
    return own_columns(numbered.join(stay, "rid"), docs.columns)
