"""Skew-safe ordered scans per key: running sums and last non-NULL values.

A window ``partitionBy(key).orderBy(seq)`` puts every row of a key into one
task, so one hot key (a third of all rows) would be one task.  Here all rows
are range-partitioned by (hash of the key, order): a key with many rows fills
several partitions, whatever its order values are and however they are
spread, and the partition number is the row's ``bucket``:

* the rows are scanned by windows per (key, bucket), their only shuffle;
* most keys lie in one bucket and are done.  A key that ``spans`` buckets is
  the first or the last of each, so there are no more than buckets: per
  (key, bucket) of these one summary row (a sum, or the last non-NULL value);
* a window over the summaries of a key gives every bucket the summary of
  all earlier ones, at most two rows per bucket, broadcast to the rows.

``by_crowd`` tells the rows that need this from those whose keys any task can
hold: a window per key alone orders these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from branchwise.session import materialize, materialize_observed

#: Hash parts that keys are counted in, and the rows of a part that one task
#: may order.
PARTS = 1 << 16
CROWD = 1 << 18


def _join_few(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with rows of spanning keys (at most two per bucket), where
    NULL matches NULL (a NULL key is a key too)."""
    ren = few.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in few.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return rows.join(F.broadcast(ren), cond, "left").drop(*[f"_r_{k}" for k in keys])


def by_crowd(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that few share, and those of keys that may be too many
    for one task (None without such).  Keys are counted in ``PARTS`` parts of
    their hash, so the counts are few; a part of more than ``CROWD`` rows
    counts as crowded with all of its keys."""
    tagged = df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
    many, seen = materialize_observed(tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD)
                                      .select("_part"), "ordered: crowded keys", n=F.count(F.lit(1)))
    if not seen["n"]:
        return df, None
    few, crowd = (tagged.join(F.broadcast(many), "_part", how).drop("_part") for how in ("left_anti", "left_semi"))
    return few, crowd


def bucketize(df: DataFrame, keys: list[str], order: str = "seq", partitions: int | None = None) -> DataFrame:
    """Add ``bucket``: rows of one key that follow each other share it, and
    buckets of a key follow the order; and ``spans``: whether the key may have
    rows in several.  Written at once, so that the buckets stay what they
    are; ``partitions`` defaults to the session's."""
    n = [partitions] if partitions else []
    spread = df.drop("bucket", "spans").withColumn("_hash", F.xxhash64(*keys)).repartitionByRange(*n, "_hash", F.col(order))
    rows = materialize(spread.withColumn("bucket", F.spark_partition_id().cast("bigint")), "ordered: buckets")
    # Keys are told apart by their hash: equal ones only mark one key too many.
    edges = rows.groupBy("bucket").agg(F.min("_hash").alias("first"), F.max("_hash").alias("last"))
    edges = edges.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("_hash"))
    several = materialize(edges.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                          .select("_hash", F.lit(True).alias("spans")), "ordered: keys of several buckets")
    return rows.join(F.broadcast(several), "_hash", "left").drop("_hash").withColumn("spans", F.coalesce("spans", F.lit(False)))


def running_sums(df: DataFrame, keys: list[str], cols: list[str], order: str = "seq") -> DataFrame:
    """Add ``p_<c>``: sum of ``c`` over the strictly earlier rows of the key.
    ``df`` comes from ``bucketize`` (rows may have been dropped since)."""
    tot = df.where("spans").groupBy(*keys, "bucket").agg(*[F.sum(c).alias(f"t_{c}") for c in cols])
    wb = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "bucket", *[F.sum(f"t_{c}").over(wb).alias(f"o_{c}") for c in cols])
    wm = Window.partitionBy(*keys, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.select("*", *[F.coalesce(F.sum(c).over(wm), F.lit(0)).alias(f"w_{c}") for c in cols])
    out = _join_few(inner, off, keys + ["bucket"])
    return out.select(*df.columns, *[(F.coalesce(F.col(f"o_{c}"), F.lit(0)) + F.col(f"w_{c}")).alias(f"p_{c}") for c in cols])


def running_last(df: DataFrame, keys: list[str], cols: dict[str, "F.Column"], order: str = "seq") -> DataFrame:
    """Add one column per ``cols`` entry: the last non-NULL value of the
    expression over the rows of the key up to and including this one."""
    tagged = df.select("*", *[e.alias(f"_v_{n}") for n, e in cols.items()])
    last_in_bucket = tagged.where("spans").groupBy(*keys, "bucket").agg(
        *[F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(F.col(order).alias("s"), F.col(f"_v_{n}").alias("v"))))
          .alias(f"t_{n}") for n in cols])
    wb = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    off = last_in_bucket.select(*keys, "bucket",
                                *[F.max(f"t_{n}").over(wb).getField("v").alias(f"o_{n}") for n in cols])
    wm = Window.partitionBy(*keys, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = tagged.select("*", *[F.last(f"_v_{n}", True).over(wm).alias(f"w_{n}") for n in cols])
    out = _join_few(inner, off, keys + ["bucket"])
    return out.select(*df.columns, *[F.coalesce(F.col(f"w_{n}"), F.col(f"o_{n}")).alias(n) for n in cols])


def numbered(df: DataFrame, order: list[str], out: str = "seq", dealt: bool = False) -> DataFrame:
    """Add ``out``: 1, 2, ... in the given order (whose values are all
    different).  Every range partition numbers its own sorted rows; offsets
    come from one row per partition, broadcast.  ``dealt``: the rows are in
    range partitions of this order already."""
    spread = df if dealt else df.repartitionByRange(*order)
    local = materialize(spread.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()),
                        "ordered: numbers", "zstd")
    part, row = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    local = local.withColumn("_part", part).withColumn("_row", row)
    sizes = local.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (local.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_offset") + F.col("_row") + 1)
            .drop("_id", "_part", "_row", "_offset"))
