"""Replication of row changes (T1): apply an ordered insert/update/delete feed.

The reference relies on the database's publication/subscription to carry
row changes between the branch databases and the central one.  Its data
effect is: the replica holds, per key, the row of the last change, or no
row when the last change is a delete.

* ``apply_changes`` is the batch core: the last change per key is a
  ``max(struct(seq, ...))`` aggregate (partial aggregation map-side, so a
  hot key is reduced in every task before the shuffle), then the snapshot
  minus the changed keys plus the surviving last changes.
* ``start_replication`` is the streaming shell: a file-source stream of
  change files, each micro-batch applied with ``foreachBatch``.  The snapshot
  lies in hash buckets of its keys.  A batch reads and writes only the buckets
  its keys fall in, as a new folder of each (dynamic partition overwrite, so a
  re-run replaces its own folders and no other), and then its marker, which
  names the folder of every bucket.  Readers go by the newest marker, so they
  never see half a batch; a batch whose marker exists is skipped, so the sink
  is idempotent when the query restarts from its checkpoint after a failure.

Deletes stay as tombstones with their ``seq``, so that a late older change
does not bring a row back.  With ``lateness`` they are bounded: what lies more
than that far behind the largest ``seq`` seen is below the watermark.  Changes
that arrive below it are refused, so tombstones below it leave as soon as
their bucket is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from branchwise.session import materialize

OPS = ("I", "U", "D")


def last_changes(feed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Latest change per key: (keys..., op, values...)."""
    last = F.max(F.struct(F.col("seq").alias("_seq"), F.col("op").alias("op"),
                          *[F.col(v).alias(v) for v in values])).alias("_last")
    return feed.groupBy(*keys).agg(last).select(*keys, "_last.op", *[f"_last.{v}" for v in values])


def apply_changes(snapshot: DataFrame, feed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New snapshot: unchanged rows plus the last insert/update of each key."""
    last = last_changes(feed, keys, values)
    kept = snapshot.select(*keys, *values).join(last.select(*keys), keys, "left_anti")
    upserts = last.where(F.col("op") != "D").select(*keys, *values)
    return kept.unionByName(upserts)


def _stored(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Change rows in the stored form: keys, values, _seq, _deleted."""
    return df.select(*keys, *values, F.col("seq").cast("bigint").alias("_seq"),
                     (F.col("op") == "D").alias("_deleted"))


def merge_stored(base: DataFrame, batch: DataFrame, keys: list[str], values: list[str],
                 watermark: int | None = None) -> DataFrame:
    """Stored snapshot + one batch of changes, last seq per key wins.

    Deletes stay as tombstones with their seq, so a change that arrives in a
    later micro-batch but carries an older seq never resurrects a row.
    Changes at or below ``watermark`` are refused.
    """
    if watermark is not None:
        batch = batch.where(F.col("seq") > watermark)
    both = base.unionByName(_stored(batch, keys, values))
    last = F.max(F.struct("_seq", "_deleted", *values)).alias("_l")
    return both.groupBy(*keys).agg(last).select(*keys, *[f"_l.{v}" for v in values], "_l._seq", "_l._deleted")


#: Buckets of a snapshot.  More make a batch touch less, in smaller files.
BUCKETS = 64

MARKER = "version BIGINT, bucket INT, folder BIGINT, watermark BIGINT"


def _file_system(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, path = _file_system(spark, path)
    return fs.exists(path)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions (a marker per finished batch)."""
    fs, path = _file_system(spark, f"{root}/_published")
    if not fs.exists(path):
        return []
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)
                  if s.getPath().getName().startswith("v="))


def _folder(root: str, bucket: int, folder: int) -> str:
    return f"{root}/data/_bucket={bucket}/_folder={folder}"


def _mark(spark: SparkSession, root: str, version: int, folders: dict[int, int], watermark: int | None) -> None:
    """Publish: which folder each bucket is read from; -1 stands for none."""
    rows = [(version, b, f, watermark) for b, f in sorted(folders.items())] or [(version, -1, -1, watermark)]
    spark.createDataFrame(rows, MARKER).coalesce(1).write.mode("errorifexists").json(f"{root}/_published/v={version}")


def _marked(spark: SparkSession, root: str, version: int) -> tuple[dict[int, int], int | None]:
    rows = spark.read.schema(MARKER).json(f"{root}/_published/v={version}").collect()  # one per bucket
    return {r.bucket: r.folder for r in rows if r.bucket >= 0}, rows[0].watermark


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _read(spark: SparkSession, root: str, folders: dict[int, int]) -> DataFrame:
    """The stored rows of the given buckets."""
    empty = spark.read.parquet(f"{root}/empty")
    paths = [_folder(root, b, f) for b, f in sorted(folders.items())]
    return spark.read.schema(empty.schema).parquet(*paths) if paths else empty


def _write(spark: SparkSession, root: str, version: int, rows: DataFrame, keys: list[str], n: int, touched: list[int]) -> dict[int, int]:
    """The rows as a new folder of each touched bucket; buckets left without
    rows get none.  A re-run replaces these folders and touches no other."""
    at = rows.withColumn("_bucket", _bucket(keys, n)).withColumn("_folder", F.lit(version))
    (at.hint("rebalance", "_bucket").sortWithinPartitions("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_bucket", "_folder").parquet(f"{root}/data"))
    return {b: version for b in touched if _exists(spark, _folder(root, b, version))}


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows of the newest published version (tombstones removed)."""
    v = _versions(spark, root)
    if not v:
        return None
    folders, _ = _marked(spark, root, v[-1])
    return _read(spark, root, folders).where(~F.col("_deleted")).drop("_seq", "_deleted")


def _drop_superseded(spark: SparkSession, root: str, old: dict[int, int], new: dict[int, int]) -> None:
    """Folders that the version before the newest replaced: readers of the
    newest two versions keep theirs."""
    for bucket, folder in old.items():
        if new.get(bucket) != folder:
            fs, path = _file_system(spark, _folder(root, bucket, folder))
            fs.delete(path, True)


def apply_batch(spark: SparkSession, root: str, batch: DataFrame, batch_id: int, keys: list[str], values: list[str],
                buckets: int = BUCKETS, lateness: int | None = None) -> None:
    """Publish version ``batch_id``: the newest version before it, with the
    changes of one batch.  A published batch is left as it is."""
    done = _versions(spark, root)
    if batch_id in done:
        return  # already published before a restart
    before = max(v for v in done if v < batch_id)
    folders, watermark = _marked(spark, root, before)
    batch = materialize(batch.withColumn("_bucket", _bucket(keys, buckets)), "replication: batch")
    touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
    top = batch.agg(F.max("seq")).first()[0]
    merged = merge_stored(_read(spark, root, {b: folders[b] for b in touched if b in folders}), batch, keys, values, watermark)
    if lateness is not None and top is not None:
        watermark = max(top - lateness, watermark if watermark is not None else top - lateness)
    if watermark is not None:
        merged = merged.where(~F.col("_deleted") | (F.col("_seq") > watermark))
    written = _write(spark, root, batch_id, merged, keys, buckets, touched) if touched else {}
    now = {b: f for b, f in folders.items() if b not in touched} | written
    _mark(spark, root, batch_id, now, watermark)
    earlier = [v for v in done if v < before]
    if earlier:
        _drop_superseded(spark, root, _marked(spark, root, max(earlier))[0], folders)


def start_replication(spark: SparkSession, feed_dir: str, feed_schema, root: str, initial: DataFrame,
                      keys: list[str], values: list[str], checkpoint: str, available_now: bool = True,
                      buckets: int = BUCKETS, lateness: int | None = None) -> StreamingQuery:
    """Stream change files from ``feed_dir`` into the snapshot under ``root``.
    ``buckets`` belongs to the snapshot and never changes; ``lateness`` is how
    far behind the largest ``seq`` a change may still arrive (None: any)."""
    if not _versions(spark, root):
        rows = initial.select(*keys, *values, F.lit(None).cast("bigint").alias("_seq"), F.lit(False).alias("_deleted"))
        rows.limit(0).write.mode("overwrite").parquet(f"{root}/empty")
        _mark(spark, root, -1, _write(spark, root, -1, rows, keys, buckets, list(range(buckets))), None)

    stream = spark.readStream.schema(feed_schema).parquet(feed_dir)
    writer = stream.writeStream.foreachBatch(
        lambda batch, batch_id: apply_batch(spark, root, batch, batch_id, keys, values, buckets, lateness))
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
