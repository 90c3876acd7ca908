"""Session helpers: one place for the settings every job relies on.

On a cluster the session comes from the platform; ``configure`` only sets
what a job needs to be correct (UTC days, AQE) and never overrides a
checkpoint folder the cluster already names.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for correctness or plan quality at any scale.
RUNTIME_CONF = {
    # Days and weeks are cut in UTC everywhere (reference quirk Q12).
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffle partitions, turn a
    # sort-merge join into a broadcast join only after the build side's real
    # size is known, and split skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins of a small, selective side (a batch of requests, one week of
    # invoices) with a huge table: a runtime Bloom filter and dynamic
    # partition pruning cut the big side at its scan.  They only fire when
    # the big side is large, so small runs are unaffected.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}


def build_local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                        app_name: str = "branchwise") -> SparkSession:
    """Local session for tests and the bench (no UI, UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session (idempotent)."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for checkpoints and written tables.

    Uses the folder the session already names (``spark.checkpoint.dir``, or
    one set with ``setCheckpointDir``).  Only a local session without either
    gets a private folder; on a cluster a missing setting is an error, because
    a machine-local folder is not visible to the other executors.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="branchwise-", dir=os.environ.get("BRANCHWISE_TMP", "/tmp"))
    base = base.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


#: Folder, below the shared one, of the tables written from here on.
_group = ""


@contextmanager
def table_group(name: str):
    """Tables written inside go to a folder of their own, so that they can be
    dropped together.  Groups do not nest."""
    global _group
    before, _group = _group, f"group-{name}"
    try:
        yield
    finally:
        _group = before


def drop_tables(spark: SparkSession, name: str, unless_read_by=None) -> None:
    """Delete the tables of a group, unless the given DataFrame reads one.
    For a group whose results have been written elsewhere: a plan that still
    reads its tables would fail."""
    if unless_read_by is not None and any(f"/tables/group-{name}/" in f for f in unless_read_by.inputFiles()):
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables/group-{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table_path(spark: SparkSession) -> str:
    """A new path for a written intermediate table."""
    return "/".join(x for x in (shared_dir(spark), "tables", _group, uuid.uuid4().hex) if x)


def materialize(df, label: str | None = None, codec: str | None = None):
    """Cut the lineage: write ``df`` as Parquet into the shared folder (the
    cluster's ``spark.checkpoint.dir``) and read it back.

    One computation (a reliable ``checkpoint()`` computes an uncached plan
    twice), columnar files with statistics for the planner, and nothing on
    executor-local disks: a lost executor does not lose it.  ``codec`` names
    another compression than the session's.
    """
    spark = df.sparkSession
    path = table_path(spark)
    with _job_label(spark, label):
        df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def materialize_observed(df, label: str | None = None, codec: str | None = None, **metrics):
    """``materialize`` that also returns aggregate metrics of the rows
    written (``name=Column``), computed by the same job via ``observe``:
    no second pass just to count something."""
    from pyspark.sql import Observation

    obs = Observation(f"m{uuid.uuid4().hex[:8]}")
    observed = df.observe(obs, *[c.alias(n) for n, c in metrics.items()])
    spark = df.sparkSession
    path = table_path(spark)
    with _job_label(spark, label):
        observed.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), dict(obs.get)


class _job_label:
    """Name the Spark jobs of a step (shown in the event log)."""

    def __init__(self, spark, label):
        self.sc, self.label = spark.sparkContext, label

    def __enter__(self):
        if self.label:
            self.sc.setJobDescription(self.label)

    def __exit__(self, *exc):
        if self.label:
            self.sc.setJobDescription(None)
