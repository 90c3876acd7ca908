"""Helpers shared by the training-data operators: text columns, row keys,
and running sums and ranks that no single key can pull into one task."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchwise.session import configure, materialize, table_path

# The white space that separates words, as a regular expression
# class, and its complement.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one chunk of a running sum holds on average.
CHUNK_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_in(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def partitions_for(rows: int, per_partition: int = 200_000) -> int:
    """Partitions for a narrow table of that many rows."""
    return max(1, math.ceil(rows / per_partition))


def hash_chunk(h: str, rows: int) -> Column:
    """Chunk number of a 64-bit hash: its leading bits, so that chunks follow
    the order of the hash and hold about ``CHUNK_ROWS`` of ``rows`` rows."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / CHUNK_ROWS)))
    return F.shiftright(F.col(h), 64 - bits) if bits else F.lit(0).cast("bigint")


def running_sum(df: DataFrame, group: str, chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the earlier rows of ``group``.

    ``chunk`` cuts every group into pieces that follow ``order``.  Pieces are
    summed first (partial aggregation), their offsets come from a window over
    one row per piece, and the rows' own sums from a window inside the piece,
    so a group with most of the rows is spread over its pieces.  ``group`` and
    ``chunk`` hold no nulls.
    """
    pieces = df.groupBy(group, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(group, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(offsets, [group, chunk]).withColumn(out, F.col(out) + F.col("_offset")).drop("_offset")


def sorted_names(values: DataFrame, keys: list[str], rows: int, out: str) -> DataFrame:
    """Adds ``out``: the position, from 0, of each row in the order of ``keys``
    (all different).  A range-partitioned sort: every partition numbers its own
    rows, and offsets come from one row per partition."""
    n = partitions_for(rows)
    spread = values.repartitionByRange(n, *keys) if n > 1 else values.coalesce(1)
    local = materialize(spread.sortWithinPartitions(*keys)
                        .withColumn("_id", F.monotonically_increasing_id()), "names: sort")
    local = local.withColumn("_part", F.shiftrightunsigned("_id", 33)).withColumn(
        "_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = local.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (local.join(offsets, "_part").withColumn(out, F.col("_offset") + F.col("_row"))
            .drop("_id", "_part", "_row", "_offset"))


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of a table as one struct ``doc``, beside others: names
    inside of it clash with nothing."""
    return docs.select(F.struct(*quoted(docs.columns)).alias("doc"), *more)


def own_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``doc`` again."""
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in columns])


def nullable(t: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as it is read from Parquet."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(nullable(t.elementType))
    return T.MapType(nullable(t.keyType), nullable(t.valueType)) if isinstance(t, T.MapType) else t


def with_arrow_column(rows: DataFrame, column: str, out: str, kind: T.DataType,
                      made: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``rows`` with ``out`` in place of a column of that name: what ``made``
    gives for each batch of ``column``.  The columns pass as one struct,
    whatever their names."""
    bounded_batches(rows.sparkSession)
    own = [c for c in rows.columns if c != out]
    packed = rows.select(F.struct(*quoted([column, *[c for c in own if c != column]])).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), made(batch.column(0).field(0))], ["row", "out"])

    schema = T.StructType([T.StructField("row", nullable(packed.schema["row"].dataType)), T.StructField("out", kind)])
    return packed.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in own], F.col("out").alias(out))


def materialize_bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``materialize``, bucketed by ``key`` into as many parts as a shuffle
    has: a join or grouping by ``key`` need not move these rows.  The table is
    known to the catalog only while it is opened; its files stay."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    spark.sparkContext.setJobDescription(label)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option(
        "path", table_path(spark)).saveAsTable(name, format="parquet")
    spark.sparkContext.setJobDescription(None)
    out = spark.table(name)
    out.schema  # opened: the plan holds the files from here on
    spark.sql(f"DROP TABLE {name}")
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Rows and bytes that a Python worker gets at once: a batch of very long
    texts stays as small as one of short ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
