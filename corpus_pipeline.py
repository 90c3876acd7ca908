"""A corpus from raw documents to token ids, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again,
so it first drops the tables that led there.  All but the last return the
columns of ``documents``: documents that break a quality
rule go; of identical texts one stays; of near duplicates one stays; sources
are mixed to their target weights, whole documents repeated as the mix takes
them; the texts are encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm import exact, minhash, mixing, pieces, quality
from branchwise.llm.common import table
from branchwise.llm.queries import tokenizer_model
from branchwise.session import drop_tables, materialize, table_group


#: A column for the decoded text while it is compared.
DECODED = "_decoded_text"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their text, with ``ids``, ``n_ids`` and whether
    the ids decode to the text (``exact``).  Own columns of these names give
    way."""
    model = tokenizer_model()
    rows = pieces.decode(pieces.encode(docs, model), model, out=DECODED)
    rows = rows.withColumn("exact", F.col(DECODED) == F.coalesce("text", F.lit("")))
    return rows.withColumn("n_ids", F.size("ids").cast("bigint")).drop(DECODED, "text")


def _group(spark: SparkSession, name: str) -> str:
    """Names a group of tables of this pipeline in this application."""
    return f"pipeline-{spark.sparkContext.applicationId}-{name}"


def _stage(number: int, stage: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with its tables in a group of their own.  The group of the
    stage before goes; ``docs`` that were not written still need it and keep it."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if number:
            drop_tables(spark, _group(spark, f"stage-{number - 1}"), unless_read_by=docs)
        with table_group(_group(spark, f"stage-{number}")):
            return stage(spark, docs, sf_dir)
    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [(name, _stage(k, stage)) for k, (name, stage) in enumerate([
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
])]

#: Minhash and Viterbi have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = stage(spark, docs, sf_dir)
        with table_group(_group(spark, f"kept-{k}")):
            docs = materialize(kept, f"pipeline: {name}")
        if k:
            drop_tables(spark, _group(spark, f"kept-{k - 1}"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
