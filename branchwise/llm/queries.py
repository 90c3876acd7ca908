"""The registered queries of the training-data operators: each applies its
operator to the whole table and derives the digest columns from its output."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm import (
    bytepairs,
    chat,
    divergence,
    exact,
    html,
    lines,
    minhash,
    mixing,
    oracle,
    periods,
    pieces,
    quality,
    secrets,
    sharding,
)
from branchwise.llm.common import WORD, table, text_of

QueryFn = Callable[[SparkSession, str], DataFrame]


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extract(table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality.passes("base")).alias("base_failed"), quality.passes("v2").alias("kept"),
                       "n_lines", F.col("fail_bits").bitwiseAND(F.lit(quality.policy_mask("v2"))).cast("bigint").alias("fail_bits"))


#: A conversation of texts that look like marks of templates.
TRICKY = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.windows(rows.unionByName(tricky)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                       F.sha2(secrets.as_text("base"), 256).alias("base_sha256"), secrets.as_text("spans").alias("spans"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decide(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rid")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    runs = F.transform("runs", lambda r: F.concat_ws("-", r["from"].cast("string"), r["to"].cast("string")))
    return rows.select("doc_id", "n_lines", F.size("gone").cast("bigint").alias("n_deleted"),
                       F.array_join(runs, ",").alias("deleted"), F.sha2("clean_text", 256).alias("clean_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def tokenizer_model() -> str:
    """Path of the public SentencePiece model."""
    return os.environ.get("BRANCHWISE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, docs = tokenizer_model(), table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pieces.decode(pieces.encode(docs, model), model)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def byte_ranks() -> tuple[str, str]:
    """Path of the public byte-level ranks, and the pattern that goes with them."""
    import public_tokenizers
    return (os.environ.get("BRANCHWISE_RANKS", public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
            public_tokenizers.PATTERN)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = byte_ranks()
    rows = bytepairs.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    rows = bytepairs.decode(rows, ranks)
    return rows.select("doc_id", F.col("n_ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document (by a hash of its id) goes on periodically from
    some word on; a null id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", text_of().alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    planted = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods.find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    text = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("m"),
                       F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("m.s")).alias("start"), F.col("m.n").alias("length"), (-F.col("m.p")).alias("period"),
                       F.expr("1000 * m.n div -m.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, QueryFn]:
    ops = (op1_chat_formatting, op2_secret_scan, op3_exact_dedup, op4_line_dedup, op5_mixing, op6_html_extraction,
           op7_quality_rules, op8_sentencepiece, op9_sharding, op10_near_dedup, op11_source_divergence, op12_byte_bpe,
           op13_periodic_runs)
    return {op.__name__: op for op in ops}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
