"""The thin queries of the operators: whole tables in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.llm import byte_bpe, chat, embedding_dedup, language_id, licenses, line_rules, mixing, oracles, packing, prefix_trie, quality, simhash, toxicity, whitening
from latentspark.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(load(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.DECISION).cast("int"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(load(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(load(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(load(spark, sf_dir, "documents")).drop("kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(load(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    return quality.grade_documents(load(spark, sf_dir, "documents"), ratings)


#: A conversation whose texts hold the escape mark and a control string.
CONTROL_ID, CONTROL_TEXT = -7, "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(CONTROL_ID, 0, "user", CONTROL_TEXT), (CONTROL_ID, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.union(extra)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = byte_bpe.public_codec(spark)
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(load(spark, sf_dir, "documents"), codec), codec), codec)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


QUERIES: tuple[Query, ...] = (
    op1_embedding_dedup, op2_toxicity, op3_line_rules, op4_licenses, op5_simhash, op6_mixing, op7_packing, op8_language_id, op9_quality, op10_chat,
    op11_prefix_trie, op12_byte_bpe, op13_whitening,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
