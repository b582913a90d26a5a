"""Stand-ins for the engine's inputs, derived from the test tables in Spark and, alike, in SQL."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH_A, WIDTH_B, CLASSES = 8, 12, 5
#: Numbers of an embedding, seen as GRID rows of GRID: agent A has the sums of the columns, and agent B, in part, those of
#: rows under signs that no column sees. Each of them takes in all numbers, and is of about unit variance.
WIDTH, GRID = 64, 8

LATENT_SQL = """
wide AS (
  SELECT vec_id AS sample_id, label, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings
), x AS (
  SELECT sample_id, label, split, list_concat(
    list_transform(range(1, 9), lambda i: sqrt(8) * list_sum(list_transform(range(0, 8), lambda m: e[i + 8 * m]))),
    list_transform(range(0, 4), lambda k: list_sum(list_transform(range(0, 64), lambda j: CASE WHEN (CASE WHEN k < 3 THEN (j // 8) >> k ELSE xor(j // 8, j // 16) END) % 2 = 1 THEN -e[j + 1] ELSE e[j + 1] END)))) AS x FROM wide
), a AS (
  SELECT sample_id, label, split, x[1:8] AS v FROM x
), b0 AS (
  SELECT sample_id, label, split,
    list_transform(range(1, 13), lambda i: sign(x[1 + (5 * i) % 12]) * pow(abs(x[1 + (5 * i) % 12]), 1.3) + 1.5 * sin(2 * x[i])) AS v FROM x
), b AS (
  SELECT *, CAST(list_position(v, list_max(v[1:5])) - 1 AS BIGINT) AS geo_label FROM b0
)"""

#: Agents of the whole width: A as it is, B of all of A's numbers.
WIDE_SQL = """
x AS (
  SELECT vec_id AS sample_id, label, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, list_transform(embedding, lambda v: 8 * CAST(v AS DOUBLE)) AS x FROM embeddings
), a AS (
  SELECT sample_id, label, split, x AS v FROM x
), b AS (
  SELECT sample_id, label, split,
    list_transform(range(1, 65), lambda i: sign(x[1 + (5 * i) % 64]) * pow(abs(x[1 + (5 * i) % 64]), 1.3) + 1.5 * sin(2 * x[i])) AS v FROM x
)"""

RECORDS_SQL = """
r AS (
  SELECT event_type AS method, CAST(user_id % 5 AS INTEGER) AS pairs, CAST(day(ts) % 5 AS INTEGER) AS seed,
    CAST(128 * pow(2, event_id % 7) AS BIGINT) AS n_pilots, CAST(event_id % 9 - 6 AS INTEGER) AS log_lam,
    CASE event_id % 3 WHEN 0 THEN 'herding' WHEN 1 THEN 'random' ELSE 'kmeans' END AS strategy,
    value AS score, event_id FROM events
)"""

REGISTRY_SQL = """
registry AS (
  SELECT p_name || '#' || p_partkey AS model_name, p_size AS latent_dim, p_type AS family, p_brand AS macro_family, p_partkey AS num_parameters
  FROM part WHERE p_partkey % 5 <> 0
), configs AS (
  SELECT p_name || '#' || p_partkey AS model_name, p_partkey % 2 = 0 AS cached FROM part WHERE p_partkey % 3 <> 0
)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("sample_id"), "label", F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"), F.col("embedding").cast("array<double>").alias("e"))


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.get("e", F.lit(j)) for j in range(WIDTH)]
    flips = [[(j // GRID >> k) % 2 for j in range(WIDTH)] for k in range(3)] + [[(j // GRID ^ j // (2 * GRID)) % 2 for j in range(WIDTH)]]
    columns = [math.sqrt(GRID) * functools.reduce(operator.add, e[i::GRID]) for i in range(GRID)]
    rows = [functools.reduce(operator.add, (-c if flip else c for c, flip in zip(e, flips[k], strict=True))) for k in range(WIDTH_B - GRID)]
    return _split(spark, sf_dir).select("sample_id", "label", "split", F.array(*columns, *rows).alias("x"))


def _bent(width: int) -> Column:
    """Signed powers and waves of the numbers of ``x``, each joined with another's."""
    at = lambda i: F.get("x", F.lit(i))
    return F.array(*(F.signum(at(5 * i % width)) * F.pow(F.abs(at(5 * i % width)), 1.3) + 1.5 * F.sin(2 * at(i - 1)) for i in range(1, width + 1)))


def agent_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, label, split, v)`` of the 8-wide agent."""
    return _x(spark, sf_dir).select("sample_id", "label", "split", F.slice("x", 1, WIDTH_A).alias("v"))


def agent_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, label, split, v, geo_label)`` of the 12-wide agent; geo_label is the place of the largest of v's first 5."""
    made = _x(spark, sf_dir).select("sample_id", "label", "split", _bent(WIDTH_B).alias("v"))
    head = F.slice("v", 1, CLASSES)
    return made.withColumn("geo_label", (F.array_position("v", F.array_max(head)) - 1).cast("long"))


def wide_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, label, split, v)``: all numbers of an embedding."""
    return _split(spark, sf_dir).select("sample_id", "label", "split", F.transform("e", lambda c: c * 8).alias("v"))


def wide_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, label, split, v)`` of the other agent of the whole width."""
    return wide_a(spark, sf_dir).withColumnRenamed("v", "x").select("sample_id", "label", "split", _bent(WIDTH).alias("v"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric records of unequal groups: ``(method, pairs, seed, n_pilots, log_lam, strategy, score, event_id)``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 3
    return e.select(
        F.col("event_type").alias("method"), (F.col("user_id") % 5).cast("int").alias("pairs"), (F.dayofmonth("ts") % 5).cast("int").alias("seed"),
        (128 * F.pow(F.lit(2.0), F.col("event_id") % 7)).cast("long").alias("n_pilots"), (F.col("event_id") % 9 - 6).cast("int").alias("log_lam"),
        F.when(k == 0, "herding").when(k == 1, "random").otherwise("kmeans").alias("strategy"), F.col("value").alias("score"), "event_id",
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 5 <> 0")
    name = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    return p.select(name.alias("model_name"), F.col("p_size").alias("latent_dim"), F.col("p_type").alias("family"), F.col("p_brand").alias("macro_family"), F.col("p_partkey").alias("num_parameters"))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 3 <> 0")
    return p.select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("model_name"), (F.col("p_partkey") % 2 == 0).alias("cached"))
