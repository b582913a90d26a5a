"""Readers: embedding tables by model and split, metric records, the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentspark.operators.selection import aligned_subsample
from latentspark.sources.synthetic import agent_name, synthetic_agents


def repo_id(dataset: Column | str, org: str = "embeddings", prefix: str = "latents-") -> Column:
    return F.concat(F.lit(f"{org}/{prefix}"), F.col(dataset) if isinstance(dataset, str) else dataset)


def read_space(spark: SparkSession, path: str, model: str, split: str, embedding: str = "embedding", ordered_by: str | None = None) -> DataFrame:
    """One model's split of an embedding table, sorted by a column if asked; partition and column pruning leave only what is asked for."""
    table = spark.read.parquet(path).where((F.col("model_name") == model) & (F.col("split") == split))
    extras = [c for c in table.columns if c not in (embedding, "model_name", "split")]
    rows = table.select(F.col(embedding).cast("array<float>").alias("embedding"), *extras)
    return rows.orderBy(ordered_by) if ordered_by else rows


def available_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("model_name").distinct()


def is_cached(spark: SparkSession, path: str, model: str, split: str) -> bool:
    """Whether the partition of a model and split is there, in any store that Spark reads."""
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/model_name={model}/split={split}")
    return bool(part.getFileSystem(spark._jsc.hadoopConfiguration()).exists(part))


def load_agents(spark: SparkSession, source: str, models: list[str] | None = None, **settings) -> DataFrame:
    """Agents by kind of source: 'table' (path) or 'synthetic' (its settings); models names the ones to keep."""
    if source == "table":
        return read_agents(spark, settings["path"], models or [])
    if source == "synthetic":
        made = synthetic_agents(spark, **settings)
        if unknown := set(models or []) - {agent_name(k) for k in range(settings["n_agents"])}:
            raise ValueError(f"unknown agents {sorted(unknown)}")
        return made.where(F.col("agent").isin(models)) if models else made
    raise ValueError(f"unknown source {source!r}")


REGISTRY_COLUMNS = ("model_name", "latent_dim", "family", "macro_family", "num_parameters")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The models' metadata, a row a model, from Parquet or CSV; a missing column or a repeated model is an error."""
    table = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    if lacking := set(REGISTRY_COLUMNS) - set(table.columns):
        raise ValueError(f"columns that the registry lacks: {sorted(lacking)}")
    if twice := table.groupBy("model_name").count().where("count > 1").limit(5).collect():
        raise ValueError(f"models listed twice: {[r.model_name for r in twice]}")
    return table


def read_agents(spark: SparkSession, path: str, models: list[str], splits: tuple[str, ...] = ("train", "test"), sizes: dict[str, int] | None = None, seed: int = 0) -> DataFrame:
    """The named models as one long table; an absent model is an error.

    sizes: rows of a split to keep, the same ids (``sample_id``) of every model.
    """
    if not models:
        raise ValueError("models must be named")
    table = spark.read.parquet(path).where(F.col("model_name").isin(models) & F.col("split").isin(*splits))
    missing = set(models) - {r[0] for r in table.select("model_name").distinct().limit(len(models)).collect()}
    if missing:
        raise ValueError(f"models without rows: {sorted(missing)}")
    agents = table.withColumnRenamed("model_name", "agent")
    if not sizes:
        return agents
    parts = [aligned_subsample(agents.where(F.col("split") == s), sizes[s], seed) if s in sizes else agents.where(F.col("split") == s) for s in splits]
    return union_records(*parts)


def require_constant_width(df: DataFrame, vector: str = "embedding", by: str = "agent") -> DataFrame:
    """Fails if a group of df has vectors of more than one width."""
    ragged = df.groupBy(by).agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most")).where("least <> most").limit(5).collect()
    if ragged:
        raise ValueError(f"vectors of several widths: {ragged}")
    return df


def records_schema(text: tuple[str, ...], whole: tuple[str, ...], real: tuple[str, ...]) -> T.StructType:
    """Explicit types of a metric-record table, so that text which looks like a number stays text."""
    kinds = [(text, T.StringType()), (whole, T.LongType()), (real, T.DoubleType())]
    return T.StructType([T.StructField(c, kind) for names, kind in kinds for c in names])


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV records by header name; blanks are null."""
    columns = spark.read.option("header", True).csv(path).columns
    ordered = T.StructType([next((f for f in schema if f.name == c), T.StructField(c, T.StringType())) for c in columns])
    return spark.read.schema(ordered).option("header", True).option("nullValue", "").csv(path)


def last_written(records: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the file written last."""
    newest = Window.partitionBy(*keys).orderBy(F.col("_metadata.file_modification_time").desc(), F.col("_metadata.file_path").desc())
    return records.withColumn("__place", F.row_number().over(newest)).where("__place = 1").drop("__place")


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; Spark's commit makes the files appear together."""
    records.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def union_records(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows with the union of the columns in the order first seen."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
