"""Fitted maps and probes as files, named by what they were fitted from."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession

from latentspark.operators.experiment import spec_key


def model_path(folder: str, dataset: str, name: str, spec: dict) -> str:
    return f"{folder}/{dataset}/{name}/{spec_key(spec)}"


def save_model(spark: SparkSession, model: object, path: str) -> None:
    """One row in a Parquet table, so that any store that Spark writes will do."""
    row: DataFrame = spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary")
    row.coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, kind: type) -> object:
    """A model that save_model wrote; one of another kind is an error. Read only files of your own: they are pickles."""
    model = pickle.loads(bytes(spark.read.parquet(path).first().model))
    if not isinstance(model, kind):
        raise TypeError(f"{path} holds a {type(model).__name__}")
    return model
