"""Embedding tables in a cache of Arrow streams, as a Spark data source.

Files lie at ``<cache>/<org>___<repo>/<model>/<version>/<hash>/<repo>-<split>.arrow``, a split
in several as ``-<split>-00000-of-00003.arrow``. Each file is a partition of the scan, read one record batch at a
time. ``model_name`` and ``split`` come from the path. Options ``models``, ``splits`` and ``columns`` name what is wanted: other
files are neither listed nor planned, other columns not taken out of the batches. (Filters of a query are not pushed down:
Spark 4.1 keeps what one plan of a data frame has pushed into a Python source for its next plan, which then lacks rows.)

Paths are read through pyarrow's file systems (local, ``hdfs://``, ``s3://`` ...), by driver and executors alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from latentspark.plans.shipping import ensure_importable

FORMAT = "embedding_cache"
_PARTS = re.compile(r"(?P<model>[^/]+)/[^/]+/[^/]+/(?P<stem>[^/]+?)-(?P<split>[^/-]+)(-\d{5}-of-\d{5})?\.arrow$")


def cache_path(cache: str, org: str, dataset: str, prefix: str = "latents-") -> str:
    """Folder of a dataset's models in a cache."""
    return f"{cache.rstrip('/')}/{org}___{prefix}{dataset}"


@dataclass
class CachedFile(InputPartition):
    path: str
    model: str
    split: str


def cached_files(path: str, models: set[str] | None = None, splits: set[str] | None = None) -> list[CachedFile]:
    """Files of a dataset's folder, of some models and splits if named, in the order of their paths; none if the folder isn't there."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    folders = [f"{at}/{m}" for m in sorted(models)] if models is not None else [at]
    found = [i.path for f in folders for i in store.get_file_info(fs.FileSelector(f, allow_not_found=True, recursive=True)) if i.type == fs.FileType.File]
    out = []
    for name in sorted(found):
        if (m := _PARTS.search(name[len(at) + 1 :])) and (models is None or m["model"] in models) and (splits is None or m["split"] in splits):
            out.append(CachedFile(name, m["model"], m["split"]))
    return out


class CacheSource(DataSource):
    """``spark.read.format(FORMAT).option("path", <dataset's folder>)``; options: models, splits and columns, JSON lists."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _named(self, option: str) -> set[str] | None:
        return set(json.loads(self.options[option])) if option in self.options else None

    def schema(self) -> StructType:
        files = cached_files(self.options["path"])
        if not files:
            raise ValueError(f"no cached files in {self.options['path']}")
        with _opened(self.options["path"], files[0].path) as stream:
            kept = from_arrow_schema(stream.schema).fields
        asked = self._named("columns")
        fields = [f for f in kept if f.name not in ("model_name", "split") and (asked is None or f.name in asked)]
        return StructType([StructField("model_name", StringType()), StructField("split", StringType()), *fields])

    def reader(self, schema: StructType) -> CacheReader:
        return CacheReader(self.options["path"], schema, self._named("models"), self._named("splits"))


def _opened(path: str, name: str) -> pa.RecordBatchStreamReader:
    store = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
    return pa.ipc.open_stream(store.open_input_stream(name))


class CacheReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, models: set[str] | None, splits: set[str] | None) -> None:
        self.path, self.names, self.models, self.splits = path, schema.fieldNames(), models, splits

    def partitions(self) -> list[InputPartition]:
        # An empty list of partitions would be read as one without a file.
        return cached_files(self.path, self.models, self.splits) or [CachedFile("", "", "")]

    def read(self, partition: CachedFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _opened(self.path, partition.path) as stream:
            for batch in stream:
                told = {"model_name": partition.model, "split": partition.split}
                columns = [pa.repeat(told[c], batch.num_rows) if c in told else batch.column(c) for c in self.names]
                yield pa.RecordBatch.from_arrays(columns, names=self.names)


def read_cache(spark: SparkSession, path: str, models: list[str] | None = None, splits: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """``(model_name, split, ...)`` of a dataset's folder in a cache; models, splits and columns: those wanted."""
    ensure_importable(spark)
    spark.dataSource.register(CacheSource)
    asked = {"models": models, "splits": splits, "columns": columns}
    return spark.read.format(FORMAT).options(path=path, **{k: json.dumps(v) for k, v in asked.items() if v is not None}).load()


def is_cached(path: str, model: str, split: str) -> bool:
    return bool(cached_files(path, {model}, {split}))


def cached_models(path: str) -> list[str]:
    return sorted({f.model for f in cached_files(path)})
