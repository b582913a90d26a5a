"""The cache reader against Parquet of the same rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latentspark.sources import arrow_cache, tables

MODELS = ("small.v1", "wide.v2")


@pytest.fixture(scope="module")
def cache(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cache")
    path = arrow_cache.cache_path(str(top), "lab", "toys")
    rows = []
    for m, model in enumerate(MODELS):
        for split, parts in (("train", 2), ("test", 1)):
            for part in range(parts):
                folder = top / "lab___latents-toys" / model / "1.0.0" / f"hash{m}"
                folder.mkdir(parents=True, exist_ok=True)
                name = f"latents-toys-{split}.arrow" if parts == 1 else f"latents-toys-{split}-{part:05d}-of-{parts:05d}.arrow"
                made = [(model, split, i + 100 * part, [float(m), float(i)], i % 3) for i in range(7)]
                rows += made
                table = pa.table({"id": [r[2] for r in made], "embedding": pa.array([r[3] for r in made], pa.list_(pa.float32())), "label": [r[4] for r in made]})
                with pa.OSFile(str(folder / name), "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
                    out.write_table(table, max_chunksize=3)
    spark.createDataFrame(rows, "model_name string, split string, id long, embedding array<float>, label long").write.parquet(str(top / "same"))
    return path, str(top / "same")


def test_the_same_rows_as_parquet(spark, cache):
    path, same = cache
    got, expected = arrow_cache.read_cache(spark, path), spark.read.parquet(same)
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    asked = (F.col("model_name") == MODELS[1]) & F.col("split").isin("test", "other") & (F.col("label") == 1)
    assert sorted(map(str, got.where(asked).collect())) == sorted(map(str, expected.where(asked).collect()))
    assert tables.require_constant_width(got.withColumnRenamed("model_name", "agent")).count() == 42


def test_only_what_is_named_is_planned(spark, cache):
    path, same = cache
    assert arrow_cache.read_cache(spark, path).rdd.getNumPartitions() == 6
    some = arrow_cache.read_cache(spark, path, [MODELS[0]], ["train"], ["id"])
    assert some.columns == ["model_name", "split", "id"]
    assert some.rdd.getNumPartitions() == 2 and some.count() == 14
    assert some.where("id = 3").count() == 1 and some.count() == 14
    expected = spark.read.parquet(same).where(F.col("model_name") == MODELS[0]).where("split = 'train'").select("model_name", "split", "id")
    assert sorted(map(str, some.collect())) == sorted(map(str, expected.collect()))
    assert arrow_cache.read_cache(spark, path, ["none"]).count() == 0


def test_what_is_there(cache, tmp_path):
    path, _ = cache
    assert arrow_cache.cached_models(path) == list(MODELS)
    assert arrow_cache.is_cached(path, MODELS[0], "train") and not arrow_cache.is_cached(path, MODELS[0], "validation")
    assert not arrow_cache.is_cached(str(tmp_path / "nothing"), "a", "train")


def test_an_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="no cached files"):
        arrow_cache.read_cache(spark, str(tmp_path)).count()
