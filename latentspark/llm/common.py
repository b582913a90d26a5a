"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.plans.shipping import ensure_importable

#: White space that separates words in every contract of this subpackage.
WHITE = " \t\n\x0b\x0c\r"
#: The same set inside a Java or Python character class.
WHITE_CLASS = r"\x20\x09-\x0D"
#: Arrow batches of whole texts stay within these bounds, so a worker holds a few MB of text at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Readies a session for operators that hand texts to Python: Arrow batches bounded by bytes as well as rows, and the package on the workers."""
    ensure_importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises df in the cluster's shared checkpoint folder; survives the loss of any executor.

    A folder of this machine is taken only in local mode; elsewhere ``spark.checkpoint.dir`` must be set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{WHITE_CLASS}]+"), 0)


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE_CLASS}]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; a null id is treated as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def in_one_column(docs: DataFrame, name: str = "row") -> Column:
    """All columns of docs as one struct, so that names of the input can't meet names of an operator."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name)


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by an MD5 of ``key`` (which SQL can repeat), spread over the whole table.

    Only ids and hashes are ordered (a distributed top-k); the caller's other columns
    come back through a join with that bounded id list.
    """
    order = F.md5(F.concat(F.lit("sample:"), F.col(key).cast("string")).cast("binary"))
    ids = rows.select(F.col(key).alias("__k"), order.alias("__h")).where(F.col("__k").isNotNull())
    ids = ids.orderBy("__h", "__k").limit(limit).select("__k").distinct()
    return rows.join(F.broadcast(ids), F.col(key) == F.col("__k"), "left_semi")
