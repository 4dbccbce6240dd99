"""Shared folders and written tables for the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside an operator: nulls sort before every id.
NULL_ID = -(2**63)

_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local\0")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='fq-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing else uses."""
    _written.append(path := f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}")
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more, and has Spark drop shuffle files that nothing refers to."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)
        _written.remove(t._written_to)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files of plans that nothing refers to any more; else they stay until the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """Where written() stands; tidy() deletes what came after."""
    return len(_written)


def tidy(spark: SparkSession, first: int, keep: DataFrame) -> None:
    """Deletes the tables written since a mark(), but for `keep`; only the one who called written() since then may do so."""
    for path in _written[first:]:
        if path != keep._written_to:
            _delete(spark, path)
    _written[first:] = [keep._written_to]
    release(spark)


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that written() and fresh_path() made in this process; their DataFrames end with them."""
    for path in _written:
        _delete(spark, path)
    _written.clear()


def id_key(col: str = "doc_id"):
    """The id as a long that is never null."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def id_back(col):
    return F.when(col != F.lit(NULL_ID), col)
