"""What the operators of this subpackage share: columns, folds, shared storage."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(folds))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a local session has none (a test), a folder below the working directory is
    set; a cluster must name its own, for its machines don't share their disks.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = "file://" + os.path.abspath(os.path.join("spark-warehouse", "checkpoints"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Folders that ``cut`` wrote and nothing has deleted yet.
_WRITTEN: set[str] = set()


def cut(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder, with options of the writer, and read it back; survives lost executors."""
    path = fresh_path(df.sparkSession, "table")
    _WRITTEN.add(path)
    df.write.options(**(options or {})).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._table_path = path
    return back


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more, and let Spark drop shuffle files without a reader."""
    for t in tables:
        _delete(spark, t._table_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.discard(folder)


def release_all(spark: SparkSession) -> int:
    """Delete every table that operators of this driver have left in the shared folder; their results must be written by then. Returns how many."""
    left = list(_WRITTEN)
    for folder in left:
        _delete(spark, folder)
    return len(left)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
