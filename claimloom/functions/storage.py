"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written bytes up to which a table of names is broadcast.
HELD = 8 << 20
#: Where a local session without ``spark.checkpoint.dir`` keeps its folder; Spark lets no session set the former.
OWN_DIR = "claimloom.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder is set only where none is configured and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set(OWN_DIR, found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def names(df: DataFrame, name: str) -> DataFrame:
    """``df``, a column of names to look rows up in, written first: a join with it moves no row while it is below ``HELD``, and merges beyond."""
    out = stored(df, name)
    size = int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(out) if size <= HELD else out


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more, in whatever file system they are."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
