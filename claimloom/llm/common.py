"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and tab .. carriage return. ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Where a local session without ``spark.checkpoint.dir`` keeps its folder; Spark lets no session set the former.
OWN_DIR = "claimloom.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one is set only where none is configured and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set(OWN_DIR, found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids fall in fold of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def lean(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``; its session hands texts to Python in batches of at most ``rows``, unless it was told another number.

    Spark's own 10,000 rows of long texts are tens of MB a task, in the JVM and again in Python.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(rows))
    return df


def gathered(batches, column: str, size: int):
    """Batches joined until ``column`` holds about ``size`` bytes."""
    import pyarrow as pa

    held, amount = [], 0
    for batch in batches:
        held.append(batch)
        amount += batch[column].nbytes
        if amount >= size:
            yield pa.concat_batches(held)
            held, amount = [], 0
    if held:
        yield pa.concat_batches(held)


def small(batches, rows: int = 1000):
    """The batches cut into smaller ones, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def veiled(docs: DataFrame) -> dict[str, Column]:
    """The columns of ``docs`` under names that clash with none of an operator's."""
    return {f"own_{k}": F.col(f"`{c}`") for k, c in enumerate(docs.columns)}


def unveiled(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` under their own names again; ``changed`` ones replaced."""
    return df.select(*[(changed[c] if c in changed else F.col(f"own_{k}")).alias(c) for k, c in enumerate(docs.columns)])


def utf8(array) -> list[bytes]:
    """The values of an Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def released() -> None:
    """Hand memory that is free in this Python worker back to the machine: workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
