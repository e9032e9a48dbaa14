"""Claims as a stream: incremental corroboration, once-only ingestion and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.functions.storage import dropped
from claimloom.operators.facts import ENGINE, TRIPLE
from claimloom.operators.graph import closure_with, closure_without


def once(claims: DataFrame, time_col: str, late: str = "1 day") -> DataFrame:
    """Each claim the first time its key comes; state of keys older than the watermark is dropped."""
    return claims.withWatermark(time_col, late).dropDuplicatesWithinWatermark([*TRIPLE, "source"])


def corroboration(claims: DataFrame) -> DataFrame:
    """Running number of claims and of sources (approximate) of each engine triple."""
    return claims.where(F.col("status").isin(*ENGINE)).groupBy(*TRIPLE).agg(F.count("*").alias("n_claims"), F.approx_count_distinct("source").alias("n_sources"))


def activity(events: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their values by kind and window; late ones count until the watermark has passed."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def append_batches(claims: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has come to a Parquet table, exactly once, then stop."""
    return claims.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PAIR = "u string, v string"


def _version(spark: SparkSession, path: str, name: str, version: int | None) -> DataFrame:
    return spark.createDataFrame([], PAIR) if version is None else spark.read.schema(PAIR).parquet(f"{path}/{name}/version={version}")


def _last_version(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The highest version whose closure was written whole, below ``before``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/closure")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    done = [int(x.getPath().getName().split("=")[1]) for x in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return max((v for v in done if before is None or v < before), default=None)


def current_closure(spark: SparkSession, path: str) -> DataFrame:
    """(u, v): the closure as the last batch left it."""
    return _version(spark, path, "closure", _last_version(spark, path))


def maintain_closure(changes: DataFrame, path: str, checkpoint: str, order_col: str = "at") -> StreamingQuery:
    """Keep the transitive closure of a changing edge set in ``path``, from a stream of changes (op, u, v, ``order_col``).

    ``op`` is ``add`` or ``remove``; of several changes of an edge in a batch the last counts, of equally late ones the
    removal. Added edges extend the closure, removed ones are deleted and rederived; no batch works the whole closure
    out again. A version is a batch, written whole before the next reads it: a repeated batch starts from the same last
    version, so a lost driver does no harm. Only the last two versions are kept.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = _last_version(spark, path, batch_id)
        edges, known = _version(spark, path, "edges", last), _version(spark, path, "closure", last)
        net = batch.groupBy("u", "v").agg(F.max_by("op", F.struct(F.col(order_col), F.col("op"))).alias("op"))  # "remove" comes after "add"
        added = net.where("op = 'add'").select("u", "v").join(edges, ["u", "v"], "left_anti")
        removed = net.where("op = 'remove'").select("u", "v").join(edges, ["u", "v"], "left_semi")
        edges.join(removed, ["u", "v"], "left_anti").unionByName(added).write.mode("overwrite").parquet(f"{path}/edges/version={batch_id}")
        stayed = edges.join(removed, ["u", "v"], "left_anti")
        if not removed.isEmpty():
            known = closure_without(known, stayed, removed)
        closure_with(known, added).write.mode("overwrite").parquet(f"{path}/closure/version={batch_id}")
        if last is not None and (old := _last_version(spark, path, last)) is not None:
            dropped(spark, f"{path}/closure/version={old}", f"{path}/edges/version={old}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
