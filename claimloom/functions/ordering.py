"""Running sums and dense numbers within keys of any size: no key is one task's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.storage import stored


#: Estimated bytes of what a task is dealt.
SHARE = 32 << 20


def dealt(df: DataFrame, keys: Sequence[str], like: DataFrame | None = None, share: int = SHARE) -> DataFrame:
    """``df`` dealt out by ``keys`` before it is grouped, in parts whose number grows with the size of ``like`` (itself) as Spark estimates it.

    What a task holds is then the groups of its part: neither the input's splits nor the number of shuffle partitions
    decides on it. Copies of one row come one after the other and take no memory.
    """
    return df.repartition(shares(df if like is None else like, share), *keys)


def shares(df: DataFrame, share: int = SHARE) -> int:
    """In how many parts of ``share`` bytes to deal ``df`` out, as Spark estimates it; no fewer than the session's shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = size < 1 << 60  # rows of a Python list have no size
    return max(least, size // share if known else 0)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], name: str = "running") -> DataFrame:
    """``df`` with each of ``sums`` added up within ``keys`` in ``order`` (ascending, null first), each row's own included.

    Rows are dealt out by ranges of (keys, order), so that a key of any size has many parts. A part adds up its own
    rows; the few keys that stand in several parts get the totals of their earlier ones. Rows that are equal in keys
    and order share a part and come in any order.
    """
    whole = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    rows = stored(whole.withColumns({f"_sum_{c}": x for c, x in sums.items()}), name)
    at = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.groupBy(*keys, "_part").agg(*[F.sum(f"_sum_{c}").alias(f"_sum_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a part
    before = parts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_in"), *[F.sum(f"_sum_{c}").over(earlier).alias(f"_before_{c}") for c in sums])
    before = before.where(F.coalesce(*[F.col(f"_before_{c}") for c in sums]).isNotNull())
    same = F.col("_part") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    local = rows.withColumns({f"_sum_{c}": F.sum(f"_sum_{c}").over(at) for c in sums})
    total = {c: (F.col(f"_sum_{c}") + F.coalesce(F.col(f"_before_{c}"), F.lit(0))).alias(c) for c in sums}
    return local.join(before, same, "left").select(*[F.col(c) for c in df.columns if c not in sums], *total.values())


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], as_: str, name: str = "numbered") -> DataFrame:
    """``df`` with the number of each row from 1 within ``keys`` in ``order``."""
    return running(df, keys, order, {as_: F.lit(1).cast("long")}, name)


def dense_names(df: DataFrame, keys: Sequence[str], as_: str, name: str = "names") -> DataFrame:
    """(keys, ``as_``): a number from 0 without gaps for each distinct combination of ``keys``, in no order."""
    ids = stored(df.select(*keys).distinct().withColumn("_id", F.monotonically_increasing_id()), name)
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = ids.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    first = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return ids.withColumn("_part", part).withColumn("_local", local).join(F.broadcast(first), "_part").select(*keys, (F.col("_first") + F.col("_local")).alias(as_))
