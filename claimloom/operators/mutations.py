"""Changes of the claim table as keyed DataFrame operators: each returns the new table, the old one stays as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.scalars import source_file
from claimloom.operators.facts import ENGINE, REVIEW, TOMBSTONE, TRIPLE


def decide(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Accept or reject: ``decisions`` (subject, relation, object, accept boolean) rule on pending claims alone.

    All sources of a triple follow. A triple that is both accepted and rejected is rejected; decided claims and
    tombstones stay.
    """
    one = decisions.groupBy(*TRIPLE).agg(F.bool_and("accept").alias("_accept"))
    status = F.when(F.col("status").isin(*REVIEW) & F.col("_accept"), "accepted").when(F.col("status").isin(*REVIEW) & ~F.col("_accept"), TOMBSTONE).otherwise(F.col("status"))
    return claims.join(one, TRIPLE, "left").withColumn("status", status).select(*claims.columns)


def amend(claims: DataFrame, amendments: DataFrame) -> DataFrame:
    """Correct objects: ``amendments`` (subject, relation, object, new_object), the least new object of each triple.

    Every source of the old triple leaves a tombstone and gets the new triple as accepted; where that source has the
    new triple already, its row is accepted instead. Tombstones of the old triple bring nothing new.
    """
    one = amendments.where("new_object <> object").groupBy(*TRIPLE).agg(F.min("new_object").alias("_new"))
    met = claims.join(one, TRIPLE, "left")
    old = met.withColumn("status", F.when(F.col("_new").isNotNull(), TOMBSTONE).otherwise(F.col("status")))
    made = met.where(F.col("_new").isNotNull() & (F.col("status") != TOMBSTONE)).withColumn("object", F.col("_new")).withColumn("status", F.lit("accepted")).select(*claims.columns)
    key = [*TRIPLE, "source"]
    made = made.groupBy(*key).agg(*[F.min(c).alias(c) for c in claims.columns if c not in key]).select(*claims.columns)
    here = old.select(*claims.columns).join(made.select(*key, F.lit(True).alias("_made")), key, "left").withColumn("status", F.when(F.col("_made"), "accepted").otherwise(F.col("status"))).select(*claims.columns)
    return here.unionByName(made.join(claims.select(*key).distinct(), key, "left_anti").select(*claims.columns))


def last_copies(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Engine triples whose every source file is in ``files`` (file): what a purge would lose for good."""
    rows = claims.where(F.col("status").isin(*ENGINE)).withColumn("file", source_file(F.col("source")))
    gone = rows.join(files.select("file", F.lit(True).alias("_gone")).distinct(), "file", "left")
    return gone.groupBy(*TRIPLE).agg(F.bool_and(F.coalesce("_gone", F.lit(False))).alias("all_gone")).where("all_gone").select(*TRIPLE)


def eject(claims: DataFrame, files: DataFrame, purge: bool = False) -> DataFrame:
    """Retire the claims of source files: tombstones, or with ``purge`` no rows (check ``last_copies`` first)."""
    rows = claims.withColumn("file", source_file(F.col("source")))
    if purge:
        return rows.join(files.select("file").distinct(), "file", "left_anti").select(*claims.columns)
    met = rows.join(files.select("file", F.lit(True).alias("_gone")).distinct(), "file", "left")
    return met.withColumn("status", F.when(F.col("_gone"), TOMBSTONE).otherwise(F.col("status"))).select(*claims.columns)


def refresh(ledger: DataFrame, upstream: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """The ledger with the whitelisted ``fields`` of upstream where it has the key and a value; no other field moves."""
    now = upstream.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    both = ledger.join(now, ledger[key] == now["_k"], "left")
    return both.select(*[(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c)) for c in ledger.columns])


def acknowledge(ledger: DataFrame, asked: DataFrame, key: str, signal: str) -> DataFrame:
    """What acknowledging a recorded signal of each asked key does: ``no-ledger``, ``unchanged`` (no signal) or ``written``."""
    both = asked.select(key).distinct().join(ledger.select(F.col(key).alias("_k"), F.col(signal).alias("_signal")), F.col(key) == F.col("_k"), "left")
    return both.select(key, F.when(F.col("_k").isNull(), "no-ledger").when(F.coalesce("_signal", F.lit(False)), "written").otherwise("unchanged").alias("outcome"))
