"""Integrity gates: each returns the rows that break a rule; an empty result passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.ordering import dealt
from claimloom.functions.scalars import has_control
from claimloom.operators.conflicts import PARSERS
from claimloom.operators.facts import STATUS_RANK, TRIPLE, canonical, engine_facts
from claimloom.operators.graph import closure


def require_none(breaches: DataFrame, what: str) -> None:
    """Raise where a gate found any row."""
    if not breaches.isEmpty():
        raise ValueError(f"gate: {what}")


def control_characters(claims: DataFrame) -> DataFrame:
    """(column, value) of parts of engine facts with control characters."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in TRIPLE]))
    return engine_facts(claims).select(parts.alias("p")).select("p.*").where(has_control(F.col("value"))).distinct()


def drift(claims: DataFrame, accepted: DataFrame) -> DataFrame:
    """Triples on one side alone: engine atoms that were not written, or written ones that are no atoms."""
    sides = engine_facts(claims).select(*TRIPLE, F.lit("only-table").alias("side")).unionByName(accepted.select(*TRIPLE, F.lit("only-written").alias("side")))
    in_table, written = (F.max((F.col("side") == x).cast("int")).alias(x) for x in ("only-table", "only-written"))
    found = dealt(sides, TRIPLE).groupBy(*TRIPLE).agg(in_table, written).where(F.col("only-table") != F.col("only-written"))
    return found.select(*TRIPLE, F.when(F.col("only-table") == 1, "only-table").otherwise("only-written").alias("side"))


def relation_gap(claims: DataFrame, accepted: DataFrame) -> DataFrame:
    """Relations of engine facts without any written row."""
    return engine_facts(claims).select("relation").distinct().join(accepted.select("relation").distinct(), "relation", "left_anti")


def unknown_statuses(claims: DataFrame) -> DataFrame:
    return claims.where(~F.coalesce(F.col("status").isin(*STATUS_RANK), F.lit(False))).groupBy("status").agg(F.count("*").alias("n"))


def untyped(claims: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """(relation, object) of engine facts whose object does not parse as its relation's type."""
    parsed = F.lit(True)
    for relation, kind in types.items():
        parsed = F.when(F.col("relation") == relation, PARSERS[kind](F.col("object")).isNotNull()).otherwise(parsed)
    return engine_facts(claims).where(F.col("relation").isin(*types) & ~parsed).select("relation", "object").distinct()


def hierarchy_warnings(claims: DataFrame, declared: DataFrame) -> DataFrame:
    """(relation, child, parent, warning) of ``declared`` rows: ``cycle``, ``unused-relation`` or ``unused-value``."""
    used = engine_facts(claims).select("relation", "object").distinct()
    both = declared.join(used.select("relation").distinct().withColumn("_r", F.lit(True)), "relation", "left").join(used.select("relation", F.col("object").alias("child"), F.lit(True).alias("_v")), ["relation", "child"], "left")
    node = lambda c: F.concat_ws("\x1f", "relation", c)
    loops = closure(declared.select(node("child").alias("u"), node("parent").alias("v"))).where("u = v").select("u").withColumn("_loop", F.lit(True))
    warned = both.withColumn("u", node("child")).join(loops, "u", "left")
    kind = F.when(F.col("_loop"), "cycle").when(F.col("_r").isNull(), "unused-relation").when(F.col("_v").isNull(), "unused-value")
    return warned.select("relation", "child", "parent", kind.alias("warning")).where("warning IS NOT NULL")


def drop_impact(questions: DataFrame, before: DataFrame, after: DataFrame, aliases: DataFrame | None = None, by: Sequence[str] = ("subject", "relation")) -> DataFrame:
    """Questions (question and the parts ``by``) that engine facts ``before`` answer and those ``after`` do not."""
    def answers(claims: DataFrame) -> DataFrame:
        rows = engine_facts(claims)
        rows = canonical(rows, aliases) if aliases is not None else rows
        return rows.select(*by).distinct()

    return questions.join(answers(before), list(by), "left_semi").join(answers(after), list(by), "left_anti").select("question", *by)


def lost_relations(kept: DataFrame, dropped: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical relations that only dropped rows would have supplied."""
    names = lambda rows: canonical(engine_facts(rows), aliases).select("relation").distinct()
    return names(dropped).join(names(kept), "relation", "left_anti")


def ledger_faults(ledger: DataFrame, key: str, flag: str, allowed: tuple[str, ...]) -> DataFrame:
    """(key, fault) of recorded rows: ``duplicate`` keys, and ``value`` where the flag is none of ``allowed``."""
    twice = ledger.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate").alias("fault"))
    odd = ledger.where(~F.coalesce(F.col(flag).isin(*allowed), F.lit(False))).select(key, F.lit("value").alias("fault")).distinct()
    return twice.unionByName(odd)
