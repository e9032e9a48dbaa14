"""Filters, identities and aggregates over claims (subject, relation, object, source, status, confidence, note)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.ordering import dealt
from claimloom.functions.scalars import source_file

ENGINE, REVIEW, TOMBSTONE = ("confirmed", "accepted"), ("needs_review", "candidate"), "superseded"
TRIPLE = ["subject", "relation", "object"]
#: Which status wins where copies of a claim disagree.
STATUS_RANK = {"confirmed": 0, "accepted": 1, "needs_review": 2, "candidate": 3, "superseded": 4}


def clean(claims: DataFrame) -> DataFrame:
    """Trimmed columns, null as the empty text."""
    return claims.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in claims.columns])


def engine_facts(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("status").isin(*ENGINE))


def review_facts(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("status").isin(*REVIEW))


def atoms(claims: DataFrame) -> DataFrame:
    """Distinct triples of engine facts."""
    return engine_facts(claims).select(*TRIPLE).distinct()


def canonical_atoms(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct triples of engine facts whose relation has a declared name, under that name; only those are told apart."""
    named = engine_facts(claims).select(*TRIPLE).join(F.broadcast(aliases), F.col("relation") == F.col("raw"))
    return dealt(named.select("subject", F.col("canonical").alias("relation"), "object"), TRIPLE, claims).distinct()


def edges(claims: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(u, v) of distinct triples whose relation is no attribute."""
    return atoms(claims).where(~F.col("relation").isin(*attributes)).select(F.col("subject").alias("u"), F.col("object").alias("v")).distinct()


def canonical(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """``claims`` with their relation's canonical name, by ``aliases`` (raw, canonical)."""
    return claims.join(aliases, claims["relation"] == aliases["raw"], "left").withColumn("relation", F.coalesce("canonical", "relation")).select(*claims.columns)


def matching(claims: DataFrame, subject: str | None = None, relation: str | None = None, obj: str | None = None, aliases: DataFrame | None = None, hierarchy: DataFrame | None = None) -> DataFrame:
    """Claims that match a pattern; None matches all. A relation also stands for its aliases, an object for its declared descendants."""
    out = claims
    if subject is not None:
        out = out.where(F.col("subject") == subject)
    if relation is not None:
        names = F.lit(relation)
        if aliases is None:
            out = out.where(F.col("relation") == names)
        else:
            variants = aliases.where(F.col("canonical") == relation).select(F.col("raw").alias("relation")).union(claims.sparkSession.createDataFrame([(relation,)], "relation string"))
            out = out.join(variants.distinct(), "relation", "left_semi")
    if obj is not None:
        if hierarchy is None:
            out = out.where(F.col("object") == obj)
        else:
            below = hierarchy.where(F.col("ancestor") == obj).select("relation", F.col("child").alias("object"))
            out = out.where(F.col("object") == obj).unionByName(out.where(F.col("object") != obj).join(below.distinct(), ["relation", "object"], "left_semi"))
    return out


def corroboration(claims: DataFrame) -> DataFrame:
    """Distinct sources, anchors included, of each engine triple."""
    rows = engine_facts(claims).where("source <> ''").select(*TRIPLE, "source")
    return dealt(rows, TRIPLE).groupBy(*TRIPLE).agg(F.countDistinct("source").alias("n_sources"))


def signals(claims: DataFrame) -> DataFrame:
    """Of each engine triple: number and list of source files, best confidence, whether a source is missing."""
    return engine_facts(claims).withColumn("file", source_file(F.col("source"))).groupBy(*TRIPLE).agg(
        F.array_sort(F.collect_set(F.when(F.col("file") != "", F.col("file")))).alias("all_files"),
        F.max(F.col("confidence").cast("decimal(3,2)")).cast("string").alias("best_confidence"),
        F.bool_or(F.col("source") == "").alias("missing_source"),
    ).select(*TRIPLE, F.size("all_files").cast("long").alias("n_files"), F.array_join("all_files", ",").alias("files"), "best_confidence", "missing_source")


def entities(claims: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Subjects, and objects of relations that are no attributes."""
    return claims.select(F.col("subject").alias("entity")).union(claims.where(~F.col("relation").isin(*attributes)).select("object")).distinct()


def usage(claims: DataFrame) -> DataFrame:
    """How often each entity and relation stands in claims: (kind, name, n)."""
    kinds = F.explode(F.array(F.struct(F.lit("entity").alias("kind"), F.col("subject").alias("name")), F.struct(F.lit("entity").alias("kind"), F.col("object").alias("name")), F.struct(F.lit("relation").alias("kind"), F.col("relation").alias("name"))))
    return claims.select(kinds.alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def per_source(claims: DataFrame) -> DataFrame:
    return claims.withColumn("file", source_file(F.col("source"))).groupBy("file").agg(F.count("*").alias("n_facts"), F.countDistinct("subject").alias("n_subjects"))


def rank(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), F.lit(len(STATUS_RANK)))


def first_by(claims: DataFrame, keys: Sequence[str], order: Sequence[Column | str], like: DataFrame | None = None) -> DataFrame:
    """One row a key: the first in ``order``, added up before the shuffle, so a key with very many copies is no one's task.

    With ``like``, what ``claims`` are made of, they are dealt out by their key in parts of its size before anything is
    sorted: no task of the input sorts its whole split, and a key's copies come one after the other in one task. Rows
    are sorted by a hash of the key first, since keys often begin alike; rows that have it as ``_key`` keep it.
    """
    by = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{k}") for k, c in enumerate(order)])
    at = {c: f"first.by.o{k}" for k, c in enumerate(order) if isinstance(c, str)}
    rest = [c for c in claims.columns if c not in ("_key", *keys) and c not in at]
    rows = claims if "_key" in claims.columns else claims.withColumn("_key", F.xxhash64(*keys))
    rows = rows if like is None else dealt(rows, ["_key"], like)
    first = rows.groupBy("_key", *keys).agg(F.min(F.struct(by.alias("by"), *[F.col(c) for c in rest])).alias("first"))
    return first.select(*[F.col(c) if c in ("_key", *keys) else F.col(at.get(c, f"first.{c}")).alias(c) for c in claims.columns])


def search(claims: DataFrame, needle: str) -> DataFrame:
    """Triples that hold ``needle`` in any part, whatever the case: statuses and number of source files."""
    hit = F.lit(False)
    for c in TRIPLE:
        hit = hit | F.contains(F.lower(c), F.lit(needle.lower()))
    return claims.where(hit).groupBy(*TRIPLE).agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"), F.countDistinct(source_file(F.col("source"))).alias("n_files"))
