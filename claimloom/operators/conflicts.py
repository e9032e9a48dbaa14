"""Contradictions between claims of relations that may have one object."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scalars
from claimloom.functions.ordering import dealt
from claimloom.functions.unicode import nfc, unsettled
from claimloom.operators.facts import TRIPLE, engine_facts

PARSERS = {"date": scalars.parse_date, "number": scalars.parse_number_scaled, "ordinal": scalars.parse_ordinal, "amount": scalars.parse_amount}


def canonical_name(relation: Column, canonical: Column, is_target: Column) -> Column:
    """A relation's name: what its alias stands for, its normal form C if it is such a name itself, else as it is spelled."""
    return F.coalesce(canonical, F.when(is_target, nfc(relation)), relation)


def with_canonical(claims: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """``claims`` with ``canonical``, by ``aliases`` (raw, canonical) in normal form C.

    Declarations are broadcast: by their relation, nearly all claims would meet in a few tasks.
    """
    if aliases is None:
        return claims.withColumn("canonical", F.col("relation"))
    targets = F.broadcast(aliases.select(F.col("canonical").alias("_target")).distinct())
    rows = claims.withColumn("_composed", nfc(F.col("relation"))).join(F.broadcast(aliases.select(F.col("raw").alias("_composed"), F.col("canonical").alias("_alias"))), "_composed", "left")
    rows = rows.join(targets, rows["_composed"] == targets["_target"], "left")
    return rows.select(*claims.columns, canonical_name(F.col("relation"), F.col("_alias"), F.col("_target").isNotNull()).alias("canonical"))


def _specs(spark, types: Mapping[str, str] | DataFrame) -> DataFrame:
    """(relation, type, units) of declared types; names in normal form C."""
    if isinstance(types, DataFrame):
        return types.select("relation", "type", "units" if "units" in types.columns else F.lit(None).cast("map<string,long>").alias("units"))
    rows = [(unicodedata.normalize("NFC", r), kind, None) for r, kind in types.items()]
    return spark.createDataFrame(rows, "relation string, type string, units map<string,long>")


def with_spec(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """``rows`` (relation, canonical) with ``_type`` and ``_units``: the declaration of the canonical name, else of the spelled one; broadcast as aliases are."""
    named = lambda k: F.broadcast(specs.select(F.col("relation").alias(f"_of{k}"), F.col("type").alias(f"_type{k}"), F.col("units").alias(f"_units{k}")))
    one, two = named(1), named(2)
    both = rows.withColumns({"_name1": nfc(F.col("canonical")), "_name2": nfc(F.col("relation"))})
    both = both.join(one, both["_name1"] == one["_of1"], "left").join(two, both["_name2"] == two["_of2"], "left")
    found = {"_type": F.coalesce("_type1", "_type2"), "_units": F.when(F.col("_type1").isNotNull(), F.col("_units1")).otherwise(F.col("_units2"))}
    return both.select(*rows.columns, *[c.alias(k) for k, c in found.items()])


def object_key(obj: Column, kind: Column, units: Column) -> Column:
    """Equal for equal objects: the scalar of a typed relation's object where it parses, else the text in normal form C."""
    scalar = scalars.scalar(kind, obj, units)
    return F.when(scalar.isNotNull(), F.concat(F.lit("scalar:"), scalar.cast("string"))).otherwise(F.concat(F.lit("raw:"), nfc(obj)))


def conflicts(claims: DataFrame, single_valued: Sequence[str], types: Mapping[str, str] | DataFrame | None = None, aliases: DataFrame | None = None, hierarchy: DataFrame | None = None) -> DataFrame:
    """(subject, relation, n_values, competing) of subjects with several objects under one single-valued relation.

    Subjects, relations and objects are compared in normal form C, relations by their canonical name, typed objects
    (``types``: a mapping, or rows of relation, type, units) by their scalar. A subject, relation or object is shown
    by its least spelling. Values of which one has all others among its declared ancestors (``hierarchy``: relation,
    child, ancestor, in normal form C) are a chain of specialisations, no conflict.
    """
    rows = engine_facts(claims).select(*TRIPLE)
    if aliases is None:  # a relation that form C leaves alone is told here; of the rest each spelling goes to Python once
        names = [unicodedata.normalize("NFC", r) for r in single_valued]
        rows = rows.where(F.col("relation").isin(*names) | unsettled(F.col("relation"))).distinct()
        rows = with_canonical(rows, None).withColumn("_relation", nfc(F.col("relation"))).where(F.col("_relation").isin(*names))
    else:
        declared = with_canonical(claims.sparkSession.createDataFrame([(r,) for r in single_valued], "relation string"), aliases).select(nfc(F.col("canonical")).alias("_relation")).distinct()
        rows = with_canonical(rows, aliases).withColumn("_relation", nfc(F.col("canonical"))).join(F.broadcast(declared), "_relation", "left_semi").distinct()
    if types is None:
        rows = rows.withColumns({"_type": F.lit(None).cast("string"), "_units": F.lit(None).cast("map<string,long>")})
    else:
        rows = with_spec(rows, _specs(claims.sparkSession, types))
    rows = rows.withColumns({"_subject": nfc(F.col("subject")), "_key": object_key(F.col("object"), F.col("_type"), F.col("_units"))})
    group = ["_subject", "_relation"]
    rows = dealt(rows, group, claims)
    shown = rows.groupBy(*group, "_key").agg(F.min("object").alias("value"), F.min("subject").alias("subject"), F.min("canonical").alias("relation"), F.first("_type").alias("_type"), F.first("_units").alias("_units"))
    found = shown.groupBy(*group).agg(F.count("*").alias("n_values"), F.min("subject").alias("subject"), F.min("relation").alias("relation"), F.array_sort(F.collect_list(F.struct("value", "_key"))).alias("all"), F.first("_type").alias("_type"), F.first("_units").alias("_units")).where("n_values > 1")
    if hierarchy is not None:
        above = hierarchy.select(F.col("relation").alias("_relation"), F.col("child").alias("_child"), F.col("ancestor").alias("_ancestor"))
        one = found.select(*group, "all", "_type", "_units", F.explode("all").alias("x")).withColumn("_child", nfc(scalars.canonical_amount(F.col("x.value"))))
        keys = one.join(above, ["_relation", "_child"]).withColumn("_above", object_key(F.col("_ancestor"), F.col("_type"), F.col("_units")))
        sets = keys.groupBy(*group, "x", "all").agg(F.collect_set("_above").alias("_above"))
        others = F.array_remove(F.transform("all", lambda v: v["_key"]), F.col("x._key"))
        chains = sets.where(F.size(F.array_except(others, "_above")) == 0).select(*group).distinct()
        found = found.join(chains, group, "left_anti")
    return found.select("subject", "relation", "n_values", F.array_join(F.transform("all", lambda v: v["value"]), "|").alias("competing"))


def competing(claims: DataFrame, single_valued: Sequence[str]) -> DataFrame:
    """Each value of a contradicted subject and relation with its number of sources; Unicode form alone is no other value."""
    names = [unicodedata.normalize("NFC", r) for r in single_valued]
    rows = engine_facts(claims).withColumns({f"_{c}": nfc(F.col(c)) for c in ("subject", "relation", "object")}).where(F.col("_relation").isin(*names))
    values = rows.groupBy("_subject", "_relation", "_object").agg(F.countDistinct("source").alias("n_sources"), F.min("object").alias("object"), F.min("subject").alias("subject"), F.min("relation").alias("relation"))
    many = values.groupBy("_subject", "_relation").agg(F.count("*").alias("n"), F.min("subject").alias("subject"), F.min("relation").alias("relation")).where("n > 1").drop("n")
    return values.drop("subject", "relation").join(many, ["_subject", "_relation"]).drop("_subject", "_relation", "_object")
