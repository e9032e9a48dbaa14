"""Names that may mean one thing: equal when folded, one within the other, or records that share an id.

No two names are compared for standing in one group. A name is looked for by its rarest run of ``GRAM`` characters: every
name that holds it holds that run too. Classes are listed by their representative, so copies cost a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.storage import stored
from claimloom.operators.audit import entity_fold
from claimloom.operators.graph import components

GRAM = 3


def folded(names: DataFrame) -> DataFrame:
    """(norm, representative, n_names): the classes of equal folded names; a name that folds to nothing has none."""
    norms = names.where("name IS NOT NULL").select("name").distinct().withColumn("norm", entity_fold(F.col("name"))).where("norm <> ''")
    return norms.groupBy("norm").agg(F.min("name").alias("representative"), F.count("*").alias("n_names"))


def _grams(norm: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(norm) - size + 1)), lambda k: F.substring(norm, k, F.lit(size))))


def contained(names: DataFrame) -> DataFrame:
    """(inner, outer): distinct folded names of which one stands within the other.

    Names of ``GRAM`` characters or more are looked for by their rarest run; shorter ones by themselves among the runs of
    their own length.
    """
    norms = stored(folded(names).select("norm"), "norms")
    found = None
    for size in range(1, GRAM + 1):
        asked = norms.where(F.length("norm") >= size if size == GRAM else F.length("norm") == size)
        held = norms.where(F.length("norm") > size).select(F.col("norm").alias("outer"), F.explode(_grams(F.col("norm"), size)).alias("gram"))
        if size < GRAM:
            pairs = held.join(asked.select(F.col("norm").alias("gram")), "gram").select(F.col("gram").alias("inner"), "outer")
        else:
            held = stored(held, "grams")
            often = held.groupBy("gram").agg(F.count("*").alias("n"))
            own = asked.select(F.col("norm").alias("inner"), F.explode(_grams(F.col("norm"), size)).alias("gram")).join(often, "gram")
            rarest = own.groupBy("inner").agg(F.min(F.struct("n", "gram")).alias("r")).select("inner", F.col("r.gram").alias("gram"))
            pairs = rarest.join(held, "gram").where((F.length("outer") > F.length("inner")) & F.contains("outer", F.col("inner"))).select("inner", "outer")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def pair_audit(names: DataFrame) -> DataFrame:
    """(kind, a, b) of names that may be one: ``equal`` (a representative and another name of its class) and ``contained`` (representatives)."""
    classes = stored(folded(names), "classes")
    members = names.where("name IS NOT NULL").select("name").distinct().withColumn("norm", entity_fold(F.col("name")))
    equal = members.join(classes.where("n_names > 1"), "norm").where("name <> representative").select(F.lit("equal").alias("kind"), F.col("representative").alias("a"), F.col("name").alias("b"))
    of = lambda c: classes.select(F.col("norm").alias(c), F.col("representative").alias(f"{c}_name"))
    within = contained(names).join(of("inner"), "inner").join(of("outer"), "outer").select(F.lit("contained").alias("kind"), F.col("inner_name").alias("a"), F.col("outer_name").alias("b"))
    return equal.unionByName(within)


def identity_classes(records: DataFrame, ids: tuple[str, ...] = ("doi", "pmid", "arxiv"), key: str = "record") -> DataFrame:
    """(record, identity, n_records, disagree): records that share an id, or are tied by others that do, are one.

    ``identity`` is the least record of the class; ``disagree`` lists the kinds of id of which the class has several
    values, comma-joined. Null and empty ids tie nothing; a record without ids is a class of its own.
    """
    own = F.concat(F.lit("r"), F.col(key).cast("string"))
    ties = F.explode(F.array_compact(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), F.col(c))) for c in ids])))
    edges = stored(records.select(F.col(key).alias("record"), own.alias("u"), ties.alias("v")).distinct(), "ties")
    label = components(edges.select("u", "v"))
    named = records.select(F.col(key).alias("record"), own.alias("node"), *ids).distinct().join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = [F.when(F.min(F.nullif(F.col(c), F.lit(""))) != F.max(F.nullif(F.col(c), F.lit(""))), F.lit(c)) for c in ids]
    classes = named.groupBy("label").agg(F.min("record").alias("identity"), F.count_distinct("record").alias("n_records"), F.array_join(F.array_compact(F.array(*several)), ",").alias("disagree"))
    return named.select("record", "label").distinct().join(classes, "label").select("record", "identity", "n_records", "disagree")
