"""Reading and writing claim tables and source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.scalars import normalize_confidence
from claimloom.operators.facts import TRIPLE, atoms, clean

CLAIM = T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "relation", "object", "source", "status", "confidence", "note")])


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of claims with a header: trimmed, no nulls, confidence between 0.00 and 1.00."""
    rows = spark.read.csv(path, header=True, schema=CLAIM, multiLine=True, escape='"', enforceSchema=False, mode="FAILFAST")
    return clean(rows).withColumn("confidence", normalize_confidence(F.col("confidence")))


def write_claims(claims: DataFrame, path: str) -> None:
    claims.select(*CLAIM.names).write.mode("overwrite").csv(path, header=True, escape='"')


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files: JSON arrays of claims. What is no array, and rows without one of the first four fields, are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(CLAIM)).alias("rows"))
    rows = clean(whole.where(F.size("rows") > 0).select(F.explode("rows").alias("r")).select("r.*"))
    return rows.where("subject <> '' AND relation <> '' AND object <> '' AND source <> ''")


def cited_sources(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.substring_index("source", "#", 1).alias("file")).agg(F.count("*").alias("n"))


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``relation("s","r","o").``; comments and other lines are left out."""
    args = F.from_json(F.concat(F.lit("["), F.regexp_extract("value", r"^\s*relation\((.*)\)\.\s*$", 1), F.lit("]")), T.ArrayType(T.StringType()))
    rows = spark.read.text(path).select(args.alias("a")).where(F.size("a") == 3)
    return rows.select(*[F.col("a")[k].alias(c) for k, c in enumerate(TRIPLE)]).distinct()


def write_atoms(claims: DataFrame, path: str) -> None:
    """Engine facts as atom lines, each triple once."""
    quoted = [F.substring(j := F.to_json(F.array(c)), 2, F.length(j) - 2) for c in TRIPLE]
    atoms(claims).select(F.concat(F.lit("relation("), F.concat_ws(",", *quoted), F.lit(").")).alias("value")).write.mode("overwrite").text(path)


def read_sources(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of all files below the given folders; names that start with a dot or underscore are left out."""
    return spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def front_matter(text):
    """The scalar fields between the opening ``---`` fences, as a map of text."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*:[ \t]*\S.*)$"), F.lit(1))
    unquoted = lambda v: F.regexp_replace(v, r'^"(.*)"$', "$1")
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).alias("key"), unquoted(F.trim(F.regexp_replace(p, r"^[^:]*:", ""))).alias("value")))
    keys = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, k: F.array_position(keys, e["key"]) == k + 1)
    return F.map_from_entries(first)
