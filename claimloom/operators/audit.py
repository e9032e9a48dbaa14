"""Audits of values and entity names."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.unicode import fold_case, nfc
from claimloom.operators.facts import TRIPLE, engine_facts

#: What a value's fold takes for separators, and which of them matter between digits.
SEPARATORS, BETWEEN_DIGITS = r"(?U)[\s\-_./·]+", "[-._/]"
# Labels for the rest, and values that say nothing.
WRAPPER_WORDS = "기타|기타사항|그 ?외|그외|other|others|misc"
PLACEHOLDERS = ("기타", "그외", "그 외", "기타사항", "불명", "미상", "해당없음", "없음", "other", "others", "misc", "unknown", "n/a", "n.a.", "none", "tbd", "-", "?")


def value_fold(text: Column) -> Column:
    """A value in normal form C without case, thousands commas, white space and separators; one separator between digits stays, whichever it is."""
    plain = F.regexp_replace(nfc(text), rf"(?<=\p{{Nd}}),(?=\p{{Nd}}{{3}}(?!\p{{Nd}}))", "")
    kept = F.regexp_replace(plain, rf"(?<=\p{{Nd}}){BETWEEN_DIGITS}(?=\p{{Nd}})", "\x00")
    return fold_case(F.regexp_replace(kept, SEPARATORS, ""))


def entity_fold(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s·_\-/().,]+", "")


def spelling_groups(claims: DataFrame) -> DataFrame:
    """(relation, fold, n_spellings, spellings) of values that differ in spelling alone; relations in normal form C."""
    values = engine_facts(claims).select(nfc(F.col("relation")).alias("relation"), "object", value_fold(F.col("object")).alias("fold")).where("fold <> ''").distinct()
    return values.groupBy("relation", "fold").agg(F.count("*").alias("n_spellings"), F.array_join(F.array_sort(F.collect_set("object")), "|").alias("spellings")).where("n_spellings > 1")


def wrapped(value: Column) -> Column:
    """What stands in a label for the rest, ``other (x)`` or ``x (other)``; null for other values."""
    composed = nfc(value)
    before = F.regexp_extract(composed, rf"(?i)^(?:{WRAPPER_WORDS})\s*[(（]\s*(.+?)\s*[)）]$", 1)
    after = F.regexp_extract(composed, rf"(?i)^(.+?)\s*[(（]\s*(?:{WRAPPER_WORDS})\s*[)）]$", 1)
    return F.when(before != "", before).when(after != "", after)


def wrappers(claims: DataFrame) -> DataFrame:
    """Values in a label for the rest: (relation, object, inner)."""
    opened = F.contains(F.col("object"), F.lit("(")) | F.contains(F.col("object"), F.lit("（"))  # no form of a text adds or takes one
    return claims.where(opened).select("relation", "object", wrapped(F.col("object")).alias("inner")).where("inner IS NOT NULL").distinct()


def placeholders(claims: DataFrame) -> DataFrame:
    """(relation, object, n_owners) of values that say nothing, with how many subjects have them; compared whole, without case."""
    nothing = fold_case(nfc(F.trim("object"))).isin(*PLACEHOLDERS)
    return engine_facts(claims).where(nothing).groupBy(nfc(F.col("relation")).alias("relation"), "object").agg(F.countDistinct(nfc(F.col("subject"))).alias("n_owners"))


def value_owners(claims: DataFrame, identity: Sequence[str] = ()) -> DataFrame:
    """(relation, fold, n_spellings, n_owners, kind) of values with several spellings, and how many subjects have them.

    kind is ``split`` for one value written in several ways, ``duplicate_record`` where the relation identifies its
    subject and several subjects have it.
    """
    rows = engine_facts(claims).select(nfc(F.col("relation")).alias("relation"), "object", nfc(F.col("subject")).alias("subject"), value_fold(F.col("object")).alias("fold")).where("fold <> ''").distinct()
    groups = rows.groupBy("relation", "fold").agg(F.countDistinct("object").alias("n_spellings"), F.countDistinct("subject").alias("n_owners")).where("n_spellings > 1")
    return groups.withColumn("kind", F.when(F.col("relation").isin(*identity) & (F.col("n_owners") > 1), "duplicate_record").otherwise("split"))


def entity_counts(claims: DataFrame) -> DataFrame:
    """(entity, n_facts, statuses, literal): where an entity stands, and whether its name looks like a literal."""
    both = claims.select("status", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"))
    literal = F.col("entity").rlike(r"^-?[0-9][0-9,]*(\.[0-9]+)?$") | F.col("entity").rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$") | F.col("entity").rlike(r"^[a-z]+\(.*\)$")
    return both.groupBy("entity").agg(F.count("*").alias("n_facts"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses")).withColumn("literal", literal)


def shared_tokens(names: DataFrame, least: int = 2) -> DataFrame:
    """(word, name, n_names) of words that several names share.

    Two names are linked if they stand under one word; the word is the class, so a common one costs a row a name and
    no pairs are listed.
    """
    words = names.select("name", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) >= least))).alias("word")).distinct()
    return words.join(words.groupBy("word").agg(F.count("*").alias("n_names")).where("n_names > 1"), "word")


def added(part: Column) -> Column:
    """The sum of longs, none negative, of which 63 bits stay: no number of rows outgrows it."""
    return F.coalesce(F.sum(part.cast("decimal(20,0)")) % F.lit(Decimal(1 << 63)), F.lit(0)).cast("long")


def snapshot(claims: DataFrame) -> DataFrame:
    """A review queue's fingerprint that no order changes: number of pending triples, and the sum of their hashes, of which 63 bits stay."""
    pending = claims.where(F.col("status").isin("needs_review", "candidate")).select(*TRIPLE).distinct()
    part = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *TRIPLE).cast("binary")), 1, 10), 16, 10).cast("long")
    return pending.agg(F.count("*").alias("n"), added(part).alias("fingerprint"))
