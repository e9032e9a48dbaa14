"""Ranked search over source texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.unicode import fold_case, nfc


def hits(text: Column, word: str) -> Column:
    """How often a word stands in a text between other characters than ASCII letters and digits, whatever the case."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z0-9]){re.escape(word.lower())}(?![a-z0-9])"))


def ranked(docs: DataFrame, words: Sequence[str], limit: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``limit`` best documents: by number of words found, then by hits, then by id. One pass; each task keeps its best."""
    counts = [F.coalesce(hits(F.col(text_col), w), F.lit(0)) for w in words]
    coverage = sum(((c > 0).cast("int") for c in counts), F.lit(0))
    scored = docs.select(id_col, coverage.alias("coverage"), sum(counts, F.lit(0)).cast("long").alias("hits")).where("coverage > 0")
    return scored.orderBy(F.desc("coverage"), F.desc("hits"), id_col).limit(limit)


def nearest(vocabulary: DataFrame, word: str, limit: int = 3) -> DataFrame:
    """Did you mean: names within an edit distance of a third of the word's length (1 to 3), in normal form C and without case."""
    asked = unicodedata.normalize("NFC", word).casefold()
    most = min(3, max(1, len(asked) // 3))
    names = vocabulary.withColumn("_plain", fold_case(nfc(F.col("name"))))
    near = names.where(F.col("_plain") != asked).withColumn("distance", F.levenshtein("_plain", F.lit(asked), most).cast("long")).where((F.col("distance") >= 0) & (F.col("distance") <= most))
    return near.orderBy("distance", "_plain", "name").limit(limit).drop("_plain")
