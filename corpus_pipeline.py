"""A training-corpus pipeline: quality rules, near-duplicates, personal data, mix, tokens.

Each stage takes what its predecessor kept, with the columns of ``documents``, and returns those columns; the last
returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, mixing, near_copies, pii, quality
from claimloom.llm.common import materialize, table, unveiled, veiled
from claimloom.llm.queries import word_bpe_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source."""
    return quality.good_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of texts of five-word similarity 0.8 or more."""
    return near_copies.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets."""
    rest = {k: c for (k, c), name in zip(veiled(docs).items(), docs.columns, strict=True) if name != "text"}
    got = pii.find(docs, keep=rest, redact=True)
    return unveiled(got, docs, text=F.col("redacted"), n_chars=F.length("redacted").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that each source comes near its share of the words."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): ids are packed little-endian unsigned 32-bit integers."""
    keep = {c: F.col(c) for c in ("doc_id", "lang", "source")}
    return bpe.encode(docs, word_bpe_file(), keep=keep).select(*keep, "n_tokens", "ids")


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("pii", redact_personal_data), ("mixing", mix_sources), ("bpe", tokenize)]

#: The outlier, classifier and BPE stages can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
