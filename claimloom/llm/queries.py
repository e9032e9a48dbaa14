"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, hmm, langid, license_scan, mixing, pii, prefix_trie, quality, simhash, suffix_dedup, template, topk
from .common import fold, table


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    return hmm.score(table(spark, sf_dir, "documents"), ~held_out, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find(table(spark, sf_dir, "documents"), keep={"doc_id": F.col("doc_id")})
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.array_remove(F.transform(base, lambda s: s["kind"] == kind), False)).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return got.select("doc_id", *counts, F.sha2(pii.listing(base).cast("binary"), 256).alias("base_sha256"), pii.listing(F.col("spans")).alias("spans"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def word_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), word_bpe_file(), keep={"doc_id": F.col("doc_id")})
    kept = {"doc_id": F.col("doc_id"), "n_tokens": F.col("n_tokens"), "ids_sha256": F.sha2("ids", 256)}
    got = bpe.decode(encoded, word_bpe_file(), keep=kept)
    return got.select(*kept, F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out})


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan.find(table(spark, sf_dir, "documents"), keep={"doc_id": F.col("doc_id")})
    return got.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, rows = prefix_trie.with_shared_openings(prefix_trie.turns(table(spark, sf_dir, "conversations")), group=100, most=6)
    nodes, ends = prefix_trie.trie(convs, rows)
    listed = nodes.join(prefix_trie.end_digests(ends), "node", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return listed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", none).alias("ends_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_hmm_scores, op2_source_mixing, op3_html_template, op4_quality_outliers, op5_pii_spans, op6_exact_top_k, op7_suffix_dedup, op8_simhash_components, op9_bpe_trie, op10_language_id, op11_license_scan, op12_prefix_trie, op13_source_divergence)}
ORACLE_SQL = {"op2_source_mixing": mixing.MIX_SQL.format(docs="documents"), "op6_exact_top_k": topk.TOP_K_SQL.format(vectors="embeddings"), "op12_prefix_trie": prefix_trie.TRIE_SQL.format(rows="conversations"), "op13_source_divergence": divergence.REPORT_SQL.format(docs="documents")}
