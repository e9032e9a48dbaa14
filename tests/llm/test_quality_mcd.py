"""The minimum covariance determinant against a search with many random starts, and the chi-square figures."""

import math

import numpy as np
import pytest

from claimloom.llm import quality, queries

P = len(quality.FEATURES)


def random_search(x, h, rng, starts=200):
    """The least log determinant that concentration from many random starts reaches, and its mean."""
    best = (math.inf, None)
    for _ in range(starts):
        near = rng.choice(len(x), P + 1, replace=False)
        for _ in range(30):
            covariance = np.cov(x[near].T, bias=True) * quality.widening(len(near) / len(x)) if len(near) == h else np.cov(x[near].T, bias=True)
            whole = covariance + np.diag(quality._CHANCE)
            off = x - x[near].mean(axis=0)
            after = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(whole), off), kind="stable")[:h]
            if set(after) == set(near):
                break
            near = after
        det = float(np.linalg.slogdet(whole)[1])
        if det < best[0]:
            best = (det, x[near].mean(axis=0))
    return best


def rows_of(spark, groups):
    return spark.createDataFrame([(key, *map(float, v)) for key, x in groups.items() for v in x], ["_key", *quality.FEATURES]).repartition(3)


def test_least_determinant_as_by_random_search(spark):
    rng = np.random.default_rng(4)
    shape = rng.normal(size=(P, P)) * 0.2
    groups = {}
    for key, share in (("clean", 0.0), ("junk", 0.4)):
        x = rng.normal(size=(160, P)) @ shape
        x[: int(share * len(x))] = rng.normal(size=(int(share * len(x)), P)) @ shape + 3
        groups[key] = x
    found = {r["_key"]: r for r in quality.minimum_determinant(rows_of(spark, groups)).collect()}
    for key, x in groups.items():
        h = math.ceil(quality.SUPPORT * (len(x) + P + 1))
        det, mean = random_search(x, h, rng)
        assert found[key]["determinant"] < det + 0.3
        assert np.abs(np.array(found[key]["center"]) - mean).max() < 0.25
    assert np.abs(np.array(found["junk"]["center"])).max() < 0.5  # two fifths of one kind of junk don't move it


def test_chi_square():
    assert quality.chi_square(quality.quantile(0.3, 7), 7) == pytest.approx(0.3)
    assert quality.quantile(0.999, 7) == pytest.approx(24.3219, abs=1e-3) and quality.quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3)
    assert quality.widening(1.0) == 1 and 1.5 < quality.widening(0.5) < 3


def test_junk_of_a_hot_source_is_rejected(spark):
    """A third of a source is junk of one kind."""
    rng = np.random.default_rng(1)
    words = ["stone", "river", "green", "cloud", "house", "lamp", "field", "road"]
    good = [" ".join(rng.choice(words, 60)) + "." for _ in range(200)]
    junk = [" ".join(f"{x}#$%" for x in rng.choice(words, 60)) for _ in range(100)]
    docs = spark.createDataFrame([(k, t, "en", "hot", 1) for k, t in enumerate(good + junk)], "doc_id long, text string, lang string, source string, _key int")
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect() if not r.base_failed}
    assert not any(v for k, v in got.items() if k >= 200) and all(v for k, v in got.items() if k < 200)


def test_query_and_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None), (1, "", "en", None), (2, "word " * 30000, "en", "a"), (2, "word " * 30000, "en", "a"), (3, "one two three four five six seven eight nine ten eleven", None, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_quality_outliers(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    kept = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in got.collect())
    assert kept == [(0, 0, True, False), (1, 0, True, False), (2, 30000, True, False), (2, 30000, True, False), (3, 11, False, True)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.quality(empty).count() == 0 and quality.good_documents(empty).count() == 0
