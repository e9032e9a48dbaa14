"""Language identification against a plain naive Bayes, and on odd input."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimloom.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string, source string, lang_pred string, n long, bucket int"
MASK = (1 << 64) - 1


def buckets(text):
    """The bucket of each n-gram, by the hash in whole numbers."""
    codes = [ord(c) for c in f" {text.lower()} "]
    out = []
    for n in langid.ORDERS:
        for at in range(len(codes) - n + 1):
            h = None
            for k in range(n):
                h = (h if k else 1) * 0x9E3779B97F4A7C15 + codes[at + k] * 0xC2B2AE3D27D4EB4F & MASK
            out.append((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 64 - langid.BITS)
    return out


def brute(train, texts):
    counts, docs = defaultdict(Counter), Counter()
    for text, lang in train:
        if text is not None and lang is not None:
            counts[lang].update(buckets(text))
            docs[lang] += 1
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text) or not docs:
            out.append(("und", 0.0))
            continue
        odds = {lang: math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * (1 << langid.BITS))) for b, n in Counter(buckets(text)).items()) for lang in sorted(docs)}
        best = max(odds, key=lambda x: odds[x])
        out.append((best, 1 / sum(math.exp(x - odds[best]) for x in odds.values())))
    return out


def corpus():
    rng = random.Random(15)
    words = {"en": "the of and thing".split(), "de": "der die und über".split(), "fr": "que la été où".split()}
    rows = [(k, " ".join(rng.choice(words[lang if rng.random() < 0.7 else "en"]) for _ in range(rng.randint(1, 12))), lang) for k in range(90) for lang in [rng.choice(sorted(words))]]
    return rows + [(200, None, "en"), (201, "", "de"), (202, "12 34 !", None), (203, "zorblax", None), (204, "ÜBER", "de"), rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, g, "s", "x", 1, 2) for k, t, g in rows], SCHEMA).repartition(3)


def test_predictions_equal_a_plain_naive_bayes(spark):
    rows = corpus()
    train = [(t, g) for k, t, g in rows if k % 3]
    model = langid.train(frame(spark, rows).where("doc_id % 3 <> 0"))
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(frame(spark, rows), model, keep={"doc_id": F.col("doc_id")}).collect())
    want = sorted((k, *x) for (k, *_), x in zip(rows, brute(train, [t for _, t, _ in rows]), strict=True))
    assert [(k, p) for k, p, _ in got] == [(k, p) for k, p, _ in want]
    assert all(s == pytest.approx(w, abs=1e-4) for (*_, s), (*_, w) in zip(got, want, strict=True))


def test_a_very_long_text_counts_like_a_short_one(spark):
    long = "der die und " * 400_000
    model = langid.train(frame(spark, [(1, "the of and " * 50, "en"), (2, long, "de"), (3, "x", None)]))
    assert [r.lang_pred for r in langid.predict(frame(spark, [(1, long, None), (2, "the of and", None), (3, "the " * 1_000_000, None)]), model, keep={"doc_id": F.col("doc_id")}).orderBy("doc_id").collect()] == ["de", "en", "en"]


def test_empty_tables(spark):
    nothing = langid.train(frame(spark, []))
    assert [(r.lang_pred, r.score) for r in langid.predict(frame(spark, [(1, "text", "en")]), nothing).collect()] == [("und", 0.0)]
    assert langid.predict(frame(spark, []), nothing).count() == 0


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    got = queries.op10_language_id(spark, "/root/testdata/sf0.001").where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and len(got) > 20
