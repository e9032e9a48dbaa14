"""Scores with rare and unknown words against a plain recursion over each text, and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from claimloom.llm import hmm, queries
from claimloom.llm.common import fold

TEXTS = {k: " ".join(["stone river", "rivers stones RIVER", "unseen" + str(k), "gone going doing"][(k + j) % 4] for j in range(k % 6)) for k in range(40)} | {90: None, 91: "", 92: "doing " * 5000, 93: "\t\n"}


def test_score_of_rare_and_unknown_words(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3)
    training = fold("doc_id", 7) != 2
    words, counts = hmm.lexicon(docs.where(training), "text", 2)
    shared = spark.sparkContext.broadcast(words)
    rows = hmm.encoded(docs, shared, {"own": F.col("doc_id"), "_training": training}, "text")
    start, move, emit = hmm.train(rows.where("_training"), words, 3, 2)
    n_of = {bytes(r.word): r.n for r in counts.collect()}
    assert np.allclose(emit[1:].sum(axis=0), 1) and np.allclose(move.sum(axis=1), 1)
    # shares of a class, with its one unknown, add up to one
    of_class = Counter()
    for w, n in n_of.items():
        if w not in words.words:
            of_class[hmm.word_class(w)] += n + 1
    assert all(words.total_of[k] == of_class[k] + 1 for k in range(hmm.CLASSES))
    got = {r.doc_id: r.score for r in hmm.score(docs, training, {"doc_id": F.col("doc_id")}, states=3, vocabulary=2, rounds=2).collect()}
    for k, text in TEXTS.items():
        alpha, total = None, 0.0
        for w in [*(text or "").lower().encode().split(), hmm.END]:
            if w == hmm.END or w in words.words:
                likely = emit[1 if w == hmm.END else words.words[w]]
            else:
                k2 = hmm.word_class(w)
                likely = emit[words.first_class + k2] * (n_of.get(w, 0) + 1) / words.total_of[k2]
            now = (start if alpha is None else alpha @ move) * likely
            total += math.log10(now.sum())
            alpha = now / now.sum()
        assert math.isclose(got[k], total, rel_tol=1e-5, abs_tol=1e-3), k


def test_query_and_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "symbols", "rare", "times", "n_tokens", "word")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_hmm_scores(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {r.doc_id: r.held_out for r in got.collect()} == {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in TEXTS}
    kept = hmm.score(docs, F.lit(True), {"row": F.col("row"), "n_times": F.col("times")}, states=2, rounds=1)
    assert kept.columns[:2] == ["row", "n_times"] and kept.count() == len(TEXTS)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score(empty, F.lit(True), {"doc_id": F.col("doc_id")}).count() == 0
