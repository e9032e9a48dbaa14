"""The pipeline's stages one by one, on odd rows, and as a whole."""

import importlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import queries
from claimloom.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ["n_words", "fp", "spans", "redacted", "size", "epochs", "kept", "distance", "own_0", "ids", "label"]


def rows():
    rng = random.Random(3)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do", "tempor", "magna"]
    out = [(k, " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(60)), "en", f"s{k % 3}", 0) for k in range(60)]
    out += [(100, out[5][1], "en", "s0", 0), (101, out[6][1] + " end", "en", "s1", 0), (102, "# $ % " * 40, "en", "s0", 0), (103, "same words again here now " * 20, "en", "s1", 0)]
    out += [(104, out[7][1] + " write to me@example.com or +49 30 1234567 today", "en", None, 0), (105, None, None, None, None), (106, "", "en", "s0", 0), (None, out[8][1] + " more and more", None, None, 0), out[9]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return materialize(df, "pipeline-docs")


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns_and_take_empty_tables(spark, docs, k):
    _, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, "")
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert got.count() > 30 and stage(spark, docs.where("false"), "").count() == 0
    assert got.select(*CLASHES).distinct().collect() == [tuple("x" for _ in CLASHES)]


def test_quality_stage(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, "").select("doc_id").collect()}
    assert set(range(60)) | {100, 101, 104} <= kept and not kept & {102, 103, 105, 106}


def classes_by_brute_force(texts):
    """The number of classes of texts whose five-word shingles are alike by 0.8 or more, whole texts where shorter."""
    shingles = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = shingles[a], shingles[b]
        if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y)):
            root[find(b)] = find(a)
    return len({find(k) for k in range(len(texts))})


def test_one_document_of_each_class_stays(spark, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    found = {(r.doc_id, r.text) for r in kept}
    assert len(found) == len(kept)
    assert not {100} & {k for k, _ in found} and sum(k == 9 for k, _ in found) == 1
    assert len(kept) == classes_by_brute_force([r[1] for r in rows()])


def test_last_stage_takes_odd_rows_and_empty_tables(spark, docs):
    _, stage = corpus_pipeline.STAGES[-1]
    got = stage(spark, docs, "")
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and got.count() == docs.count()
    assert stage(spark, docs.where("false"), "").count() == 0


def test_personal_data_goes(spark, docs):
    got = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, docs, "").collect()}
    assert got[104].text.endswith(" write to [EMAIL] or [PHONE] today") and got[104].n_chars == len(got[104].text)
    assert got[105].text is None and got[106].text == "" and got[1].text == rows()[1][1]


def test_run(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows()} and len(got) > 30
    assert all(len(r.ids) == 4 * r.n_tokens and np.frombuffer(r.ids, "<u4").max(initial=0) < 49408 for r in got)


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in found} and "pipeline" in found
    assert set(queries.ORACLE_SQL) <= set(found)
    assert importlib.import_module("corpus_pipeline").STAGES[0][0] == "quality"
