"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) in every task over whole texts and adds them up with a groupBy; the resulting
log-probability matrix has at most ``max_langs`` x 2**``BITS`` floats, which bounds what is collected and broadcast
(more languages than that are an error, never dropped). Scoring counts the buckets of each text of a batch and takes one
sparse product with the matrix.

Defined results: a null text, or one without a letter, is ``und`` with score 0; when nothing was learned every text
is ``und``; a training row with a null language teaches nothing; ties go to the first language by code point;
repeated rows count and are returned as often as they stand; other columns are ignored; an empty table teaches nothing
and gives no rows; a text of any length is hashed in pieces of ``PIECE`` characters and held as 2**``BITS`` counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small

BITS, ORDERS = 16, (1, 2, 3)
#: Characters hashed at a time, so that a very long text needs little memory.
PIECE = 1 << 20
#: Matrix values that a batch multiplies at a time.
ENTRIES = 1 << 21
_LETTER = regex.compile(r"\p{L}")


def grams(text: str):
    """Arrays of bucket numbers, one or more for each order; n-grams run over the lower-cased text between spaces."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for at in range(0, len(codes), PIECE):
        hashed = np.zeros(0, np.uint64)
        for order in range(1, max(ORDERS) + 1):
            tail = codes[at + order - 1 : min(len(codes), at + PIECE + order - 1)]
            hashed = (hashed[: len(tail)] if order > 1 else np.zeros(len(tail), np.uint64) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) + tail * np.uint64(0xC2B2AE3D27D4EB4F)
            if order in ORDERS and len(hashed):
                mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (mixed >> np.uint64(64 - BITS)).astype(np.intp)


def _count(batches):
    sums: dict[str, np.ndarray] = {}

    def out():
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])
        sums.clear()

    for batch in small(batches):
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            total = sums.setdefault(lang.as_py(), np.zeros(1 << BITS, np.int64))
            for part in grams(text.as_py()):
                np.add.at(total, part, 1)
        if len(sums) > 64:
            yield from out()
    yield from out()


def train(docs: DataFrame, max_langs: int = 512, smoothing: float = 0.5, text_col: str = "text", lang_col: str = "lang"):
    """(languages, float32 matrix buckets x languages, log priors) from the rows with a text and a language."""
    rows = lean(docs).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    prior = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(prior) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs if a matrix of that size may be broadcast")
    langs = sorted(prior)
    matrix = np.full((1 << BITS, len(langs)), smoothing, np.float64)
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    where = {lang: k for k, lang in enumerate(langs)}
    columns = np.array([where[x] for x in got["lang"].to_pylist()], np.intp)
    matrix[got["bucket"].to_numpy(), columns] += got["n"].to_numpy()
    logs = np.log(matrix) - np.log(matrix.sum(axis=0))
    total = sum(prior.values())
    return langs, logs.astype(np.float32), np.log([prior[x] / total for x in langs]) if langs else np.zeros(0)


def scored(texts: list[str], logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """texts x languages: the log joint probabilities of a batch, one product of its sparse counts and the matrix.

    A text is its buckets and how often they occur, 2**``BITS`` at most; entries are multiplied ``ENTRIES`` values at a time.
    """
    sums = np.tile(prior.astype(np.float64), (len(texts), 1))
    rows, buckets, counts, held = [], [], [], 0

    def add() -> None:
        nonlocal held
        row, bucket, n = (np.concatenate(x) for x in (rows, buckets, counts))
        step = max(1, ENTRIES // logs.shape[1])
        for at in range(0, len(row), step):
            part = logs[bucket[at : at + step]] * n[at : at + step, None]
            np.add.at(sums, row[at : at + step][starts := np.flatnonzero(np.diff(row[at : at + step], prepend=-1))], np.add.reduceat(part, starts, axis=0))
        for x in (rows, buckets, counts):
            x.clear()
        held = 0

    for k, text in enumerate(texts):
        total = np.zeros(1 << BITS, np.int64) if len(text) > PIECE else None
        parts = []
        for part in grams(text):
            if total is None:
                parts.append(part)
            else:
                total += np.bincount(part, minlength=1 << BITS)
        bucket, n = np.unique(np.concatenate(parts), return_counts=True) if total is None else (at := np.flatnonzero(total), total[at])
        rows.append(np.full(len(bucket), k, np.intp))
        buckets.append(bucket)
        counts.append(n.astype(np.float64))
        held += len(bucket)
        if held > ENTRIES:
            add()
    if rows:
        add()
    return sums


def predict(docs: DataFrame, model, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``keep``, then lang_pred and score (the posterior of the language)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = keep or {}
    kept_names = list(keep)
    rows = lean(docs).select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("_text"))
    kept = rows.drop("_text")

    def score(batches):
        langs, logs, prior = shared.value
        for batch in small(batches):
            texts = [value.as_py() for value in batch["_text"]]
            known = np.array([bool(langs and text is not None and _LETTER.search(text)) for text in texts], bool)
            sums = scored([t for t, k in zip(texts, known, strict=True) if k], logs, prior)
            best, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            if len(sums):
                odds = np.exp(sums - sums.max(axis=1, keepdims=True))
                best[known] = np.array(langs, object)[sums.argmax(axis=1)]
                scores[known] = odds.max(axis=1) / odds.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in kept_names], pa.array(best, pa.string()), pa.array(scores, pa.float64())], [*kept_names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(score, schema)
