"""Quality rules: robust multivariate outliers among documents of one language and source.

Every text becomes a short vector of transformed statistics. For each language, and for each language and source, the
minimum covariance determinant is searched for as in the deterministic form of the method: three starts (mean and
covariance of all rows, median and median deviation, covariance of the signs about the median), concentration steps
with the half of the rows (``SUPPORT``) that lie nearest, after ``TRIALS`` steps the start with the least determinant,
and more steps until the determinant falls no further. The bulk is then estimated once more from the rows within the
``WITHIN`` quantile, and a document is rejected if its squared Mahalanobis distance is above the ``CUT`` quantile of
the chi-square distribution with as many degrees as there are statistics.

A step is one groupBy of (group, start, distance bin) to counts and moments, so a group of any size is added up in every
task; the bins of a group (at most ``BINS``) meet in one row set, and of the bin in which the half ends the missing
share is taken. A source's estimate is pulled towards its language's with the weight of ``PRIOR_ROWS`` rows, so tiny
groups need no rule of their own. A share of few words is known no better than chance allows: every covariance has the
variance of that chance (``DRAWS``) added, so a statistic that never varies in the bulk does not turn the smallest
deviation into an outlier.

Defined results: a null or empty text has no words, so it fails the base rule; null language or source is a group of
its own; documents that fail the base rule teach the estimates nothing; rows at one distance get one verdict;
repeated rows count and are returned as often as they stand; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, small, unveiled, utf8, veiled

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: The statistics, and how many words, characters or lines each share takes in addition (so that few tell little).
#: By chance asin(sqrt(share)) of n draws has the variance 1 / (4 n): with DRAWS of them a text counts as known.
FEATURES = {"symbols": 20, "marks": 100, "upper": 100, "digits": 200, "duplicates": 10, "repeats": 50, "word_length": 30}
DRAWS, SUPPORT, WITHIN, CUT = 40, 0.5, 0.975, 1 - 1e-6
PRIOR_ROWS, TRIALS, MOST_STEPS, SETTLED, BINS = 30.0, 2, 20, 1e-3, 2048
STARTS = ("mean", "median", "signs")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of five words which is found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words)) + np.uint64(1)
    hashed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        part = ids[k : k + n] * _MIX[k]
        hashed ^= (part ^ (part >> np.uint64(31))) * _MIX[(k + 2) % WINDOW]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    first: dict[tuple, int] = {}
    starts = np.zeros(n, bool)
    for at in np.flatnonzero(maybe).tolist():  # exact: windows themselves are compared
        seen = first.setdefault(tuple(words[at : at + WINDOW]), at)
        if seen != at:
            starts[seen] = starts[at] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts of the base rules, and the transformed vector."""
    words = text.split()
    n = len(words)
    cells = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    code_points = len(text) - int(cells[0x80:0xC0].sum())
    chars = code_points - int(cells[list(SPACES)].sum())
    symbols = int(cells[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x.split()]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper, digits = int(cells[65:91].sum()), int(cells[48:58].sum())
    letters = int(cells[65:91].sum() + cells[97:123].sum())
    marks = int(cells[33:48].sum() + cells[58:65].sum() + cells[91:97].sum() + cells[123:127].sum()) - symbols
    share = lambda k, of, some: math.asin(math.sqrt(min(1.0, k / (of + some))))
    return [n, chars, symbols, duplicates, repeats], [
        *[share(k, of, FEATURES[name]) for name, k, of in (("symbols", symbols, n), ("marks", marks, chars), ("upper", upper, letters), ("digits", digits, chars), ("duplicates", duplicates, len(lines)), ("repeats", repeats, n))],
        math.log((chars + 5 * FEATURES["word_length"]) / (n + FEATURES["word_length"])),
    ]


def measure(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, the base counts, base_failed, and the statistics as columns of doubles."""
    rows = lean(docs).select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("_text"))
    kept_names = list(keep)

    def work(batches):
        for batch in small(batches):
            got = [statistics(x) for x in utf8(batch["_text"])]
            counts = list(zip(*[x[0] for x in got], strict=True)) or [()] * len(_COUNTS)
            values = list(zip(*[x[1] for x in got], strict=True)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in kept_names], *[pa.array(x, pa.int64()) for x in counts], *[pa.array(x, pa.float64()) for x in values]], [*kept_names, *_COUNTS, *FEATURES])

    fields = [*[T.StructField(k, T.LongType()) for k in _COUNTS], *[T.StructField(k, T.DoubleType()) for k in FEATURES]]
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return rows.mapInArrow(work, T.StructType([*rows.drop("_text").schema.fields, *fields])).withColumn("base_failed", failed)


_NAMES = list(FEATURES)
_P = len(_NAMES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_CHANCE = np.full(_P, 0.25 / DRAWS)
_FIT = "_key string, start string, n double, center array<double>, covariance array<double>, inverse array<double>, determinant double"


def chi_square(x: float, degrees: int) -> float:
    """P(chi-square with ``degrees`` <= x), by the series of the incomplete gamma function."""
    a, z = degrees / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def quantile(share: float, degrees: int) -> float:
    """Where the distribution function reaches ``share``."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < share:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return high


def widening(share: float, degrees: int = _P) -> float:
    """What the covariance of the nearest ``share`` of Gaussian rows is to be multiplied by."""
    return share / chi_square(quantile(share, degrees), degrees + 2) if share < 1 else 1.0


def _distance(columns: list[Column]) -> Column:
    """Squared Mahalanobis distance from ``center`` by ``inverse`` (the upper triangle, off-diagonal terms doubled)."""
    off = [x - F.col("center")[k] for k, x in enumerate(columns)]
    return sum((off[i] * off[j] * F.col("inverse")[k] for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _full(flat) -> np.ndarray:
    full = np.zeros((_P, _P))
    for k, (i, j) in enumerate(_PAIRS):
        full[i, j] = full[j, i] = flat[k]
    return full


def _fitted(key: str, start: str, n: float, mean: np.ndarray, covariance: np.ndarray) -> tuple:
    """A row of ``_FIT``; the variance of chance is added here."""
    whole = covariance + np.diag(_CHANCE)
    inverse = np.linalg.inv(whole)
    return (key, start, float(n), [float(x) for x in mean], [float(covariance[i, j]) for i, j in _PAIRS], [float(inverse[i, j] * (1 if i == j else 2)) for i, j in _PAIRS], float(np.linalg.slogdet(whole)[1]))


def _moments(n: float, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = sums / max(n, 1e-9)
    return mean, _full(squares / max(n, 1e-9)) - np.outer(mean, mean)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["_key", "start", "n", "center", "covariance", "inverse", "determinant"])


def _sums(values: list[Column], prefix: str = "") -> list[Column]:
    return [F.sum(x).alias(f"{prefix}s{k}") for k, x in enumerate(values)] + [F.sum(values[i] * values[j]).alias(f"{prefix}q{k}") for k, (i, j) in enumerate(_PAIRS)]


_SUMS, _SQUARES = [f"s{k}" for k in range(_P)], [f"q{k}" for k in range(len(_PAIRS))]


def _starts(rows: DataFrame) -> DataFrame:
    """The starting estimates of every key: a row for each of ``STARTS``."""
    middle = materialize(rows.groupBy("_key").agg(F.array(*[F.percentile_approx(x, 0.5, 1000) for x in _NAMES]).alias("middle")), "mcd-median")
    off = [F.col(x) - F.col("middle")[k] for k, x in enumerate(_NAMES)]
    size = F.sqrt(sum((x * x / float(_CHANCE[k]) for k, x in enumerate(off)), F.lit(1e-12)))
    spread = rows.join(middle, "_key").groupBy("_key").agg(
        F.first("middle").alias("middle"), F.count("*").alias("n"), *_sums([F.col(x) for x in _NAMES]),
        *[F.percentile_approx(F.abs(x), 0.5, 1000).alias(f"m{k}") for k, x in enumerate(off)], *_sums([x / size for x in off], "u"),
    )

    def work(batches):
        for got in batches:
            out = []
            for row in got.to_dict("records"):
                n, middle = float(row["n"]), np.array(row["middle"], float)
                mean, covariance = _moments(n, np.array([row[c] for c in _SUMS]), np.array([row[c] for c in _SQUARES]))
                out.append(_fitted(row["_key"], "mean", n, mean, covariance))
                out.append(_fitted(row["_key"], "median", n, middle, np.diag([(1.4826 * row[f"m{k}"]) ** 2 for k in range(_P)])))
                out.append(_fitted(row["_key"], "signs", n, middle, _P * _full([row[f"u{c}"] for c in _SQUARES]) / n))
            yield _frame(out)

    return spread.mapInPandas(work, _FIT)


def _concentrated(bins: pd.DataFrame) -> pd.DataFrame:
    """The distance bins of one key and start to its next estimate: the nearest h rows, of the last bin a share."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy(float)
    half = min(n.sum(), math.ceil(SUPPORT * (n.sum() + _P + 1)))
    share = np.clip((half - (np.cumsum(n) - n)) / n, 0, 1)
    weigh = lambda columns: (bins[columns].to_numpy(float) * share[:, None]).sum(axis=0)
    mean, covariance = _moments(half, weigh(_SUMS), weigh(_SQUARES))
    return _frame([_fitted(bins["_key"].iloc[0], bins["start"].iloc[0], n.sum(), mean, covariance * widening(half / n.sum()))])


def _step(rows: DataFrame, last: DataFrame) -> DataFrame:
    """One concentration step over ``rows`` (_key and statistics) from the estimates ``last``."""
    values = [F.col(x) for x in _NAMES]
    place = F.floor(F.log2(F.greatest(_distance(values), F.lit(1e-12))) * 16 + 640)
    near = rows.join(last.select("_key", "start", "center", "inverse"), "_key").withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).cast("int"))
    return near.groupBy("_key", "start", "bin").agg(F.count("*").alias("n"), *_sums(values)).groupBy("_key", "start").applyInPandas(_concentrated, _FIT)


def minimum_determinant(rows: DataFrame) -> DataFrame:
    """The estimates of least determinant (a row of ``_FIT`` a key), for ``rows`` (_key and statistics)."""
    found = materialize(_starts(rows), "mcd")
    for _ in range(TRIALS):
        found = materialize(_step(rows, found), "mcd")
    best = found.groupBy("_key").agg(F.min_by(F.struct(*[c for c in found.columns if c != "_key"]), F.struct("determinant", "start")).alias("b"))
    found = materialize(best.select("_key", "b.*"), "mcd")
    for _ in range(MOST_STEPS):
        after = materialize(_step(rows, found), "mcd")
        fall = after.alias("a").join(found.alias("b"), "_key").agg(F.max(F.col("b.determinant") - F.col("a.determinant"))).first()[0]
        found = after
        if fall is None or fall < SETTLED:
            break
    return found


def _reweighted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Mean and covariance of the rows within the ``WITHIN`` quantile of ``found``."""
    values = [F.col(x) for x in _NAMES]
    near = rows.join(found.select("_key", "center", "inverse"), "_key").where(_distance(values) <= quantile(WITHIN, _P))
    factor = widening(WITHIN)

    def work(batches):
        for got in batches:
            yield _frame([_fitted(row["_key"], "", row["n"], *(lambda m, c: (m, c * factor))(*_moments(row["n"], np.array([row[c] for c in _SUMS]), np.array([row[c] for c in _SQUARES])))) for row in got.to_dict("records")])

    return near.groupBy("_key").agg(F.count("*").alias("n"), *_sums(values)).mapInPandas(work, _FIT)


def _text(name: str) -> Column:
    """A key without nulls: value with a mark before it, or the mark of null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("~"))


def _group(lang_col: str, source_col: str) -> Column:
    return F.concat_ws("\x1f", _text(lang_col), _text(source_col))


def fit(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The estimates (_group, center, inverse) of the groups of ``measured``, a stored table.

    They come from rows that passed the base rule. The estimates of each step are written out and joined by key: so
    Spark knows their size and broadcasts them, rather than shuffle rows by language, while they are below its threshold.
    """
    lang, group = F.concat(F.lit("L"), _text(lang_col)), F.concat(F.lit("G"), _group(lang_col, source_col))
    good = measured.where(~F.col("base_failed")).select(lang.alias("_lang"), group.alias("_group"), *_NAMES)
    rows = good.select(F.explode(F.array("_lang", "_group")).alias("_key"), *_NAMES)
    bulk = materialize(_reweighted(rows, minimum_determinant(rows)), "mcd-bulk")
    pairs = good.select("_lang", "_group").distinct()
    own, whole = bulk.select(F.col("_key").alias("_group"), "n", "center", "covariance"), bulk.select(F.col("_key").alias("_lang"), F.col("center").alias("center0"), F.col("covariance").alias("covariance0"))

    def work(batches):
        for got in batches:
            out = []
            for row in got.to_dict("records"):
                n = row["n"] if row["n"] == row["n"] and row["center"] is not None else 0.0
                mix = lambda a, b, n=n: np.array(b, float) if not n else (n * np.array(a, float) + PRIOR_ROWS * np.array(b, float)) / (n + PRIOR_ROWS)
                out.append((row["_group"][1:], *_fitted("", "", n, mix(row["center"], row["center0"]), _full(mix(row["covariance"], row["covariance0"])))[3:6:2]))
            yield pd.DataFrame(out, columns=["_group", "center", "inverse"])

    mixed = pairs.join(own, "_group", "left").join(whole, "_lang").mapInPandas(work, "_group string, center array<double>, inverse array<double>")
    return materialize(mixed, "mcd-group")


def verdict(measured: DataFrame, estimates: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``measured`` with ``distance`` double and ``kept`` boolean.

    A group whose rows all failed the base rule has no estimate; its rows are rejected anyway.
    """
    joined = measured.withColumn("_group", _group(lang_col, source_col)).join(estimates, "_group", "left")
    judged = joined.withColumn("distance", _distance([F.col(x) for x in FEATURES]))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= quantile(CUT, _P), F.lit(True))).drop("_group", "center", "inverse")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, counts, base_failed, statistics, distance, kept) for every document."""
    keep = {id_col: F.col(id_col), lang_col: F.col(lang_col), source_col: F.col(source_col)}
    measured = materialize(measure(docs, keep, text_col), "quality")
    return verdict(measured, fit(measured, lang_col, source_col), lang_col, source_col)


def good_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that are kept, with their columns. Texts are measured twice rather than shuffled."""
    estimates = fit(materialize(measure(docs, {lang_col: F.col(lang_col), source_col: F.col(source_col)}, text_col), "quality"), lang_col, source_col)
    lang, source = (f"own_{docs.columns.index(c)}" for c in (lang_col, source_col))
    return unveiled(verdict(measure(docs, veiled(docs), text_col), estimates, lang, source).where("kept"), docs)
