"""Language-model scoring with a hidden Markov model.

Words of the training documents are counted in every task and added up. The ``VOCABULARY`` most frequent ones are
symbols of their own (that bounds what is broadcast). All other words, known or not, are symbols by their ending: words
with one hash of their last ``ENDING`` bytes are a class, whose emissions are learnt by state from all of its words'
tokens, and each word brings its own exact share of its class, joined to it from the full table of counts, which grows
with the input. Each class has one unknown. So the model is a proper distribution over known words and the unknowns.

Training: the states start from groups of frequent words that stand in the same documents (co-occurrence counts over
all training documents of ``ANCHORS`` words; that is where the search begins, not what it learns from); then ``ROUNDS``
rounds of Baum-Welch, each a pass over all training documents whose expected counts (start, transition, and one row
for each symbol) are added up with a groupBy. Scoring runs the scaled forward recursion over every text; with the
scales' logarithms it is the exact likelihood of the sequence, whatever its length.

Defined results: a null or empty text is one end token; no training documents leave every word unknown,
of base probability 1; repeated rows count and are returned as often as they stand; ties in the vocabulary go by the
word's bytes; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, lean, materialize, small, utf8

STATES, VOCABULARY, ROUNDS, ANCHORS, CLASSES, ENDING = 8, 1 << 17, 2, 384, 1 << 15, 3
#: Bytes of packed symbols from which sequences of like length are picked.
GATHERED = 16 << 20
#: Share of the base distribution in each state's emissions; words a task counts before it hands them on; tokens
#: whose recursion is held in memory at once.
SMOOTHING, HELD_WORDS, GROUP = 0.01, 200_000, 250_000
#: The end token, as a word that no text can hold.
END = b"\n"


def _counted(batches):
    """(word, n) of whole texts, summed for each task."""
    held: Counter = Counter()

    def out():
        words = list(held)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
        held.clear()

    for batch in small(batches):
        texts = utf8(batch["_text"])
        held[END] += len(texts)
        for text in texts:
            held.update(text.lower().split())
            if len(held) > HELD_WORDS:
                yield from out()
    if held:
        yield from out()


def word_class(word: bytes) -> int:
    """The class of a word that is no symbol: XXH64 of its ending, as Spark's xxhash64 has it, modulo ``CLASSES``."""
    hashed = xxhash.xxh64_intdigest(word[-ENDING:], 42)
    return (hashed - (1 << 64) if hashed >> 63 else hashed) % CLASSES


class Lexicon:
    """Symbols: 1 for the end, then the frequent words, then the classes (0 is none); and their figures.

    ``plain``: a symbol's count plus one (0 for classes); ``mass``: its starting probability; ``total_of``: what a
    class's words have together, each its count plus one, with one unknown.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, distinct: int, ends: int, of_class: dict[int, int]):
        self.total, self.distinct = total, distinct
        self.words = {w: k + 2 for k, (w, _) in enumerate(frequent)}
        self.first_class = len(frequent) + 2
        self.plain = np.array([0, ends + 1, *[n + 1 for _, n in frequent], *[0] * CLASSES], np.float64)
        self.total_of = np.ones(CLASSES)
        for k, n in of_class.items():
            self.total_of[k] += n
        self.mass = self.plain.copy()
        self.mass[self.first_class :] = self.total_of
        self.mass /= self.mass.sum()
        self.known = (self.plain > 1).astype(np.int64)

    def size(self) -> float:
        return float(self.total + self.distinct + 1)


def lexicon(training: DataFrame, text_col: str, vocabulary: int) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and the stored table (word, n) of all training words without the end."""
    rows = training.select(F.col(text_col).cast("string").alias("_text"))
    counts = materialize(rows.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = (counts.where(F.col("word") == F.lit(bytearray(END))).first() or (None, 0))[1]
    words = counts.where(F.col("word") != F.lit(bytearray(END)))
    top = words.orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
    frequent = list(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    ending = F.expr(f"substring(word, -{ENDING}, {ENDING})")
    whole = F.when(F.length("word") <= ENDING, F.col("word")).otherwise(ending)
    sums = words.groupBy(F.pmod(F.xxhash64(whole), F.lit(CLASSES)).cast("int").alias("k")).agg(F.sum(F.col("n") + 1).alias("n")).toArrow()  # at most CLASSES rows
    of_class = dict(zip(sums["k"].to_pylist(), sums["n"].to_pylist(), strict=True))
    for word, n in frequent:
        of_class[word_class(word)] -= n + 1
    return Lexicon(frequent, total, distinct, ends, of_class), words


def encoded(docs: DataFrame, shared, keep: dict[str, Column], text_col: str) -> DataFrame:
    """A row for each text: the columns of ``keep``, a row number, its symbols (packed int32) and its rare words."""
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("_text"))
    kept_names = list(keep)

    def work(batches):
        words, first, class_of = shared.value.words, shared.value.first_class, {}

        def symbol(word: bytes) -> int:
            found = words.get(word)
            if found is None:
                ending = word[-ENDING:]
                found = class_of.get(ending)
                if found is None:
                    found = class_of[ending] = first + word_class(ending)
            return found

        number = TaskContext.get().partitionId() << 40
        for batch in small(batches):
            packed, rare, times, sizes = [], [], [], []
            for text in utf8(batch["_text"]):
                tokens = text.lower().split()
                symbols = [symbol(w) for w in tokens]
                own = Counter([w for w, s in zip(tokens, symbols, strict=True) if s >= first])
                rare.append(list(own))
                times.append(list(own.values()))
                symbols.append(1)
                packed.append(np.array(symbols, "<i4").tobytes())
                sizes.append(len(symbols))
            n = len(packed)
            yield pa.RecordBatch.from_arrays(
                [*[batch[k] for k in kept_names], pa.array(np.arange(number, number + n)), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                [*kept_names, "row", "n_tokens", "symbols", "rare", "times"],
            )
            number += n
            if len(class_of) > HELD_WORDS:
                class_of.clear()

    fields = [T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("symbols", T.BinaryType()), T.StructField("rare", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(work, T.StructType([*rows.drop("_text").schema.fields, *fields]))


class Layout:
    """Sequences side by side: longest first, tokens in order of position, so a step is one contiguous slice."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        lengths = np.array([len(sequences[k]) for k in self.order])
        flat = np.concatenate([sequences[k] for k in self.order])
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(flat)) - np.repeat(starts, lengths)
        by_place = np.argsort(place, kind="stable")
        self.symbols = flat[by_place]
        self.lane = np.repeat(np.arange(len(lengths)), lengths)[by_place]
        self.widths = np.bincount(place)
        self.at = np.concatenate(([0], np.cumsum(self.widths))).tolist()


def forward(layout: Layout, start, move, emit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward recursion: alpha, the scale of each token, and the emissions in the layout's order."""
    likely = emit[layout.symbols]
    alpha = np.empty_like(likely)
    scale = np.empty(len(likely), likely.dtype)
    at = layout.at
    before = None
    for t in range(len(at) - 1):
        a, b = at[t], at[t + 1]
        now = (start if before is None else before[: b - a] @ move) * likely[a:b]
        total = now.sum(axis=1)
        scale[a:b] = total
        now /= total[:, None]
        alpha[a:b] = now
        before = now
    return alpha, scale, likely


def expected(layout: Layout, start, move, emit):
    """Baum-Welch counts of the sequences: start, transitions, and gamma of each token in the layout's order."""
    alpha, scale, likely = forward(layout, start, move, emit)
    at = layout.at
    weight = likely / scale[:, None]
    gamma = np.empty_like(alpha)
    back = np.ones((0, alpha.shape[1]), alpha.dtype)
    moves = np.zeros(move.shape)
    flipped = move.T.copy()
    for t in range(len(at) - 2, -1, -1):
        a, b = at[t], at[t + 1]
        beta = np.ones((b - a, alpha.shape[1]), alpha.dtype)
        if len(back):
            later = back @ flipped
            beta[: len(back)] = later
            moves += alpha[a : a + len(back)].T @ back
        gamma[a:b] = alpha[a:b] * beta
        back = weight[a:b] * beta
    return gamma[: at[1]].sum(axis=0), moves * move, gamma


def _grouped(packed: list[bytes]):
    """Index lists of sequences of like length, each of about GROUP tokens (one sequence may be longer)."""
    order = sorted(range(len(packed)), key=lambda k: len(packed[k]))
    held, size = [], 0
    for k in order:
        if held and size + len(packed[k]) // 4 > GROUP:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(packed[k]) // 4
    if held:
        yield held


def _unpacked(packed: list[bytes], which: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(packed[k], "<i4") for k in which]


def _baum_welch(shared):
    """Task: (kind, at, one column a state): kind 0 emission of a symbol, 1 a row of transitions, 2 the start."""

    def work(batches):
        start, move, emit = shared.value
        states = len(start)
        emitted, moves, starts = np.zeros((len(emit), states)), np.zeros((states, states)), np.zeros(states)
        for batch in gathered(batches, "symbols", GATHERED):
            packed = batch["symbols"].to_pylist()
            for which in _grouped(packed):
                layout = Layout(_unpacked(packed, which))
                s, m, gamma = expected(layout, start, move, emit)
                starts += s
                moves += m
                for k in range(states):
                    emitted[:, k] += np.bincount(layout.symbols, weights=gamma[:, k], minlength=len(emit))
        seen = np.flatnonzero(emitted.any(axis=1))
        table = np.concatenate([emitted[seen], moves, starts[None]])
        kinds = np.repeat([0, 1, 2], [len(seen), states, 1])
        places = np.concatenate([seen, np.arange(states), [0]])
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(places.astype(np.int32)), *[pa.array(table[:, k].astype(np.float32)) for k in range(states)]], ["kind", "at", *[f"g{k}" for k in range(states)]])

    return work


def _companions(batches):
    """Task: how many documents hold both of two frequent symbols (a, b, n)."""
    total = np.zeros((ANCHORS, ANCHORS))
    for batch in small(batches):
        packed = batch["symbols"].to_pylist()
        for at in range(0, len(packed), 512):
            held = np.zeros((len(packed[at : at + 512]), ANCHORS), np.float32)
            for k, x in enumerate(packed[at : at + 512]):
                symbols = np.frombuffer(x, "<i4")
                held[k, symbols[(symbols >= 2) & (symbols < ANCHORS + 2)] - 2] = 1
            total += held.T @ held
    a, b = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["a", "b", "n"])


def first_states(together: np.ndarray, base: np.ndarray, states: int):
    """Starting parameters: frequent words grouped by the company they keep; each state prefers one group."""
    n = len(together)
    hold = np.sqrt(np.maximum(np.diag(together), 1e-9))
    rows = together / hold[:, None] / hold[None, :]
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    centers = [rows[0]] if n else []
    for _ in range(states - 1):
        if n:
            far = 1 - np.max(rows @ np.array(centers).T, axis=1)
            centers.append(rows[int(np.argmax(far * np.sqrt(np.maximum(np.diag(together), 0))))])
    group = np.zeros(n, int)
    for _ in range(25 if n else 0):
        group = np.argmax(rows @ np.array(centers).T, axis=1)
        centers = [rows[group == k].mean(axis=0) if (group == k).any() else centers[k] for k in range(states)]
    emit = np.repeat(base[:, None], states, axis=1)
    for k in range(states):
        emit[2 : n + 2][group != k, k] *= 0.1
        emit[n + 2 :, k] *= 1 + 0.02 * ((np.arange(len(base) - n - 2) + k) % states == 0)
    emit /= emit.sum(axis=0)
    move = np.full((states, states), 0.2 / max(1, states - 1))
    np.fill_diagonal(move, 0.8)
    if states == 1:
        move[:] = 1.0
    return np.full(states, 1.0 / states), move, emit


def train(rows: DataFrame, words: Lexicon, states: int = STATES, rounds: int = ROUNDS):
    """(start, move, emit) after ``rounds`` of Baum-Welch over all ``rows`` (with ``symbols``)."""
    spark = rows.sparkSession
    symbols = rows.select("symbols")
    n = min(ANCHORS, len(words.words))
    together = np.zeros((n, n))
    got = symbols.mapInArrow(_companions, "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    together[got["a"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
    base = words.mass
    start, move, emit = first_states(together, base, states)
    columns = [f"g{k}" for k in range(states)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)))
        schema = "kind int, at int, " + ", ".join(f"{c} float" for c in columns)
        counts = symbols.mapInArrow(_baum_welch(shared), schema).groupBy("kind", "at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        table = np.stack([counts[c].to_numpy() for c in columns], axis=1) if len(counts) else np.zeros((0, states))
        kind, at = counts["kind"].to_numpy(), counts["at"].to_numpy()
        emitted, moves = np.zeros_like(emit), np.full((states, states), 1e-3)
        emitted[at[kind == 0]] = table[kind == 0]
        moves[at[kind == 1]] += table[kind == 1]
        starts = table[kind == 2].sum(axis=0) + 1e-3
        share = emitted / np.maximum(emitted.sum(axis=0), 1e-9)
        emit = (1 - SMOOTHING) * np.where(emitted.sum(axis=0) > 0, share, base[:, None]) + SMOOTHING * base[:, None]
        start, move = starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True)
        shared.unpersist()
    return start, move, emit


def _scored(shared, names: list[str]):
    """Task: base and model log10 probabilities from the symbols alone; rare words come later."""

    def work(batches):
        words, (start, move, emit) = shared.value
        known = words.known
        base = np.zeros(len(words.plain))
        base[1 : words.first_class] = np.log10(words.plain[1 : words.first_class] / words.size())
        # what the classes in a text take from its words' shares
        share = np.zeros(len(base))
        share[words.first_class :] = np.log10(words.total_of)
        model = (start.astype(np.float64), move.astype(np.float64), emit.astype(np.float64))
        for batch in gathered(batches, "symbols", GATHERED):
            packed = batch["symbols"].to_pylist()
            plain, scores, n_known = np.zeros(len(packed)), np.zeros(len(packed)), np.zeros(len(packed), np.int64)
            for which in _grouped(packed):
                layout = Layout(_unpacked(packed, which))
                _, scale, _ = forward(layout, *model)
                lanes = len(which)
                at = np.array(which)[layout.order]
                scores[at] = np.bincount(layout.lane, weights=np.log10(scale) - share[layout.symbols], minlength=lanes)
                plain[at] = np.bincount(layout.lane, weights=base[layout.symbols], minlength=lanes)
                n_known[at] = np.bincount(layout.lane, weights=known[layout.symbols], minlength=lanes).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in names], pa.array(plain), pa.array(scores), pa.array(n_known)], [*names, "plain", "likelihood", "n_frequent"])

    return work


def score(docs: DataFrame, training: Column, keep: dict[str, Column], text_col: str = "text", states: int = STATES, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """The columns of ``keep``, n_tokens, n_known, train_tokens, base_score and score; learns from rows where ``training`` holds."""
    spark = docs.sparkSession
    given, keep = keep, {f"own_{k}": c for k, c in enumerate(keep.values())}
    words, counts = lexicon(lean(docs).where(training), text_col, vocabulary)
    shared_words = spark.sparkContext.broadcast(words)
    texts = materialize(encoded(docs, shared_words, keep | {"_training": training}, text_col), "symbols")
    model = train(texts.where("_training"), words, states, rounds)
    shared = spark.sparkContext.broadcast((words, model))
    names = [*keep, "row", "n_tokens"]
    own = texts.select(*names, "symbols")
    fields = [*own.drop("symbols").schema.fields, T.StructField("plain", T.DoubleType()), T.StructField("likelihood", T.DoubleType()), T.StructField("n_frequent", T.LongType())]
    scored = own.mapInArrow(_scored(shared, names), T.StructType(fields))
    size = words.size()
    if words.distinct - (len(words.words) + 1) > 0:
        # the rest exactly: each rare word with its own count
        rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), "r.times").join(counts.where(F.col("word").isNotNull()), "word", "left")
        own_log = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(size))
        extra = rare.groupBy("row").agg(F.sum(own_log * F.col("times")).alias("rare_base"), F.sum("times").alias("n_rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    else:  # no known word is rare: all of them are the unknown
        rare = texts.select("row", F.aggregate("times", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_rare"))
        extra = rare.where("n_rare > 0").select("row", (F.col("n_rare") * float(np.log10(1 / size))).alias("rare_base"), "n_rare", F.lit(0).cast("long").alias("rare_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # a rare word's own share: its count plus one of what its class has together, which is in the likelihood already
    share = zero("rare_base") + zero("n_rare") * F.lit(float(np.log10(size)))
    return scored.join(extra, "row", "left").select(
        *[F.col(own).alias(c) for own, c in zip(keep, given, strict=True)], "n_tokens", (F.col("n_frequent") + zero("rare_known")).cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("plain") + zero("rare_base")).alias("base_score"), (F.col("likelihood") + share).alias("score"),
    )
