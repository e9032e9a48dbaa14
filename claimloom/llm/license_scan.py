"""Licence notices in texts, by a positional index of rare words.

Every notice's words are posted with their positions. In one pass the licence words' document frequencies over the
whole corpus are counted, which makes their IDF. In a second one each file's licence words are looked up, for every
notice the ``RARE`` with the highest IDF that the file holds; an occurrence at word i of a word that the notice has at q
votes for a copy that starts at i - q. Votes within ``SLACK`` words of each other are one copy (words put in or left
out shift its later ones). A copy counts if it covers ``COVER`` of the notice's IDF and holds all of the notice's
mandatory phrases, word for word. Base phrases are found wherever they stand, whatever the index says.

Defined results: a null or empty text has no words, no labels and score 0; first_word and last_word are null without a
base phrase; score is the largest share of a notice's IDF among the copies found, 1 with a base phrase; a notice that
stands many times counts once; of equal IDF the smaller word is looked up first; repeated rows are scanned, and count,
each; an empty table gives no row; clashing column names stay with the caller's ``keep``.

Scale: no shuffle of texts. What is counted and broadcast are the notices' few hundred words. A text goes through in
pieces of 64 KB that overlap by more than the longest notice, so its length does not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, released, small, utf8
from .license_texts import NOTICES, PHRASES

RARE, SLACK, COVER, PIECE = 8, 6, 0.7, 1 << 16
#: Bytes of words stay, A-Z lowered; all others are spaces.
_WORDS = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Index:
    """The notices' postings, and for each notice its words by falling IDF."""

    def __init__(self, notices: Sequence[tuple], phrases: Mapping[str, str], n_docs: int, found: Mapping[bytes, int]):
        self.notices = [(label, words(text.encode()), [words(p.encode()) for p in must]) for label, text, must in notices]
        self.phrases = [(words(p.encode()), label) for p, label in phrases.items()]
        self.vocabulary = frozenset(w for _, text, _ in self.notices for w in text)
        self.idf = {w: math.log((n_docs + 1) / (found.get(w, 0) + 1)) + 1e-9 for w in self.vocabulary}
        self.postings = [{w: [q for q, x in enumerate(text) if x == w] for w in text} for _, text, _ in self.notices]
        self.rarest = [sorted(p, key=lambda w: (-self.idf[w], w)) for p in self.postings]
        self.whole = [sum(self.idf[w] for w in sorted(p)) for p in self.postings]
        self.overlap = max([len(text) for _, text, _ in self.notices] + [len(p) for p, _ in self.phrases], default=1) + 2 * SLACK


def _holds(piece: list[bytes], phrase: list[bytes], at: int, end: int) -> bool:
    return any(piece[i : i + len(phrase)] == phrase for i in range(max(0, at), min(end, len(piece)) - len(phrase) + 1) if piece[i] == phrase[0])


def copies(index: Index, piece: list[bytes]) -> Iterator[tuple[str, float]]:
    """(label, share of the IDF) of each notice with a copy in ``piece``."""
    where: dict[bytes, list[int]] = {}
    for i, w in enumerate(piece):
        if w in index.vocabulary:
            where.setdefault(w, []).append(i)
    for (label, text, must), postings, rarest, whole in zip(index.notices, index.postings, index.rarest, index.whole, strict=True):
        present = [w for w in rarest if w in where]
        if sum(index.idf[w] for w in present) < COVER * whole:  # no copy in it can cover enough
            continue
        votes = sorted({i - q for w in present[:RARE] for i in where[w] for q in postings[w]})
        best, at = 0.0, 0
        while at < len(votes):
            last = at
            while last + 1 < len(votes) and votes[last + 1] - votes[at] <= SLACK:
                last += 1
            low, high = votes[at] - SLACK, votes[at] + len(text) + 2 * SLACK
            covered = sum(index.idf[w] for w in present if any(low <= i < high for i in where[w]))
            if covered >= COVER * whole and covered / whole > best and all(_holds(piece, p, low, high) for p in must):
                best = covered / whole
            at = last + 1
        if best:
            yield label, min(1.0, best)


def pieces(text: bytes, overlap: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(number of the first word, words that are this piece's own, words) over a whole text."""
    flat = text.translate(_WORDS)
    start, held, at = 0, [], 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        held += flat[at:end].split()
        at = end
        own = len(held) if at >= len(flat) else max(0, len(held) - overlap)
        yield start, own, held
        start, held = start + own, held[own:]


def scan(index: Index, text: bytes) -> tuple:
    """One text's row of ``FOUND``."""
    n, places, base, found = 0, [], set(), {}
    for start, own, piece in pieces(text, index.overlap):
        n = start + len(piece)
        joined = None
        for phrase, label in index.phrases:
            if joined is None:
                joined = b" " + b" ".join(piece) + b" "
            needle, at, i = b" " + b" ".join(phrase) + b" ", -1, 0
            while (hit := joined.find(needle, at + 1)) >= 0:
                i += joined.count(b" ", max(at, 0), hit)
                at = hit
                if i >= own:
                    break
                places.append(start + i)
                base.add(label)
        for label, share in copies(index, piece):
            found[label] = max(share, found.get(label, 0.0))
    score = 1.0 if base else max(found.values(), default=0.0)
    return n, len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | set(found)), score


def frequencies(docs: DataFrame, vocabulary, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """(rows, documents that hold each of ``vocabulary``) over the whole table."""

    def local(batches):
        held: Counter = Counter()
        for batch in small(batches, 200):
            for text in utf8(batch["_text"]):
                held[b""] += 1
                flat, seen, at = text.translate(_WORDS), set(), 0
                while at < len(flat):
                    end = flat.find(b" ", at + PIECE)
                    end = len(flat) if end < 0 else end
                    seen |= vocabulary.intersection(flat[at:end].split())
                    at = end
                held.update(seen)
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in held], "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = lean(docs).select(F.col(text_col).cast("string").alias("_text")).mapInArrow(local, "word string, n long")
    found = {r["word"].encode(): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the notices' words at most
    return found.pop(b"", 0), found


def find(docs: DataFrame, keep: dict[str, Column], text_col: str = "text", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """The columns of ``keep``, then those of ``FOUND``, for every row."""
    spark = docs.sparkSession
    blank = Index(notices, phrases, 0, {})
    shared = spark.sparkContext.broadcast(Index(notices, phrases, *frequencies(docs, blank.vocabulary, text_col)))
    rows = lean(docs).select(*[c.alias(f"_keep_{k}") for k, c in enumerate(keep.values())], F.col(text_col).cast("string").alias("_text"))
    fields = T._parse_datatype_string(FOUND).fields
    schema = T.StructType([*rows.drop("_text").schema.fields, *fields])
    names = schema.fieldNames()
    n_kept, kinds = len(keep), [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]

    def local(batches):
        index = shared.value
        for batch in small(batches, 200):
            found = [scan(index, text) for text in utf8(batch["_text"])]
            made = [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *made], names)
        released()

    got = rows.mapInArrow(local, schema)
    return got.select(*[F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)], *[f.name for f in fields])
