"""How far each source's words stand from those of the others of its language: sketch-prefiltered exact counts.

Document frequencies of (language, term) go into a count-min sketch in every task; the tasks' sketches are merged block
by block. Its estimates are never too low, so a term below ``LEAST`` documents by the sketch is below it in truth, and
is left out before anything is shuffled by term. What survives is counted exactly and held to ``LEAST`` again.

With count n of a term in a group, N their sum and V the language's number of terms, p = 1 + floor(10**9 * (n + 1) /
(N + V)). A pair of sources differs by floor((p - q)**2 / q) summed over all V terms. The sum is made from the pairs'
shared terms alone: all terms as if absent from both, plus what each source's own terms change (a group's terms with
equal n change alike, so each distinct n counts once), plus what shared ones change on top (a join on the term).

Defined results: null text, language or source is empty; a group without terms, or with an empty text only, has its
pairs; a language of one source has no pair; with V = 0 all values are 0; ties go to the smaller item by UTF-8;
repeated rows are documents of their own; an empty table gives no row; other columns are ignored; texts of any length
are cut whole, one at a time.

Scale: rows shuffled are a task's distinct (language, source, term), added up before. The sketch is sized by the rows
(``cells``) and is 64 MB at most; beyond that it lets more terms pass, never less. The report's pairs of sources are
its output. Sums stay in a long below 2 * 10**9 terms a language; p is worked out in decimals where a count needs them.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, released, small, utf8

#: Documents of a language that a term must be in, and sketch rows.
LEAST, ROWS = 3, 4
#: Bytes of a block of cells, and (group, term) counts that a task holds at once.
BLOCK, HELD = 1 << 16, 1_000_000
#: Every byte that is no letter or part of a character beyond ASCII as a space, A-Z lowered.
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def cells(n_rows: int) -> int:
    """Cells of a sketch row: a power of two, 8 a document, 2**16 to 2**24."""
    return 1 << min(24, max(16, (8 * n_rows).bit_length()))


def _places(lang: bytes, terms: list[bytes], width: int) -> np.ndarray:
    """ROWS x terms cell numbers."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(lang + b"\0" + t) for t in terms), np.uint64, len(terms))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(r) * high) & np.uint64(width - 1) for r in range(ROWS)]).astype(np.intp)


def _grouped(batches, *names):
    """(values of ``names``, terms) of each row."""
    for batch in small(batches, 200):
        for *group, text in zip(*[utf8(batch[c]) for c in names], utf8(batch["_text"]), strict=True):
            yield tuple(group), text.translate(_LETTERS).split()


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """ROWS x ``width`` counts of documents, held at ``LEAST``: the merged sketch."""

    def local(batches):
        table, held = np.zeros((ROWS, width), np.uint16), {}

        def add():
            for lang, counts in held.items():
                n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), LEAST).astype(np.uint16)
                for row, at in zip(table, _places(lang, list(counts), width), strict=True):
                    np.add.at(row, at, n)
            np.minimum(table, LEAST, out=table)
            held.clear()

        rows = 0
        for (lang,), terms in _grouped(batches, "_lang"):
            held.setdefault(lang, Counter()).update(set(terms))
            rows += 1
            if rows % 64 == 0 and sum(map(len, held.values())) > HELD:
                add()
        add()
        flat = table.astype(np.uint8).reshape(-1, min(BLOCK, width))
        full = np.flatnonzero(flat.any(axis=1))
        for block in full:
            yield pa.RecordBatch.from_pydict({"block": [int(block)], "cells": [flat[block].tobytes()]}, pa.schema([("block", pa.int32()), ("cells", pa.binary())]))

    def merged(batches):
        block, total = None, None

        def out():
            return pa.RecordBatch.from_pydict({"block": [block], "cells": [total.tobytes()]}, pa.schema([("block", pa.int32()), ("cells", pa.binary())]))

        for batch in batches:
            for b, cells_ in zip(batch["block"].to_pylist(), batch["cells"], strict=True):
                got = np.frombuffer(cells_.as_buffer(), np.uint8)
                if b != block:
                    if block is not None:
                        yield out()
                    block, total = b, np.zeros(len(got), np.uint8)
                total = np.minimum(total + got, LEAST).astype(np.uint8)
        if block is not None:
            yield out()

    parts = docs.select("_lang", "_text").mapInArrow(local, "block int, cells binary")
    whole = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block int, cells binary")
    table = np.zeros((ROWS * width // min(BLOCK, width), min(BLOCK, width)), np.uint8)
    for row in whole.toLocalIterator():  # ROWS * width bytes in all
        table[row["block"]] = np.frombuffer(row["cells"], np.uint8)
    return table.reshape(ROWS, width)


def term_counts(docs: DataFrame, width: int | None = None) -> DataFrame:
    """(lang, source, term, n, lang_n, lead): exact occurrences of the terms in at least ``LEAST`` documents of a language.

    lang_n is the language's; lead is 1 on one row of each (lang, term), else 0.
    """
    spark = docs.sparkSession
    width = width or cells(docs.count())
    rows = lean(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in (("lang", "_lang"), ("source", "_source"), ("text", "_text"))])
    shared = spark.sparkContext.broadcast(sketch(rows, width))

    def local(batches):
        found: dict[tuple, Counter] = {}
        in_docs: dict[bytes, Counter] = {}

        def out():  # a term's documents go with the first of its sources, since they are summed over all of them
            table, possible = shared.value, {}
            for lang, counts in in_docs.items():
                terms = list(counts)
                least = np.min([row[at] for row, at in zip(table, _places(lang, terms, width), strict=True)], axis=0) if terms else np.zeros(0)
                possible[lang] = set(itertools.compress(terms, (least >= LEAST).tolist()))
            for (lang, source), counts in found.items():
                kept, docs_of = list(filter(possible[lang].__contains__, counts)), in_docs[lang]
                for at in range(0, len(kept), 20_000):
                    part = kept[at : at + 20_000]
                    group = [pa.repeat(pa.scalar(x.decode()), len(part)) for x in (lang, source)]
                    n = np.fromiter(map(counts.__getitem__, part), np.int64, len(part))
                    in_part = np.fromiter((docs_of.pop(t, 0) for t in part), np.int64, len(part))
                    yield pa.RecordBatch.from_arrays([*group, pa.array(part, pa.string()), pa.array(n), pa.array(in_part)], ["lang", "source", "term", "n", "docs"])
            found.clear()
            in_docs.clear()

        rows = 0
        for group, terms in _grouped(batches, "_lang", "_source"):
            found.setdefault(group, Counter()).update(terms)
            in_docs.setdefault(group[0], Counter()).update(set(terms))
            rows += 1
            if rows % 64 == 0 and sum(map(len, found.values())) > HELD:
                yield from out()
        yield from out()
        released()

    partial = rows.mapInArrow(local, "lang string, source string, term string, n long, docs long")
    # tasks have added up already: rows are dealt out as they are
    exact = partial.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # a row a source
    whole = exact.withColumns({"_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "lead": (F.col("source") == F.min("source").over(of_term)).cast("long")})
    return whole.where(F.col("_docs") >= LEAST).select("lang", "source", "term", "n", "lang_n", "lead")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)); null where there are no terms."""
    below = (total + terms).cast("decimal(20,0)")
    up = (n + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    wide = F.floor((up - F.pmod(up, below)) / below).cast("long")
    return F.when(terms > 0, F.when(n < 9_000_000_000, F.call_function("div", (n + 1) * 1_000_000_000, total + terms)).otherwise(wide) + 1)


def most_above(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of the highest value of each (lang, source), with ``rank``; ties by item.

    Rows are first counted by their value's order of magnitude, so that only those that may be among them are sorted.
    """
    size = F.floor(F.log2(F.col("value") + 1) * 4)
    cells = rows.groupBy("lang", "source", size.alias("_size")).agg(F.count("*").alias("_n"))
    higher = Window.partitionBy("lang", "source").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    least = cells.withColumn("_above", F.coalesce(F.sum("_n").over(higher), F.lit(0))).where(F.col("_above") < most).groupBy("lang", "source").agg(F.min("_size").alias("_least"))
    least = materialize(least, "divergence-least")  # a row a group: its size decides how it is joined
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.join(least, ["lang", "source"]).where(size >= F.col("_least")).drop("_least").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q), in whole numbers."""
    square = (p - q) * (p - q)
    return F.call_function("div", square, q)


def report(docs: DataFrame, most_terms: int = 200, width: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` for each other source of the language, ``term`` for the
    ``most_terms`` terms that a source has most above its language."""
    counts = materialize(term_counts(docs, width), "divergence-counts")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = counts.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = materialize(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("v"))), "divergence-groups")
    rows = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    own = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = rows.withColumn("q", own).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = most_above(above, most_terms)

    c = F.col
    other = groups.select("lang", c("source").alias("item"), c("p0").alias("q0"))
    both = groups.select("lang", "source", "v", "p0").join(other, "lang").where("source <> item")
    absent = both.select("lang", "source", "item", F.coalesce(c("v") * gap(c("p0"), c("q0")), F.lit(0).cast("long")).alias("value"))
    alike = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m")).join(other, "lang").where("source <> item")
    single = alike.groupBy("lang", "source", "item").agg(
        F.sum(c("m") * (gap(c("p"), c("q0")) - gap(c("p0"), c("q0")))).alias("there"), F.sum(c("m") * (gap(c("q0"), c("p")) - gap(c("q0"), c("p0")))).alias("back"))
    left = rows.select("lang", "term", "source", "p", "p0")
    right = rows.select("lang", "term", c("source").alias("item"), c("p").alias("q"), c("p0").alias("q0"))
    more = lambda p, p0, q, q0: gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
    shared = left.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(
        F.sum(more(c("p"), c("p0"), c("q"), c("q0"))).alias("there"), F.sum(more(c("q"), c("q0"), c("p"), c("p0"))).alias("back"))
    changes = single.unionByName(shared)
    ways = F.explode(F.array(F.struct(c("source"), c("item"), c("there").alias("value")), F.struct(c("item").alias("source"), c("source").alias("item"), c("back").alias("value"))))
    values = absent.unionByName(changes.select("lang", ways.alias("x")).select("lang", "x.*")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = values.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


#: The same report over table {docs}, each pair of sources over all terms.
REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM {docs}),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
counts AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2),
groups AS (SELECT g.lang, g.source, coalesce(s.total, 0) AS total, coalesce(l.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sums s USING (lang, source) LEFT JOIN langs l USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums_of_pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums_of_pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM
      (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM found WHERE part = 'pair' OR rank <= 200
"""
