"""Near copies by the Jaccard similarity of word shingles: fingerprints' bit planes and banded minima propose pairs, the exact similarity decides.

A text is the set of its shingles of ``SHINGLE`` words. Texts of the same words are one node. First
``simhash.near_duplicates`` puts the nodes' fingerprints into classes by its bit planes, and each node is compared with
the first of its class. Not all texts of a similarity of 0.8 have near fingerprints; minima propose the pairs that are
left: each node has ``BANDS`` keys of ``ROWS`` minimum hashes, and nodes that share a key are compared. Nodes are linked
where the exact similarity of their sets is at least 4/5. A class is what links connect. Two sets of similarity s share
no key with probability (1 - s^ROWS)^BANDS: 3 in a million at 0.8, fewer above.

Comparisons by keys go in rounds, in those keys whose members the links so far don't all connect: first each key's
members with its most central one, whose keys are shared most (of many edited copies that is the text they come from);
then ``TURNS`` times the others with one member of the widest class there, another one each time. Of the classes that
are left, only texts that can still have a link are compared in pairs: two sets have at most as many shingles in common
as each has shingles that another set holds too, so a copy whose own edits make up over a fifth of it goes at once
(``PRUNINGS`` times, since each one that goes takes its shingles along), and a pair where either number is below 4/9 of
both sizes is never made, nor one that the sets' bitmaps rule out: each bit that one of them alone has is a shingle that
the other set lacks. A pair is made in the first key it shares. So a text with very many near copies costs a few
comparisons a copy and key, and no link between classes is left out. Keys with more than ``CHUNK`` members are cut into
chunks at the end.

Defined results: texts without words are one node; a text of fewer words than a shingle is one shingle; rows without
an id count as ones of equal ids, after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, small, unveiled, utf8, veiled
from .simhash import components, fingerprint, near_duplicates

SHINGLE, SEED = 5, 42
BANDS, ROWS = 32, 5
#: Members of a key compared in one piece; shingles hashed at once.
CHUNK, HASHED, TURNS, PRUNINGS = 4096, 2000, 4, 2
#: Longs of a set's bitmap: a bit is set where a shingle's hash starts with its number.
BITMAP = 16
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def node_of(words: list[bytes]) -> int:
    """One number for texts of the same words, a signed long."""
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63)


def shingles(words: list[bytes]) -> np.ndarray:
    """The hashes of the different shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + SHINGLE]), SEED) for k in range(max(1, len(words) - SHINGLE + 1))], np.uint64))


def keys(hashes: np.ndarray) -> list[int]:
    """The keys of a set of shingles, signed longs; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), HASHED):
        np.minimum(least, ((hashes[at : at + HASHED] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[t * ROWS : (t + 1) * ROWS].tobytes(), t) - (1 << 63) for t in range(BANDS)]


def _mapped(docs: DataFrame, keep: dict[str, Column], text_col: str, work, fields: list[T.StructField]) -> DataFrame:
    """The columns of ``keep``, ``node``, and what ``work`` makes of each text's words."""
    rows = lean(docs).select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("_text"))
    kept = list(keep)
    names = [*kept, "node", *[f.name for f in fields]]

    def task(batches):
        for batch in small(batches):
            words = [words_of(x) for x in utf8(batch["_text"])]
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in kept], pa.array([node_of(w) for w in words], pa.int64()), *work(words)], names)

    return rows.mapInArrow(task, T.StructType([*rows.drop("_text").schema.fields, T.StructField("node", T.LongType()), *fields]))


def _longs(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.LongType()))


def _keyed(words: list[list[bytes]]) -> list[pa.Array]:
    sets = [shingles(w) for w in words]
    marks = np.array([fingerprint(b" ".join(w)) for w in words], np.uint64).view(np.int64)
    return [pa.array([len(s) for s in sets], pa.int32()), pa.array([keys(s) for s in sets], pa.list_(pa.int64())), pa.array(marks)]


def bitmap(hashes: np.ndarray) -> list[int]:
    """``BITMAP`` signed longs."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[hashes >> np.uint64(64 - (64 * BITMAP).bit_length() + 1)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _sets(words: list[list[bytes]]) -> list[pa.Array]:
    sets = [shingles(w) for w in words]
    return [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))]


def _can_link(n_a: Column, bits_a: Column, n: Column, bits: Column) -> Column:
    """Whether two sets may have a similarity of 4/5: each bit of one alone is a shingle that the other set does not have."""
    lacks = lambda x, y: sum((F.bit_count(x[k].bitwiseAND(F.bitwise_not(y[k]))) for k in range(BITMAP)), F.lit(0))
    return 9 * F.least(n_a - lacks(bits_a, bits), n - lacks(bits, bits_a)) >= 4 * (n_a + n)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is at least 4/5."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"_{x}"))
    common = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(9 * common >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b")


def links(distinct: DataFrame, docs: DataFrame, text_col: str, proposed: DataFrame | None = None) -> DataFrame:
    """Confirmed pairs (a, b) that connect all nodes of ``distinct`` (node, n, keys) which confirmed pairs connect.

    ``proposed`` pairs (a, b), a stored table, are compared before all others, and keys that they settle not again.
    """
    entries = distinct.select("node", "n", F.explode("keys").alias("key"))
    groups = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(entries.join(groups, "key"), "near-shared")
    central = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    wanted = shared.select(F.col("node").alias("_node"))
    if proposed is not None:
        wanted = wanted.union(proposed.select("a")).union(proposed.select("b"))
    wanted = wanted.distinct()
    texts = _mapped(docs, {"_text_again": F.col(text_col)}, text_col, lambda words: [], [])
    texts = texts.join(wanted, texts.node == wanted._node, "left_semi").dropDuplicates(["node"])
    sets = materialize(_mapped(texts, {}, "_text_again", _sets, [_longs("shingles"), _longs("bits")]), "near-sets")

    near = lambda x, y: (5 * F.least(x, y)) >= (4 * F.greatest(x, y))  # noqa: E731  else the sizes alone rule it out
    if proposed is None:
        found, left = None, shared.withColumn("label", F.col("node"))
    else:
        found = materialize(_confirmed(proposed, sets), "near-links")
        left = _undecided(shared, found)
    chosen = left.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node", F.col("n").alias("n_a"), F.col("label").alias("l_a"))).alias("most")).select("key", F.col("most.node").alias("a"), "most.n_a", "most.l_a")
    stars = left.join(chosen, "key").where((F.col("label") != F.col("l_a")) & near("n", "n_a")).select("a", F.col("node").alias("b")).distinct()
    first = materialize(_confirmed(stars, sets), "near-links")

    found = first if found is None else found.union(first)
    for turn in range(TURNS):
        left = _undecided(shared, found)
        seed = lambda c, turn=turn: F.xxhash64("node", F.lit(turn)).alias(c)
        parts = left.groupBy("key", "label").agg(F.count("*").alias("members"), F.min(F.struct(seed("order"), "node", "n")).alias("one"))
        widest = parts.groupBy("key").agg(F.max(F.struct("members", F.col("label").alias("l_a"), F.col("one.node").alias("a"), F.col("one.n").alias("n_a"))).alias("w")).select("key", "w.*")
        met = left.join(widest, "key").where((F.col("label") != F.col("l_a")) & near("n", "n_a"))
        met = met.groupBy("node", "l_a").agg(F.min(F.struct(F.xxhash64("a", F.lit(turn)).alias("order"), "a")).alias("one")).select("node", "one.a")
        pairs = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        found = found.union(materialize(_confirmed(pairs, sets), "near-links"))

    left = _undecided(shared, found).withColumn("held", F.col("n"))
    for _ in range(PRUNINGS):
        left = _pruned(left, sets)
    parts = left.groupBy("key", "label").agg(F.count("*").alias("members")).groupBy("key").agg(F.max(F.struct("members", "label")).alias("w"), F.sum("members").alias("size"))
    left = left.drop("size").join(parts.select("key", "size", F.col("w.label").alias("widest")), "key").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    # members of a key's widest class meet the others only
    left = left.join(distinct.select("node", "keys"), "node").join(sets.select("node", "bits"), "node")
    one = left.where("label <> widest").select("key", F.col("keys").alias("keys_a"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("held").alias("held_a"), F.col("label").alias("l_a"), F.col("bits").alias("bits_a"))
    other = left.select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("node").alias("b"), "n", "held", "label", "widest", "keys", "bits")
    once = (F.col("label") == F.col("widest")) | (F.col("a") < F.col("b"))
    can = (9 * F.least("held", "held_a") >= 4 * (F.col("n") + F.col("n_a"))) & _can_link(F.col("n_a"), F.col("bits_a"), F.col("n"), F.col("bits"))
    here = F.array_min(F.array_intersect("keys_a", "keys")) == F.col("key")
    pairs = one.join(other, ["key", "chunk"]).where((F.col("l_a") != F.col("label")) & once & can & here).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.union(materialize(_confirmed(pairs, sets), "near-links"))


def _pruned(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``left`` whose node can have a link to another, with ``held``: how many of the node's shingles another one of ``left`` has too."""
    single = sets.join(left.select("node").distinct(), "node").select("node", F.explode("shingles").alias("shingle"))
    alone = single.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("high")).where("node = high").groupBy("node").agg(F.count("*").alias("alone"))
    held = left.drop("held").join(alone, "node", "left").withColumn("held", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return materialize(held.where("5 * held >= 4 * n"), "near-left")


def _undecided(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, n, size, label) of the keys whose members the links ``found`` don't all connect, stored."""
    label = components(found, "a", "b").withColumnRenamed("node", "_node")
    named = shared.join(label, shared.node == label._node, "left").select("key", "node", "n", "size", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return materialize(named.join(mixed, "key", "left_semi"), "near-left")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each class, with its columns.

    Nodes are worked out again rather than kept with the texts; texts are shuffled by node and id.
    """
    marked = materialize(_mapped(docs, {"id": F.col(id_col)}, text_col, _keyed, [T.StructField("n", T.IntegerType()), _longs("keys"), T.StructField("fp", T.LongType())]), "near-nodes")
    distinct = materialize(marked.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "near-distinct")
    alike = near_duplicates(distinct, "node", fp_col="fp").where("node <> component_id")
    proposed = materialize(alike.select(F.col("component_id").alias("a"), F.col("node").alias("b")), "near-proposed")
    label = components(links(distinct, docs, text_col, proposed), "a", "b").withColumnRenamed("node", "_node")
    labelled = distinct.join(label, distinct.node == label._node, "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    # an id that is null comes last
    winners = labelled.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("w")).select(F.col("w.node").alias("_node"), F.col("w.id").alias("_id"), F.xxhash64("w.id").alias("_hash"))
    again = _mapped(docs, veiled(docs), text_col, lambda words: [], []).withColumn("hash", F.xxhash64(f"own_{docs.columns.index(id_col)}"))
    kept = again.join(winners, (F.col("node") == F.col("_node")) & (F.col("hash") == F.col("_hash"))).where(F.col(f"own_{docs.columns.index(id_col)}").eqNullSafe(F.col("_id")))
    return unveiled(kept.dropDuplicates(["_node", "_hash"]), docs)
