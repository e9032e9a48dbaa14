"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit where more than half of the shingles' hashes have it. Fingerprints that differ in at most
``RADIUS`` bits are linked, and a class is what links connect. Only distinct fingerprints are compared. They are cut
into b pieces; two within the radius agree in some b - 3 pieces, so each choice of b - 3 pieces is a table of keys
(b grows with the number of fingerprints, which keeps the groups of a key small). A key with more than ``CHUNK``
members is cut into chunks, and pairs of chunks are compared apart, so a hot key is many small tasks.

Within a sorted run of groups the 64 bit planes are stored vertically, as long integers with a bit for each member.
Shifting a plane by d and comparing it with itself compares every member with the one d places on; two carry-save
counter planes and a plane of overflows hold all distances at once, and the run is abandoned at the plane where every
pair has overflowed. A run gives a star for each connected part, never its pairs; the stars are joined by
alternating large-star and small-star rounds.

Defined results: a null text or one without words has fingerprint zero, linked like any other; a text of fewer words
than a shingle is one shingle; rows without an id are in a class by their fingerprint, and a class without ids has a
null component; repeated rows are returned as often as they stand; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, small, unveiled, utf8, veiled

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Members of a key compared in one piece; members whose planes are held at once.
CHUNK, RUN = 4096, 8192
#: Links written by a task of a round of ``components``, so that a small graph is not many tiny files.
LINKS_A_FILE = 250_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8) * 256)
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((counts.ravel() * 2 > len(hashes)), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``fp`` (the fingerprint as a signed long)."""
    rows = lean(docs).select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("_text"))
    kept_names = list(keep)

    def work(batches):
        for batch in small(batches):
            found = np.array([fingerprint(x) for x in utf8(batch["_text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in kept_names], pa.array(found)], [*kept_names, "fp"])

    return rows.mapInArrow(work, T.StructType([*rows.drop("_text").schema.fields, T.StructField("fp", T.LongType())]))


def _planes(values: np.ndarray) -> list[int]:
    """64 long integers: bit k of plane p is bit p of value k."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little")
    return [int.from_bytes(packed[:, p].tobytes(), "little") for p in range(64)]


def _as_bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def near_in_run(values: np.ndarray, groups: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For each member of a run (groups are consecutive equal numbers) the first member of its connected part.

    Members are compared within a group; where a group has two sides (0 and 1), only across them. ``sides`` of -1 is
    a group of one chunk, compared within.
    """
    n = len(values)
    label = np.arange(n)
    if n < 2:
        return label
    planes = _planes(values)
    edges = np.flatnonzero(np.diff(groups)) + 1
    longest = int(np.diff(np.concatenate(([0], edges, [n]))).max())
    side, inside = _as_bits(sides == 1), _as_bits(sides == -1)
    for d in range(1, longest):
        same = groups[d:] == groups[:-d]
        wanted = _as_bits(same) & (inside | (side ^ (side >> d)))
        if not wanted:
            continue
        ones = twos = over = 0
        for plane in planes:
            differ = plane ^ (plane >> d)
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if not wanted & ~over:  # every pair is beyond the radius
                break
        else:
            near = wanted & ~over
            at = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))
            at = at[label[at] != label[at + d]]
            for k in at.tolist():
                a, b = label[k], label[k + d]
                if a != b:
                    label[label == max(a, b)] = min(a, b)
    return label


def _stars(batches):
    """Sorted entries (t, key, i, j, side, fp) to the stars of their runs (fp, hub), hub < fp."""
    held: list[np.ndarray] = []

    def cut(block: np.ndarray, last: bool):
        """Whole groups of about RUN members; the rest, which may go on in the next batch, comes back."""
        while len(block):
            groups = np.concatenate(([0], np.cumsum((block[1:, :4] != block[:-1, :4]).any(axis=1))))
            stop = min(RUN, len(block)) - 1
            end = int(np.searchsorted(groups, groups[stop], "right"))
            if end == len(block) and not last:
                end = int(np.searchsorted(groups, groups[stop], "left"))  # its last group may go on
                if not end:
                    return block
            part = block[:end]
            label = near_in_run(part[:, 5].copy().view(np.uint64), groups[:end], part[:, 4])
            values = part[:, 5]
            hub = np.full(len(label), np.iinfo(np.int64).max)
            np.minimum.at(hub, label, values)
            hubs = hub[label]
            out = hubs != values
            if out.any():
                found.append((values[out], hubs[out]))
            block = block[end:]
        return block

    found: list[tuple[np.ndarray, np.ndarray]] = []
    names = ("t", "key", "i", "j", "side", "fp")
    rest = np.zeros((0, 6), np.int64)
    for batch in batches:
        rest = np.concatenate([rest, np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)])
        if len(rest) >= 2 * RUN:
            rest = cut(rest, False)
        for fp, hub in found:
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(hub)], ["fp", "hub"])
        found.clear()
    cut(rest, True)
    for fp, hub in found:
        yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(hub)], ["fp", "hub"])


def _keys(pieces: int) -> list[Column]:
    """One key for every choice of ``pieces`` - RADIUS pieces of the fingerprint."""
    cuts = [64 * k // pieces for k in range(pieces + 1)]
    mask = lambda a, b: ((1 << b) - (1 << a)) - (1 << 64 if b == 64 else 0)  # noqa: E731  as a signed long
    return [F.col("fp").bitwiseAND(F.lit(sum(mask(cuts[k], cuts[k + 1]) for k in choice)).cast("long")) for choice in combinations(range(pieces), pieces - RADIUS)]


def links(distinct: DataFrame, count: int) -> DataFrame:
    """Stars (fp, hub) whose connected parts are those of the links between ``count`` distinct fingerprints."""
    pieces = 4 if count <= 1 << 22 else 5 if count <= 1 << 31 else 6
    keys = _keys(pieces)
    entries = distinct.select("fp", F.posexplode(F.array(*keys)).alias("t", "key"))
    hot = entries.groupBy("t", "key").agg(F.count("*").alias("size")).where(F.col("size") > CHUNK)
    sized = entries.join(hot, ["t", "key"], "left").withColumn("chunks", F.coalesce(F.ceil(F.col("size") / CHUNK), F.lit(1)).cast("int"))
    own = sized.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(i == j, -1).otherwise((F.col("own") == j).cast("int"))
    paired = own.select("t", "key", i.alias("i"), j.alias("j"), side.alias("side"), "fp")
    return paired.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(_stars, "fp long, hub long").distinct()


def components(edges: DataFrame, a: str = "fp", b: str = "hub", most_rounds: int = 40) -> DataFrame:
    """(node, label): the smallest node of each node's connected part, for nodes that have an edge.

    Alternating large-star and small-star rounds; each is written out, so lineage stays short.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    checksum = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = checksum(now)
    for _ in range(most_rounds):
        if not last[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        # a round never has more links than the last one has, twice
        now = materialize(small.select("e.*").where("u <> v").distinct().coalesce(1 + 2 * last[0] // LINKS_A_FILE), "edges")
        new = checksum(now)
        if new == last:
            break
        last = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _classes(marked: DataFrame, id_col: str) -> DataFrame:
    """(fp, label, component_id) for each distinct fingerprint of ``marked``, a stored table."""
    distinct = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-distinct")
    label = components(links(distinct, distinct.count()))
    labelled = distinct.join(label, distinct.fp == label.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    return labelled.join(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fp_col: str | None = None) -> DataFrame:
    """(id, fp as a signed long, component_id: the smallest id of the class) for every document.

    ``fp_col`` names the fingerprints where the stored table ``docs`` has them already; no text is read then.
    """
    marked = docs.select(id_col, F.col(fp_col).alias("fp")) if fp_col else materialize(fingerprints(docs, {id_col: F.col(id_col)}, text_col), "simhash")
    return marked.join(_classes(marked, id_col), "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each class, with its columns.

    Fingerprints are worked out again rather than kept with the texts; texts are shuffled once, by id and fingerprint.
    """
    marked = materialize(fingerprints(docs, {id_col: F.col(id_col)}, text_col), "simhash")
    found = marked.join(_classes(marked, id_col), "fp").where(F.col(id_col).eqNullSafe(F.col("component_id")))
    winners = found.groupBy("label").agg(F.min("fp").alias("_fp")).join(found.select("label", F.col("fp").alias("_fp"), F.col(id_col).alias("_id")).distinct(), ["label", "_fp"]).select("_fp", "_id")
    again = fingerprints(docs, veiled(docs), text_col)
    kept = again.join(winners, (F.col("fp") == F.col("_fp")) & F.col(f"own_{docs.columns.index(id_col)}").eqNullSafe(F.col("_id")))
    return unveiled(kept.dropDuplicates(["_fp", "_id"]), docs)


def hexadecimal(fp: Column) -> Column:
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
