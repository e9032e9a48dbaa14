"""Exact substring dedup: bytes of a document covered by a string of ``LENGTH`` bytes that an earlier document holds.

Every string of 50 bytes has one *anchor*: the 20 bytes in it with the smallest hash (the first of equals). Equal
strings have equal anchors, so the strings of an anchor are a bucket, and a document has about one anchor in 16 bytes.

1. Each document announces its anchors (a hash and the id, packed); anchors that stand in one document are done.
2. Documents learn which of their anchors are repeated, and send the bytes around those, about a tenth of all text.
3. There, bucket-pointer refinement sorts all strings: positions start in buckets of their first 8 bytes, and are
   refined by the bucket identifiers at the offset of the depth reached, 8 to 16 to 32 to 50 bytes; each refinement
   uses the identifiers that the last one updated, and positions alone in their bucket are left out from then on.
   A bucket at depth 50 is one string; its smallest document keeps it.
4. Documents learn which of their strings start in an earlier document, and drop the bytes those cover.

Copies are settled in the task that reads them wherever it can: of an anchor, or of equal bytes around one, a task
sends on only its smallest document, so a passage in a third of all documents is one row a task, not one a document.

Defined results: a null or empty text has no bytes; texts shorter than 50 bytes lose nothing; a null id counts as
the largest; rows of one id are no earlier than each other and each is judged by its own text; strings are judged on
the input, overlaps count; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small, utf8

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
#: Positions worked on at once; anchors, and strings around anchors, that a task gathers before it sends them.
PIECE, HELD, HELD_NEAR = 1 << 16, 750_000, 80_000
#: Bytes of text for each part into which anchors are dealt, and the most partitions that hold parts.
PART_BYTES, MOST_PARTITIONS = 4 << 20, 50_000
#: Whole parts a task works on at once: anchors, and bytes around them; strings judged at once.
AT_ONCE, AT_ONCE_BYTES, JUDGED = 750_000, 1 << 20, 1 << 19
#: Groups of documents for each shuffle partition, in which answers travel.
SPREAD = 4
#: Level at which texts and the bytes around anchors are packed for a shuffle.
LEVEL = 3
_M = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _P = [_M]
    for _ in range(4):
        _P.append(_P[-1] * _P[-1])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start) of each run of strings that share an anchor, in order."""
    found = []
    last = len(text) - LENGTH
    for a in range(0, last + 1, PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE, last + 1 - a) + LENGTH - 1, a)
        h1 = data.astype(np.uint64) + np.uint64(1)
        h2 = h1[:-1] * _P[0] + h1[1:]
        h4 = h2[:-2] * _P[1] + h2[2:]
        h8 = h4[:-4] * _P[2] + h4[4:]
        h16 = h8[:-8] * _P[3] + h8[8:]
        gram = h16[:-4] * _P[2] + h4[16:]
        gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        for k in (1, 2, 4, 8):
            least = np.minimum(least[:-k], least[k:])
        least = np.minimum(least[: len(least) - WINDOW + 16], least[WINDOW - 16 :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        final = np.append(first[1:], len(at)) - 1
        own = gram[at[first]]
        found.append(((own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), first + a, final + a))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part above 32 bits of the hash."""
    return ((hashes % np.uint64(parts)) << np.uint64(32)) | (hashes >> np.uint64(32))


def _by(values: np.ndarray) -> list[slice]:
    """Slices of equal neighbours."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return [slice(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)] if len(values) else []


def _grouped_minimum(key: np.ndarray, ids: np.ndarray):
    """Entries in order of key; where keys start, their least ids, each entry's key number, and whether a key has several ids."""
    order = np.argsort(key)
    key, ids = key[order], ids[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.flatnonzero(first)
    least = np.minimum.reduceat(ids, start)
    return key, ids, start, least, np.cumsum(first) - 1, np.maximum.reduceat(ids, start) != least


_ANNOUNCED = "part int, kind int, ids binary, keys binary"
_TOLD = "group int, ids binary, keys binary"
_WANTED = "id long, keys binary"


def _announce(parts: int):
    """Task: kind 0 rows hold a part's (key, id); kind 2 the same for keys known to repeat; kind 1 rows tell a document."""

    def out(keys: list[np.ndarray], ids: list[np.ndarray]):
        key, own, start, least, group, several = _grouped_minimum(np.concatenate(keys), np.concatenate(ids))
        rows = []
        for kind, which in ((0, ~several), (2, several)):
            k, i = key[start[which]], least[which]
            part = (k >> np.uint64(32)).astype(np.int64)
            rows += [(int(part[s.start]), kind, i[s].tobytes(), (k[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()) for s in _by(part)]
        many = several[group]
        order = np.argsort(own[many], kind="stable")
        i, k = own[many][order], key[many][order]
        rows += [(int(i[s.start] % parts), 1, i[s.start : s.start + 1].tobytes(), k[s].tobytes()) for s in _by(i)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "kind", "ids", "keys"])

    def work(batches):
        keys, ids, size = [], [], 0
        for batch in batches:
            for number, text in zip(batch["_id"].to_pylist(), utf8(batch["_text"]), strict=True):
                if len(text) >= LENGTH:
                    own = np.unique(_keys(anchors(text)[0], parts))
                    keys.append(own)
                    ids.append(np.full(len(own), number, np.int64))
                    size += len(own)
                    if size > HELD:
                        yield out(keys, ids)
                        keys, ids, size = [], [], 0
        if size:
            yield out(keys, ids)

    return work


def _whole_parts(batches, size, most: int, part: str = "part"):
    """Lists of rows (dicts) that hold whole parts, of at least ``most`` in size where there is as much."""
    held, amount, last = [], 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if amount >= most and row[part] != last:
                yield held
                held, amount = [], 0
            held.append(row)
            amount += size(row)
            last = row[part]
    if held:
        yield held


def _repeated(groups: int):
    """Task: the parts dealt to it, in order; which documents have which repeated keys, a row a group of documents."""

    def work(batches):
        for rows in _whole_parts(batches, lambda row: len(row["keys"]) // 4, AT_ONCE):
            ids, keys = [], []
            for row in rows:
                if row["kind"] == 1:
                    keys.append(np.frombuffer(row["keys"], np.uint64))
                    ids.append(np.full(len(keys[-1]), np.frombuffer(row["ids"], np.int64)[0]))
            asked = [row for row in rows if row["kind"] != 1]
            if asked:
                found = [np.frombuffer(row["keys"], np.uint32).astype(np.uint64) | (np.uint64(row["part"]) << np.uint64(32)) for row in asked]
                flagged = [k for k, row in zip(found, asked, strict=True) if row["kind"] == 2]
                key, own, start, _, number, several = _grouped_minimum(np.concatenate(found), np.concatenate([np.frombuffer(row["ids"], np.int64) for row in asked]))
                if flagged:
                    several |= np.isin(key[start], np.concatenate(flagged))
                many = several[number]
                ids.append(own[many])
                keys.append(key[many])
            i, k = np.concatenate(ids), np.concatenate(keys)
            group = i % groups
            order = np.lexsort((i, group))
            group, i, k = group[order], i[order], k[order]
            cut = _by(group)
            yield pa.RecordBatch.from_arrays([pa.array([int(group[x.start]) for x in cut], pa.int32()), *[pa.array([c[x].tobytes() for x in cut], pa.binary()) for c in (i, k)]], ["group", "ids", "keys"])

    return work


def _wanted(batches):
    """Task: the groups dealt to it, in order; a row (id, repeated keys) for each id."""
    for rows in _whole_parts(batches, lambda row: len(row["keys"]) // 8, AT_ONCE, "group"):
        ids, keys = (np.concatenate([np.frombuffer(row[c], kind) for row in rows]) for c, kind in (("ids", np.int64), ("keys", np.uint64)))
        order = np.argsort(ids, kind="stable")
        ids, keys = ids[order], keys[order]
        cut = _by(ids)
        for at in range(0, len(cut), 5000):
            some = cut[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[x.start]) for x in some], pa.int64()), pa.array([np.unique(keys[x]).tobytes() for x in some], pa.binary())], ["id", "keys"])


_NEAR = "part int, ids binary, hashes binary, starts binary, which binary, sizes binary, bytes binary"
_EARLIER = "group int, ids binary, hashes binary, first binary, last binary"
_ANSWER = "id long, hash long, runs binary"


def text_hash(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _packed(texts):
    """Task: texts packed for the shuffle that both joins share."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in small(texts):
        yield pa.RecordBatch.from_arrays([batch[0], batch["_id"], pa.array([pack(x) for x in utf8(batch["_text"])], pa.binary())], [batch.schema.names[0], "_id", "_packed"])


def _near(parts: int, hashed: bool):
    """Task: documents with their repeated keys to the bytes around those anchors, by part.

    The hash of the text tells rows of one id apart; it is 0 where no id is repeated.

    Of equal bytes in several documents the smallest id goes on. The others' strings start in an earlier document,
    which rows of part -1 - k say (their ``which`` is the last start); k only spreads them.
    """
    kinds = (pa.int32(), *[pa.binary()] * 6)
    names = ["part", "ids", "hashes", "starts", "which", "sizes", "bytes"]

    def out(held: list):
        least: dict[bytes, int] = {}
        for near, number, *_ in held:
            if least.get(near, number) >= number:
                least[near] = number
        told, send = [], {}
        for near, number, own, start, part in held:
            if least[near] < number:
                told.append((number, own, start, start + len(near) - LENGTH))
            else:
                send.setdefault(part, []).append((near, number, own, start))
        rows = []
        for part, every in send.items():
            place: dict[bytes, int] = {}
            which = np.array([place.setdefault(x[0], len(place)) for x in every], np.uint32)
            rows.append((part, *[np.array([x[k] for x in every], np.int64).tobytes() for k in (1, 2, 3)], which.tobytes(), np.array([len(x) for x in place], np.uint32).tobytes(), b"".join(place)))
        for at in range(0, len(told), 2000):
            numbers, own, start, last = (np.array(x, np.int64).tobytes() for x in zip(*told[at : at + 2000], strict=True))
            rows.append((-1 - int(told[at][2] % 1009), numbers, own, start, last, b"", b""))
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        rows = [(part, *map(pack, more)) for part, *more in rows]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def work(batches):
        held: list = []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            for number, packed, listed in zip(batch["_id"].to_pylist(), batch["_packed"].to_pylist(), batch["keys"].to_pylist(), strict=True):
                text = unpack(packed)
                wanted = np.frombuffer(listed, np.uint64)
                hashes, lo, hi = anchors(text)
                if not len(hashes):  # the keys are those of another row with this id
                    continue
                key = _keys(hashes, parts)
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                hit = np.flatnonzero(wanted[at] == key)
                own = text_hash(text) if hashed else 0
                part = (key[hit] >> np.uint64(32)).astype(np.int64)
                held += [(text[a : b + LENGTH], number, own, a, p) for a, b, p in zip(lo[hit].tolist(), hi[hit].tolist(), part.tolist(), strict=True)]
                if len(held) > HELD_NEAR:
                    yield from out(held)
                    held = []
        if held:
            yield from out(held)

    return work


def refine(bucket: np.ndarray, offset: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One refinement: sort positions within their bucket by the bucket at ``offset``; (buckets, positions not alone).

    ``active`` are positions whose bucket has others; all positions ``offset`` on must have a bucket. Identifiers
    stay in the order of the strings: a bucket's members get identifiers from the bucket's own on.
    """
    if not len(active):
        return bucket, active
    now, then = bucket[active], bucket[active + offset]
    order = np.argsort((now << 32) | then)  # identifiers are positions of a piece of a part, far below 2**31
    a, b = now[order], then[order]
    new_bucket = np.concatenate(([True], a[1:] != a[:-1]))
    new_part = new_bucket | np.concatenate(([True], b[1:] != b[:-1]))
    place = np.arange(len(a))
    rank = place[new_part][np.cumsum(new_part) - 1] - place[new_bucket][np.cumsum(new_bucket) - 1]
    bucket = bucket.copy()
    bucket[active[order]] = a + rank
    alone = new_part & np.append(new_part[1:], True)
    return bucket, active[order][~alone]


def string_buckets(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For every position of ``text`` (pieces of the given sizes, one after another) an identifier of the LENGTH bytes from it.

    Positions too near the end of their piece for LENGTH bytes have identifiers that mean nothing.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH + 8, np.uint8)])
    word = np.zeros(n + LENGTH, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n + LENGTH].astype(np.uint64)
    order = np.argsort(word)
    sorted_words = word[order]
    first = np.concatenate(([True], sorted_words[1:] != sorted_words[:-1]))
    bucket = np.empty(n + LENGTH, np.int64)
    bucket[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    alone = first & np.append(first[1:], True)
    active = order[~alone]
    left = np.concatenate([np.repeat(np.cumsum(size), size) - np.arange(n), np.zeros(LENGTH, np.int64)])  # bytes left in the piece
    for depth, step in ((8, 8), (16, 16), (32, LENGTH - 32)):
        bucket, active = refine(bucket, step, active[left[active] >= depth + step])
    return bucket[:n]


def _runs(ids: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Runs of starts in order of text, touching ones joined; and where a text's runs begin."""
    order = np.lexsort((first, hashes, ids))
    ids, hashes, first, last = ids[order], hashes[order], first[order], last[order]
    fresh = np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))
    begin = np.flatnonzero(fresh | np.concatenate(([True], first[1:] != last[:-1] + 1)))
    end = np.append(begin[1:], len(ids)) - 1
    return ids[begin], hashes[begin], first[begin], last[end], np.flatnonzero(fresh[begin])


def _told(groups: int, *runs: np.ndarray):
    """Runs as one row a group of documents that is concerned: documents meet their runs group by group."""
    ids, hashes, first, last, _ = _runs(*runs)
    group = ids % groups
    order = np.argsort(group, kind="stable")
    group, columns = group[order], [x[order] for x in (ids, hashes, first, last)]
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    cut = _by(group)
    yield pa.RecordBatch.from_arrays([pa.array([int(group[x.start]) for x in cut], pa.int32()), *[pa.array([pack(c[x].tobytes()) for x in cut], pa.binary()) for c in columns]], ["group", "ids", "hashes", "first", "last"])


def _answers(batches):
    """Task: the groups dealt to it, in order; a row (id, text hash, runs of starts) for each text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for rows in _whole_parts(batches, lambda row: 3 * len(row["ids"]), AT_ONCE_BYTES, "group"):
        ids, hashes, first, last, text = _runs(*[np.concatenate([np.frombuffer(unpack(row[c]), np.int64) for row in rows]) for c in ("ids", "hashes", "first", "last")])
        runs = np.stack([first, last], axis=1)
        cut = [slice(a, b) for a, b in zip(text.tolist(), [*text[1:].tolist(), len(ids)], strict=True)]
        for at in range(0, len(cut), 5000):
            some = cut[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[x.start]) for x in some], pa.int64()), pa.array([int(hashes[x.start]) for x in some], pa.int64()), pa.array([runs[x].tobytes() for x in some], pa.binary())], ["id", "hash", "runs"])


def _earlier(groups: int):
    """Task: the parts dealt to it, in order; rows of runs of starts whose string an earlier document holds, by group of documents."""

    def work(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for packed in _whole_parts(batches, lambda row: 3 * len(row["bytes"]), AT_ONCE_BYTES):
            rows = [{k: x if k == "part" else unpack(x) for k, x in row.items()} for row in packed]
            ready = [row for row in rows if row["part"] < 0]
            if ready:
                yield from _told(groups, *[np.concatenate([np.frombuffer(row[c], np.int64) for row in ready]) for c in ("ids", "hashes", "starts", "which")])
            asked = [row for row in rows if row["part"] >= 0]
            if not asked:
                continue
            place: dict[bytes, int] = {}
            which = []
            for row in asked:
                ends = np.cumsum(np.frombuffer(row["sizes"], np.uint32)).tolist()
                data = row["bytes"]
                mine = np.array([place.setdefault(data[a:b], len(place)) for a, b in zip([0, *ends], ends, strict=False)], np.int64)
                which.append(mine[np.frombuffer(row["which"], np.uint32)])
            piece_of = np.concatenate(which)
            ids, hashes, starts = (np.concatenate([np.frombuffer(row[c], np.int64) for row in asked]) for c in ("ids", "hashes", "starts"))
            size = np.fromiter(map(len, place), np.int64, len(place))
            least = np.full(len(place), np.iinfo(np.int64).max)
            np.minimum.at(least, piece_of, ids)
            bucket = string_buckets(np.frombuffer(b"".join(place), np.uint8), size)
            width = size - LENGTH + 1
            base = np.cumsum(width) - width
            piece = np.repeat(np.arange(len(place)), width)
            string = bucket[(np.cumsum(size) - size)[piece] + np.arange(len(piece)) - base[piece]]
            smallest = np.full(len(bucket) + LENGTH, np.iinfo(np.int64).max)
            np.minimum.at(smallest, string, least[piece])
            earliest = smallest[string]
            wide = width[piece_of]
            turn = np.cumsum(wide) // JUDGED
            for x in _by(turn):  # a document's strings in a few steps, as many as there may be
                own_wide, own_ids, own_piece = wide[x], ids[x], piece_of[x]
                entry = np.repeat(np.arange(len(own_ids)), own_wide)
                at = np.arange(len(entry)) - np.repeat(np.cumsum(own_wide) - own_wide, own_wide)
                gone = earliest[base[own_piece[entry]] + at] < own_ids[entry]
                begins = gone & np.concatenate(([True], ~gone[:-1] | (at[1:] == 0)))
                ends_ = gone & np.concatenate((~gone[1:] | (at[1:] == 0), [True]))
                if gone.any():
                    own = entry[begins]
                    yield from _told(groups, own_ids[own], hashes[x][own], starts[x][own] + at[begins], starts[x][own] + at[ends_])

    return work


_KEPT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])


def _apply(names: list[str], hashed: bool):
    def work(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            rows = []
            for packed, told in zip(batch["_packed"].to_pylist(), batch["told"].to_pylist(), strict=True):
                text = unpack(packed)
                runs = []
                if told:
                    own = text_hash(text) if hashed else 0
                    runs = [np.frombuffer(x["runs"], np.int64).reshape(-1, 2) for x in told if x["hash"] == own]
                if not runs:
                    rows.append((len(text), 0, [], text))
                    continue
                edge = np.zeros(len(text) + 1, np.int32)
                every = np.concatenate(runs)
                np.add.at(edge, every[:, 0], 1)
                np.add.at(edge, every[:, 1] + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                cut = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
                rows.append((len(text), int(gone.sum()), cut.tolist(), np.frombuffer(text, np.uint8)[~gone].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in names], *[pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]], [*names, *_KEPT.names])

    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, spans of removed bytes, kept bytes) for every document."""
    spark = docs.sparkSession
    most = (1 << 63) - 1
    rows = lean(docs).select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(most)).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(partitions, -(-total // PART_BYTES))
    partitions = max(partitions, min(parts, MOST_PARTITIONS))
    groups = SPREAD * partitions
    hashed = bool(rows.groupBy("_id").count().where("count > 1").limit(1).count())
    dealt = lambda df, by="part": df.repartition(partitions, by).sortWithinPartitions(by)
    told = dealt(rows.select("_id", "_text").mapInArrow(_announce(parts), _ANNOUNCED)).mapInArrow(_repeated(groups), _TOLD)
    told = dealt(told, "group").mapInArrow(_wanted, _WANTED)
    packed = rows.mapInArrow(_packed, T.StructType([*rows.drop("_text").schema.fields, T.StructField("_packed", T.BinaryType())]))
    # both joins read the same columns of the same rows by the same key, so that Spark shuffles the texts once
    columns = [packed[c] for c in packed.columns]
    wanting = packed.join(told, packed["_id"] == told["id"]).select(*columns, "keys")
    earlier = dealt(wanting.mapInArrow(_near(parts, hashed), _NEAR)).mapInArrow(_earlier(groups), _EARLIER)
    answers = dealt(earlier, "group").mapInArrow(_answers, _ANSWER).groupBy(F.col("id").alias("answer_id")).agg(F.collect_list(F.struct("hash", "runs")).alias("told"))
    judged = packed.join(answers, packed["_id"] == answers["answer_id"], "left").select(*columns, "told")
    return judged.mapInArrow(_apply([id_col], hashed), T.StructType([packed.schema[id_col], *_KEPT.fields]))
