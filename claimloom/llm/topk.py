"""Exact top-k inner products with block-at-a-time pruning.

An index is written once: documents are ordered by their two nearest of ``CENTERS`` centers (fitted to at most ``SAMPLE``
rows; every row is indexed) and cut into ranges of ``BLOCK``. A block keeps, for each term (dimension), the largest and
smallest weight in it, and its documents' vectors as forward index. A query's bound on a block is the sum of its weights
times those extremes. Each query visits the blocks in order of bound, scores a whole block through its forward index,
and stops where the next bound falls below its k-th score.

Queries come in chunks of about ``CHUNK`` vectors, which bounds what is broadcast; each chunk is two passes over the
stored blocks, which never move. In the first every task scores the best block of each query alone; the k-th best of
what all tasks found is a valid floor, and with it the second pass leaves most blocks of structured data out. The
tasks' short lists meet in a window by query.

Defined results: components become floor(1024 * x); vectors that are null, or hold null or non-finite components, or
another number of components than the query, take no part; rows with a query's id are its own; rows repeated under
one id are candidates each; ties go to the smaller id; an empty table gives no rows; extra columns are ignored; the
order of documents and the sample change what is pruned, never a result.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

K, SCALE, BLOCK, CHUNK, CENTERS, SAMPLE = 10, 1024, 128, 4096, 64, 4096
_LEAST = np.iinfo(np.int64).min


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v")
    )


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T; through floats where sums stay below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**52 else a @ b.T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Queries x blocks: the most that a member of the block can score, rounded up where floats are inexact."""
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    total = up @ high.T.astype(np.float64) + down @ low.T.astype(np.float64)
    return total + np.abs(total) * 1e-12 + 1


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _LEAST)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` is rows x candidates; candidates of the least score count as none."""
        k = self.score.shape[1]
        score = np.concatenate([self.score[rows], score], axis=1)
        ids = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        order = np.lexsort((ids, -score.astype(np.float64) if np.abs(score[score > _LEAST]).max(initial=0) < 2**53 else -score.astype(object)), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.id[rows] = np.take_along_axis(ids, order, 1)


class Block:
    """A range of documents: ids, forward index, and the extremes of each term."""

    __slots__ = ("high", "ids", "low", "vectors")

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, high: np.ndarray | None = None, low: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors
        self.high = vectors.max(axis=0) if high is None else high
        self.low = vectors.min(axis=0) if low is None else low


def cut(ids: np.ndarray, vectors: np.ndarray) -> list[Block]:
    """Blocks of consecutive documents."""
    return [Block(ids[at : at + BLOCK], vectors[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]


def search_block_at_a_time(best: Best, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, blocks: list[Block], most: int | None = None) -> int:
    """Offer the blocks' documents to ``best``; returns the number of (query, block) pairs that were scored.

    ``most``: blocks that a query visits at most; without it, all whose bound reaches the k-th score.
    """
    bounds = _bounds(queries, np.stack([b.high for b in blocks]), np.stack([b.low for b in blocks]))
    visit = np.argsort(-bounds, axis=1, kind="stable")
    active = np.arange(len(queries))
    scored = 0
    for step in range(min(len(blocks), most or len(blocks))):
        block = visit[active, step]
        kth = np.maximum(best.score[active, -1], floor[active])
        go = bounds[active, block] >= kth  # ties may still win by id
        active, block = active[go], block[go]
        if not len(active):
            break
        by_block = np.argsort(block, kind="stable")
        for rows in np.split(by_block, np.flatnonzero(np.diff(block[by_block])) + 1):
            found = blocks[block[rows[0]]]
            who = active[rows]
            score = _products(queries[who], found.vectors)
            score[(query_ids[who][:, None] == found.ids[None, :]) | (score < floor[who][:, None])] = _LEAST
            best.offer(who, score, found.ids)
            scored += len(who)
    return scored


def _centers(sample: np.ndarray) -> np.ndarray:
    """``CENTERS`` centers of the sample: the farthest from those before, then ten rounds of means."""
    x = sample.astype(np.float64)
    chosen, far = [x[0]], np.full(len(x), np.inf)
    for _ in range(min(CENTERS, len(x)) - 1):
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
        chosen.append(x[int(far.argmax())])
    centers = np.array(chosen)
    for _ in range(10):
        near = _nearest(x, centers)[:, 0]
        for k in range(len(centers)):
            if (near == k).any():
                centers[k] = x[near == k].mean(axis=0)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The two nearest centers of each row (the same twice, where there is one)."""
    score = x @ centers.T - (centers**2).sum(axis=1) / 2
    first = score.argmax(axis=1)
    score[np.arange(len(x)), first] = -np.inf
    return np.stack([first, score.argmax(axis=1) if len(centers) > 1 else first], axis=1)


def index(rows: DataFrame) -> DataFrame:
    """The stored blocks (size, ids, vectors, high, low; packed int64) of ``rows`` (id, v): every row is in one."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toArrow()
    lengths = sample["v"].combine_chunks().value_lengths().to_numpy() if len(sample) else np.zeros(0, int)
    size = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    centers = _centers(_matrix(sample["v"].combine_chunks().filter(pa.array(lengths == size)))) if size else None
    shared = spark.sparkContext.broadcast(centers)

    def coded(batches):
        centers = shared.value
        for batch in batches:
            code = np.zeros(len(batch), np.int32)
            lengths = batch["v"].value_lengths().to_numpy()
            of = np.flatnonzero(lengths == (centers.shape[1] if centers is not None else -1))
            if len(of):
                near = _nearest(_matrix(batch["v"].take(pa.array(of))).astype(np.float64), centers)
                code[of] = near[:, 0] * CENTERS + near[:, 1]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(lengths.astype(np.int32)), pa.array(code)], ["id", "v", "size", "code"])

    # sorted by a hash within a code, so that one that holds many rows is dealt to many ranges
    ordered = rows.mapInArrow(coded, "id long, v array<long>, size int, code int").repartitionByRange("size", "code", F.xxhash64("id")).sortWithinPartitions("size", "code", F.xxhash64("id"))

    def packed(batches):
        held: list = []
        count = 0

        def out():
            ids = np.concatenate([x["id"].to_numpy() for x in held])
            lengths = np.concatenate([x["size"].to_numpy() for x in held])
            flat = np.concatenate([x["v"].flatten().to_numpy(zero_copy_only=False) for x in held]).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            found = []
            for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(ids)]):
                found += [(int(lengths[a]), x) for x in cut(ids[a:b], flat[starts[a] : starts[b]].reshape(b - a, -1))]
            held.clear()
            columns = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*[(b.ids, b.vectors, b.high, b.low) for _, b in found], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int32()), *columns], ["size", "ids", "vectors", "high", "low"])

        for batch in batches:
            if len(batch):
                held.append(batch)
                count += len(batch)
            if count >= 32 * BLOCK:
                yield out()
                count = 0
        if held:
            yield out()

    return materialize(ordered.mapInArrow(packed, "size int, ids binary, vectors binary, high binary, low binary"), "blocks")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK, counted=None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row where ``is_query`` (over ``id``) holds.

    ``counted``: an accumulator that is told how many (query, block) pairs were scored, or None.
    """
    rows = scaled(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    asked = materialize(rows.where(is_query).distinct(), "queries")
    parts = -(-asked.count() // chunk)
    blocks = index(rows) if parts else None
    found = None
    for part in range(parts):
        # distinct rows by their hash: a part has about ``chunk`` of them
        got = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(parts)) == part).toArrow()
        if not len(got):
            continue
        lengths, ids, v = got["v"].combine_chunks().value_lengths().to_numpy(), got["id"].to_numpy(), got["v"].combine_chunks()
        queries, numbers = {}, {}
        for size in np.unique(lengths).tolist():
            numbers[size] = np.flatnonzero(lengths == size)
            queries[size] = (_matrix(v.take(pa.array(numbers[size]))), ids[numbers[size]])
        floors = {size: np.full(len(q), _LEAST) for size, (q, _) in queries.items()}
        shared = spark.sparkContext.broadcast((queries, numbers, floors))
        schema = "q int, query_id long, vec_id long, score long"
        first = blocks.mapInArrow(_task(shared, k, 1, counted), schema)
        ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        kth = first.withColumn("rank", ranked).where(F.col("rank") == k).select("q", "score").toArrow()  # at most a row a query
        least = np.full(len(ids), _LEAST)
        least[kth["q"].to_numpy()] = kth["score"].to_numpy()
        floors = {size: least[at] for size, at in numbers.items()}
        shared = spark.sparkContext.broadcast((queries, numbers, floors))
        short = blocks.mapInArrow(_task(shared, k, None, counted), schema).withColumn("part", F.lit(part))
        short = short if parts == 1 else materialize(short, "topk")
        found = short if found is None else found.union(short)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    if found is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("part", "q", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _task(shared, k: int, most: int | None, counted):
    """Task: the best of its blocks for each query; with ``most``, of so many blocks of each batch."""

    def work(batches):
        queries, numbers, floors = shared.value
        best = {size: Best(len(q), k) for size, (q, _) in queries.items()}
        for batch in batches:
            of = defaultdict(list)
            for size, *packed in zip(*[batch[c].to_pylist() for c in ("size", "ids", "vectors", "high", "low")], strict=True):
                if size in queries:
                    ids, vectors, high, low = (np.frombuffer(x, np.int64) for x in packed)
                    of[size].append(Block(ids, vectors.reshape(-1, size), high, low))
            for size, blocks in of.items():
                scored = search_block_at_a_time(best[size], *queries[size], floors[size], blocks, most)
                if counted is not None:
                    counted.add(scored)
        for size, found in best.items():
            q, column = np.nonzero(found.score > _LEAST)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[size][q].astype(np.int32)), pa.array(queries[size][1][q]), pa.array(found.id[q, column]), pa.array(found.score[q, column])], ["q", "query_id", "vec_id", "score"])

    return work


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM {vectors}
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
