"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources get a share of the whole by weight. A source whose share would need more than ``max_epochs`` passes over
it is clamped there; what it leaves is shared among the others by weight, until none is above its cap. That fixed
point has a closed form: with the sources in order of ``cap / weight`` the clamped ones are a prefix, found from
running sums.

Each document is then taken ``floor(target / size of its source)`` whole times, and the rest of the target is
filled with one more repetition of documents in a seeded pseudo-random order (md5 of seed and id), stopping where
the running size comes nearest. The running sum never puts a source in one task: the order key is a 60-bit hash,
and sums run over its first 8 bits (256 rows a source), then its next 8 bits (256 rows each), then the rows in one
of those 65,536 cells.

Defined results: null or empty text has size 0 and is never short of its target; a null source is a source of its
own, last; with no words at all every target is 0; repeated rows count as often as they stand, ties go by id and
size; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, unveiled, veiled


def source_targets(by_source: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``by_source`` (no_source, src, source_size long) plus ``target`` double: one row a source."""
    n = len(weights)
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "src")))
    weighed = ranked.select(
        "no_source", "src", "source_size",
        F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % n + 1).cast("int")).cast("long").alias("w"),
        (F.col("source_size") * max_epochs).alias("cap"),
    )
    order = Window.orderBy(F.col("cap") / F.col("w"), "no_source", "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    big = "decimal(38,0)"
    sums = weighed.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.sum("w").over(whole).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    left, left_w = F.col("total") - F.col("cap_before"), F.col("all_w") - F.col("w_before")
    clamped = sums.withColumn("clamped", left.cast(big) * F.col("w").cast(big) >= F.col("cap").cast(big) * left_w.cast(big))
    free = clamped.select(
        "*",
        (F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(whole), F.lit(0))).alias("rest"),
        (F.col("all_w") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("w"))).over(whole), F.lit(0))).alias("rest_w"),
    )
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(
        F.col("rest").cast("double") * F.col("w").cast("double") / F.col("rest_w").cast("double")
    )
    return free.select("no_source", "src", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, size, source_size, target, taken, epochs) for every document, and the columns of ``keep``."""
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")
    columns = [
        F.col(id_col).alias("id"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
    ]
    cell = F.shiftright("key", 44).cast("int")
    sized = materialize(docs.select(*columns), "mix").withColumn("cell", cell)
    source = ["no_source", "src"]
    cells = sized.groupBy(*source, "cell").agg(F.sum("size").alias("cell_size")).withColumn("slab", F.shiftright("cell", 8))
    slabs = cells.groupBy(*source, "slab").agg(F.sum("cell_size").alias("slab_size"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    slabs = slabs.withColumn("slab_start", F.coalesce(F.sum("slab_size").over(upto(Window.partitionBy(*source).orderBy("slab"))), F.lit(0)))
    targets = source_targets(slabs.groupBy(*source).agg(F.sum("slab_size").alias("source_size")), weights, max_epochs)
    starts = (
        cells.withColumn("in_slab", F.coalesce(F.sum("cell_size").over(upto(Window.partitionBy(*source, "slab").orderBy("cell"))), F.lit(0)))
        .join(slabs.select(*source, "slab", "slab_start"), [*source, "slab"])
        .join(targets, source)
        .select(*source, "cell", "source_size", "target", (F.col("slab_start") + F.col("in_slab")).alias("cell_start"))
    )
    kept = [c.alias(k) for k, c in (keep or {}).items()]
    rows = (docs.select(*columns, *kept).withColumn("cell", cell) if kept else sized).join(starts, [*source, "cell"])
    before = F.col("cell_start") + F.coalesce(F.sum("size").over(upto(Window.partitionBy(*source, "cell").orderBy("key", "id", "size"))), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("before", before).withColumn("whole", whole)
    more = F.col("before") + F.col("size") / 2.0 <= F.col("target") - F.col("whole") * F.col("source_size")
    times = F.least(F.col("whole") + F.when(more, 1).otherwise(0), F.lit(max_epochs))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.cast("long").alias("epochs"), *(keep or {}))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with its columns."""
    rows = mix(docs, id_col=id_col, keep=veiled(docs), **options).where("epochs > 0")
    return unveiled(rows.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))), docs)


#: The same in DuckDB, written as plain running sums.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM {docs}),
by_source AS (
  SELECT no_source, src, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap FROM sized GROUP BY ALL),
weighed AS (SELECT *, (row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1 AS w FROM by_source),
sums AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM weighed WINDOW o AS (ORDER BY cap / w, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
clamps AS (SELECT *, (total - cap_before) * w >= cap * (all_w - w_before) AS clamped FROM sums),
free AS (
  SELECT *, total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0) AS rest,
         all_w - coalesce(sum(CASE WHEN clamped THEN w END) OVER (), 0) AS rest_w FROM clamps),
targets AS (
  SELECT no_source, src, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(rest AS DOUBLE) * CAST(w AS DOUBLE) / CAST(rest_w AS DOUBLE) END AS target FROM free),
runs AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY no_source, src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN targets USING (no_source, src)),
taken AS (
  SELECT *, least(whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END, 3) AS epochs FROM runs)
SELECT doc_id, size, source_size, target, CAST(size * epochs AS BIGINT) AS taken, CAST(epochs AS BIGINT) AS epochs FROM taken
"""
