"""The prefix trie of conversations, by prefix-doubling names.

Turns get dense numbers by content. In round k each aligned block of 2**k turns is the pair of its halves and gets a
dense number as well (one join of halves, one of names); a prefix of d turns is the prefix without d's lowest binary
digit and one such block, named once more. So a conversation of n turns is named in about 2 * log2(n) join rounds, and
rows stay a few numbers wide. Nodes are then groups of equal prefix names.

Sums over a subtree need no walk: a node belongs to its smallest member, so that what a subtree holds is the sum, over
the members, of what they own from that depth on: a running sum from the end of each conversation.

Defined results: turns in order of their number, null first, equal ones by the SHA-256 of role and text; equal rows
are as many turns; a null role or text is empty; rows without a conversation id take no part; an empty table has no
node, not even a root; other columns are ignored. A turn is known by the SHA-256 of its role and text.

Scale: texts are read once and never shuffled; all else is numbers. A conversation, or a prefix, with a third of all
turns is split by ranges (``ordering.running``) or by AQE (joins on names have unique names on one side).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.ordering import dense_names, numbered, running

from .common import materialize

#: Ids in a piece of a node's list.
PIECE = 8192
ROOT = 0


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, n_chars): each conversation's turns from position 0; the key tells role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", key.alias("turn_key"), F.length(text).cast("long").alias("n_chars"))
    return numbered(rows, ["conv_id"], ["turn", "turn_key"], "pos", "trie-turns").select("conv_id", (F.col("pos") - 1).alias("pos"), "turn_key", "n_chars")


def with_shared_openings(rows: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first of their group of ``group`` ids: (conversations, turns).

    h is the CRC-32 of the decimal id modulo ``most``. A turn keeps the rest of its columns.
    """
    c = F.col("conv_id")
    given = F.crc32(c.cast("string").cast("binary")) % most
    convs = materialize(rows.where("pos = 0").select("conv_id", (c - c % group).alias("_base"), given.alias("_h")), "trie-conversations")
    openings = rows.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "_base")
    first = convs.join(openings, "_base").where(F.col("pos") < F.col("_h")).drop("_base", "_h")
    n_given = first.groupBy("conv_id").agg(F.count("*").alias("_given"))
    own = rows.where(F.col("pos") >= given).join(n_given, "conv_id", "left").withColumn("pos", F.col("pos") - given + F.coalesce("_given", F.lit(0))).drop("_given")
    return convs.select("conv_id"), first.select(*rows.columns).unionByName(own.select(*rows.columns))


def _named(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``rows`` with ``name``, a dense number from 0 for each combination of ``keys``, in their place."""
    return materialize(rows.join(dense_names(rows, keys, "name", f"trie-{what}-names"), keys).drop(*keys), f"trie-{what}")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, n_chars) of every prefix of a turn or more: equal nodes are equal prefixes.

    ``rows`` has (conv_id, pos, turn_key, n_chars); node numbers start at 1, n_chars is the last turn's.
    """
    rows = materialize(rows.select("conv_id", "pos", "turn_key", "n_chars"), "trie-rebuilt")
    blocks = [_named(rows.withColumnRenamed("pos", "block"), ["turn_key"], "turns")]
    longest = (rows.agg(F.max("pos")).first()[0] or 0) + 1
    while 2 ** len(blocks) <= longest:
        half, right = blocks[-1], F.col("block") % 2 == 1
        whole = half.groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(~right, F.col("name"))).alias("_left"), F.max(F.when(right, F.col("name"))).alias("_right"), F.max(F.when(right, F.col("n_chars"))).alias("n_chars"))
        blocks.append(_named(materialize(whole.where("_right IS NOT NULL"), "trie-halves"), ["_left", "_right"], "blocks"))
    found, used = None, 1
    for k in reversed(range(len(blocks))):
        last = blocks[k].where("block % 2 = 0").select("conv_id", (F.col("block") * 2**k).alias("_from"), F.col("name").alias("_last"), "n_chars")
        if found is None:
            pairs = last.withColumn("_before", F.lit(ROOT).cast("long"))
        else:
            pairs = last.join(found.select("conv_id", F.col("depth").alias("_from"), F.col("node").alias("_before")), ["conv_id", "_from"], "left").withColumn("_before", F.coalesce("_before", F.lit(ROOT).cast("long")))
        done = _named(materialize(pairs.withColumn("depth", F.col("_from") + 2**k).drop("_from"), "trie-pairs"), ["_before", "_last"], "prefixes")
        done = done.select("conv_id", "depth", (F.col("name") + used).alias("node"), "n_chars")
        used += (done.agg(F.max("node")).first()[0] or used - 1) - used + 1
        found = done if found is None else found.unionByName(done)
    return found


def trie(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie of conversations ``convs`` (conv_id) with turns ``rows`` (conv_id, pos, turn_key, n_chars).

    nodes: node, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, as long.
    ends: (node, conv_id), the node of each whole conversation.
    """
    at = prefixes(rows)
    stats = materialize(at.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("n_chars").alias("n_chars")), "trie-groups")
    above = at.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    known = materialize(stats.join(above, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(ROOT).cast("long"))), "trie-parents")
    children = known.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = materialize(known.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")
    owned = known.select("conv_id", "depth", F.lit(1).alias("_owned"), (F.col("n_children") == 0).cast("long").alias("_leaf"))
    rest = at.join(owned, ["conv_id", "depth"], "left").select(
        "conv_id", (-F.col("depth")).alias("_back"), "node", F.when(F.col("_owned").isNull(), F.col("n_chars")).otherwise(0).alias("_chars"), F.coalesce("_leaf", F.lit(0).cast("long")).alias("_leaf"))
    sums = running(rest, ["conv_id"], ["_back"], {"saved": F.col("_chars"), "leaves": F.col("_leaf")}, "trie-sums").groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    parents = stats.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    totals = known.agg(F.count_if(F.col("parent") == ROOT).alias("n_children"), F.count_if(F.col("n_children") == 0).alias("n_leaves"), F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("n_chars")), F.lit(0)).alias("saved")).first()
    whole = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    top = whole.first()["conv_id"]
    number = lambda x: F.lit(x).cast("long")
    root = whole.where("n_convs > 0").select(
        number(ROOT).alias("node"), "conv_id", number(0).alias("depth"), number(None).alias("parent_conv_id"), "n_convs",
        number(totals["n_children"]).alias("n_children"), number(max(1, totals["n_leaves"])).alias("n_leaves"), number(totals["saved"]).alias("saved_tokens"))
    deep, first = known.where(F.col("parent") != ROOT), known.where(F.col("parent") == ROOT)
    nodes = deep.join(parents, "parent").unionByName(first.withColumn("parent_conv_id", number(top))).join(sums, "node")
    nodes = nodes.select(*root.columns).unionByName(root)
    ends = convs.join(at.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node")), "conv_id", "left")
    return nodes, ends.select(F.coalesce("node", F.lit(ROOT).cast("long")).alias("node"), "conv_id")


def _pieces(batches):
    """(node, first, ids): the ids of rows that follow each other in one node, comma-joined, at most ``PIECE`` together."""
    node, held = None, []

    def piece():
        return pa.RecordBatch.from_pydict({"node": [node], "first": [held[0]], "ids": [",".join(map(str, held))]}, pa.schema([("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        for a, c in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if held and (a != node or len(held) == PIECE):
                yield piece()
                held = []
            node = a
            held.append(c)
    if held:
        yield piece()


def _digests(batches):
    """(node, sha256) of pieces in order: a node's list is hashed as it passes, never held."""
    node, state = None, None

    def out():
        return pa.RecordBatch.from_pydict({"node": [node], "sha256": [state.hexdigest()]}, pa.schema([("node", pa.int64()), ("sha256", pa.string())]))

    for batch in batches:
        for a, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if a != node:
                if state:
                    yield out()
                node, state = a, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state:
        yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, sha256): of the ids that end at a node, ascending and comma-joined. A node with very many is cut into pieces first."""
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node long, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node long, sha256 string")


#: The same nodes of the table {rows}, with lists of turn numbers for prefixes.
TRIE_SQL = """
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {rows} WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) - 1 AS pos,
             dense_rank() OVER (ORDER BY role, text) AS name FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
g AS (SELECT c.conv_id, o.pos, o.name, length(o.text) AS n FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h),
r AS (SELECT * FROM g UNION ALL SELECT o.conv_id, 10 + o.pos, o.name, length(o.text) FROM o JOIN c USING (conv_id) WHERE o.pos >= c.h),
w AS (SELECT c.conv_id, coalesce(list(r.name ORDER BY r.pos) FILTER (r.name IS NOT NULL), []) AS names, coalesce(list(r.n ORDER BY r.pos) FILTER (r.n IS NOT NULL), []) AS sizes FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
p AS (SELECT conv_id, d, list_slice(names, 1, d) AS prefix, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS n, len(names) = d AS ends FROM (SELECT *, unnest(range(0, len(names) + 1)) AS d FROM w)),
v AS (SELECT prefix, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids FROM p GROUP BY 1),
k AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
n AS (SELECT v.*, coalesce(k.n_children, 0) AS n_children FROM v LEFT JOIN k USING (prefix)),
u AS (SELECT list_slice(prefix, 1, a) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM n) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM n JOIN u USING (prefix) LEFT JOIN n AS m ON n.depth > 0 AND m.prefix = list_slice(n.prefix, 1, n.depth - 1)
"""
