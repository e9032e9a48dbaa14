"""Closure and routes over directed edges (u, v)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.storage import shared_dir, stored


def closure(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Transitive closure, not reflexive: semi-naive, each round joins only the pairs that the last one added.

    A round is one join on the shared node and one anti-join with what is known; both are written out, so a round's
    lineage starts at files. Pairs come as (u, v).
    """
    edges = stored(edges.select("u", "v").distinct(), "edges")
    step = edges.select(F.col("u").alias("w"), "v")
    known = new = edges
    for round_ in range(most_rounds):
        found = new.withColumnRenamed("v", "w").join(step, "w").select("u", "v").distinct()
        new = stored(found.join(known, ["u", "v"], "left_anti"), "closure-new")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        if round_ % 8 == 7:  # keep the union short
            known = stored(known, "closure-known")
    raise RuntimeError(f"no fixpoint in {most_rounds} rounds")


def reachable(edges: DataFrame, seeds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(v, hops) of the nodes reached from the nodes in ``seeds`` (v): breadth first, bound side first.

    A seed is reached only through a cycle, with the length of the shortest one.
    """
    edges = stored(edges.select("u", "v").distinct(), "edges")
    front = seeds.select("v").distinct()
    known = None
    for hops in range(1, most_rounds + 1):
        found = front.withColumnRenamed("v", "u").join(edges, "u").select("v").distinct()
        if known is not None:
            found = found.join(known, "v", "left_anti")
        front = stored(found.withColumn("hops", F.lit(hops)), "front")
        if front.isEmpty():
            break
        known = front if known is None else known.unionByName(front)
    return known if known is not None else seeds.select("v", F.lit(0).alias("hops")).where("false")


def breadth_first(edges: DataFrame, seeds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(start, v, hops, parent) of what each of ``seeds`` (v) reaches: all starts at once, the least parent of the shortest routes.

    A start reaches itself only through a cycle.
    """
    edges = stored(edges.select("u", "v").distinct(), "edges")
    front = seeds.select(F.col("v").alias("start"), "v").distinct()
    known = None
    for hops in range(1, most_rounds + 1):
        found = front.select("start", F.col("v").alias("u")).join(edges, "u").groupBy("start", "v").agg(F.min("u").alias("parent"))
        if known is not None:
            found = found.join(known, ["start", "v"], "left_anti")
        front = stored(found.select("start", "v", F.lit(hops).alias("hops"), "parent"), "front")
        if front.isEmpty():
            return known if known is not None else front
        known = front if known is None else known.unionByName(front)
        if hops % 8 == 0:  # keep the union short
            known = stored(known, "reached")
    raise RuntimeError(f"routes of more than {most_rounds} hops")


def steps(reached: DataFrame) -> DataFrame:
    """(start, v, step, node) of all routes in ``reached`` (of ``breadth_first``), ``step`` from 0 at the start.

    Pointer jumping: the ancestors 1, 2, 4 ... hops back are joined once each, so a route of n steps takes log2(n) joins.
    """
    longest = reached.agg(F.max("hops")).first()[0] or 0
    back = stored(reached.where("hops > 1").select("start", "v", F.col("parent").alias("to")), "back")
    at = reached.select("start", "v", F.explode(F.sequence(F.lit(0), F.col("hops") - 1)).alias("left"), "hops").withColumn("node", F.col("v"))
    k = 0
    while 2**k < max(longest, 1):
        jump = back.select("start", F.col("v").alias("node"), "to")
        moves = F.shiftright("left", k) % 2 == 1
        at = at.join(jump, ["start", "node"], "left").withColumn("node", F.when(moves, F.col("to")).otherwise(F.col("node"))).drop("to")
        back = stored(back.join(back.select("start", F.col("v").alias("to"), F.col("to").alias("far")), ["start", "to"]).select("start", "v", F.col("far").alias("to")), "back")
        k += 1
    first = reached.select("start", "v", F.lit(0).alias("step"), F.col("start").alias("node"))
    return at.select("start", "v", (F.col("hops") - F.col("left")).alias("step"), "node").unionByName(first)


def routes(reached: DataFrame, mark: str = ">") -> DataFrame:
    """(start, v, route) of ``reached`` (of ``breadth_first``): each route's nodes in one text, ``mark`` between them.

    A level of hops is its parents' level with one node more, so a route is written once and passed on once, whatever
    its length. Levels are written out but for the last, most often the largest.
    """
    longest = reached.agg(F.max("hops")).first()[0] or 0
    at = f"{shared_dir(reached.sparkSession)}/routes-{uuid.uuid4().hex}"
    last = reached.where("hops = 1").select("start", "v", F.concat_ws(mark, "start", "v").alias("route"))
    for hops in range(2, longest + 1):
        last.write.parquet(f"{at}/level={hops - 1}")
        before = reached.sparkSession.read.schema(last.schema).parquet(f"{at}/level={hops - 1}").withColumnRenamed("v", "parent")
        last = reached.where(F.col("hops") == hops).select("start", "v", "parent").join(before, ["start", "parent"]).select("start", "v", F.concat_ws(mark, "route", "v").alias("route"))
    if longest < 2:
        return last
    return reached.sparkSession.read.schema(last.schema).parquet(*[f"{at}/level={k}" for k in range(1, longest)]).unionByName(last)


def route(edges: DataFrame, start: str, target: str, most_rounds: int = 1000) -> DataFrame:
    """(step, node) of one shortest route from ``start`` to ``target``; of equal ones the smallest parent each time."""
    seed = edges.sparkSession.createDataFrame([(start,)], "v string")
    return steps(breadth_first(edges, seed, most_rounds)).where(F.col("v") == target).select("step", "node")


def first_route(edges: DataFrame) -> DataFrame:
    """(start, v, step, node) of the route from the least node that has edges to the least one it reaches."""
    reached = breadth_first(edges, edges.agg(F.min("u").alias("v")).where("v IS NOT NULL"))
    return steps(reached).join(reached.groupBy("start").agg(F.min("v").alias("v")), ["start", "v"], "left_semi")


def paths(edges: DataFrame, start: str | None = None, target: str | None = None, same: bool = False) -> DataFrame:
    """(u, v) of the closure where u is ``start`` and v is ``target``, if given; ``same`` holds them equal. A given end is walked from, not the closure filtered."""
    spark = edges.sparkSession
    if same and (start or target):
        start = target = start or target
    if start is not None:
        found = reachable(edges, spark.createDataFrame([(start,)], "v string")).select(F.lit(start).alias("u"), "v")
        return found if target is None else found.where(F.col("v") == target)
    if target is not None:
        reverse = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        return reachable(reverse, spark.createDataFrame([(target,)], "v string")).select(F.col("v").alias("u"), F.lit(target).alias("v"))
    whole = closure(edges)
    return whole.where("u = v") if same else whole


def _hops(known: DataFrame, added: DataFrame) -> DataFrame:
    """(u, v): an edge of ``added``, alone or with what ``known`` reaches beyond it."""
    beyond = added.join(known.select(F.col("u").alias("v"), F.col("v").alias("d")), "v").select("u", F.col("d").alias("v"))
    return added.select("u", "v").unionByName(beyond).distinct()


def _doubled(hops: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) of walks of one or more ``hops``, in about log2(longest) rounds.

    What is ``reach`` hops apart at most is known with its least number of hops; a pair that is further apart, but not
    twice as far, has a node exactly ``reach`` hops on. So a round joins those nodes' pairs alone, not all with all.
    """
    far = stored(hops.select("u", "v", F.lit(1).alias("hops")), "hops")
    for k in range(most_rounds):
        middle = far.where(F.col("hops") == 2**k).select("u", F.col("v").alias("w"))
        found = middle.join(far.select(F.col("u").alias("w"), "v", "hops"), "w").groupBy("u", "v").agg((F.min("hops") + 2**k).alias("hops"))
        new = stored(found.join(far, ["u", "v"], "left_anti"), "hops")
        if new.isEmpty():
            return far.select("u", "v")
        far = far.unionByName(new)
    raise RuntimeError(f"walks of more than 2^{most_rounds} hops")


def closure_with(known: DataFrame, added: DataFrame) -> DataFrame:
    """The closure ``known`` once the edges ``added`` (u, v) have come: only pairs that a new edge makes are worked out.

    A walk with new edges is a known pair or none, then one or more hops: a new edge with what is known beyond it.
    """
    added = stored(added.select("u", "v").distinct().join(known, ["u", "v"], "left_anti"), "added")
    beyond = stored(_doubled(_hops(known, added)), "beyond")
    led = known.withColumnRenamed("v", "w").join(beyond.withColumnRenamed("u", "w"), "w").select("u", "v")
    new = stored(beyond.unionByName(led).distinct().join(known, ["u", "v"], "left_anti"), "closure-new")
    return known.unionByName(new)


def closure_without(known: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """The closure ``known`` once ``removed`` (u, v) have gone and ``edges`` are left: delete and rederive.

    All pairs of nodes that reach a removed edge are taken out, and come back as those nodes' edges are added to the
    rest. The other nodes reach none of them: their pairs stay as they are.
    """
    gone = removed.select("u").distinct()
    doubted = stored(known.join(gone.withColumnRenamed("u", "v"), "v", "left_semi").select("u").unionByName(gone).distinct(), "doubted")
    kept = stored(known.join(doubted, "u", "left_anti"), "closure-known")
    return closure_with(kept, edges.join(doubted, "u", "left_semi"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label): what undirected ``edges`` (u, v) connect has one label, its least node.

    A round lowers each node's label to its neighbours' least and then to that one's own label, so that labels travel
    twice as far each time. A node with very many neighbours is added up before it is shuffled; joins have a row a node
    on one side.
    """
    both = stored(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = stored(label.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "labels")
        if not lower.where("moved").limit(1).count():
            return label
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("far"))
        label = stored(lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
    raise RuntimeError(f"no fixpoint in {most_rounds} rounds")


def closed_hierarchy(pairs: DataFrame) -> DataFrame:
    """(relation, child, ancestor): closure of child under parent in each relation, without values on a cycle."""
    key = lambda c: F.to_json(F.struct(F.col("relation").alias("r"), F.col(c).alias("v")))
    whole = closure(pairs.select(key("child").alias("u"), key("parent").alias("v"))).select(
        F.get_json_object("u", "$.r").alias("relation"), F.get_json_object("u", "$.v").alias("child"), F.get_json_object("v", "$.v").alias("ancestor"))
    cyclic = whole.where("child = ancestor").select("relation", F.col("child").alias("bad")).distinct()
    clean = whole.join(cyclic, (whole.relation == cyclic.relation) & (whole.child == cyclic.bad), "left_anti")
    return clean.join(cyclic, (clean.relation == cyclic.relation) & (clean.ancestor == cyclic.bad), "left_anti")
