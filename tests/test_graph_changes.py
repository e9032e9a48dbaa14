"""Routes, and closures kept up to date, against plain loops."""

import random

from pyspark.sql import functions as F

from claimloom.functions.storage import stored
from claimloom.operators import graph
from claimloom.streaming import freshness, incremental


def brute(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= more
    return out


def frame(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "u string, v string")


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_closure_after_any_changes(spark):
    rng = random.Random(11)
    edges = {(a, b) for a, b in zip("abcdef", "bcdefa")} | {("x", "y")}  # a cycle
    known = graph.closure(frame(spark, edges))
    for turn in range(4):
        gone = {("b", "c")} if turn == 0 else set(rng.sample(sorted(edges), min(len(edges), 3)))
        edges -= gone
        known = graph.closure_without(known, frame(spark, edges), frame(spark, gone))
        assert rows(known) == brute(edges)
        new = {(rng.choice("abcdefxyz"), rng.choice("abcdefxyz")) for _ in range(3)}
        edges |= new
        known = graph.closure_with(known, frame(spark, new))
        assert rows(known) == brute(edges)


def test_a_stream_of_changes(spark, tmp_path):
    schema = "op string, u string, v string, at int"
    batches = [[("add", "a", "b", 1), ("add", "b", "a", 2), ("add", "b", "c", 3)], [("remove", "b", "a", 4), ("add", "c", "d", 5), ("add", "z", "z", 6), ("remove", "z", "z", 6)], [("remove", "a", "b", 7), ("remove", "q", "q", 7), ("add", "a", "b", 8)]]
    want = [{("a", "b"), ("b", "a"), ("b", "c")}, {("a", "b"), ("b", "c"), ("c", "d")}, {("a", "b"), ("b", "c"), ("c", "d")}]
    for batch, edges in zip(batches, want, strict=True):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.maintain_closure(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/state", f"file://{tmp_path}/check").awaitTermination()
        assert rows(incremental.current_closure(spark, f"file://{tmp_path}/state")) == brute(edges)


def test_routes_of_several_starts(spark):
    e = frame(spark, [tuple(x) for x in "AB BC CD AC DA XY".split()])
    seeds = spark.createDataFrame([("A",), ("X",), ("none",)], "v string")
    reached = graph.breadth_first(e, seeds)
    assert rows(reached.select("start", "v", "hops", "parent")) == {("A", "B", 1, "A"), ("A", "C", 1, "A"), ("A", "D", 2, "C"), ("A", "A", 3, "D"), ("X", "Y", 1, "X")}
    line = frame(spark, [(f"n{k:02}", f"n{k + 1:02}") for k in range(20)])
    walked = graph.steps(graph.breadth_first(line, spark.createDataFrame([("n00",)], "v string")))
    assert sorted((r.step, r.node) for r in walked.where("v = 'n19'").collect()) == [(k, f"n{k:02}") for k in range(20)]
    assert [r.node for r in graph.first_route(e).orderBy("step").collect()] == ["A", "C", "D", "A"]
    assert rows(graph.paths(e, target="D")) == {(x, "D") for x in "ABCD"} and rows(graph.paths(e, "X", "Y")) == {("X", "Y")}
    assert rows(graph.paths(e, "X", same=True)) == set() and rows(graph.paths(e, same=True)) == {(x, x) for x in "ABCD"}
    assert graph.steps(graph.breadth_first(e.where("false"), seeds)).count() == 0


def test_due_by_timers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", freshness.PROVIDER)
    schema = "id string, checked_at string, at timestamp"
    batches = [
        [("a", "2024-01-01T00:00:00", "2024-01-01"), ("b", "2024-01-01T12:00:00", "2024-01-01"), ("torn", "yesterday", "2024-01-01"), ("future", "2024-03-01", "2024-01-01"), (None, "2024-01-01", "2024-01-01")],
        [("b", "2024-01-02T12:00:00", "2024-01-03"), ("torn", "2024-01-03", "2024-01-03")],  # the watermark passes a's time; b was checked again
        [("c", "2024-01-05", "2024-01-05"), ("c", "", "2024-01-05")],
    ]
    got = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "id string, checked_at string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = freshness.due(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2)
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        now = sorted((r.id, str(r.last)) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect())
        got.append([x for x in now if x not in sum(got, [])])
    assert got == [[("torn", "None")], [("a", "2024-01-01 00:00:00")], [("b", "2024-01-02 12:00:00"), ("torn", "2024-01-03 00:00:00")]]


def test_a_long_cycle_is_closed_in_few_rounds(spark, monkeypatch):
    """A round once grew each walk by one edge: 64 rounds, each of which wrote the closure again."""
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append(name) or stored(df, name))
    cycle = {(f"n{k:02}", f"n{(k + 1) % 64:02}") for k in range(64)}
    whole = graph.closure_with(frame(spark, cycle).where("false"), frame(spark, cycle | {("n00", "n32"), ("x", "n07")}))
    assert whole.count() == 64 * 65 and len(written) < 15
    less = graph.closure_without(whole, frame(spark, cycle | {("x", "n07")}), frame(spark, {("n00", "n32")}))
    assert less.count() == 64 * 65 and len(written) < 30
