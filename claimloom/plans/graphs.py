"""Graphs over all customers and suppliers, and the queries of routes and of a closure kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimloom.functions.storage import shared_dir
from claimloom.operators import graph
from claimloom.plans.registry import query
from claimloom.plans.triples import table
from claimloom.streaming import freshness, incremental


def _referrals(spark, sf_dir):
    """(u, v): each customer refers to the two that its key doubled, and one more, falls on."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    m = F.lit(c.count())
    return c.select(key.cast("string").alias("u"), F.explode(F.array((key * 2 % m).cast("string"), ((key * 2 + 1) % m).cast("string"))).alias("v"))


def _starts(spark, sf_dir):
    """The first customer of each nation."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").cast("string").alias("v")).select("v")


REFERRALS = """m AS (SELECT count(*) AS m FROM customer),
refers AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS u, CAST(unnest([c_custkey * 2 % m, (c_custkey * 2 + 1) % m]) AS VARCHAR) AS v FROM customer, m),
starts AS (SELECT CAST(min(c_custkey) AS VARCHAR) AS start FROM customer GROUP BY c_nationkey),
walk AS (SELECT start, v, 1 AS hops FROM starts JOIN refers ON u = start UNION SELECT w.start, r.v, w.hops + 1 FROM walk w JOIN refers r ON r.u = w.v WHERE w.hops < 24),
levels AS (SELECT start, v, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY 1, 2),
reached AS (SELECT l.start, l.v, l.hops, min(r.u) AS parent FROM levels l JOIN refers r ON r.v = l.v LEFT JOIN levels p ON p.start = l.start AND p.v = r.u AND p.hops = l.hops - 1 WHERE CASE WHEN l.hops = 1 THEN r.u = l.start ELSE p.v IS NOT NULL END GROUP BY ALL)"""


@query(f"WITH RECURSIVE {REFERRALS} SELECT start, v, hops, parent FROM reached")
def R3_routes_of_all_starts(spark, sf_dir):
    return graph.breadth_first(_referrals(spark, sf_dir), _starts(spark, sf_dir))


@query(f"""WITH RECURSIVE {REFERRALS}, line AS (SELECT start, v, hops, start || '>' || v AS route FROM reached WHERE hops = 1 UNION ALL SELECT r.start, r.v, r.hops, l.route || '>' || r.v FROM line l JOIN reached r ON r.start = l.start AND r.parent = l.v AND r.hops = l.hops + 1)
  SELECT start, v, route FROM line""")
def R3_routes_as_written(spark, sf_dir):
    return graph.routes(graph.breadth_first(_referrals(spark, sf_dir), _starts(spark, sf_dir)))


@query(f"""WITH RECURSIVE {REFERRALS.replace("SELECT CAST(min(c_custkey) AS VARCHAR) AS start FROM customer GROUP BY c_nationkey", "SELECT min(u) AS start FROM refers")}, t AS (SELECT min(v) AS v FROM reached),
  back AS (SELECT v AS node, hops AS step, parent FROM reached WHERE v = (SELECT v FROM t) UNION ALL SELECT b.parent, b.step - 1, r.parent FROM back b LEFT JOIN reached r ON r.v = b.parent AND b.step > 1 AND r.hops = b.step - 1 WHERE b.step > 0)
  SELECT (SELECT start FROM starts) AS start, (SELECT v FROM t) AS v, CAST(step AS INTEGER) AS step, node FROM back""")
def R4_first_route(spark, sf_dir):
    return graph.first_route(_referrals(spark, sf_dir))


@query(f"WITH RECURSIVE {REFERRALS}, r AS (SELECT u FROM refers WHERE v = '7' UNION SELECT e.u FROM r JOIN refers e ON e.v = r.u) SELECT u, '7' AS v FROM r")
def F7_paths_to_a_target(spark, sf_dir):
    return graph.paths(_referrals(spark, sf_dir), target="7")


#: Three batches of changes to edges between suppliers: all double, then some are doubled and one, others go, also within cycles.
CHANGES = [("add", "s_suppkey * 2 % m", "true", 0), ("add", "(s_suppkey * 2 + 1) % m", "s_suppkey % 3 = 0", 1), ("remove", "s_suppkey * 2 % m", "s_suppkey % 5 = 1", 1), ("remove", "(s_suppkey * 2 + 1) % m", "s_suppkey % 6 = 0", 2), ("add", "s_suppkey * 2 % m", "s_suppkey % 10 = 1", 2)]


@query("""WITH RECURSIVE m AS (SELECT count(*) AS m FROM supplier),
  e AS (SELECT s_suppkey AS u, s_suppkey * 2 % m AS v FROM supplier, m WHERE s_suppkey % 5 <> 1 OR s_suppkey % 10 = 1 UNION SELECT s_suppkey, (s_suppkey * 2 + 1) % m FROM supplier, m WHERE s_suppkey % 3 = 0 AND s_suppkey % 6 <> 0),
  p AS (SELECT u, v FROM e UNION SELECT p.u, e.v FROM p JOIN e ON p.v = e.u) SELECT CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v FROM p""")
def ST1_maintained_closure(spark, sf_dir):
    """The closure after three batches of a stream of changes, none of which works it out anew."""
    at = f"{shared_dir(spark)}/edge-changes-{uuid.uuid4().hex}"
    s = table(spark, sf_dir, "supplier")
    s = s.select("s_suppkey", F.lit(s.count()).alias("m"))
    schema = "op string, u string, v string, at int"
    for batch in sorted({b for *_, b in CHANGES}):
        parts = [s.where(where).select(F.lit(op).alias("op"), F.col("s_suppkey").cast("string").alias("u"), F.expr(v).cast("string").alias("v"), F.lit(b).alias("at")) for op, v, where, b in CHANGES if b == batch]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        whole.coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        incremental.maintain_closure(stream, f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return incremental.current_closure(spark, f"{at}/state")


@query("""WITH log AS (SELECT user_id, max(ts) FILTER (event_id % 97 <> 0) AS last FROM events GROUP BY 1), now AS (SELECT max(ts) AS t FROM events)
  SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(last) AS last_us FROM log, now WHERE last IS NULL OR epoch_ms(last) + 21600000 <= epoch_ms(t)""")
def ST2_due_by_timers(spark, sf_dir):
    """Users of the event log whose last check is six hours old at its end; some entries are torn."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", freshness.PROVIDER)
    at = f"{shared_dir(spark)}/freshness-{uuid.uuid4().hex}"
    log = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 97 == 0, F.lit("torn")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("checked_at"), F.col("ts").cast("timestamp").alias("ts"))
    log.repartitionByRange(4, "ts").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{at}/in")
    found = freshness.due(stream, 0.25, "user_id", time_col="ts")
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    events = spark.read.schema(found.schema).parquet(f"{at}/out")
    return events.groupBy("id").agg(F.unix_micros(F.max("last")).alias("last_us"))
