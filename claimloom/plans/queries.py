"""One registered query an operator, over the claims derived from the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.functions.ordering import numbered
from claimloom.functions.storage import names, stored
from claimloom.operators import audit, conflicts, facts as K, graph, merge, records, text_search
from claimloom.plans.registry import query
from claimloom.plans.triples import ATTRIBUTES, ENGINE_SQL, FACTS, IN_ATTRIBUTES, SINGLE_VALUED, TRADES, facts, table, trades

EDGES = ENGINE_SQL + f",\nedges AS (SELECT DISTINCT subject AS u, object AS v FROM engine WHERE relation NOT IN {IN_ATTRIBUTES})"
SINGLE = "(" + ",".join(f"'{x}'" for x in SINGLE_VALUED) + ")"
FILE = "split_part(source, '#', 1)"
SUM = lambda x: f"CAST(sum({x}) AS BIGINT)"


def _aliases(spark):
    return spark.createDataFrame([("placed_by", "ordered_by"), ("in_nation", "located_in"), ("in_region", "located_in")], "raw string, canonical string")


ALIASES = "aliases(raw, canonical) AS (VALUES ('placed_by','ordered_by'), ('in_nation','located_in'), ('in_region','located_in'))"


def _nations_below(spark, sf_dir):
    """in_nation: nation under its region's name as a declared value hierarchy."""
    return table(spark, sf_dir, "nation").select(F.lit("in_nation").alias("relation"), F.concat(F.lit("nation:"), "n_nationkey").alias("child"), F.concat(F.lit("region:"), "n_regionkey").alias("parent"))


# filters and projections

@query(f"WITH {FACTS} SELECT * FROM facts WHERE status IN ('confirmed','accepted')")
def F1_engine_facts(spark, sf_dir):
    return K.engine_facts(facts(spark, sf_dir))


@query(f"WITH {FACTS} SELECT * FROM facts WHERE status IN ('needs_review','candidate')")
def F2_review_facts(spark, sf_dir):
    return K.review_facts(facts(spark, sf_dir))


@query(f"WITH {ENGINE_SQL}, {ALIASES} SELECT subject, relation, object FROM engine WHERE object = 'customer:7' AND (relation = 'ordered_by' OR relation IN (SELECT raw FROM aliases WHERE canonical = 'ordered_by'))")
def F4_relation_pattern(spark, sf_dir):
    return K.matching(K.engine_facts(facts(spark, sf_dir)), relation="ordered_by", obj="customer:7", aliases=_aliases(spark)).select(*K.TRIPLE)


@query(f"WITH {ENGINE_SQL} SELECT subject, object FROM engine WHERE relation = 'in_nation' AND (object = 'region:1' OR object IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1))")
def F5_object_or_descendant(spark, sf_dir):
    closed = graph.closed_hierarchy(_nations_below(spark, sf_dir))
    return K.matching(K.engine_facts(facts(spark, sf_dir)), relation="in_nation", obj="region:1", hierarchy=closed).select("subject", "object")


@query(f"WITH {FACTS} SELECT relation, relation IN {IN_ATTRIBUTES} AS is_attribute, count(*) AS n FROM facts GROUP BY ALL")
def F8_attribute_relations(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("relation", F.col("relation").isin(*ATTRIBUTES).alias("is_attribute")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT subject, relation, object FROM facts WHERE subject LIKE 'customer:1%' AND relation = 'in_nation'")
def F12_triple_filter(spark, sf_dir):
    return facts(spark, sf_dir).where(F.col("subject").startswith("customer:1") & (F.col("relation") == "in_nation")).select(*K.TRIPLE)


@query(f"WITH {FACTS} SELECT subject, relation, object, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, count(DISTINCT {FILE}) AS n_files FROM facts WHERE contains(lower(subject), 'urgent') OR contains(lower(relation), 'urgent') OR contains(lower(object), 'urgent') GROUP BY ALL")
def F13_fact_search(spark, sf_dir):
    return K.search(facts(spark, sf_dir), "Urgent")


@query(r"SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def X82_json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# joins and rules

@query(f"WITH {EDGES} SELECT u, v FROM edges")
def J1_edges(spark, sf_dir):
    return K.edges(facts(spark, sf_dir), ATTRIBUTES)


@query(f"WITH {ENGINE_SQL} SELECT DISTINCT subject FROM engine WHERE relation = 'placed_by' AND subject IN (SELECT subject FROM engine WHERE relation = 'ordered_on') AND subject IN (SELECT subject FROM engine WHERE relation = 'has_total')")
def J3_rule_conjunction(spark, sf_dir):
    wanted = ("placed_by", "ordered_on", "has_total")
    rows = K.engine_facts(facts(spark, sf_dir)).where(F.col("relation").isin(*wanted))
    return rows.groupBy("subject").agg(F.countDistinct("relation").alias("n")).where(F.col("n") == len(wanted)).select("subject")


@query(f"WITH {EDGES} SELECT u, v FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.u = e.v)")
def J4_rule_negation(spark, sf_dir):
    e = K.edges(facts(spark, sf_dir), ATTRIBUTES)
    return e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_anti").select("u", "v")


@query(f"WITH {ENGINE_SQL} SELECT subject, CAST(replace(object, '-', '') AS BIGINT) AS day FROM engine WHERE relation = 'ordered_on' AND CAST(replace(object, '-', '') AS BIGINT) >= 19970701")
def J5_typed_comparison(spark, sf_dir):
    rows = K.engine_facts(facts(spark, sf_dir)).where("relation = 'ordered_on'")
    return rows.select("subject", S.parse_date(F.col("object")).alias("day")).where("day >= 19970701")


@query(f"WITH {ENGINE_SQL}, {ALIASES} SELECT coalesce(canonical, relation) AS relation, count(*) AS n FROM engine LEFT JOIN aliases ON relation = raw GROUP BY 1")
def J7_alias_resolution(spark, sf_dir):
    return K.canonical(K.engine_facts(facts(spark, sf_dir)), _aliases(spark)).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"WITH {ENGINE_SQL} SELECT e.subject, 'region:' || n_regionkey AS ancestor FROM engine e JOIN nation ON e.object = 'nation:' || n_nationkey WHERE relation = 'in_nation'")
def J9_hierarchy_join(spark, sf_dir):
    closed = graph.closed_hierarchy(_nations_below(spark, sf_dir)).where("relation = 'in_nation'").select(F.col("child").alias("object"), "ancestor")
    return K.engine_facts(facts(spark, sf_dir)).where("relation = 'in_nation'").join(closed, "object").select("subject", "ancestor")


#: The files on disk: those of suppliers in debt were withdrawn.
KNOWN = f"known AS (SELECT DISTINCT {FILE} AS file FROM facts WHERE {FILE} NOT IN (SELECT 'sources/supplier_' || s_suppkey || '.md' FROM supplier WHERE s_acctbal < 0))"


def _known(spark, sf_dir, rows):
    withdrawn = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("sources/supplier_"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("file"))
    return rows.select(S.source_file(F.col("source")).alias("file")).distinct().join(withdrawn, "file", "left_anti")


@query(f"WITH {FACTS}, {KNOWN} SELECT relation, count(*) AS n FROM facts WHERE {FILE} NOT IN (SELECT file FROM known) GROUP BY 1")
def J11_unknown_sources(spark, sf_dir):
    rows = facts(spark, sf_dir)
    per = stored(merge.per_file(rows), "per-file")  # read twice
    return per.join(_known(spark, sf_dir, per.withColumnRenamed("file", "source")), "file", "left_anti").groupBy("relation").agg(F.sum("n").alias("n"))


@query(f"WITH {ENGINE_SQL} SELECT DISTINCT subject, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN toxic = 1 THEN 'superseded' ELSE status END AS status FROM engine JOIN labels ON subject = 'order:' || doc_id WHERE relation = 'placed_by'")
def J12_status_ratchet(spark, sf_dir):
    rulings = table(spark, sf_dir, "labels").select(F.concat(F.lit("order:"), "doc_id").alias("subject"), "quality", "toxic")
    rows = K.engine_facts(facts(spark, sf_dir)).where("relation = 'placed_by'").join(rulings, "subject")
    return rows.select("subject", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").when(F.col("toxic") == 1, "superseded").otherwise(F.col("status")).alias("status")).distinct()


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def J16_uncovered_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'P'),
  n AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice < 50000 THEN '5-LOW' ELSE o_orderpriority END AS p, o_orderstatus AS s FROM orders WHERE o_totalprice < 250000)
  SELECT o.k AS k, CASE WHEN n.k IS NULL THEN 'missing' WHEN o.p IS DISTINCT FROM n.p THEN 'changed' ELSE 'unchanged' END AS state,
  CASE WHEN n.k IS NOT NULL AND o.p IS DISTINCT FROM n.p THEN 'p' ELSE '' END AS differ FROM o LEFT JOIN n USING (k)""")
def J22_ledger_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("total"))
    upstream = o.where("total < 250000").withColumn("p", F.when(F.col("total") < 50000, "5-LOW").otherwise(F.col("p")))
    return records.changes(o.where("s <> 'P'").drop("total"), upstream, "k", ("p", "s"))


@query("""WITH log AS (SELECT user_id, max(ts) AS checked_at FROM events GROUP BY 1), now AS (SELECT max(ts) AS t FROM events)
  SELECT c_custkey AS user_id FROM customer LEFT JOIN log ON c_custkey = user_id, now WHERE checked_at IS NULL OR checked_at <= t - INTERVAL 2 DAY""")
def J24_freshness(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return records.due(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), events.select("user_id", F.col("ts").alias("checked_at")), "user_id", now, 2)


@query(r"""WITH words AS (SELECT DISTINCT p_name AS name, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{Nd}]+'), lambda w: len(w) >= 2))) AS word FROM part),
  n AS (SELECT word, count(*) AS n_names FROM words GROUP BY 1 HAVING count(*) > 1) SELECT word, name, n_names FROM words JOIN n USING (word)""")
def J25_entity_shared_words(spark, sf_dir):
    return audit.shared_tokens(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct())


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM conversations""")
def J27_anchor_carried_forward(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("anchor"))


# aggregates

@query(f"WITH {ENGINE_SQL} SELECT subject, relation, object, count(DISTINCT source) AS n_sources FROM engine WHERE source <> '' GROUP BY ALL")
def A1_corroboration(spark, sf_dir):
    return K.corroboration(facts(spark, sf_dir))


@query(f"WITH {ENGINE_SQL} SELECT subject, relation, object, count(DISTINCT {FILE}) AS n_files, string_agg(DISTINCT {FILE}, ',' ORDER BY {FILE}) AS files, CAST(max(CAST(confidence AS DECIMAL(3,2))) AS VARCHAR) AS best_confidence, bool_or(source = '') AS missing_source FROM engine GROUP BY ALL")
def A2_fact_signals(spark, sf_dir):
    return K.signals(facts(spark, sf_dir))


@query(f"WITH {ENGINE_SQL} SELECT DISTINCT subject, relation, object FROM engine")
def A3_distinct_atoms(spark, sf_dir):
    return K.atoms(facts(spark, sf_dir))


@query(f"WITH {ENGINE_SQL}, {ALIASES} SELECT DISTINCT subject, canonical AS relation, object FROM engine JOIN aliases ON relation = raw")
def A4_canonical_atoms(spark, sf_dir):
    return K.canonical_atoms(facts(spark, sf_dir), _aliases(spark))


@query(f"WITH {ENGINE_SQL} SELECT relation, subject, count(DISTINCT object) AS n_objects FROM engine GROUP BY ALL")
def A5_count_objects(spark, sf_dir):
    return K.engine_facts(facts(spark, sf_dir)).groupBy("relation", "subject").agg(F.countDistinct("object").alias("n_objects"))


@query(f"WITH {ENGINE_SQL} SELECT subject, relation, count(DISTINCT object) AS n_values, string_agg(DISTINCT object, '|' ORDER BY object) AS competing FROM engine WHERE relation IN {SINGLE} GROUP BY 1, 2 HAVING count(DISTINCT object) > 1")
def A6_conflicts(spark, sf_dir):
    return conflicts.conflicts(facts(spark, sf_dir), SINGLE_VALUED, types={"has_size": "number"})


@query(f"WITH {ENGINE_SQL}, v AS (SELECT subject, relation, object, count(DISTINCT source) AS n_sources FROM engine WHERE relation IN {SINGLE} GROUP BY ALL) SELECT * FROM v WHERE (subject, relation) IN (SELECT (subject, relation) FROM v GROUP BY subject, relation HAVING count(*) > 1)")
def A8_competing_values(spark, sf_dir):
    return conflicts.competing(facts(spark, sf_dir), SINGLE_VALUED).select("subject", "relation", "object", "n_sources")


@query(f"""WITH {FACTS}, b AS (SELECT status, subject AS entity FROM facts UNION ALL SELECT status, object FROM facts WHERE object <> subject)
  SELECT entity, count(*) AS n_facts, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses,
  regexp_matches(entity, '^-?[0-9][0-9,]*([.][0-9]+)?$') OR regexp_matches(entity, '^[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?$') OR regexp_matches(entity, '^[a-z]+[(].*[)]$') AS literal FROM b GROUP BY 1""")
def A10_entity_counts(spark, sf_dir):
    return audit.entity_counts(facts(spark, sf_dir))


@query(f"WITH {FACTS} SELECT kind, name, count(*) AS n FROM (SELECT 'entity' AS kind, subject AS name FROM facts UNION ALL SELECT 'entity', object FROM facts UNION ALL SELECT 'relation', relation FROM facts) GROUP BY ALL")
def A11_vocabulary_usage(spark, sf_dir):
    return K.usage(facts(spark, sf_dir))


@query(f"WITH {FACTS} SELECT coalesce(relation, '*') AS relation, coalesce(status, '*') AS status, count(*) AS n, count(DISTINCT subject) AS n_subjects FROM facts GROUP BY GROUPING SETS ((relation, status), (relation), (status), ())")
def A12_status_dashboard(spark, sf_dir):
    rows = facts(spark, sf_dir)
    cells = rows.groupingSets([("relation", "status"), ("relation",), ("status",), ()], "relation", "status").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"))
    return cells.select(F.coalesce("relation", F.lit("*")).alias("relation"), F.coalesce("status", F.lit("*")).alias("status"), "n", "n_subjects")


@query(f"WITH {FACTS} SELECT {FILE} AS file, count(*) AS n_facts, count(DISTINCT subject) AS n_subjects FROM facts GROUP BY 1")
def A13_facts_per_source(spark, sf_dir):
    return K.per_source(facts(spark, sf_dir))


@query(f"WITH {ENGINE_SQL} SELECT subject AS entity FROM engine UNION SELECT object FROM engine WHERE relation NOT IN {IN_ATTRIBUTES}")
def A14_entity_set(spark, sf_dir):
    return K.entities(K.engine_facts(facts(spark, sf_dir)), ATTRIBUTES)


@query(f"WITH {ENGINE_SQL} SELECT DISTINCT relation FROM engine")
def A16_allowed_relations(spark, sf_dir):
    return K.engine_facts(facts(spark, sf_dir)).select("relation").distinct()


@query(f"""WITH {FACTS} SELECT count(*) AS n, CAST(coalesce(sum(CAST('0x' || substr(md5(subject || chr(31) || relation || chr(31) || object), 1, 10) AS BIGINT)), 0) AS BIGINT) AS fingerprint
  FROM (SELECT DISTINCT subject, relation, object FROM facts WHERE status IN ('needs_review','candidate'))""")
def A29_review_snapshot(spark, sf_dir):
    return audit.snapshot(facts(spark, sf_dir))


@query("""SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good,
  round((sum(quality) / count(*) + 1.9208 / count(*) - 1.96 * sqrt(sum(quality) / count(*) * (1 - sum(quality) / count(*)) / count(*) + 0.9604 / (count(*) * count(*)))) / (1 + 3.8416 / count(*)), 6) AS low,
  round((sum(quality) / count(*) + 1.9208 / count(*) + 1.96 * sqrt(sum(quality) / count(*) * (1 - sum(quality) / count(*)) / count(*) + 0.9604 / (count(*) * count(*)))) / (1 + 3.8416 / count(*)), 6) AS high
  FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def A34_wilson_interval(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    n, k = F.count("*"), F.sum("quality").cast("long")
    p, z = k / n, 1.96
    half = z * F.sqrt(p * (1 - p) / n + z * z / 4 / (n * n))
    side = lambda sign: F.round((p + z * z / 2 / n + sign * half) / (1 + z * z / n), 6)
    return rows.groupBy("lang").agg(n.alias("n"), k.alias("good"), side(-1).alias("low"), side(1).alias("high"))


@query(f"""WITH {FACTS}, r AS (SELECT *, {FILE} AS file, row_number() OVER (PARTITION BY subject, relation, object, {FILE} ORDER BY CASE status WHEN 'confirmed' THEN 0 WHEN 'accepted' THEN 1 WHEN 'needs_review' THEN 2 WHEN 'candidate' THEN 3 ELSE 4 END, source, confidence) AS n FROM facts)
  SELECT subject, relation, object, file, status, source FROM r WHERE n = 1""")
def A28_fold_copies(spark, sf_dir):
    rows = facts(spark, sf_dir)
    kept = merge.keyed(rows).select(*merge.KEY, "status", "source", "confidence")
    return K.first_by(kept, merge.KEY, [K.rank(F.col("status")), "source", "confidence"], rows).select(*merge.KEY, "status", "source")


# recursion

@query(f"WITH RECURSIVE {EDGES}, path AS (SELECT u, v FROM edges UNION SELECT p.u, e.v FROM path p JOIN edges e ON p.v = e.u) SELECT u, v FROM path")
def R1_closure_acyclic(spark, sf_dir):
    return graph.closure(K.edges(facts(spark, sf_dir), ATTRIBUTES))


@query(f"WITH RECURSIVE {TRADES}, path AS (SELECT u, v FROM trades UNION SELECT p.u, e.v FROM path p JOIN trades e ON p.v = e.u) SELECT u, v FROM path")
def R1_closure_cyclic(spark, sf_dir):
    return graph.closure(trades(spark, sf_dir))


@query(f"WITH RECURSIVE {TRADES}, path AS (SELECT u, v FROM trades UNION SELECT p.u, e.v FROM path p JOIN trades e ON p.v = e.u) SELECT u AS node FROM path WHERE u = v")
def F7_nodes_on_a_cycle(spark, sf_dir):
    return graph.closure(trades(spark, sf_dir)).where("u = v").select(F.col("u").alias("node"))


@query(f"WITH RECURSIVE {EDGES}, path AS (SELECT v FROM edges WHERE u = 'order:1' UNION SELECT e.v FROM path p JOIN edges e ON p.v = e.u) SELECT v AS node FROM path")
def F7_path_from_constant(spark, sf_dir):
    return graph.reachable(K.edges(facts(spark, sf_dir), ATTRIBUTES), spark.createDataFrame([("order:1",)], "v string")).select(F.col("v").alias("node"))


@query(f"""WITH RECURSIVE {TRADES}, start AS (SELECT min(u) AS s FROM trades), walk AS (SELECT v, 1 AS hops FROM trades, start WHERE u = s
  UNION SELECT e.v, w.hops + 1 FROM walk w JOIN trades e ON w.v = e.u WHERE w.hops < 25) SELECT v AS node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY 1""")
def R3_shortest_hops(spark, sf_dir):
    edges = trades(spark, sf_dir)
    return graph.reachable(edges, edges.agg(F.min("u").alias("v"))).select(F.col("v").alias("node"), F.col("hops").cast("int").alias("hops"))


@query("SELECT 'in_nation' AS relation, 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS ancestor FROM nation")
def R5_closed_hierarchy(spark, sf_dir):
    return graph.closed_hierarchy(_nations_below(spark, sf_dir)).distinct()


@query(f"WITH {ENGINE_SQL} SELECT DISTINCT subject FROM engine")
def R7_alive_subjects(spark, sf_dir):
    return K.engine_facts(facts(spark, sf_dir)).select("subject").distinct()


# windows, order, limits, sets

@query(f"WITH {FACTS}, r AS (SELECT DISTINCT subject, relation, object FROM facts WHERE status IN ('needs_review','candidate')) SELECT relation, subject, object, CAST(row_number() OVER (PARTITION BY relation ORDER BY subject, object) AS INTEGER) AS number FROM r")
def W11_numbered_queue(spark, sf_dir):
    rows = K.review_facts(facts(spark, sf_dir)).select(*K.TRIPLE).distinct()
    return numbered(rows.select("relation", "subject", "object"), ["relation"], ["subject", "object"], "number").withColumn("number", F.col("number").cast("int"))


@query("SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS round FROM part")
def W9_round_robin(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (-F.col("p_retailprice")).alias("_order"))
    return numbered(rows, ["p_brand"], ["_order", "p_partkey"], "round").select("p_partkey", "p_brand", F.col("round").cast("int").alias("round"))


@query(r"""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^0-9a-z]+', '-', 'g'), '-') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s)
  SELECT p_partkey, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS slug FROM n""")
def W10_distinct_slugs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", S.slug(F.col("p_type")).alias("slug"))
    return numbered(rows, ["slug"], ["p_partkey"], "k").select("p_partkey", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("k").cast("string"))).alias("slug"))


@query(r"""WITH h AS (SELECT doc_id, len(regexp_extract_all(' ' || replace(replace(lower(text), ' ', '  '), chr(10), '  ') || ' ', '[^a-z0-9]the[^a-z0-9]')) AS a, len(regexp_extract_all(' ' || replace(replace(lower(text), ' ', '  '), chr(10), '  ') || ' ', '[^a-z0-9]tion[^a-z0-9]')) AS b FROM documents)
  SELECT doc_id, CAST((a > 0)::INT + (b > 0)::INT AS INTEGER) AS coverage, CAST(a + b AS BIGINT) AS hits FROM h WHERE a + b > 0 ORDER BY coverage DESC, hits DESC, doc_id LIMIT 10""")
def T4_ranked_search(spark, sf_dir):
    return text_search.ranked(table(spark, sf_dir, "documents"), ["the", "tion"])


@query("""SELECT DISTINCT c_mktsegment AS name, CAST(levenshtein(lower(c_mktsegment), 'machinary') AS BIGINT) AS distance FROM customer WHERE levenshtein(lower(c_mktsegment), 'machinary') BETWEEN 1 AND 3 ORDER BY distance, name LIMIT 3""")
def T5_did_you_mean(spark, sf_dir):
    return text_search.nearest(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct(), "machinary")


@query(f"WITH {FACTS} SELECT {FILE} AS file, count(*) AS n FROM facts GROUP BY 1 ORDER BY n DESC, file LIMIT 20")
def T13_largest_sources(spark, sf_dir):
    return K.per_source(facts(spark, sf_dir)).select("file", F.col("n_facts").alias("n")).orderBy(F.desc("n"), "file").limit(20)


@query(f"WITH {FACTS} SELECT object AS value FROM facts EXCEPT SELECT subject FROM facts")
def U6_objects_never_subjects(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return rows.select(F.col("object").alias("value")).distinct().join(rows.select(F.col("subject").alias("value")).distinct(), "value", "left_anti")


@query(f"WITH {ENGINE_SQL}, gone AS (SELECT * FROM facts WHERE status = 'superseded') SELECT relation, subject FROM gone EXCEPT SELECT relation, subject FROM engine")
def U5_only_in_tombstones(spark, sf_dir):
    rows = facts(spark, sf_dir)
    gone = rows.where("status = 'superseded'").select("relation", "subject")
    return gone.subtract(K.engine_facts(rows).select("relation", "subject"))


# scalars

@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS day, CAST(strftime(o_orderdate, '%Y%m') || '01' AS BIGINT) AS month FROM orders")
def X60_parse_date(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_date(F.date_format(d, "yyyy.M.d")).alias("day"), S.parse_date(F.concat(F.lit("date("), F.date_format(d, "yyyy"), F.lit(", "), F.date_format(d, "M"), F.lit(")"))).alias("month"))


@query("SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 1000) AS BIGINT) AS scaled FROM orders")
def X62_parse_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_number_scaled(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("scaled"))


#: Ordinals by the part's key: all counters and spellings, some that are none.
_FORMS = ["%호", "제%위", "%번", "% 차", "%등", "제% 째", "%st", "%ND", "% rd", "%Th", "ordinal(%)", "Ordinal( % )", "%회", "제%", "%억", "x%th", "", "%. 호"]
_RANKS = 12  # the first so many forms are ordinals
_AMOUNTS = ["%원", "% 천", "%만원", "%억", "%조", 'amount(%,"억")', "Amount( %, 만 )", "%k", "제%호", "%  억", "amount(%)", "%,5억"]


@query(f"""WITH p AS (SELECT p_partkey, p_size, p_partkey % {len(_FORMS)} AS f, p_partkey % {len(_AMOUNTS)} AS a FROM part)
  SELECT p_partkey, CASE WHEN f < {_RANKS} THEN CAST(p_size AS BIGINT) END AS rank,
  CAST(CASE a WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 10000 WHEN 3 THEN p_size * 100000000::BIGINT WHEN 4 THEN p_size * 1000000000000::BIGINT WHEN 5 THEN p_size * 100000000::BIGINT WHEN 6 THEN p_size * 10000
    WHEN 9 THEN p_size * 100000000::BIGINT WHEN 11 THEN CAST(p_size || '5' AS BIGINT) * 100000000::BIGINT END AS BIGINT) AS amount FROM p""")
def X64_ordinals_and_amounts(spark, sf_dir):
    form = lambda forms: F.replace(F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("p_partkey") % len(forms) + 1).cast("int")), F.lit("%"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", S.parse_ordinal(form(_FORMS)).alias("rank"), S.parse_amount(form(_AMOUNTS)).alias("amount"))


#: Texts of thousandths from -0.100 to 1.199, with ties, gaps and what is no number.
_SHARE = "CASE WHEN event_id % 50 = 0 THEN 'n/a' WHEN event_id % 51 = 0 THEN NULL ELSE CASE WHEN event_id % 1300 < 100 THEN '-' ELSE '' END || (abs(event_id % 1300 - 100) // 1000) || '.' || lpad(CAST(abs(event_id % 1300 - 100) % 1000 AS VARCHAR), 3, '0') END"


@query(f"SELECT event_id, printf('%.2f', least(greatest(coalesce(TRY_CAST(t AS DOUBLE), 0.5), 0.0), 1.0)) AS confidence FROM (SELECT event_id, {_SHARE} AS t FROM events)")
def X66_confidence(spark, sf_dir):
    n = F.col("event_id") % 1300 - 100
    text = F.concat(F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 1000).cast("string"), F.lit("."), F.lpad((F.abs(n) % 1000).cast("string"), 3, "0"))
    shown = F.when(F.col("event_id") % 50 == 0, "n/a").when(F.col("event_id") % 51 != 0, text)
    return table(spark, sf_dir, "events").select("event_id", S.normalize_confidence(shown).alias("confidence"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '[^0-9a-z]+', ' ', 'g')) AS title, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower(strip_accents(p_name)), '[^0-9a-z]+', ' ', 'g')), ' '))), ',') AS words FROM part")
def X14_title_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.title_key(F.col("p_name")).alias("title"), F.array_join(F.array_sort(S.tokens(F.col("p_name"))), ",").alias("words"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS INTEGER) AS number FROM pages")
def X40_url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("int").alias("number"))


@query("SELECT o_orderkey, '10.5555/o.' || o_orderkey AS doi, CAST(o_orderkey AS VARCHAR) AS pmid, lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS arxiv FROM orders")
def X38_identifiers(spark, sf_dir):
    k = F.col("o_orderkey")
    four, five = F.lpad((k % 10000).cast("string"), 4, "0"), F.lpad((k % 100000).cast("string"), 5, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.doi(F.concat(F.lit("https://doi.org/10.5555/O."), k.cast("string"))).alias("doi"), S.pmid(F.concat(F.lit("PMID: "), k.cast("string"))).alias("pmid"), S.arxiv_id(F.concat(F.lit("arXiv:"), four, F.lit("."), five, F.lit("v2"))).alias("arxiv"))


# records and mutations

@query(r"""WITH p AS (SELECT p_partkey AS id, list_sort(list_distinct(string_split(trim(regexp_replace(lower(strip_accents(p_name)), '[^0-9a-z]+', ' ', 'g')), ' '))) AS w, p_brand AS surname, p_size AS year FROM part),
  m AS (SELECT a.id AS l_id, b.id AS r_id, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) AS score FROM p a JOIN p b ON a.surname = b.surname AND abs(a.year - b.year) <= 1 AND a.id <> b.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS n FROM m WHERE score >= 0.8) SELECT l_id, r_id, score FROM r WHERE n = 1""")
def J21_fuzzy_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("surname"), F.col("p_size").alias("year"))
    return records.fuzzy_pairs(p, p)


@query("""WITH new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'd' || c_nationkey END AS doi, CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_custkey % 50 END AS pmid, CAST(NULL AS VARCHAR) AS arxiv FROM customer),
  known AS (SELECT s_suppkey AS record, 'd' || s_nationkey AS doi, 'p' || s_suppkey AS pmid FROM supplier), d AS (SELECT doi, min(record) AS m FROM known GROUP BY 1), p AS (SELECT pmid, min(record) AS m FROM known GROUP BY 1)
  SELECT id, CASE WHEN d.m IS NOT NULL THEN 'doi' WHEN p.m IS NOT NULL THEN 'pmid' END AS by, coalesce(d.m, p.m) AS match FROM new LEFT JOIN d ON new.doi = d.doi LEFT JOIN p ON new.pmid = p.pmid""")
def J20_exact_resolution(spark, sf_dir):
    key = F.col("c_custkey")
    new = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 3 == 0, F.concat(F.lit("d"), "c_nationkey")).alias("doi"), F.when(key % 2 == 0, F.concat(F.lit("p"), (key % 50).cast("string"))).alias("pmid"), F.lit(None).cast("string").alias("arxiv"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record"), F.concat(F.lit("d"), "s_nationkey").alias("doi"), F.concat(F.lit("p"), "s_suppkey").alias("pmid"), F.lit(None).cast("string").alias("arxiv"))
    return records.resolve_exact(new, known).select("id", "by", "match")


#: A last table that decided otherwise on some keys and did not have those of little confidence.
MERGE = f"""{FACTS}, {KNOWN}, runs AS (SELECT *, {FILE} AS file, row_number() OVER (PARTITION BY subject, relation, object, {FILE} ORDER BY source, status, confidence) AS n FROM facts WHERE {FILE} IN (SELECT file FROM known)),
  new AS (SELECT * FROM runs WHERE n = 1),
  last AS (SELECT * EXCLUDE (n, status), CASE right(confidence, 1) WHEN '0' THEN 'superseded' WHEN '1' THEN 'confirmed' WHEN '2' THEN 'needs_review' ELSE status END AS status
    FROM (SELECT *, {FILE} AS file, row_number() OVER (PARTITION BY subject, relation, object, {FILE} ORDER BY source, status, confidence) AS n FROM facts) WHERE n = 1 AND confidence >= '0.30')"""


def _last(rows):
    one = K.first_by(merge.placed(merge.keyed(rows), rows), merge.KEY, ["source", "status", "confidence"]).where("confidence >= '0.30'")
    digit = F.right("confidence", F.lit(1))
    return one.withColumn("status", F.when(digit == "0", "superseded").when(digit == "1", "confirmed").when(digit == "2", "needs_review").otherwise(F.col("status")))


@query(f"""WITH {MERGE}, kept AS (SELECT new.subject, new.relation, new.object, new.file, CASE WHEN last.status = 'superseded' THEN 'superseded' WHEN new.status <> 'superseded' AND last.status IN ('confirmed','accepted') THEN last.status
    WHEN new.status IN ('confirmed','accepted') AND last.status = 'needs_review' THEN 'needs_review' ELSE new.status END AS status FROM new LEFT JOIN last USING (subject, relation, object, file)),
  every AS (SELECT * FROM kept UNION ALL SELECT subject, relation, object, file, status FROM last WHERE status = 'superseded' AND (subject, relation, object, file) NOT IN (SELECT (subject, relation, object, file) FROM new))
  SELECT subject, relation, object, file, status FROM every""")
def M1_merge_rebuild(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return merge.rebuild(rows, _last(rows), _known(spark, sf_dir, rows), with_file=True).select(*merge.KEY, "status")


@query(f"""WITH {MERGE} SELECT subject, relation, object, file FROM last WHERE status <> 'superseded' AND (subject, relation, object, file) NOT IN (SELECT (subject, relation, object, file) FROM new)""")
def J14_destroyed_decisions(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return merge.lost(rows, _last(rows), _known(spark, sf_dir, rows))


#: A table with several rows a key, decided otherwise than the runs, and with a status that is none.
RULED = f"ruled AS (SELECT * EXCLUDE (status), CASE right(confidence, 1) WHEN '0' THEN 'superseded' WHEN '1' THEN 'confirmed' WHEN '2' THEN 'needs_review' WHEN '3' THEN 'weird' ELSE status END AS status, {FILE} AS file FROM facts WHERE confidence >= '0.30')"
DECIDED = "('confirmed','accepted','superseded')"


@query(f"""WITH {FACTS}, {KNOWN}, {RULED},
  t AS (SELECT subject, relation, object, file, string_agg(DISTINCT status, ',' ORDER BY status) AS status, count(DISTINCT status) > 1 AS many, bool_or(status = 'weird') AS odd FROM ruled GROUP BY ALL),
  r AS (SELECT subject, relation, object, {FILE} AS file, string_agg(DISTINCT status, ',' ORDER BY status) AS status, count(DISTINCT status) > 1 AS many FROM facts WHERE {FILE} IN (SELECT file FROM known) GROUP BY subject, relation, object, {FILE})
  SELECT subject, relation, object, file, CASE WHEN t.status IS NULL THEN 'run-only' WHEN t.odd THEN 'status-unrecognised' WHEN t.many THEN 'ambiguous-table' WHEN r.status IS NULL THEN 'table-only' WHEN r.many THEN 'runs-disagree' WHEN t.status = r.status THEN 'same'
    WHEN t.status IN {DECIDED} AND r.status NOT IN {DECIDED} THEN 'repair' WHEN t.status = 'superseded' AND r.status IN ('confirmed','accepted') THEN 'repair'
    WHEN t.status IN {DECIDED} AND r.status IN {DECIDED} THEN 'both-decided' WHEN r.status IN {DECIDED} THEN 'table-pending-run-decided' ELSE 'both-pending' END AS class
  FROM t FULL JOIN r USING (subject, relation, object, file)""")
def J15_reconciliation(spark, sf_dir):
    rows = facts(spark, sf_dir)
    runs = merge.keyed(rows).join(names(_known(spark, sf_dir, rows), "known"), "file", "left_semi")
    digit = F.right("confidence", F.lit(1))
    ruled = rows.where("confidence >= '0.30'").withColumn("status", F.when(digit == "0", "superseded").when(digit == "1", "confirmed").when(digit == "2", "needs_review").when(digit == "3", "weird").otherwise(F.col("status")))
    return merge.reconciliation(ruled, runs).select(*merge.KEY, "class")


@query(r"""WITH v AS (SELECT DISTINCT 'has_segment' AS relation, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) WHEN c_acctbal < 500 THEN substr(c_mktsegment, 1, 4) || '-' || substr(c_mktsegment, 5) ELSE c_mktsegment END AS object FROM customer UNION SELECT 'has_brand', CASE WHEN p_size < 10 THEN replace(p_brand, '#', '# ') ELSE p_brand END FROM part)
  SELECT relation, replace(replace(lower(object), '-', ''), ' ', '') AS fold, count(*) AS n_spellings, string_agg(object, '|' ORDER BY object) AS spellings FROM v GROUP BY ALL HAVING count(*) > 1""")
def A9_spelling_groups(spark, sf_dir):
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    name = F.col("c_mktsegment")
    segment = F.when(F.col("c_acctbal") < 0, F.lower(name)).when(F.col("c_acctbal") < 500, F.concat(F.substring(name, 1, 4), F.lit("-"), F.expr("substring(c_mktsegment, 5)"))).otherwise(name)
    brand = F.when(F.col("p_size") < 10, F.replace("p_brand", F.lit("#"), F.lit("# "))).otherwise(F.col("p_brand"))
    rows = c.select(F.lit("has_segment").alias("relation"), segment.alias("object")).union(p.select(F.lit("has_brand"), brand)).withColumn("status", F.lit("accepted"))
    return audit.spelling_groups(rows)
