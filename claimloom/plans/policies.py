"""Policy files written from the tables, read as tables, and the operators that take them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.storage import shared_dir
from claimloom.operators import conflicts, facts as K, globs, graph
from claimloom.plans.registry import query
from claimloom.plans.triples import COLUMNS, ENGINE_SQL, FACTS, facts, table
from claimloom.sources import policy


def _file(spark, lines: DataFrame, name: str) -> str:
    """The path of a policy file with ``lines`` (value)."""
    at = f"{shared_dir(spark)}/policy-{name}-{uuid.uuid4().hex}"
    lines.write.text(at)
    return at


def _written(spark, name: str, *lines: str) -> str:
    return _file(spark, spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), name)


def _hierarchy(spark, sf_dir) -> str:
    """Nations under their regions, regions under the world; each fifth nation's line is no declaration, one line is a cycle."""
    n = table(spark, sf_dir, "nation")
    lines = n.select(F.when(F.col("n_nationkey") % 5 == 4, F.concat(F.lit("- located_in "), "n_name")).otherwise(F.concat(F.lit("- located_in: `nation:"), F.col("n_nationkey").cast("string"), F.lit("` ⊂ `region:"), F.col("n_regionkey").cast("string"), F.lit("`"))).alias("value"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("* located_in: `region:"), F.col("r_regionkey").cast("string"), F.lit("` <: world")).alias("value"))
    return _file(spark, lines.union(r).union(spark.createDataFrame([("# comment",), ("- x: a ⊂ b",), ("- x: b ⊂ a",)], "value string")), "hierarchy")


def _aliases(spark) -> DataFrame:
    return policy.aliases(spark, _written(spark, "aliases", "# names", "- `in_nation` -> `located_in`", "- `based_in` -> `located_in` # by hand", "- `size_of` -> `has_size`", "plain text", "- `a` => `b`"))


def _types(spark) -> DataFrame:
    return policy.types(spark, _written(spark, "types", "- `has_size` : amount as size (xu=3, one=1)", "- has_total : number as total", "- odd : colour as c", "- broken"))


def _placed(spark, sf_dir) -> DataFrame:
    """The claims, with where each customer is based by region (one in seven elsewhere) and each part's size in units (one in eleven off by one)."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    region = F.when(F.col("c_custkey") % 7 == 0, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    based = c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("subject"), F.lit("based_in").alias("relation"), F.concat(F.lit("region:"), region.cast("string")).alias("object"))
    p = table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") % 3 == 0, F.concat((F.col("p_size") / 3).cast("long").cast("string"), F.lit(" xu"))).otherwise(F.concat(F.lit("amount("), F.col("p_size").cast("string"), F.lit(",one)")))
    sizes = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("subject"), F.lit("size_of").alias("relation"), F.when(F.col("p_partkey") % 11 == 0, F.concat((F.col("p_size") + 1).cast("string"), F.lit(" one"))).otherwise(size).alias("object"))
    more = based.unionByName(sizes).select("*", F.lit("sources/by_hand.md").alias("source"), F.lit("accepted").alias("status"), F.lit("0.50").alias("confidence"), F.lit("").alias("note"))
    units = facts(spark, sf_dir).withColumn("object", F.when(F.col("relation") == "has_size", F.concat("object", F.lit("one"))).otherwise(F.col("object")))
    return units.select(*COLUMNS).unionByName(more)


PLACED = ENGINE_SQL + """,
places AS (SELECT e.subject, e.object AS nation, 'region:' || n.n_regionkey AS region, 'region:' || CASE WHEN c_custkey % 7 = 0 THEN (n.n_regionkey + 1) % 5 ELSE n.n_regionkey END AS based, n.n_nationkey AS k
  FROM engine e JOIN customer ON e.subject = 'customer:' || c_custkey JOIN nation n ON c_nationkey = n_nationkey WHERE e.relation = 'in_nation'),
sizes AS (SELECT e.subject, e.object || 'one' AS a, p_size, p_partkey FROM engine e JOIN part ON e.subject = 'part:' || p_partkey WHERE e.relation = 'has_size')"""


@query(f"""WITH {PLACED}
  SELECT subject, 'located_in' AS relation, 2::BIGINT AS n_values, nation || '|' || based AS competing FROM places WHERE based <> region OR k % 5 = 4
  UNION ALL SELECT subject, 'has_size', 2, least(a, (p_size + 1) || ' one') || '|' || greatest(a, (p_size + 1) || ' one') FROM sizes WHERE p_partkey % 11 = 0""")
def A7_conflicts_by_policy(spark, sf_dir):
    """Contradictions under aliases, typed units and a value hierarchy that all come from policy files."""
    closed = graph.closed_hierarchy(policy.hierarchy(spark, _hierarchy(spark, sf_dir)))
    return conflicts.conflicts(_placed(spark, sf_dir), ["located_in", "has_size"], _types(spark), _aliases(spark), closed)


@query("""SELECT 'located_in' AS relation, 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS ancestor FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT 'located_in', 'nation:' || n_nationkey, 'world' FROM nation WHERE n_nationkey % 5 <> 4
  UNION ALL SELECT 'located_in', 'region:' || r_regionkey, 'world' FROM region""")
def R6_hierarchy_from_files(spark, sf_dir):
    return graph.closed_hierarchy(policy.hierarchy(spark, _hierarchy(spark, sf_dir)))


@query("SELECT 'not a declaration: located_in ' || n_name AS warning FROM nation WHERE n_nationkey % 5 = 4")
def S16_hierarchy_mistakes(spark, sf_dir):
    return policy.warnings(spark, "hierarchy", _hierarchy(spark, sf_dir)).select("warning")


@query(f"""WITH {FACTS} SELECT CASE relation WHEN 'in_nation' THEN 'located_in' ELSE relation END AS relation, status, count(*) AS n FROM facts GROUP BY ALL""")
def S15_aliases_from_files(spark, sf_dir):
    rows = conflicts.with_canonical(facts(spark, sf_dir), _aliases(spark))
    return rows.groupBy(F.col("canonical").alias("relation"), "status").agg(F.count("*").alias("n"))


@query(f"""WITH {PLACED}, s AS (SELECT subject, p_size AS v FROM sizes UNION ALL SELECT 'part:' || p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END FROM part)
  SELECT subject, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM s GROUP BY 1""")
def J8_typed_by_policy(spark, sf_dir):
    """Each size in its own unit, as the scalar that the declared units make of it."""
    rows = conflicts.with_canonical(K.engine_facts(_placed(spark, sf_dir)), _aliases(spark)).where("canonical = 'has_size'")
    typed = conflicts.with_spec(rows, conflicts._specs(spark, _types(spark)))
    return typed.select("subject", conflicts.scalars.scalar(F.col("_type"), F.col("object"), F.col("_units")).alias("v")).groupBy("subject").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


#: A glob for each supplier, in turn of each shape; and the paths of all claims' files.
_GLOBS = ["sources/supplier_{k}.md", "supplier_{k}*", "sources/**/part?_{k}.md", "*_{k}.md", "sources/orders_{k}?.md", "**/custom*s_{k}.md", "none/{k}/", "[x]_{k}.md"]


def _ignore_globs(spark, sf_dir) -> DataFrame:
    shape = F.element_at(F.array(*[F.lit(g) for g in _GLOBS]), (F.col("s_suppkey") % len(_GLOBS) + 1).cast("int"))
    lines = table(spark, sf_dir, "supplier").select(F.concat(F.lit("- "), F.replace(shape, F.lit("{k}"), F.col("s_suppkey").cast("string"))).alias("value"))
    return policy.ignore_globs(spark, _file(spark, lines, "ignore"))


@query(rf"""WITH {FACTS}, p AS (SELECT DISTINCT split_part(source, '#', 1) AS path FROM facts), s AS (SELECT s_suppkey AS k, s_suppkey % {len(_GLOBS)} AS g FROM supplier),
  r AS (SELECT k, CASE g WHEN 0 THEN '(sources/)?supplier_K[.]md' WHEN 1 THEN '(sources/)?supplier_K[^/]*' WHEN 2 THEN '(sources/)?sources/(.*/)?part[^/]_K[.]md' WHEN 3 THEN '(sources/)?[^/]*_K[.]md' WHEN 4 THEN '(sources/)?orders_K[^/][.]md' WHEN 5 THEN '(.*/)?custom[^/]*s_K[.]md' ELSE 'no match' END AS re, g FROM s)
  SELECT DISTINCT path FROM p JOIN r ON regexp_full_match(path, replace(re, 'K', CAST(k AS VARCHAR))) WHERE g <> 3 OR path LIKE 'sources/%'""")
def F9_ignored_sources(spark, sf_dir):
    return globs.ignored(facts(spark, sf_dir).select(F.substring_index("source", "#", 1).alias("path")), _ignore_globs(spark, sf_dir))
