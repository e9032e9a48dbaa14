"""Names within names and records that share ids, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import names
from claimloom.plans.registry import query
from claimloom.plans.triples import table


def _names(spark, sf_dir):
    """Names of parts with their brand, in two spellings, of their kinds, words of them, and of suppliers."""
    p = table(spark, sf_dir, "part")
    s = table(spark, sf_dir, "supplier")
    cut = F.expr("substring(s_name, 10)")
    parts = [p.select(F.concat_ws(" ", "p_name", "p_brand")), p.select(F.concat_ws("-", "p_name", F.upper("p_brand"))), p.select("p_name"), p.select("p_type"), p.select(F.substring("p_brand", 7, 9)), s.select("s_name"), s.select(F.regexp_replace(cut, "^0+", ""))]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.toDF("name").distinct()


NAMES = """names AS (SELECT p_name || ' ' || p_brand AS name FROM part UNION SELECT p_name || '-' || upper(p_brand) FROM part UNION SELECT p_name FROM part UNION SELECT p_type FROM part UNION SELECT substr(p_brand, 7, 9) FROM part
  UNION SELECT s_name FROM supplier UNION SELECT regexp_replace(substr(s_name, 10), '^0+', '') FROM supplier),
n AS (SELECT name, regexp_replace(lower(name), '[\\s·_\\-/().,]+', '', 'g') AS norm FROM names),
c AS (SELECT norm, min(name) AS representative, count(*) AS n FROM n WHERE norm <> '' GROUP BY 1)"""


@query(f"WITH {NAMES} SELECT a.norm AS inner, b.norm AS outer FROM c a JOIN c b ON a.norm <> b.norm AND contains(b.norm, a.norm)".replace("AS inner", 'AS "inner"').replace("AS outer", 'AS "outer"'))
def J25_contained_names(spark, sf_dir):
    return names.contained(_names(spark, sf_dir))


@query(f"""WITH {NAMES} SELECT 'equal' AS kind, representative AS a, name AS b FROM n JOIN c USING (norm) WHERE name <> representative
  UNION ALL SELECT 'contained', a.representative, b.representative FROM c a JOIN c b ON a.norm <> b.norm AND contains(b.norm, a.norm)""")
def J25_pair_audit(spark, sf_dir):
    return names.pair_audit(_names(spark, sf_dir))


#: Records of customers: one in three has a number of its nation's, one in four one of its own that its neighbour shares, some have both.
RECORDS = """records AS (SELECT c_custkey AS record, CASE WHEN c_custkey % 3 = 0 THEN 'd' || c_custkey // 6 WHEN c_custkey % 7 = 0 THEN '' END AS doi, CASE WHEN c_custkey % 4 = 0 THEN 'p' || c_custkey // 8 END AS pmid, CASE WHEN c_custkey % 50 = 0 THEN 'a' || c_nationkey END AS arxiv FROM customer)"""


def _records(spark, sf_dir):
    k = F.col("c_custkey")
    whole = lambda n: F.floor(k / n).cast("string")
    return table(spark, sf_dir, "customer").select(
        k.alias("record"), F.when(k % 3 == 0, F.concat(F.lit("d"), whole(6))).when(k % 7 == 0, "").alias("doi"), F.when(k % 4 == 0, F.concat(F.lit("p"), whole(8))).alias("pmid"), F.when(k % 50 == 0, F.concat(F.lit("a"), F.col("c_nationkey").cast("string"))).alias("arxiv"))


@query(f"""WITH RECURSIVE {RECORDS}, e AS (SELECT record, 'd:' || doi AS id FROM records WHERE doi <> '' UNION ALL SELECT record, 'p:' || pmid FROM records WHERE pmid IS NOT NULL UNION ALL SELECT record, 'a:' || arxiv FROM records WHERE arxiv IS NOT NULL),
  l AS (SELECT DISTINCT a.record AS x, b.record AS y FROM e a JOIN e b USING (id)),
  w AS (SELECT record AS x, record AS y FROM records UNION SELECT w.x, l.y FROM w JOIN l ON w.y = l.x),
  i AS (SELECT x AS record, min(y) AS identity FROM w GROUP BY 1),
  c AS (SELECT identity, count(*) AS n_records, concat_ws(',', CASE WHEN count(DISTINCT nullif(doi, '')) > 1 THEN 'doi' END, CASE WHEN count(DISTINCT pmid) > 1 THEN 'pmid' END, CASE WHEN count(DISTINCT arxiv) > 1 THEN 'arxiv' END) AS disagree FROM i JOIN records USING (record) GROUP BY 1)
  SELECT record, identity, n_records, disagree FROM i JOIN c USING (identity)""")
def U10_identity_classes(spark, sf_dir):
    return names.identity_classes(_records(spark, sf_dir))
