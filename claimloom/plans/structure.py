"""Markdown made of every line of the documents, and the queries over its structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import markdown
from claimloom.plans.registry import query
from claimloom.plans.triples import table

#: What the line numbered k (modulo their count) becomes; {x} is the line. Kinds of headings, and what is none.
SHAPES = ["# {x} ##", "- {x}\n----", "\n{x}\n----", "~~~~ md\n## {x}\n```\n- {x}\n~~~\n~~~~", "{x}", "### {x}", "  - {x}", "\n{x}\n{x}\n  ===", "#{x}", "> {x}\n{x}\n----", "\n####### {x}", "1. [rule_{k}] if `{x}`\n   then `b`"]
#: The last line of some documents opens a fence that nothing closes.
OPEN = "```\n# {x}"


def markdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each line of a whole text in one of the shapes."""
    cleaned = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[\x00-\x1F\x{85}\x{2028}\x{2029}`]", " "), r"^[^A-Za-z]+", ""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "x"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n"))
    x = F.concat(F.lit("x"), cleaned(F.col("x")))
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.col("k") % len(SHAPES) + 1).cast("int"))
    shape = F.when((F.col("k") == F.col("n") - 1) & (F.col("doc_id") % 5 == 0), F.lit(OPEN)).otherwise(shape)
    made = F.replace(F.replace(shape, F.lit("{x}"), x), F.lit("{k}"), F.col("k").cast("string"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", made.alias("m")))).alias("all")).select("doc_id", F.array_join(F.transform("all", lambda r: r["m"]), "\n").alias("text"))


_SIZES = "[" + ",".join(str(s.count("\n") + 1) for s in SHAPES) + "]"
#: (doc_id, k, x, open, top, n_lines): each line, whether it opens the last fence, and where its shape begins.
LINES = rf"""l AS (SELECT doc_id, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
m AS (SELECT doc_id, k, 'x' || trim(regexp_replace(regexp_replace(raw, '[\x00-\x1F\x{{85}}\x{{2028}}\x{{2029}}`]', ' ', 'g'), '^[^A-Za-z]+', '')) AS x, k % {len(SHAPES)} AS s, k = n - 1 AND doc_id % 5 = 0 AS open FROM l),
a AS (SELECT *, CASE WHEN open THEN 2 ELSE {_SIZES}[CAST(s AS INTEGER) + 1] END AS size FROM m),
t AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, sum(size) OVER (PARTITION BY doc_id) AS n_lines FROM a),
h AS (SELECT doc_id, n_lines, CASE s WHEN 2 THEN top + 1 WHEN 7 THEN top + 1 ELSE top END AS start, CASE s WHEN 2 THEN top + 3 WHEN 7 THEN top + 4 ELSE top + 1 END AS "end", CASE s WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 3 ELSE 1 END AS level, CASE s WHEN 7 THEN x || chr(10) || x ELSE x END AS title FROM t WHERE NOT open AND s IN (0, 2, 5, 7))"""


@query(f"""WITH {LINES} SELECT doc_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(level AS INTEGER) AS level, title FROM h""")
def X111_headings(spark, sf_dir):
    return markdown.spans(markdowns(spark, sf_dir)).where("kind = 'heading'").select("doc_id", "start", "end", "level", "title")


@query(f"""WITH {LINES} SELECT doc_id, CASE WHEN open THEN 'unclosed' ELSE 'fence' END AS kind, CAST(top AS BIGINT) AS start, CAST(CASE WHEN open THEN n_lines ELSE top + 6 END AS BIGINT) AS "end" FROM t WHERE open OR s = 3""")
def X110_code_fences(spark, sf_dir):
    return markdown.spans(markdowns(spark, sf_dir)).where("kind IN ('fence', 'unclosed')").select("doc_id", "kind", "start", "end")


@query(f"WITH {LINES} SELECT doc_id, CAST(top AS BIGINT) AS start, CASE s WHEN 1 THEN '- ' ELSE '  - ' END || x AS title FROM t WHERE NOT open AND s IN (1, 6)")
def X112_bullets(spark, sf_dir):
    return markdown.spans(markdowns(spark, sf_dir)).where("kind = 'bullet'").select("doc_id", "start", "title")


@query(f"""WITH {LINES} SELECT h.doc_id, CAST(h.start AS BIGINT) AS start, CAST(coalesce(min(o.start), any_value(h.n_lines)) AS BIGINT) AS body_end FROM h LEFT JOIN h o ON o.doc_id = h.doc_id AND o.start > h.start AND o.level <= h.level GROUP BY h.doc_id, h.start""")
def X113_section_ends(spark, sf_dir):
    return markdown.sections(markdown.spans(markdowns(spark, sf_dir))).select("doc_id", "start", "body_end")


@query(rf"""WITH {LINES}, b AS (SELECT doc_id, start, regexp_replace(lower(title), '\s+', '-', 'g') AS plain, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', '-', 'g'), '-') AS base FROM h),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY start) AS nth FROM b),
  every AS (SELECT doc_id, start, CASE WHEN nth = 1 THEN base ELSE base || '-' || (nth - 1) END AS anchor FROM n UNION ALL SELECT doc_id, start, plain FROM n)
  SELECT doc_id, anchor, CAST(min(start) AS BIGINT) AS line FROM every GROUP BY 1, 2""")
def X114_heading_anchors(spark, sf_dir):
    return markdown.anchors(markdown.spans(markdowns(spark, sf_dir)))


@query(rf"""WITH {LINES}, o AS (SELECT DISTINCT doc_id FROM t WHERE open), w(keyword) AS (VALUES ('th'), ('ein'), ('que')), d AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM o))
  SELECT d.doc_id, w.keyword FROM d, w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = d.doc_id AND h.level = 2 AND contains(h.title, w.keyword))""")
def X117_missing_sections(spark, sf_dir):
    made = markdowns(spark, sf_dir)
    return markdown.sections_without(markdown.spans(made), made, spark.createDataFrame([("th",), ("ein",), ("que",)], "keyword string"))


@query(rf"""WITH {LINES} SELECT doc_id, CAST(top + 1 AS BIGINT) AS line, 'rule_' || k AS name, 'if `' || x || '` then `b`' AS sentence, x || '|b' AS relations FROM t WHERE s = 11 AND NOT open AND (k // {len(SHAPES)}) % 2 = 1""")
def X116_policy_items(spark, sf_dir):
    """Here any line of three backticks begins or ends code: each fourth shape has one, so that every second rule is code."""
    return markdown.policy_items(markdowns(spark, sf_dir)).withColumn("relations", F.array_join("relations", "|"))
