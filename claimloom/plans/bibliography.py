"""Article records made of all parts and their suppliers, torn ones among them, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import articles
from claimloom.plans.registry import query
from claimloom.plans.triples import table


def _records(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    t = lambda c: c.cast("string")
    tag = lambda name, inner, attributes="": F.concat(F.lit(f"<{name}{attributes}>"), inner, F.lit(f"</{name}>"))
    when = lambda test, x: F.when(test, x).otherwise("")
    date = F.when(size % 3 == 0, tag("Year", t(size + 1950))).when(size % 3 == 1, tag("MedlineDate", F.concat(F.lit("Winter "), t(size + 1950), F.lit(" - Spring")))).otherwise(tag("MedlineDate", F.lit("Winter")))
    authors = F.concat(tag("Author", F.concat(tag("LastName", F.col("p_brand")), tag("ForeName", F.col("p_type")))), when(k % 5 == 0, tag("Author", tag("CollectiveName", F.lit("The <b>Group</b> &amp; Co")))), when(k % 7 == 0, tag("Author", tag("Initials", F.lit("X")))))
    article = F.concat(
        tag("Journal", F.concat(tag("JournalIssue", tag("PubDate", date)), when(k % 2 == 0, tag("Title", F.lit("Journal  of Parts"))), tag("ISOAbbreviation", F.lit("J Parts")))), tag("ArticleTitle", F.concat(F.lit("On <i>"), "p_name", F.lit("</i>\n &lt;")) ),
        tag("Abstract", F.concat(tag("AbstractText", F.lit("One"), ' Label="A"'), tag("AbstractText", F.concat(F.lit("two "), "p_name")))), when(k % 4 != 0, tag("AuthorList", authors)),
        tag("ELocationID", F.concat(F.lit("10.1234/E"), t(k)), ' EIdType="doi"'), tag("PublicationTypeList", F.concat(tag("PublicationType", F.lit("Journal Article"), ' UI="D1"'), when(k % 17 == 0, tag("PublicationType", F.lit("Retracted Publication"), ' UI="D016441"')))))
    mesh = tag("MeshHeadingList", F.concat(
        tag("MeshHeading", F.when(size > 25, tag("DescriptorName", F.col("p_type"), ' UI="D2" MajorTopicYN="Y"')).otherwise(tag("DescriptorName", F.col("p_type"), ' UI="D2" MajorTopicYN="N"'))),
        tag("MeshHeading", F.concat(tag("DescriptorName", F.lit("Tools"), ' MajorTopicYN="N"'), F.when(size > 40, tag("QualifierName", F.lit("history"), ' MajorTopicYN="Y"')).otherwise(tag("QualifierName", F.lit("history"), ' MajorTopicYN="N"'))))))
    notice = when(k % 19 == 0, tag("CommentsCorrectionsList", tag("CommentsCorrections", tag("PMID", t(k + 1), ' Version="1"'), ' RefType="RetractionIn"')))
    citation = F.concat(when(k % 29 != 0, tag("PMID", t(k), ' Version="1"')), tag("Article", article), notice, mesh)
    whole = tag("PubmedArticle", F.concat(tag("MedlineCitation", citation), when(k % 3 == 0, tag("PubmedData", tag("ArticleIdList", F.concat(tag("ArticleId", F.lit("S1"), ' IdType="pii"'), tag("ArticleId", F.concat(F.lit("10.1234/P"), t(k)), ' IdType="doi"')))))))
    parts = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # few splits, and long work a row
    return parts.select("p_partkey", F.when(k % 23 == 0, F.substring(whole, 1, 200)).otherwise(whole).alias("xml"))


@query("""WITH p AS (SELECT *, p_partkey % 23 <> 0 AS whole, p_partkey AS k FROM part)
  SELECT p_partkey, whole AND k % 29 <> 0 AS addressable, CASE WHEN whole AND k % 29 <> 0 THEN CAST(k AS VARCHAR) END AS pmid, CASE WHEN whole THEN 'On ' || p_name || ' <' END AS title,
  CASE WHEN whole AND k % 4 <> 0 THEN concat_ws('|', p_type || ' ' || p_brand, CASE WHEN k % 5 = 0 THEN 'The Group & Co' END, CASE WHEN k % 7 = 0 THEN 'X' END) ELSE '' END AS authors,
  CASE WHEN whole THEN CASE WHEN k % 2 = 0 THEN 'Journal of Parts' ELSE 'J Parts' END END AS journal, CASE WHEN whole AND p_size % 3 < 2 THEN CAST(p_size + 1950 AS INTEGER) END AS year,
  CASE WHEN whole THEN CASE p_size % 3 WHEN 1 THEN 'Winter ' || (p_size + 1950) || ' - Spring' WHEN 2 THEN 'Winter' END END AS date_text, CASE WHEN whole THEN CASE WHEN k % 3 = 0 THEN '10.1234/p' ELSE '10.1234/e' END || k END AS doi,
  CASE WHEN whole THEN 'One two ' || p_name END AS abstract, CASE WHEN whole THEN concat_ws('|', CASE WHEN p_size > 25 THEN p_type END, CASE WHEN p_size > 40 THEN 'Tools' END) ELSE '' END AS major,
  CASE WHEN whole THEN concat_ws('|', CASE WHEN p_size <= 25 THEN p_type END, CASE WHEN p_size <= 40 THEN 'Tools' END) ELSE '' END AS minor, whole AND (k % 17 = 0 OR k % 19 = 0) AS retracted, CASE WHEN whole AND k % 19 = 0 THEN CAST(k + 1 AS VARCHAR) END AS notice FROM p""")
def X87_articles(spark, sf_dir):
    got = articles.parsed(_records(spark, sf_dir))
    return got.withColumns({c: F.array_join(c, "|") for c in ("authors", "major", "minor")})
