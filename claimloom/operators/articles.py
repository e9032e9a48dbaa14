"""Bibliographic article records in XML as rows, by Spark's own XML parser and array functions.

Defined results: a record that is no whole XML, or without a number, has nulls and ``addressable`` false; what a record
does not hold is null or an empty array; inline markup within a title or abstract goes, its text stays; a date that is
free text gives the first four digits as the year, and the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.scalars import doi

#: The parts of a record that are read.
RECORD = """MedlineCitation struct<
  PMID: string,
  Article: struct<
    ArticleTitle: string, Abstract: struct<AbstractText: array<string>>,
    AuthorList: struct<Author: array<struct<CollectiveName: string, LastName: string, ForeName: string, Initials: string>>>,
    Journal: struct<Title: string, ISOAbbreviation: string, JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>,
    ELocationID: array<struct<_VALUE: string, _EIdType: string>>,
    PublicationTypeList: struct<PublicationType: array<struct<_VALUE: string, _UI: string>>>>,
  MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string, _MajorTopicYN: string, _UI: string>, QualifierName: array<struct<_VALUE: string, _MajorTopicYN: string>>>>>,
  CommentsCorrectionsList: struct<CommentsCorrections: array<struct<_RefType: string, PMID: string>>>>,
PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>"""
RETRACTED_TYPE, RETRACTED_UI, RETRACTION_NOTICE = "Retracted Publication", "D016441", "RetractionIn"


def _plain(text: Column) -> Column:
    """Text without inline markup, white space as single spaces; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"(?U)\s+", " ")
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(letter))
    return F.nullif(F.trim(bare), F.lit(""))


def _each(items: Column, what) -> Column:
    """What each item gives, nulls left out; an empty array where there are no items."""
    return F.coalesce(F.array_compact(F.transform(items, what)), F.array().cast("array<string>"))


def parsed(records: DataFrame, xml_col: str = "xml") -> DataFrame:
    """The columns of ``records`` but the XML, then addressable, pmid, title, authors, journal, year, date_text, doi, abstract, major, minor, retracted and notice."""
    kept = [c for c in records.columns if c != xml_col]
    r = F.from_xml(F.col(xml_col), RECORD.replace("\n", " "), {"mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE"})
    rows = records.select(*kept, r.alias("_r"))
    citation, article = F.col("_r.MedlineCitation"), F.col("_r.MedlineCitation.Article")
    journal = article["Journal"]
    date = journal["JournalIssue"]["PubDate"]
    free = _plain(date["MedlineDate"])
    dated = F.coalesce(_plain(date["Year"]).rlike("^[0-9]+$"), F.lit(False))
    name = lambda a: F.coalesce(_plain(a["CollectiveName"]), F.nullif(F.concat_ws(" ", F.coalesce(_plain(a["ForeName"]), _plain(a["Initials"])), _plain(a["LastName"])), F.lit("")))
    ids = F.concat(
        _each(F.filter(F.col("_r.PubmedData.ArticleIdList.ArticleId"), lambda x: x["_IdType"] == "doi"), lambda x: doi(_plain(x["_VALUE"]))),
        _each(F.filter(article["ELocationID"], lambda x: x["_EIdType"] == "doi"), lambda x: doi(_plain(x["_VALUE"]))))
    headings = citation["MeshHeadingList"]["MeshHeading"]
    major = lambda h: F.coalesce((h["DescriptorName"]["_MajorTopicYN"] == "Y") | F.exists(F.coalesce(h["QualifierName"], F.array().cast("array<struct<_VALUE:string,_MajorTopicYN:string>>")), lambda q: F.coalesce(q["_MajorTopicYN"] == "Y", F.lit(False))), F.lit(False))
    kinds = article["PublicationTypeList"]["PublicationType"]
    notices = F.filter(citation["CommentsCorrectionsList"]["CommentsCorrections"], lambda c: c["_RefType"] == RETRACTION_NOTICE)
    marked = F.coalesce(F.exists(kinds, lambda k: (F.trim(k["_VALUE"]) == RETRACTED_TYPE) | (k["_UI"] == RETRACTED_UI)), F.lit(False))
    return rows.select(
        *kept, _plain(citation["PMID"]).isNotNull().alias("addressable"), _plain(citation["PMID"]).alias("pmid"), _plain(article["ArticleTitle"]).alias("title"), _each(article["AuthorList"]["Author"], name).alias("authors"),
        F.coalesce(_plain(journal["Title"]), _plain(journal["ISOAbbreviation"])).alias("journal"),
        F.when(dated, _plain(date["Year"]).try_cast("int")).otherwise(F.nullif(F.regexp_extract(free, "([0-9]{4})", 1), F.lit("")).try_cast("int")).alias("year"), F.when(~dated, free).alias("date_text"),
        F.get(ids, 0).alias("doi"), F.nullif(F.array_join(_each(article["Abstract"]["AbstractText"], _plain), " "), F.lit("")).alias("abstract"),
        _each(F.filter(headings, lambda h: major(h)), lambda h: _plain(h["DescriptorName"]["_VALUE"])).alias("major"), _each(F.filter(headings, lambda h: ~major(h)), lambda h: _plain(h["DescriptorName"]["_VALUE"])).alias("minor"),
        (marked | F.coalesce(F.size(notices) > 0, F.lit(False))).alias("retracted"), _plain(F.get(F.array_compact(F.transform(notices, lambda c: c["PMID"])), 0)).alias("notice"))
