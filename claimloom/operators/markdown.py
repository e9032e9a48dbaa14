"""Markdown structure as rows: headings, bullets and code fences, then sections and anchors over them.

A document goes once through a small automaton, line by line, which holds the open fence and where the current paragraph
began; everything after that is DataFrames over its spans.

Defined results: a null text has no spans; lines end as ``str.splitlines`` ends them; a fence is closed by a run of its
own character that is as long and stands alone, else it reaches the end; blocks inside quotations and list items are
nobody's headings; repeated rows give their spans each; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = "kind string, start long, end long, level int, title string, n_lines long"
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)", re.DOTALL)
_ATX = re.compile(r"(#{1,6})(?: .*)?\Z", re.DOTALL)
_UNDERLINE = re.compile(r" {0,3}(=+|-+)\s*\Z")
_BREAK = re.compile(r" {0,3}([-_*])\s*(?:\1\s*){2,}\Z")
_CONTAINER = re.compile(r" *(?:>|[-+*](?= |\s*\Z)|[0-9]{1,9}[.)](?= |\s*\Z))(.*)", re.DOTALL)


def _atx_title(line: str) -> str:
    content = line.lstrip("#").strip()
    cut = content.rstrip("#")
    return cut.strip() if cut != content and (not cut or cut.endswith(" ")) else content


def scan(text: str):
    """(kind, start, end, level, title) of each heading, bullet and fence; lines count from 0, ends are exclusive."""
    lines = text.splitlines()
    fence, opened = "", 0
    first, inside = None, ""  # first line of the paragraph so far, and what it would belong to: a filled or an empty container
    for at, line in enumerate(lines):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not mark[2].strip():
                yield "fence", opened, at + 1, None, None
                fence = ""
            continue
        if mark:
            fence, opened, first, inside = mark[1], at, None, ""
            continue
        if line.lstrip().startswith("- "):
            yield "bullet", at, at + 1, None, line
        if atx := _ATX.match(line):
            yield "heading", at, at + 1, len(atx[1]), _atx_title(line)
            first, inside = None, ""
            continue
        if first is not None and (under := _UNDERLINE.match(line)) and inside != "filled" and not lines[first].lstrip(" ").startswith("<") and not (inside == "empty" and lines[first].startswith(" ")):
            yield "heading", first, at + 1, 1 if under[1][0] == "=" else 2, "\n".join(lines[first:at]).strip()
            first, inside = None, ""
        elif not line.strip() or _BREAK.match(line):
            first, inside = None, ""
        elif held := _CONTAINER.match(line):
            first, inside = None, "filled" if held[1].strip() else "empty"
        elif first is None and len(line) - len(line.lstrip(" ")) <= 3:
            first = at
    if fence:
        yield "unclosed", opened, len(lines), None, None


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``SPANS`` of each document; ``n_lines`` is the document's, a bullet's title its whole line."""
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    fields = T._parse_datatype_string(SPANS).fields
    names = [id_col, *[f.name for f in fields]]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]

    def task(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch["_text"][k].as_py()
                found = list(scan(text))
                n = len(text.splitlines()) if found else 0
                columns = list(zip(*[(*x, n) for x in found], strict=True)) if found else [()] * len(kinds)
                ids = batch.column(0).take(pa.array([k] * len(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]], names)

    return rows.mapInArrow(task, T.StructType([rows.schema[0], *fields]))


def sections(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The headings of ``found`` (spans) with ``body_end``: the next heading of their level or above, else the end."""
    after = Window.partitionBy(id_col).orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    ends = F.lit(None).cast("long")
    for level in range(1, 7):
        ends = F.when(F.col("level") == level, F.min(F.when(F.col("level") <= level, F.col("start"))).over(after)).otherwise(ends)
    return found.where("kind = 'heading'").withColumn("body_end", F.coalesce(ends, F.col("n_lines"))).drop("kind", "n_lines")


def heading_slug(title: Column) -> Column:
    """A heading's anchor: lower case, letters, digits, ``_`` and hyphens, white space as hyphens."""
    kept = F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}_\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}-]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", "-"), F.lit("-"))


def anchors(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, anchor, line): equal anchors of a document get -1, -2 ...; a title with hyphens for white space is one too; the first line counts."""
    heads = found.where("kind = 'heading'").select(id_col, "start", "title", heading_slug(F.col("title")).alias("base"))
    nth = F.row_number().over(Window.partitionBy(id_col, "base").orderBy("start"))
    named = heads.withColumn("nth", nth).select(id_col, "start", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), (F.col("nth") - 1).cast("string"))).alias("anchor"), F.regexp_replace(F.lower("title"), r"(?U)\s+", "-").alias("plain"))
    both = named.select(id_col, "start", F.explode(F.array("anchor", "plain")).alias("anchor"))
    return both.groupBy(id_col, "anchor").agg(F.min("start").alias("line"))


def sections_without(found: DataFrame, docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, keyword) of documents without a heading of level 2 that holds a keyword of ``wanted``; documents with an open fence at the end are left out."""
    asked = F.array(*[F.lit(r["keyword"]) for r in wanted.select("keyword").distinct().collect()])  # the sections that a format asks for: a few
    heads = found.where("kind = 'heading' AND level = 2").select(id_col, F.explode(F.filter(asked, lambda k: F.contains(F.col("title"), k))).alias("keyword")).distinct()
    whole = docs.select(id_col).distinct().join(found.where("kind = 'unclosed'").select(id_col).distinct(), id_col, "left_anti")
    every = whole.withColumn("keyword", F.explode(asked))
    return every.join(heads, [id_col, "keyword"], "left_anti")


def policy_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, name, sentence, relations) of bullets ``- [name] sentence``, wrapped lines joined, outside ``` fences; lines from 1.

    Bullets begin with ``-``, ``*`` or a number; an indented line goes on; a heading or a blank line ends one. relations
    are the names in backticks.
    """
    text = F.regexp_replace(F.col(text_col).cast("string"), r"\r\n?|[\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n")
    line = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    bare = F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    mark = F.startswith(bare, F.lit("```"))
    order = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a document's lines
    known = line.withColumns({"bare": bare, "mark": mark, "open": F.sum(mark.cast("int")).over(order) % 2 == 1})
    kind = F.when(F.col("mark"), "end").when(F.col("open"), "code").when((F.col("bare") == "") | F.startswith("bare", F.lit("#")), "end").when(F.col("bare").rlike(r"^(?:[-*]|[0-9]+\.)(?U:\s)"), "item").when(F.col("line").rlike(r"^(?U:\s)"), "more").otherwise("end")
    known = known.withColumn("kind", kind).where("kind <> 'code'").withColumn("block", F.sum((F.col("kind") != "more").cast("int")).over(order))
    opening = F.regexp_replace(F.regexp_replace("bare", r"^[-*](?U:\s)+", ""), r"^[0-9]+\.(?U:\s)+", "")
    joined = known.groupBy(id_col, "block").agg(F.bool_or(F.col("kind") == "item").alias("is_item"), F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", F.when(F.col("kind") == "item", opening).otherwise(F.col("bare")).alias("t")))).alias("parts"))
    whole = joined.where("is_item").select(id_col, (F.col("at") + 1).cast("long").alias("line"), F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("item"))
    named = whole.where(F.col("item").rlike(r"^\[[a-z0-9_]+\](?U:\s)+.")).select(id_col, "line", F.regexp_extract("item", r"^\[([a-z0-9_]+)\]", 1).alias("name"), F.trim(F.regexp_extract("item", r"^\[[a-z0-9_]+\](?U:\s)+(.+)$", 1)).alias("sentence"))
    return named.withColumn("relations", F.regexp_extract_all("sentence", F.lit("`([^`]+)`"), F.lit(1)))
