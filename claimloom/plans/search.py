"""Excerpt search over every line of the documents, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import excerpts
from claimloom.plans.registry import query
from claimloom.plans.spellings import WORDS, words as _words
from claimloom.plans.triples import table

#: Questions to the documents, with words that no search is about.
QUESTIONS = {1: "Is the of tion and?", 2: "Que la ment des?", 3: "heit keit der und", 4: "License mit version"}
_WORDS = {q: [w for w, _ in excerpts.keywords(text)] for q, text in QUESTIONS.items()}


def _index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("sources/"), F.coalesce("source", F.lit("")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("file"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 3 == 0).cast("int").alias("grade"))
    return excerpts.build(docs, grade_col="grade")


def _questions(spark):
    return spark.createDataFrame(list(QUESTIONS.items()), "question long, text string")


_FOUND = rf"""asked(question, term) AS (VALUES {', '.join(f"({q}, '{w}')" for q, words in _WORDS.items() for w in words)}),
d AS (SELECT 'sources/' || coalesce(source, '') || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS file, CAST(doc_id % 3 = 0 AS INTEGER) AS grade, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS all_lines FROM documents),
l AS (SELECT file, grade, unnest(all_lines) AS text, unnest(range(0, len(all_lines))) AS line FROM d),
w AS (SELECT file, grade, line, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM l),
hits AS (SELECT question, file, grade, line, term, count(*) AS n FROM w JOIN asked USING (term) GROUP BY ALL),
m AS (SELECT DISTINCT question, file, line FROM hits)"""
_WINDOWS = """sel AS (SELECT question, file, min(line) AS line FROM m GROUP BY 1, 2 UNION ALL SELECT s.question, s.file, (SELECT min(m.line) FROM m WHERE m.question = s.question AND m.file = s.file AND m.line > s.line + 6) AS line FROM sel s WHERE s.line IS NOT NULL),
s AS (SELECT question, file, line AS at_line FROM sel WHERE line IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_FOUND}, {_WINDOWS},
  r AS (SELECT s.question, s.file, at_line, any_value(grade) AS grade, count(DISTINCT term) AS coverage, CAST(sum(n) AS BIGINT) AS frequency FROM s JOIN hits h ON h.question = s.question AND h.file = s.file AND h.line BETWEEN at_line - 3 AND at_line + 3 GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY grade DESC, coverage DESC, frequency DESC, file, at_line) AS rank FROM r)
  SELECT question, CAST(rank AS INTEGER) AS rank, file, CAST(at_line + 1 AS INTEGER) AS line, grade, coverage, frequency FROM k WHERE rank <= 10""")
def T4_ranked_excerpts(spark, sf_dir):
    return excerpts.search(spark, _index(spark, sf_dir), _questions(spark)).drop("excerpt")


@query(f"""WITH RECURSIVE {_FOUND}, {_WINDOWS} SELECT question, count(*) AS n_windows, count(DISTINCT file) AS n_files, CAST(sum(at_line) AS BIGINT) AS lines FROM s GROUP BY 1""")
def W8_windows_that_do_not_overlap(spark, sf_dir):
    got = excerpts.search(spark, _index(spark, sf_dir), _questions(spark), limit=None, texts=False)
    return got.groupBy("question").agg(F.count("*").alias("n_windows"), F.countDistinct("file").alias("n_files"), F.sum(F.col("line") - 1).cast("long").alias("lines"))


@query(f"WITH {_FOUND} SELECT question, term, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT file) AS n_files FROM hits GROUP BY 1, 2")
def X27_keyword_hits(spark, sf_dir):
    found = excerpts.hits(spark, _index(spark, sf_dir), _questions(spark))
    return found.groupBy("question", "term").agg(F.sum("n").cast("long").alias("n"), F.countDistinct("file").alias("n_files"))


#: Groups of words that a question may be led on by.
_SYNONYMS = [["License", "version", "Gnu"], ["ment", "heit"]]


@query(rf"""WITH {WORDS}, w AS (SELECT DISTINCT 'work:' || doc_id // 2 AS subject, 'mentions' AS relation, word AS object, lower(word) AS word FROM words),
  asked(question, term) AS (VALUES {', '.join(f"({q}, '{w}')" for q, words in _WORDS.items() for w in words)}), groups(g, member) AS (VALUES {', '.join(f"({k}, '{m}')" for k, ms in enumerate(_SYNONYMS) for m in ms)}),
  looks AS (SELECT question, term, term AS look, '' AS via FROM asked UNION ALL SELECT question, term, lower(o.member), o.member FROM asked JOIN groups a ON lower(a.member) = term JOIN groups o ON o.g = a.g AND o.member <> a.member),
  m AS (SELECT question, subject, relation, object, term, via, word, len(list_filter(range(1, least(length(word), length(look)) + 1), lambda k: left(word, k) = left(look, k))) AS shared
        FROM (SELECT DISTINCT subject, relation, object, unnest([word, 'mentions']) AS word FROM w) JOIN looks ON left(word, 3) = left(look, 3) WHERE length(word) >= 3 AND length(look) >= 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY question, subject, relation, object, term ORDER BY via <> '', shared DESC, word, via) AS n FROM m)
  SELECT question, subject, relation, object, term, via, word, CAST(shared AS INTEGER) AS shared FROM r WHERE n = 1""")
def J19_vocabulary_bridge(spark, sf_dir):
    """What every document mentions, by the questions' words and their synonyms."""
    claims = _words(spark, sf_dir).select(F.concat(F.lit("work:"), F.floor(F.col("doc_id") / 2).cast("string")).alias("subject"), F.lit("mentions").alias("relation"), F.col("word").alias("object"))
    return excerpts.bridge(claims, _questions(spark), spark.createDataFrame([(g,) for g in _SYNONYMS], "members array<string>"))
