"""Claims whose words stand in two Unicode forms, derived from the documents, and the queries that must see through them."""

from __future__ import annotations

import unicodedata
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimloom.functions import scalars as S
from claimloom.functions.unicode import beyond_ascii, changed, fold_case, nfc
from claimloom.operators import audit, conflicts, facts as K, merge, text_search
from claimloom.plans.registry import query
from claimloom.plans.triples import COLUMNS, FACTS, facts, table

#: Letters of the documents that have a decomposed form.
LETTERS = [c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) == 2]
#: A relation in both forms.
NAME, NAME_D = "langue_attestée", unicodedata.normalize("NFD", "langue_attestée")


_DECOMPOSED = {ord(c): unicodedata.normalize("NFD", c) for c in LETTERS}


@F.arrow_udf(StringType())
def _letters_decomposed(text: pa.Array) -> pa.Array:
    return changed(text, lambda x: x.translate(_DECOMPOSED))


def decomposed(text: Column) -> Column:
    """``text`` with each of ``LETTERS`` in its decomposed form. (As a replacement a letter in the plan, the step is too long for the JVM to compile.)"""
    return F.coalesce(_letters_decomposed(F.when(beyond_ascii(text), text)), text)


def _decomposed_sql(text: str) -> str:
    for c in LETTERS:
        text = f"replace({text}, '{c}', '{unicodedata.normalize('NFD', c)}')"
    return text


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, words): the distinct words of each document's whole text, parted at all else; nulls as empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return d.select("doc_id", "lang", "source", F.array_remove(F.array_distinct(F.split("text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")), "").alias("words"))


def _each(listed: DataFrame, words: Column | str) -> DataFrame:
    """A row a word. (The filter that Spark derives from a plain explode would part every text three times.)"""
    return listed.select("doc_id", "lang", "source", F.explode_outer(words).alias("word")).where("word IS NOT NULL")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, lang, source, doc_id): a row a word of ``_listed``."""
    return _each(_listed(spark, sf_dir), "words")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each word is attested: in documents with an odd id all is decomposed, a document's words at once (none holds a space)."""
    odd = F.col("doc_id") % 2 == 1
    other = F.when(odd, F.filter("words", beyond_ascii))
    parts = _listed(spark, sf_dir).withColumn("_joined", F.array_join(other, " ")).withColumn("_joined", F.nullif("_joined", F.lit("")))
    spelled = F.concat(F.filter("words", lambda w: ~beyond_ascii(w)), F.split(_letters_decomposed(F.col("_joined")), " "))
    rows = _each(parts, F.coalesce(spelled, "words"))
    status = F.element_at(F.array(*[F.lit(s) for s in K.STATUS_RANK]), (F.col("doc_id") % 5 + 1).cast("int"))
    return rows.select(
        F.col("word").alias("subject"), F.when(odd, NAME_D).otherwise(NAME).alias("relation"), F.col("lang").alias("object"),
        F.concat(F.lit("sources/"), "source", F.lit(".md#"), F.col("doc_id").cast("string")).alias("source"), status.alias("status"), ((F.col("doc_id") % 101) / F.lit(100)).cast("decimal(3,2)").cast("string").alias("confidence"), F.lit("").alias("note")).select(*COLUMNS)


_STATUSES = "[" + ",".join(f"'{s}'" for s in K.STATUS_RANK) + "]"
WORDS = r"words AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))) AS word FROM documents)"
SPELLED = WORDS + f""",
spelled AS (SELECT CASE WHEN doc_id % 2 = 1 THEN {_decomposed_sql('word')} ELSE word END AS subject, CASE WHEN doc_id % 2 = 1 THEN '{NAME_D}' ELSE '{NAME}' END AS relation, lang AS object,
  'sources/' || source || '.md#' || doc_id AS source, {_STATUSES}[CAST(doc_id % 5 AS INTEGER) + 1] AS status, CAST(CAST((doc_id % 101) / 100 AS DECIMAL(3,2)) AS VARCHAR) AS confidence FROM words)"""
_KEY = "nfc_normalize(subject) AS subject, nfc_normalize(relation) AS relation, object, split_part(source, '#', 1) AS file"


@query(f"""WITH {SPELLED} SELECT min(subject) AS subject, min(relation) AS relation, count(DISTINCT object) AS n_values, string_agg(DISTINCT object, '|' ORDER BY object) AS competing
  FROM spelled WHERE status IN ('confirmed','accepted') GROUP BY nfc_normalize(subject) HAVING count(DISTINCT object) > 1""")
def A6_conflicts_across_spellings(spark, sf_dir):
    return conflicts.conflicts(claims(spark, sf_dir), [NAME])


@query(f"""WITH {SPELLED}, v AS (SELECT nfc_normalize(subject) AS s, object, count(DISTINCT source) AS n_sources FROM spelled WHERE status IN ('confirmed','accepted') GROUP BY ALL),
  m AS (SELECT nfc_normalize(subject) AS s, min(subject) AS subject, min(relation) AS relation FROM spelled WHERE status IN ('confirmed','accepted') GROUP BY 1 HAVING count(DISTINCT object) > 1)
  SELECT object, n_sources, subject, relation FROM v JOIN m USING (s)""")
def A8_competing_across_spellings(spark, sf_dir):
    return conflicts.competing(claims(spark, sf_dir), [NAME_D])


@query(f"""WITH {SPELLED}, k AS (SELECT {_KEY}, status, confidence, source, list_position({_STATUSES}, status) AS r FROM spelled),
  n AS (SELECT *, row_number() OVER (PARTITION BY subject, relation, object, file ORDER BY r, source, confidence) AS m, count(*) OVER (PARTITION BY subject, relation, object, file) AS n_rows FROM k),
  o AS (SELECT subject, relation, object, file, status, confidence, count(*) FILTER (m > 1) AS c, count(*) AS a FROM n WHERE n_rows > 1 GROUP BY ALL),
  d AS (SELECT subject, relation, object, file, count(*) > 1 AS disagree, coalesce(string_agg(status || ' ' || confidence || ' ' || c, ',' ORDER BY status, confidence) FILTER (c > 0), '') AS discarded FROM o GROUP BY ALL)
  SELECT subject, relation, object, file, n_rows, status, confidence, source, disagree, discarded FROM n JOIN d USING (subject, relation, object, file) WHERE m = 1 AND n_rows > 1""")
def A28_folded_spellings(spark, sf_dir):
    return merge.fold_spellings(claims(spark, sf_dir))


@query(f"""WITH {SPELLED}, r AS (SELECT {_KEY}, nfc_normalize(source) AS source, status, row_number() OVER (PARTITION BY nfc_normalize(subject), nfc_normalize(relation), object, split_part(source, '#', 1) ORDER BY source, status, confidence) AS n FROM spelled WHERE subject <> '' AND object <> '')
  SELECT subject, relation, object, source, status FROM r WHERE n = 1""")
def M1_merge_of_spellings(spark, sf_dir):
    rows = claims(spark, sf_dir)
    known = rows.select(S.source_file(F.col("source")).alias("file")).distinct()
    return merge.normalized(rows, known).select(*K.TRIPLE, "source", "status")


@query(f"""WITH {WORDS}, v AS (SELECT DISTINCT word FROM words) SELECT {_decomposed_sql('word')} AS spelled, word AS value FROM v
  UNION ALL SELECT 'Amount( ' || p_size || ',0' || p_size || ' , ' || p_brand || ' )', 'amount(' || p_size || '0' || p_size || ',"' || p_brand || '")' FROM (SELECT DISTINCT p_size, p_brand FROM part)""")
def X1_canonical_values(spark, sf_dir):
    size = F.col("p_size").cast("string")
    amounts = table(spark, sf_dir, "part").select("p_size", "p_brand").distinct().select(F.concat(F.lit("Amount( "), size, F.lit(",0"), size, F.lit(" , "), "p_brand", F.lit(" )")).alias("spelled"))
    found = words(spark, sf_dir).select("word").distinct().select(decomposed(F.col("word")).alias("spelled")).unionByName(amounts)
    return found.select("spelled", S.canonical_amount(nfc(F.col("spelled"))).alias("value"))


#: DuckDB counts an edit distance in bytes: letters of two bytes stand as capitals there.
_BYTES = "translate(lower(nfc_normalize(name)), 'äöüéèêçñáíóúàâîôû', 'ABCDEFGHIJKLMNOPQ')"


@query(f"""WITH {WORDS}, v AS (SELECT DISTINCT {_decomposed_sql('word')} AS name FROM words), d AS (SELECT name, CAST(levenshtein({_BYTES}, 'schAft') AS BIGINT) AS distance FROM v)
  SELECT name, distance FROM d WHERE distance BETWEEN 1 AND 2 ORDER BY distance, replace(lower(nfc_normalize(name)), 'ß', 'ss'), name LIMIT 25""")
def T5_did_you_mean_across_spellings(spark, sf_dir):
    return text_search.nearest(words(spark, sf_dir).select("word").distinct().select(decomposed(F.col("word")).alias("name")).distinct(), "SCHÄFT", 25)


@query(f"""WITH {SPELLED}, e AS (SELECT DISTINCT relation, CASE WHEN object = 'en' THEN translate(subject, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ' ELSE subject END AS object FROM (SELECT nfc_normalize(relation) AS relation, subject, object FROM spelled WHERE status IN ('confirmed','accepted'))),
  f AS (SELECT relation, object, replace(replace(lower(nfc_normalize(object)), ' ', ''), 'ß', 'ss') AS fold FROM e)
  SELECT relation, fold, count(*) AS n_spellings, string_agg(object, '|' ORDER BY object) AS spellings FROM f GROUP BY ALL HAVING count(*) > 1""")
def A9_spellings_of_words(spark, sf_dir):
    """Values that are one but for case, white space and Unicode form: English ones stand in capitals as well."""
    rows = claims(spark, sf_dir).select(F.col("relation"), F.when(F.col("object") == "en", F.concat(F.translate("subject", ascii_lowercase, ascii_uppercase), F.lit(" "))).otherwise(F.col("subject")).alias("object"), "status")
    return audit.spelling_groups(rows)


@query(f"WITH {WORDS} SELECT DISTINCT word, replace(lower(word), 'ß', 'ss') AS fold FROM words")
def X20_folded_case(spark, sf_dir):
    return words(spark, sf_dir).select("word").distinct().select("word", fold_case(F.col("word")).alias("fold"))


#: All claims with objects in other spellings, in labels for the rest, or saying nothing, by their confidence.
VARIED = FACTS + """, varied AS (SELECT subject, relation, CASE right(confidence, 1) WHEN '1' THEN 'N/A' WHEN '2' THEN 'Unknown' WHEN '3' THEN 'Other( ' || object || ' )' WHEN '4' THEN object || ' (misc)' WHEN '5' THEN lower(object) WHEN '6' THEN object || ' ' ELSE object END AS object, status FROM facts),
live AS (SELECT * FROM varied WHERE status IN ('confirmed','accepted'))"""


def _varied(spark, sf_dir):
    digit, obj = F.right("confidence", F.lit(1)), F.col("object")
    other = F.when(digit == "1", "N/A").when(digit == "2", "Unknown").when(digit == "3", F.concat(F.lit("Other( "), obj, F.lit(" )"))).when(digit == "4", F.concat(obj, F.lit(" (misc)"))).when(digit == "5", F.lower(obj)).when(digit == "6", F.concat(obj, F.lit(" "))).otherwise(obj)
    return facts(spark, sf_dir).withColumn("object", other)


@query(f"WITH {VARIED} SELECT DISTINCT relation, object, CASE WHEN object LIKE 'Other( %' THEN substr(object, 8, length(object) - 9) ELSE left(object, length(object) - 7) END AS inner FROM varied WHERE object LIKE 'Other( %' OR object LIKE '% (misc)'".replace("AS inner", 'AS "inner"'))
def F16_wrapped_values(spark, sf_dir):
    return audit.wrappers(_varied(spark, sf_dir))


@query(f"WITH {VARIED} SELECT relation, object, count(DISTINCT subject) AS n_owners FROM live WHERE object IN ('N/A', 'Unknown') GROUP BY 1, 2")
def A9_placeholders(spark, sf_dir):
    return audit.placeholders(_varied(spark, sf_dir))


@query(rf"""WITH {VARIED}, k AS (SELECT relation, object, subject, regexp_replace(regexp_replace(object, '([0-9])[-._/]([0-9])', '\1|\2', 'g'), '([0-9])[-._/]([0-9])', '\1|\2', 'g') AS kept FROM live),
  f AS (SELECT relation, object, subject, replace(lower(regexp_replace(kept, '[\s\-_./·]+', '', 'g')), '|', '-') AS fold FROM k),
  g AS (SELECT relation, fold, count(DISTINCT object) AS n_spellings, count(DISTINCT subject) AS n_owners FROM f WHERE fold <> '' GROUP BY relation, fold)
  SELECT *, CASE WHEN relation = 'placed_by' AND n_owners > 1 THEN 'duplicate_record' ELSE 'split' END AS kind FROM g WHERE n_spellings > 1""")
def A9_value_owners(spark, sf_dir):
    """All claims' values with several spellings; who placed an order identifies it here."""
    return audit.value_owners(_varied(spark, sf_dir), identity=("placed_by",)).withColumn("fold", F.translate("fold", "\x00", "-"))
