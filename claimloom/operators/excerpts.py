"""Excerpt search: a stored inverted index, windows around matched lines that never overlap, ranked.

``build`` writes two tables once: postings (word, file, line, n) in partitions by the word, sorted, and lines with what a
file's front matter needs. A search joins the questions' words to the postings of their partitions; texts are read for
the excerpts that are returned, and nowhere else.

In a file, lines with a word of the question are gone through in order: a line opens a window of ``REACH`` lines on both
sides unless that would overlap the last window. An excerpt is scored by its file's grade, the number of the question's
words in its window, and how often they stand there; ties by file and line.

Defined results: a null text has no lines; a word is a run of letters, digits and ``_``, compared in lower case; a
question without words finds nothing; equal questions of other ids are answered each; repeated files count as one file
with the lines of all of them added up (each has postings of its own).
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.ordering import numbered, shares
from claimloom.functions.storage import shared_dir, stored
from claimloom.functions.unicode import nfc

REACH, BUCKETS = 3, 64
#: Bytes of written lines whose words a task sorts.
PART = 4 << 20
WORD = r"[\p{L}\p{N}_]+"
# English words that no question is about, the endings of Korean words, and Korean words of asking.
FUNCTION_WORDS = frozenset("am an as at be by do he if in is it me my no of on or so to up us we".split())
ENDINGS = """이 가 을 를 은 는 의 에 도 만 로 와 과 에서 에게 에는 에도 으로 부터 까지 처럼 보다 마다 조차 마저 에서는 에서도 에서의 으로는 으로도 으로서 으로써 로서 로써 로는 로도
 에게는 에게서 와는 과는 와의 과의 라도 이라도 라는 이라는 라고 이라고 하는 하는가 하는지 하나 하다 한다 하고 하여 해서 했나 했는가 한 되는 되는가 되나 된다 된 인가 인지""".split()
ASKING = frozenset("""무엇 무엇이 무엇을 무엇인가 무엇인지 무엇인가요 무엇에 뭐가 뭐야 뭔가 언제 언제부터 언제까지 언제인가 어디 어디에 어디서 어디에서 어디까지 어디인가 어떻게 어떤 어떠한 어느
 누가 누구 누구인가 누구인가요 얼마나 있나 있는지 있나요 있는가 없나 없나요 없는가 맞나 맞는가 여기서 거기서 저기서 논문은 논문이 논문을 논문인가""".split())
_EAST_ASIAN = re.compile("[가-힣一-鿿぀-ヿ]")


def stem(word: str) -> str:
    """A Korean word without its longest ending; the word itself where less than two characters, no Korean ones, or another ending would be left."""
    ending = max((e for e in ENDINGS if word.endswith(e)), key=len, default="")
    rest = word[: len(word) - len(ending)]
    return rest if ending and len(rest) >= 2 and _EAST_ASIAN.search(rest) and rest not in ENDINGS else word


def keywords(question: str) -> list[tuple[str, bool]]:
    """The distinct words a question is searched by, each with whether a part of a word will do."""
    found: dict[str, bool] = {}
    for word in re.findall(r"\w+", unicodedata.normalize("NFC", question).lower()):
        if len(word) < 2 or word in FUNCTION_WORDS or word in ASKING:
            continue
        if _EAST_ASIAN.search(word):
            if (short := stem(word)) not in ASKING:
                found.setdefault(short, True)
        else:
            found.setdefault(word, False)
    return list(found.items())


@dataclass(frozen=True)
class Index:
    """Where the tables of a built index are."""

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        reader = spark.read.schema("word string, file string, line int, n long, bucket int") if name == "postings" else spark.read
        return reader.parquet(f"{self.path}/{name}")


def _postings(lines: DataFrame) -> DataFrame:
    """(word, file, line, n, bucket) of ``lines``, sorted: a line's words are counted in its row and shuffled once.

    A bucket is dealt out by its files, in as many parts as ``lines`` ask for, so that a word of very many lines is many tasks'.
    """
    words = lines.select("file", "line", F.array_sort(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("words")).where(F.size("words") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: ~F.get("words", k).eqNullSafe(F.get("words", k - 1)))
    counted = F.transform("starts", lambda at, k: F.struct(F.get("words", at).alias("word"), (F.coalesce(F.get("starts", k + 1), F.size("words")) - at).cast("long").alias("n")))
    rows = words.withColumn("starts", first).select("file", "line", F.explode(counted).alias("x")).select("x.word", "file", "line", "x.n")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    parts = shares(lines, PART)
    return rows.repartition(parts, "bucket", F.pmod(F.xxhash64("file"), F.lit(parts // BUCKETS + 1))).sortWithinPartitions("bucket", "word", "file", "line")


def build(docs: DataFrame, file_col: str = "file", text_col: str = "text", grade_col: str | None = None, path: str | None = None) -> Index:
    """Index ``docs``; ``grade_col`` is a number, the higher the better, else all files are alike."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/excerpts-{uuid.uuid4().hex}"
    grade = F.col(grade_col).cast("int") if grade_col else F.lit(0)
    text = F.col(text_col).cast("string")
    head = F.regexp_extract(text, r"(?s)^(---[ \t]*\r?\n.*?\n---[ \t]*)(?:\r?\n|$)", 1)
    rows = docs.where(text.isNotNull()).select(F.col(file_col).cast("string").alias("file"), grade.alias("grade"), F.when(head != "", F.regexp_count(head, F.lit("\n"))).alias("fence"), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "text"))
    rows.select("file", "grade", "fence", "line", "text").write.parquet(f"{path}/lines")
    lines = spark.read.parquet(f"{path}/lines")
    _postings(lines).write.partitionBy("bucket").parquet(f"{path}/postings")
    Index(path).table(spark, "postings").select("word", "bucket").distinct().write.parquet(f"{path}/words")
    prose = lines.where(F.col("fence").isNotNull() & (F.col("line") > F.col("fence")) & (F.trim("text") != "") & ~F.ltrim("text").startswith("#"))
    lines.groupBy("file").agg(F.max("grade").alias("grade"), F.max("line").alias("last")).join(prose.groupBy("file").agg(F.min("fence").alias("fence"), F.min("line").alias("prose")), "file", "left").write.parquet(f"{path}/files")
    return Index(path)


def _windows(batches):
    """Of matched lines (question, file, line, fence, prose) in order, those that open a window, with its last line."""
    at, covered = None, -1
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("question", "file", "line", "fence", "prose")]
        keep, ends = [], []
        for k, (question, file, line, fence, prose) in enumerate(zip(*columns, strict=True)):
            if (question, file) != at:
                at, covered = (question, file), -1
            if max(0, line - REACH) <= covered:
                continue
            covered = line + REACH
            if fence is not None and line <= fence and prose is not None and prose > covered:  # metadata: the first line of prose goes with it
                covered = prose
            keep.append(k)
            ends.append(covered)
        kept = batch.take(pa.array(keep, pa.int32()))
        yield pa.RecordBatch.from_arrays([kept["question"], kept["file"], kept["line"], pa.array(ends, pa.int32())], ["question", "file", "line", "covered"])


def hits(spark: SparkSession, index: Index, questions: DataFrame) -> DataFrame:
    """(question, file, line, term, n): how often each term of each question stands in a line; rows of one line and term add up."""
    asked = [(r["question"], term, part) for r in questions.select("question", "text").collect() for term, part in keywords(r["text"] or "")]  # the questions themselves
    terms = spark.createDataFrame(asked, f"question {questions.schema['question'].dataType.simpleString()}, term string, part boolean")
    words = index.table(spark, "words")
    whole = terms.where("NOT part").select("question", "term", F.col("term").alias("word"), F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    parts = sorted({term for _, term, part in asked if part})
    if parts:  # words that hold a term
        held = words.where(F.col("word").rlike("|".join(map(re.escape, parts)))).withColumn("term", F.explode(F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(F.col("word"), p))))
        whole = whole.unionByName(held.join(terms.where("part"), "term").select("question", "term", "word", "bucket"))
    found = index.table(spark, "postings").join(F.broadcast(whole) if not parts else whole, ["bucket", "word"])  # without parts: the questions' own words
    in_word = F.greatest(F.lit(1), F.floor((F.length("word") - F.length(F.replace("word", F.col("term"), F.lit("")))) / F.length("term")))
    return found.select("question", "file", "line", "term", (F.col("n") * in_word).alias("n"))


def search(spark: SparkSession, index: Index, questions: DataFrame, limit: int | None = 10, texts: bool = True) -> DataFrame:
    """(question, rank, file, line, grade, coverage, frequency, excerpt) of the ``limit`` best excerpts of each of ``questions`` (question, text); lines from 1.

    Without ``texts`` there is no excerpt, and no text is read. Tables of files and windows are small as they are
    written and large once they are broadcast, so that they are merged.
    """
    found = stored(hits(spark, index, questions), "excerpt-hits")
    files = index.table(spark, "files").hint("merge")
    matched = found.select("question", "file", "line").distinct().join(files.select("file", "fence", "prose"), "file").select("question", "file", "line", "fence", "prose")
    schema = f"question {questions.schema['question'].dataType.simpleString()}, file string, line int, covered int"
    windows = stored(matched.repartition("question", "file").sortWithinPartitions("question", "file", "line").mapInArrow(_windows, schema), "excerpt-windows")
    near = windows.select("question", "file", F.col("line").alias("at"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("line") - REACH), F.col("line") + REACH)).alias("line"))
    by_term = near.hint("merge").join(found, ["question", "file", "line"]).groupBy("question", "file", "at", "term").agg(F.sum("n").alias("n"))
    scored = by_term.groupBy("question", "file", "at").agg(F.count("*").alias("coverage"), F.sum("n").cast("long").alias("frequency")).join(files.select("file", "grade"), "file")
    if limit:
        order = Window.partitionBy("question").orderBy(F.desc("grade"), F.desc("coverage"), F.desc("frequency"), "file", "at")
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    else:
        falling = {f"_{c}": -F.col(c) for c in ("grade", "coverage", "frequency")}
        ranked = numbered(scored.withColumns(falling), ["question"], [*falling, "file", "at"], "rank").drop(*falling).withColumn("rank", F.col("rank").cast("int"))
    if not texts:
        return ranked.select("question", "rank", "file", (F.col("at") + 1).alias("line"), "grade", "coverage", "frequency")
    best = stored(ranked.join(windows.withColumnRenamed("line", "at").hint("merge"), ["question", "file", "at"]), "excerpt-best")
    shown = best.select("question", "file", "at", F.explode(F.concat(F.sequence(F.greatest(F.lit(0), F.col("at") - REACH), F.col("at") + REACH), F.when(F.col("covered") > F.col("at") + REACH, F.array("covered")).otherwise(F.array().cast("array<int>")))).alias("line"))
    lines = index.table(spark, "lines").select("file", "line", F.regexp_replace("text", r"[\p{Cc}\p{Cf}&&[^\t]]", "").alias("text"))
    texts = shown.join(lines, ["file", "line"]).groupBy("question", "file", "at").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all"))
    joined = F.array_join(F.transform("all", lambda x: F.when(x["line"] > F.col("at") + REACH, F.concat(F.lit("...\n"), x["text"])).otherwise(x["text"])), "\n")
    return best.join(texts, ["question", "file", "at"]).select("question", "rank", "file", (F.col("at") + 1).alias("line"), "grade", "coverage", "frequency", joined.alias("excerpt"))


#: Leading characters that a question's word and a claim's word share at least.
SHARED = 3


def shared_prefix(a, b):
    """How many leading characters two texts share."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b))))
    return F.size(F.filter(places, lambda k: F.left(a, k) == F.left(b, k)))


def bridge(claims: DataFrame, questions: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(question, subject, relation, object, term, via, word, shared): claims that a question's words lead to by their beginnings.

    A word of a claim's relation or object meets the words of questions with the same ``SHARED`` first characters, case
    and Unicode form aside; of a claim's words the one that shares the longest beginning stays, of equal ones the least.
    ``synonyms`` (members) lead on from a question's word to the others of its group, which ``via`` names; a word that
    leads there itself needs none. Distinct relations and objects are compared, not claims, so a word that very many
    claims have costs one comparison a question's word; a claim then takes the better of its relation's and its object's.
    """
    spark = claims.sparkSession
    asked = [(r["question"], term) for r in questions.select("question", "text").collect() for term, _ in keywords(r["text"] or "")]  # the questions themselves
    kind = questions.schema["question"].dataType.simpleString()
    terms = spark.createDataFrame([(*x, x[1], "") for x in asked], f"question {kind}, term string, look string, via string")
    if synonyms is not None:
        member = synonyms.select("members", F.explode("members").alias("_one")).withColumn("_term", F.lower("_one"))
        more = terms.join(member, terms["term"] == member["_term"]).select("question", "term", F.explode(F.array_remove("members", F.col("_one"))).alias("via"))
        terms = terms.unionByName(more.select("question", "term", F.lower("via").alias("look"), "via"))
    terms = terms.where(F.length("look") >= SHARED).withColumn("start", F.left("look", F.lit(SHARED)))
    rows = stored(claims.select(*[nfc(F.col(c)).alias(c) for c in ("subject", "relation", "object")]).distinct(), "bridge-claims")

    def led(part: str) -> DataFrame:
        """Each distinct text of a part of the claims with its best word for each term of a question."""
        words = rows.select(part).distinct().select(part, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(part), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
        met = words.where(F.length("word") >= SHARED).withColumn("start", F.left("word", F.lit(SHARED))).join(F.broadcast(terms), "start")
        best = met.groupBy(part, "question", "term").agg(F.min(F.struct((F.col("via") != "").alias("led"), (-shared_prefix(F.col("word"), F.col("look"))).alias("less"), "word", "via")).alias("best"))
        return stored(best.groupBy(part).agg(F.collect_list(F.struct("question", "term", "best")).alias(f"_{part}")), "bridge-words")

    both = rows.join(F.broadcast(led("relation")), "relation", "left").join(led("object"), "object", "left")
    none = F.array().cast(both.schema["_object"].dataType)
    both = both.withColumn("all", F.array_sort(F.concat(F.coalesce("_relation", none), F.coalesce("_object", none))))
    same = lambda x, y: x["question"].eqNullSafe(y["question"]) & x["term"].eqNullSafe(y["term"])
    first = F.filter("all", lambda x, k: (k == 0) | ~same(x, F.get("all", k - 1)))  # the least of a term comes first
    found = both.select("subject", "relation", "object", F.explode(first).alias("x"))
    return found.select("x.question", "subject", "relation", "object", "x.term", F.col("x.best.via").alias("via"), F.col("x.best.word").alias("word"), (-F.col("x.best.less")).alias("shared"))
