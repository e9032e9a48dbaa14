"""Bibliographic records: resolution, ledgers and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.scalars import jaccard, tokens
from claimloom.functions.storage import stored


def resolve_exact(new: DataFrame, known: DataFrame, ids: tuple[str, ...] = ("doi", "pmid", "arxiv")) -> DataFrame:
    """``new`` with the record that shares an id, and by which: earlier kinds of id win, then the least record."""
    found = None
    for k, kind in enumerate(ids):
        one = known.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("value")).agg(F.min("record").alias("match"))
        hit = new.where(F.col(kind).isNotNull()).join(one, F.col(kind) == F.col("value")).select("id", F.lit(k).alias("order"), F.lit(kind).alias("by"), "match")
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("id").agg(F.min(F.struct("order", "by", "match")).alias("b"))
    return new.join(best, "id", "left").select(*new.columns, F.col("b.by").alias("by"), F.col("b.match").alias("match"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, similarity: float = 0.8, years: int = 1) -> DataFrame:
    """Best candidate of each left row (id, title, surname, year): equal surname, near year, title words alike.

    Rows of one surname, year and set of words are a class, and classes are compared: of a class on the right at most its
    two least ids can be a best candidate, since a row is none of itself. Blocked on (surname, rare shared word): sets of
    similarity s share one of the first ``size - ceil(s * size) + 1`` words in any one order of words. Rare words come
    first, so words that very many titles begin with are nobody's key.
    """
    def rows_of(df: DataFrame) -> DataFrame:
        titles = df.select("title").distinct().select("title", F.array_sort(tokens(F.col("title"))).alias("words"))
        return df.where("surname <> ''").select("id", "title", "surname", "year").join(titles, "title").drop("title")

    ours, theirs = rows_of(left), rows_of(right)
    kind = ["surname", "year", "words"]
    sets = [stored(df.select(*kind).distinct(), "title-sets") for df in (ours, theirs)]
    often = stored(sets[0].unionByName(sets[1]).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "title-words")

    def prefixed(df: DataFrame, side: str) -> DataFrame:
        one = df.select(*kind, F.explode("words").alias("word")).join(often, "word")
        ranked = one.groupBy(*kind).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("rare"))
        n = F.size("rare")
        return ranked.select("surname", F.col("year").alias(f"{side}_year"), F.col("words").alias(f"{side}_words"), F.explode(F.slice("rare", F.lit(1), n - F.ceil(n * similarity).cast("int") + 1)).alias("word"))

    near = prefixed(sets[0], "l").join(prefixed(sets[1], "r"), ["surname", "word"]).where(F.abs(F.col("l_year") - F.col("r_year")) <= years)
    alike = near.select("surname", "l_year", "l_words", "r_year", "r_words", jaccard(F.col("l_words"), F.col("r_words")).alias("score")).where(F.col("score") >= similarity).distinct()
    first = theirs.groupBy(*kind).agg(F.min("id").alias("one"))
    second = theirs.join(first, kind).where(F.col("id") > F.col("one")).groupBy(*kind).agg(F.min("id").alias("two"))
    least = first.join(second, kind, "left").select("surname", F.col("year").alias("r_year"), F.col("words").alias("r_words"), F.explode(F.array_compact(F.array("one", "two"))).alias("r_id"))
    met = alike.join(least, ["surname", "r_year", "r_words"]).groupBy("surname", F.col("l_year").alias("year"), F.col("l_words").alias("words"), "r_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy(*kind).orderBy(F.desc("score"), "r_id"))
    two = met.withColumn("_n", best).where("_n <= 2").groupBy(*kind).agg(F.array_sort(F.collect_list(F.struct("_n", "r_id", "score"))).alias("two"))
    found = ours.join(two, kind).select(F.col("id").alias("l_id"), F.get(F.filter("two", lambda x: x["r_id"] != F.col("id")), 0).alias("b"))
    one = F.row_number().over(Window.partitionBy("l_id").orderBy(F.desc("score"), "r_id"))
    return found.where("b IS NOT NULL").select("l_id", "b.r_id", "b.score").withColumn("_n", one).where("_n = 1").drop("_n")


def changes(ledger: DataFrame, upstream: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """State of each recorded row against upstream: ``missing``, ``changed`` or ``unchanged``, and which fields differ."""
    now = upstream.select(F.col(key).alias("_k"), *[F.col(f).alias(f"new_{f}") for f in fields])
    both = ledger.join(now, ledger[key] == now["_k"], "left")
    differ = F.array_join(F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull()), ",")
    state = F.when(F.col("_k").isNull(), "missing").when(F.col("differ") != "", "changed").otherwise("unchanged")
    return both.withColumn("differ", F.when(F.col("_k").isNull(), F.lit("")).otherwise(differ)).select(key, state.alias("state"), "differ")


def due(rows: DataFrame, log: DataFrame, key: str, now: Column, days: int) -> DataFrame:
    """Rows that were never checked, or last checked ``days`` ago or earlier."""
    return rows.join(log.groupBy(key).agg(F.max("checked_at").alias("checked_at")), key, "left").where(F.col("checked_at").isNull() | (F.col("checked_at") <= now - F.make_dt_interval(F.lit(days)))).select(*rows.columns)
