"""Operators of the claim engine against small worlds, and every registered query against its SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.operators import audit, conflicts, facts as K, graph, merge, records
from claimloom.plans import bibliography as _bibliography, changes as _changes, graphs as _graphs, identities as _identities, policies as _policies, queries as _, search as _search, spellings as _spellings, structure as _structure  # noqa: F401
from claimloom.plans.registry import QUERIES, SQL
from claimloom.sources import tables
from claimloom.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CLAIM = "subject string, relation string, object string, source string, status string, confidence string, note string"


def claims(spark, *rows):
    return spark.createDataFrame([(s, r, o, src, st, "0.50", "") for s, r, o, src, st in rows], CLAIM)


def edges(spark, text):
    return spark.createDataFrame([tuple(x) for x in text.split()], "u string, v string")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    rows = lambda d: sorted(map(repr, ([None if v != v or v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r] for r in d[columns].astype(object).where(d[columns].notna(), None).values.tolist())))
    assert columns == sorted(want.columns) and rows(got) == rows(want)


def test_closure(spark):
    assert pairs(graph.closure(edges(spark, "AB BC"))) == [("A", "B"), ("A", "C"), ("B", "C")]
    assert len(pairs(graph.closure(edges(spark, "AB BC CA")))) == 9
    assert pairs(graph.closure(edges(spark, "AB").where("false"))) == []
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(12)], "u string, v string")
    assert graph.closure(chain).count() == 12 * 13 // 2


def test_routes(spark):
    e = edges(spark, "AB BC CD AC DA XY")
    assert [r.node for r in graph.route(e, "A", "D").orderBy("step").collect()] == ["A", "C", "D"]
    assert [r.node for r in graph.route(e, "A", "A").orderBy("step").collect()] == ["A", "C", "D", "A"]
    assert graph.route(e, "X", "A").count() == 0


def test_hierarchy_drops_cyclic_values(spark):
    h = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "x", "y"), ("r", "y", "x"), ("r", "z", "x"), ("q", "a", "d")], "relation string, child string, parent string")
    assert pairs(graph.closed_hierarchy(h)) == [("q", "a", "d"), ("r", "a", "b"), ("r", "a", "c"), ("r", "b", "c")]


def test_conflicts_fold_types_aliases_and_chains(spark):
    rows = claims(spark, ("a", "due", "2030-1-2", "f", "accepted"), ("a", "due", "2030.01.02", "f", "confirmed"), ("b", "due", "2030-1-2", "f", "accepted"), ("b", "deadline", "2031-1-2", "f", "accepted"),
                  ("c", "due", "2031-1-2", "f", "candidate"), ("c", "due", "2030-1-2", "f", "accepted"), ("d", "is", "dog", "f", "accepted"), ("d", "is", "animal", "f", "accepted"), ("e", "is", "dog", "f", "accepted"), ("e", "is", "car", "f", "accepted"))
    aliases = spark.createDataFrame([("deadline", "due")], "raw string, canonical string")
    hierarchy = spark.createDataFrame([("is", "dog", "animal")], "relation string, child string, ancestor string")
    got = conflicts.conflicts(rows, ["due", "is"], {"due": "date"}, aliases, hierarchy)
    assert pairs(got.select("subject", "competing")) == [("b", "2030-1-2|2031-1-2"), ("e", "car|dog")]


@pytest.mark.parametrize("function, text, want", [
    (S.parse_date, "2030.1", 20300101), (S.parse_date, "date(2030,2,29)", None), (S.parse_date, "2028-02-29", 20280229), (S.parse_date, "2030", None), (S.parse_date, "date(2030)", 20300101),
    (S.parse_number_scaled, "2.5", 2500), (S.parse_number_scaled, "-1,000.0005", -1000001), (S.parse_number_scaled, "number(7)", 7000), (S.parse_number_scaled, "x", None),
    (S.parse_ordinal, "3rd", 3), (S.parse_ordinal, "제3호", 3), (S.parse_ordinal, "third", None), (S.parse_amount, 'amount(7,"억")', 700000000), (S.parse_amount, "1,000억원", 100000000000), (S.parse_amount, "7 apples", None),
    (S.normalize_confidence, "1.7", "1.00"), (S.normalize_confidence, "nan", "0.50"), (S.normalize_confidence, "", "0.50"), (S.slug, "Hello, World!", "hello-world"), (S.slug, "!!", "item"),
    (S.doi, "https://doi.org/10.1234/AbC", "10.1234/abc"), (S.pmid, "PMID: 123", "123"), (S.arxiv_id, "https://arxiv.org/abs/2101.00001v3", "2101.00001"), (S.arxiv_id, "hep-th/9901001", "hep-th/9901001"), (S.year, "in 1999-01", 1999),
])
def test_scalars(spark, function, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(function(F.col("x"))).first()[0] == want


def test_restore_abstract(spark):
    df = spark.createDataFrame([({"b": [1, 3], "a": [0], "c": [1, -1]},)], "i map<string,array<int>>")
    assert df.select(S.restore_abstract(F.col("i"))).first()[0] == "a b b"


def test_rebuild_keeps_decisions(spark):
    runs = claims(spark, ("a", "r", "o", "sources/f#1", "candidate"), ("a", "r", "o", "sources/f#2", "accepted"), ("b", "r", "o", "sources/f", "accepted"), ("c", "r", "o", "sources/f", "weird"), ("d", "r", "o", "gone", "accepted"), ("", "r", "o", "sources/f", "accepted"))
    last = claims(spark, ("a", "r", "o", "sources/f", "confirmed"), ("b", "r", "o", "sources/f", "needs_review"), ("t", "r", "o", "sources/f", "superseded"), ("z", "r", "o", "sources/f", "accepted"))
    new = merge.rebuild(runs, last, spark.createDataFrame([("sources/f",)], "file string"))
    assert pairs(new.select("subject", "status")) == [("a", "confirmed"), ("b", "needs_review"), ("c", "needs_review"), ("t", "superseded")]
    assert [r.subject for r in merge.destroyed(new, last).collect()] == ["z"]


def test_fuzzy_pairs_lose_none(spark):
    import itertools
    import random

    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 6))), rng.choice(["x", "y", ""]), rng.randint(2000, 2003)) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, title string, surname string, year int")
    want = {}
    for a, b in itertools.permutations(rows, 2):
        s, t = set(a[1].split()), set(b[1].split())
        score = len(s & t) / len(s | t)
        if a[2] == b[2] != "" and abs(a[3] - b[3]) <= 1 and score >= 0.8:
            want[a[0]] = max(want.get(a[0], (0, 0)), (score, -b[0]))
    assert pairs(records.fuzzy_pairs(df, df).select("l_id", "r_id")) == sorted((k, -v[1]) for k, v in want.items())


def test_audits(spark):
    rows = claims(spark, ("a", "r", "New York", "f", "accepted"), ("b", "r", "new-york", "f", "accepted"), ("c", "r", "1-2", "f", "accepted"), ("c", "r", "12", "f", "accepted"), ("d", "r", "other(x)", "f", "accepted"))
    assert pairs(audit.spelling_groups(rows).select("spellings")) == [("New York|new-york",)]
    assert pairs(audit.wrappers(rows)) == [("r", "other(x)", "x")]
    assert pairs(K.search(rows, "YORK").select("subject")) == [("a",), ("b",)]


def test_tables_round_trip(spark, tmp_path):
    rows = claims(spark, ("a", "r", 'say "hi", \\ you', "f#1", "accepted"), ("b", "r", "é\nx", "f", "candidate"))
    tables.write_claims(rows, f"{tmp_path}/csv")
    assert pairs(tables.read_claims(spark, f"{tmp_path}/csv").select(*K.TRIPLE)) == pairs(rows.select(*K.TRIPLE))
    tables.write_atoms(rows, f"{tmp_path}/atoms")
    assert pairs(tables.read_atoms(spark, f"{tmp_path}/atoms")) == [("a", "r", 'say "hi", \\ you')]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text('[{"subject":"s","relation":"r","object":"o","source":"f#2"},{"subject":"s"}]')
    (tmp_path / "runs" / "b.json").write_text("{}")
    runs = tables.read_runs(spark, f"{tmp_path}/runs")
    assert pairs(tables.cited_sources(runs)) == [("f", 1)]
    text = spark.createDataFrame([('---\ntitle: "A: b"\nyear: 2020\n---\nbody: no',)], "t string")
    assert text.select(tables.front_matter(F.col("t"))).first()[0] == {"title": "A: b", "year": "2020"}


def test_streams(spark, tmp_path):
    rows = claims(spark, ("a", "r", "o", "f", "accepted"), ("a", "r", "o", "g", "accepted"), ("b", "r", "o", "f", "candidate"))
    rows.withColumn("at", F.lit("2024-01-01").cast("timestamp")).union(rows.limit(1).withColumn("at", F.lit("2024-01-01").cast("timestamp"))).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    incremental.append_batches(incremental.once(stream, "at"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    incremental.append_batches(incremental.once(stream, "at"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    q = incremental.corroboration(stream).writeStream.outputMode("complete").format("memory").queryName("support").trigger(availableNow=True).start()
    q.awaitTermination()
    assert pairs(spark.table("support").select("subject", "n_sources")) == [("a", 2)]


def test_the_rest_works_without_the_training_operators(tmp_path):
    """In a copy without both folders and the pipeline, all else imports, registers the same queries, and its tests are found."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache"))
    code = "import sys, __spark_entry__ as e; assert set(e.queries()) == set(sys.argv[1].split(',')); assert set(e.oracle_sql()) <= set(e.queries()); assert not [m for m in sys.modules if '.llm' in m]"
    environment = {**os.environ, "PYTHONPATH": str(tmp_path / "copy")}
    subprocess.run([sys.executable, "-c", code, ",".join(QUERIES)], cwd=tmp_path / "copy", env=environment, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=tmp_path / "copy", env=environment, check=True, capture_output=True)
