"""Steps whose cost once grew faster than their input, and sums that outgrew their type."""

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimloom.functions import storage, unicode
from claimloom.functions.unicode import nfc
from claimloom.operators import audit, conflicts, excerpts, facts as K, gates, globs, graph, merge, records
from claimloom.plans import bibliography, queries, spellings  # noqa: F401  it registers as it is imported
from claimloom.plans.registry import QUERIES
from test_core import claims, pairs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_character_before_the_first_unsettled_one_changes(spark):
    low = [chr(c) for c in range(unicode.FIRST_UNSETTLED)]
    assert all(unicodedata.normalize("NFC", a + b) == a + b for a in low for b in ("", "e", "\xe9", "˿"))
    assert not unicodedata.is_normalized("NFC", "e" + chr(unicode.FIRST_UNSETTLED))


def test_normal_form_asks_for_cheap_signs_first(spark):
    shown = plan(spark.createDataFrame([("x",)], "t string").select(nfc(F.col("t"))))
    assert "octet_length" in shown and "340" not in shown  # no class of hundreds of ranges


def test_declared_names_meet_claims_where_they_are(spark, tmp_path):
    """Aliases of a file have no known size: a join by relation would bring all claims of one relation to one task."""
    (tmp_path / "a").write_text("raw,to\n")
    of_file = spark.read.schema("raw string, canonical string").csv(str(tmp_path / "a"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(conflicts.with_canonical(claims(spark, ("s", "raw", "o", "f", "accepted")), of_file))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in shown and "BroadcastHashJoin" in shown


def test_a_glob_meets_only_paths_of_its_rarer_literal_end(spark, monkeypatch):
    tried = []
    rlike = F.rlike
    monkeypatch.setattr(F, "rlike", lambda text, regex: tried.append(1) or rlike(text, regex))
    paths = spark.createDataFrame([(f"sources/supplier_{k}.md",) for k in range(300)], "path string")
    made = spark.createDataFrame([(g.format(k=k),) for k in range(300) for g in ("sources/supplier_{k}.md", "supplier_{k}?", "*_{k}.md", "sources/**/supplier_{k}.md")], "pattern string")
    assert globs.matches(paths, made).count() == 300 + 0 + 300 + 300
    asked = made.select("pattern", globs._glob_keys(F.col("pattern")).alias("keys"))
    keys = {r.pattern: {x.side: x.key for x in r["keys"]} for r in asked.collect()}
    assert keys["sources/**/supplier_7.md"] == {0: "sources/", 1: "supplier_7.md"} and keys["supplier_7?"] == {0: "supplier_7"}
    assert keys["sources/supplier_7.md"][0] == "sources/supplier_7.md"


def test_routes_as_text_equal_their_steps(spark):
    edges = spark.createDataFrame([(str(k), str(x)) for k in range(40) for x in (k * 2 % 40, (k * 2 + 1) % 40)] + [(f"c{k}", f"c{k + 1}") for k in range(11)], "u string, v string")
    reached = graph.breadth_first(edges, spark.createDataFrame([("1",), ("c0",), ("none",)], "v string"))
    parts = graph.steps(reached).groupBy("start", "v").agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("all"))
    want = parts.select("start", "v", F.array_join(F.transform("all", lambda x: x["node"]), ">").alias("route"))
    assert pairs(graph.routes(reached)) == pairs(want) and "c0>c1>c2>c3>c4>c5>c6>c7>c8>c9>c10>c11" in {r.route for r in graph.routes(reached).collect()}
    assert graph.routes(reached.where("false")).count() == 0 and graph.routes(reached.where("hops = 1")).count() == reached.where("hops = 1").count()


def test_fingerprints_beyond_a_long(spark):
    rows = spark.createDataFrame([(1 << 62,), (1 << 62,), (5,)], "x long")
    assert rows.agg(audit.added(F.col("x"))).first()[0] == 5
    assert rows.where("x = 5").agg(audit.added(F.col("x"))).first()[0] == 5 and rows.where("false").agg(audit.added(F.col("x"))).first()[0] == 0


def test_all_windows_are_ranked_without_a_text_or_a_task_a_question(spark):
    docs = spark.createDataFrame([(f"f{k}", "the word\n" + "x\n" * 9 + "word word") for k in range(6)], "file string, text string")
    asked = spark.createDataFrame([(1, "word"), (2, "the")], "question long, text string")
    index = excerpts.build(docs)
    bare = excerpts.search(spark, index, asked, limit=None, texts=False)
    assert pairs(bare) == pairs(excerpts.search(spark, index, asked, limit=None).drop("excerpt"))
    assert sorted((r.question, r["rank"]) for r in bare.collect()) == [(1, k) for k in range(1, 13)] + [(2, k) for k in range(1, 7)]


def test_a_bridge_takes_the_better_of_relation_and_object(spark):
    rows = claims(spark, ("s", "mention", "mentions men", "f", "accepted"), ("s", "mention", "mentions men", "g", "accepted"), ("t", "other", "x", "f", "accepted"))
    got = excerpts.bridge(rows, spark.createDataFrame([(1, "mentions menu")], "question long, text string"))
    assert pairs(got.select("subject", "term", "word", "shared")) == [("s", "mentions", "mentions", 8), ("s", "menu", "men", 3)]
    assert "mapinarrow" not in plan(got).lower() and plan(got).count("SortMergeJoin") == 0  # claims stay where they are


def joined(df) -> int:
    """The rows that the joins of a plan give as it runs."""
    df.collect()

    def rows(node):
        kids = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
        return own + sum(map(rows, kids))

    return rows(df._jdf.queryExecution().executedPlan())


def test_titles_that_are_alike_are_compared_once(spark):
    df = spark.createDataFrame([(k, "blue ring", "x", 2000 + k % 2) for k in range(400)], "id int, title string, surname string, year int")
    got = records.fuzzy_pairs(df, df)
    assert pairs(got) == [(0, 1, 1.0)] + [(k, 0, 1.0) for k in range(1, 400)] and joined(got) < 4000  # 160,000 pairs of rows


def test_files_are_looked_up_once_a_relation(spark):
    rows = claims(spark, *[(f"s{k}", "r", "o", f"é{k % 2}#{k}", "accepted") for k in range(50)], ("s", "q", "o", "é1", "accepted"))
    assert pairs(merge.per_file(rows)) == [("q", "é1", 1), ("r", "é0", 25), ("r", "é1", 25)]


def test_claims_are_dealt_out_before_they_are_grouped(spark):
    """No task holds the groups of a whole split: nothing is added up before the shuffle, and there is one shuffle."""
    rows = claims(spark, ("s", "raw", "o", "f", "accepted"), ("s", "raw", "o", "g", "accepted"), ("t", "r", "o", "f", "accepted"))
    aliases = spark.createDataFrame([("raw", "named")], "raw string, canonical string")
    for got in (K.corroboration(rows), K.canonical_atoms(rows, aliases), gates.drift(rows, rows.where("subject = 't'"))):
        lines = plan(got).splitlines()
        dealt = [k for k, x in enumerate(lines) if "Exchange hashpartitioning" in x]
        assert len(dealt) == 1 and max(k for k, x in enumerate(lines) if "HashAggregate" in x) < dealt[0]
    assert pairs(K.canonical_atoms(rows, aliases)) == [("s", "named", "o")] and pairs(K.corroboration(rows)) == [("s", "raw", "o", 2), ("t", "r", "o", 1)]
    assert pairs(gates.drift(rows, rows.where("subject = 't'"))) == [("s", "raw", "o", "only-table")]


def test_values_without_a_bracket_are_no_wrappers_at_once(spark):
    rows = claims(spark, *[("s", "r", x, "f", "accepted") for x in ("other (x)", "기타（y）", "other x")])
    shown = plan(audit.wrappers(rows))
    assert shown.count("Contains(object") >= 2 and pairs(audit.wrappers(rows)) == [("r", "other (x)", "x"), ("r", "기타（y）", "y")]


def test_articles_are_parsed_in_many_tasks(spark):
    assert bibliography._records(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_copies_are_dealt_out_before_anything_is_sorted(spark):
    """Sorting a whole split of the input before the shuffle took memory that grew with the input."""
    shown = plan(QUERIES["A28_fold_copies"](spark, "/root/testdata/sf0.001"))
    assert "Sort" in shown and "Sort" not in shown.rpartition("Exchange")[2]
    rows = claims(spark, *[("s", "r", "o", f"f#{k}", status) for k in range(3) for status in ("candidate", "accepted", "superseded")], ("s", "r", "o", "g", "candidate"))
    order = [K.rank(F.col("status")), "source"]
    one, other = (K.first_by(merge.keyed(rows), merge.KEY, order, like).select("file", "source", "status") for like in (None, rows))
    assert pairs(one) == pairs(other) == [("f", "f#0", "accepted"), ("g", "g", "candidate")]


def test_words_of_lines_are_counted_in_their_row_and_shuffled_once(spark):
    """They were grouped first and then dealt out by ranges, which read and grouped them twice."""
    texts = {("a", 0): "the The of, the\tx_1", ("a", 1): "...", ("b", 0): "", ("b", 1): "é É z", ("c", 0): "the " * 3000}
    lines = spark.createDataFrame([(f, k, t) for (f, k), t in texts.items()], "file string, line int, text string")
    postings = excerpts._postings(lines)
    shown = plan(postings)
    assert shown.count("Exchange") == 1 and "Aggregate" not in shown and "rangepartitioning" not in shown
    want = Counter((w, f, k) for (f, k), t in texts.items() for w in re.findall(r"\w+", t.lower()))
    assert pairs(postings.select("word", "file", "line", "n")) == sorted((*key, n) for key, n in want.items())


def test_contradictions_tell_spellings_apart_before_python_and_without_a_join(spark):
    """By their relation, nearly all claims met in one task; each claim went to Python, and a text was parted three times."""
    shown = plan(QUERIES["A6_conflicts_across_spellings"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in shown and "size(array_remove" not in shown and sum("array_distinct(split(" in x for x in shown.splitlines()) == 1
    lines = shown.splitlines()
    first = max(k for k, x in enumerate(lines) if "HashAggregate(keys=[subject" in x and "functions=[]" in x)
    assert all(k < first for k, x in enumerate(lines) if "ArrowEvalPython" in x and "subject" in x)


def test_words_of_odd_texts(spark, tmp_path):
    texts = [None, "", " ..,", "é \xe9 \xe9 plain", "\U0001d400x-\xfc\x00\xfcber 1\xa02", "가\tÉa\xe9a", "a\r\nb", "\x7f{a}`b[c@d"] * 2
    made = [(k, texts[k], "en", "s") for k in range(len(texts))]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = [(k, w) for k, t, *_ in made for w in dict.fromkeys(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or ""))]
    assert pairs(spellings.words(spark, str(tmp_path)).select("doc_id", "word")) == sorted(found)
    want = sorted((w.translate(spellings._DECOMPOSED) if k % 2 else w, f"sources/s.md#{k}") for k, w in found)
    assert pairs(spellings.claims(spark, str(tmp_path)).select("subject", "source")) == want


def _random_tables(seed: int) -> tuple[list, list]:
    """Runs and a last table with few keys, so with many copies, in both Unicode forms, with anchors and statuses that are none."""
    rng = random.Random(seed)
    row = lambda: (rng.choice(["a", "\xe9", "é", "", "b"]), "r", rng.choice(["o", "p"]), rng.choice(["f", "f#1", "f#2", "g", "\xe9#1", "é#2"]), rng.choice([*K.STATUS_RANK, "weird"]))
    return [row() for _ in range(25)], [row() for _ in range(25)]


def _rebuilt(runs: list, last: list, known: set) -> tuple[list, list]:
    """(subject, relation, object, source, status) of the new table, and the keys it loses."""
    composed = lambda rows: [tuple(unicodedata.normalize("NFC", x) for x in r) for r in rows]
    key = lambda r: (*r[:3], r[3].split("#")[0])
    new, old, gone = {}, {}, {}
    for r in sorted((*r[:4], r[4] if r[4] in K.STATUS_RANK else "needs_review") for r in composed(runs)):
        if r[0] and key(r)[3] in known:
            new.setdefault(key(r), r)
    for r in sorted(composed(last), key=lambda r: (key(r), r[3], r[4])):
        old.setdefault(key(r), r[4])
        if r[4] == "superseded":
            gone.setdefault(key(r), r)
    engine = ("confirmed", "accepted")
    for k, r in new.items():
        o, s = old.get(k), r[4]
        new[k] = (*r[:4], o if o == "superseded" or s != "superseded" and o in engine or s in engine and o == "needs_review" else s)
    table = gone | new
    return sorted(table.values()), sorted({key(r) for r in composed(last) if r[4] != "superseded"} - set(table))


@pytest.mark.parametrize("seed", range(4))
def test_a_rebuild_equals_its_rules(spark, seed):
    runs, last = _random_tables(seed)
    want, lost = _rebuilt(runs, last, {"f", "\xe9"})
    known = spark.createDataFrame([("f",), ("é",)], "file string")
    got = merge.rebuild(claims(spark, *runs), claims(spark, *last), known)
    assert pairs(got.select(*K.TRIPLE, "source", "status")) == want and pairs(merge.destroyed(got, claims(spark, *last))) == lost
    assert set(got.columns) == {*K.TRIPLE, "source", "status", "confidence", "note"}


def test_a_merge_deals_each_side_out_once(spark, tmp_path):
    """Claims were written four times and dealt out seven times, and sorted as whole splits before that."""
    shown = plan(QUERIES["M1_merge_rebuild"](spark, "/root/testdata/sf0.001"))
    assert shown.count("Exchange hashpartitioning") == 2 and shown.count("REPARTITION_BY_NUM") == 2
    assert not [x for x in shown.split("Exchange hashpartitioning")[1:] if " Sort [" in x.split("SortMergeJoin")[0].split("SortAggregate")[0]]
    assert not list(tmp_path.parent.glob("shared*/facts-*")) and not list(tmp_path.parent.glob("shared*/merge-*"))


def test_names_beyond_a_size_are_merged(spark, monkeypatch):
    rows, known = claims(spark, ("s", "r", "o", "f#1", "accepted"), ("s", "r", "o", "g", "accepted")), spark.createDataFrame([("f",)], "file string")
    few = merge.normalized(rows, known)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(storage, "HELD", 0)
    try:
        many = merge.normalized(rows, known)
        assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(many)
        assert pairs(few.select("source")) == pairs(many.select("source")) == [("f#1",)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed", range(4))
def test_lost_claims_are_told_without_the_table(spark, seed):
    runs, last = _random_tables(seed)
    known = spark.createDataFrame([("f",), ("é",)], "file string")
    assert pairs(merge.lost(claims(spark, *runs), claims(spark, *last), known)) == _rebuilt(runs, last, {"f", "\xe9"})[1]


def test_lost_claims_need_each_side_once(spark):
    """The rebuilt table was made first, and then the last table was dealt out again to look for its keys."""
    shown = plan(QUERIES["J14_destroyed_decisions"](spark, "/root/testdata/sf0.001"))
    assert shown.count("Exchange hashpartitioning") == shown.count("REPARTITION_BY_NUM") == 2


def test_table_and_runs_are_reconciled_in_one_grouping(spark):
    """Each side was dealt out by key and status, then by key, and then both were joined."""
    shown = plan(QUERIES["J15_reconciliation"](spark, "/root/testdata/sf0.001"))
    assert shown.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in shown
    table = claims(spark, ("a", "r", "o", "f#1", "weird"), ("a", "r", "o", "f#2", "accepted"), ("b", "r", "o", "f", "accepted"), ("b", "r", "o", "f#1", "candidate"), ("\xe9", "r", "o", "f", "superseded"), ("c", "r", "o", "f", "accepted"))
    runs = claims(spark, ("é", "r", "o", "f#3", "accepted"), ("c", "r", "o", "f", "accepted"), ("c", "r", "o", "f#1", "candidate"), ("d", "r", "o", "g", "weird"))
    got = merge.reconciliation(table, merge.keyed(runs)).select("subject", "table_status", "run_status", "class").collect()
    assert {r.subject: tuple(r)[1:] for r in got} == {
        "a": ("accepted,weird", None, "status-unrecognised"), "b": ("accepted,candidate", None, "ambiguous-table"), "\xe9": ("superseded", "accepted", "repair"),
        "c": ("accepted", "accepted,candidate", "runs-disagree"), "d": (None, "weird", "run-only")}
