"""Normal form C, full case folding and the operators that compare by them."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.functions.unicode import fold_case, nfc
from claimloom.operators import audit, conflicts, merge, text_search
from test_core import claims, pairs

C, D = "출판연도", unicodedata.normalize("NFD", "출판연도")


def test_nfc_equals_the_tables_of_unicode(spark):
    texts = [chr(c) for c in range(0x80, 0x30000, 7) if not 0xD800 <= c < 0xE000] + [chr(a) + chr(b) for a in (0x65, 0x1100, 0x915, 0xE9) for b in (0x301, 0x327, 0x1161, 0x93C, 0x20D0)] + ["ȩ́", "ȩ́", "", "plain"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([t for x in texts for t in (x, unicodedata.normalize("NFD", x), f"a{x}b")])] + [(-1, None)], "k long, t string")
    for r in rows.select("t", nfc(F.col("t")).alias("c"), fold_case(F.col("t")).alias("f")).collect():
        assert r.t is None and r.c is None and r.f is None or (r.c, r.f) == (unicodedata.normalize("NFC", r.t), r.t.casefold())


@pytest.mark.parametrize("rows, want", [
    ([("s", C, "2020"), ("s", D, "2021")], [("s", min(C, D), 2, "2020|2021")]),  # one relation in two forms contradicts itself
    ([(C, "r", "1"), (D, "r", "2")], [(min(C, D), "r", 2, "1|2")]),  # one subject in two forms
    ([("s", "r", C), ("s", "r", D)], []),  # one value in two forms is no contradiction
    ([("s", "r", C), ("s", "r", D), ("s", "r", "x")], [("s", "r", 2, "|".join(sorted([min(C, D), "x"])))]),
])
def test_contradictions_see_through_unicode_forms(spark, rows, want):
    facts = claims(spark, *[(*r, "f", "accepted") for r in rows])
    assert pairs(conflicts.conflicts(facts, [C, "r"])) == want
    assert pairs(conflicts.conflicts(facts, [D, "r"]).select("n_values")) == [(w[2],) for w in want]


def test_contradictions_by_alias_type_unit_and_chain(spark):
    facts = claims(spark, *[(*r, "f", "accepted") for r in [
        ("a", "게재연도", "2020"), ("a", unicodedata.normalize("NFD", "발행년도"), "2021"), ("b", "발행년도", "date(2020)"), ("b", "published", "2020.1.1"),
        ("c", "순위", "3위"), ("c", "순위", "제3호"), ("c2", "순위", "3째"), ("c2", "순위", "4 등"), ("d", "cost", "amount(5400,억)"), ("d", "cost", 'amount(0.54,"조")'), ("d2", "cost", "5 xu"), ("d2", "cost", "15 one"),
        ("e", "type", unicodedata.normalize("NFD", "코호트연구")), ("e", "type", "관찰연구"), ("e2", "type", "코호트연구"), ("e2", "type", "실험연구")]])
    aliases = spark.createDataFrame([("게재연도", "published"), ("발행년도", "published")], "raw string, canonical string")
    types = spark.createDataFrame([("published", "date", None), ("순위", "ordinal", None), ("cost", "amount", {"억": 10**8, "조": 10**12, "xu": 3, "one": 1})], "relation string, type string, units map<string,long>")
    above = spark.createDataFrame([("type", "코호트연구", "관찰연구")], "relation string, child string, ancestor string")
    got = conflicts.conflicts(facts, ["게재연도", "순위", "cost", "type"], types, aliases, above)
    assert pairs(got.select("subject", "relation", "competing")) == [("a", "published", "2020|2021"), ("c2", "순위", "3째|4 등"), ("e2", "type", "실험연구|코호트연구")]


def test_merge_keeps_one_form_and_refuses_a_loss(spark):
    known = spark.createDataFrame([(f"sources/{D}.md",)], "file string")
    runs = claims(spark, (D, "r", "amount(1,000,억)", f"sources/{D}.md#2", "candidate"), (C, "r", 'Amount( 1000 , "억" )', f"sources/{C}.md#1", "weird"))
    got = merge.rebuild(runs, claims(spark, (D, "r", 'amount(1000,"억")', f"sources/{D}.md", "accepted")), known)
    assert [(r.subject, r.object, r.source, r.status) for r in got.collect()] == [(C, 'amount(1000,"억")', f"sources/{C}.md#1", "accepted")]
    with pytest.raises(ValueError, match="1 decided"):
        merge.rebuild(runs, claims(spark, ("z", "r", "o", f"sources/{C}.md", "accepted")), known, allow_loss=False)
    with pytest.raises(ValueError, match="no rows"):
        merge.rebuild(runs.where("false"), claims(spark, ("z", "r", "o", "sources/x.md", "needs_review")), known, allow_loss=False)


def test_folded_copies_keep_the_best_row_and_tell_the_rest(spark):
    rows = spark.createDataFrame([(D, "r", "o", "f#2", "accepted", "0.9", ""), (C, "r", "o", "f#1", "accepted", "0.4", ""), (C, "r", "o", "f", "superseded", "0.4", ""), (C, "r", "o", "g", "accepted", "1", "")], "subject string, relation string, object string, source string, status string, confidence string, note string")
    assert [tuple(r) for r in merge.fold_spellings(rows).collect()] == [(C, "r", "o", "f", 3, "accepted", "0.4", "f#1", True, "accepted 0.9 1,superseded 0.4 1")]


def test_reconciliation_classes(spark):
    table = claims(spark, ("a", "r", "o", "f", "confirmed"), ("a", "r", "o", "f#2", "candidate"), ("b", "r", "o", "f", "odd"), ("c", "r", "o", "f", "accepted"), ("d", "r", "o", "f", "superseded"), ("e", "r", "o", "f", "accepted"), ("g", "r", "o", "f", "candidate"), ("h", "r", "o", "f", "candidate"))
    runs = claims(spark, ("a", "r", "o", "f", "candidate"), ("b", "r", "o", "f", "candidate"), ("c", "r", "o", "f", "candidate"), ("d", "r", "o", "f", "accepted"), ("e", "r", "o", "f", "confirmed"), ("g", "r", "o", "f", "accepted"), ("i", "r", "o", "f", "accepted"), ("k", "r", "o", "f", "accepted"), ("k", "r", "o", "f#1", "candidate"))
    want = {"a": "ambiguous-table", "b": "status-unrecognised", "c": "repair", "d": "repair", "e": "both-decided", "g": "table-pending-run-decided", "h": "table-only", "i": "run-only", "k": "run-only"}
    assert {r.subject: r["class"] for r in merge.reconciliation(table, runs).collect()} == want


@pytest.mark.parametrize("text, want", [("3째", 3), ("3회", None), ("3 위", 3), ("3RD", 3), ("제12 번", 12), ("제3", None), ("Ordinal( 4 )", 4)])
def test_ordinals(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(S.parse_ordinal(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("a, b, same", [("1,000", "1000", True), ("1,0000", "10000", False), ("1.5", "15", False), ("1.5", "1-5", True), ("Straße 1", "STRASSE1", True), (C, D, True), ("a_b", "A-b", True)])
def test_value_folds(spark, a, b, same):
    x, y = [r[0] for r in spark.createDataFrame([(0, a), (1, b)], "k int, x string").orderBy("k").select(audit.value_fold(F.col("x"))).collect()]
    assert (x == y) == same


def test_small_scalars(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "x string").select(f(F.col("x"))).first()[0]
    assert one(S.title_key, r"\emph*{Über} $x^2$ Test") == "uber test"
    assert one(S.canonical_amount, "amount(-1,000.5, kilometer per hour)") == 'amount(-1000.5,"kilometer per hour")' and one(S.canonical_amount, "amount(x)") == "amount(x)"
    assert one(S.parse_number_scaled, 'Number("1,000.5")') == 1000500 and one(S.parse_amount, "7 bn") is None
    names = spark.createDataFrame([("Straße",), (unicodedata.normalize("NFD", "Gäste"),), ("x",)], "name string")
    assert pairs(text_search.nearest(names, "strasze")) == [("Straße", 1)] and [r.distance for r in text_search.nearest(names, "GÄSTEN").collect()] == [1]
