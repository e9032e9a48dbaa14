"""Recall of each kind on lines that another rule makes than the examples, proposals in crowded numbers, odd rows."""

import random

import pytest

from claimloom.llm import pii, queries

rng = random.Random(77)
D = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
H = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))


def iban():
    body = D(18)
    return f"DE{98 - int(body + '131400') % 97:02d}{body}"


LINES = {
    "email": lambda: ("Please reach me by mail, ", rng.choice(["jane.roe [at] mail.example.org", "jane_roe {at} example.net", "Jane.Roe(AT)example(DOT)com", "j.roe at example dot org", "jane.r AT example.edu"]), " before noon."),
    "phone": lambda: ("You may call ", rng.choice([f"({D(3)}) {D(3)}-{D(4)}", f"{D(3)}-{D(3)}-{D(4)}", f"0{rng.randint(100, 999)} {D(7)}"]), " any time."),
    "secret": lambda: ("export API ", f'key="{H(40)}"', " done"),
    "account": lambda: ("Bank account ", iban(), " at the branch."),
    "identity": lambda: ("Her SSN is ", f"{D(3)}-{D(2)}-{D(4)}", " on file."),
    "device": lambda: ("The adapter MAC ", ":".join(H(2) for _ in range(6)), " was seen."),
    "birthdate": lambda: ("She was born ", rng.choice([f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.19{D(2)}", f"{rng.randint(1, 28)} May 19{D(2)}"]), " in town."),
    "street": lambda: ("My home address: ", rng.choice([f"{rng.randint(1, 99)} Kings Road", f"Gartenstraße {rng.randint(1, 99)}", f"{rng.randint(1, 99)} Willow Lane"]), ", upstairs."),
}


@pytest.mark.parametrize("kind", sorted(LINES))
def test_recall_of_each_kind(kind):
    model, found = pii.model(), 0
    for _ in range(60):
        before, span, after = LINES[kind]()
        line = before + span + after
        got = [line[a:b] for a, b, k, _ in model.select(line, pii.base_spans(line)) if k == kind]
        got += [line[a:b] for a, b, k in pii.base_spans(line) if k == kind]
        found += any(x in span and len(x) >= 0.7 * len(span) for x in got)
    assert found >= 54


def test_clean_lines_stay():
    lines = ["The 1,234,567 people of 2019-2020 read page 123-456.", "order 123-45-6789 of version 10.2.33", "We met at noon. The dot was red.", "10 20 30 40 50 60 70 80 90 11 22 33 44 55", "It began on 12.03.1984 and ended in 1991."]
    assert not [x for line in lines for x in pii.model().select(line, pii.base_spans(line))]


def test_numbers_side_by_side_are_proposed_and_runs_stay_linear():
    text = "call (555) 123-4567 (555) 123-4568 or 12 0171 1234567"
    proposed = {text[a:b] for a, b, kind in pii.candidates(text) if kind == "phone"}
    assert {"(555) 123-4567", "(555) 123-4568", "0171 1234567"} <= proposed
    assert len(pii.candidates("12 " * 50_000)) < 50_000 * 10


def test_long_spans_are_judged_whole():
    text = 'key = "' + "aB3" * 2000 + '" end'
    assert any(b - a == 6000 for a, b, _ in pii.candidates(text)) and len(pii.features(text, 7, 6007, "secret")) == len(pii.features("a 12345678", 2, 10, "phone"))


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_pii_spans(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and got.count() == 0
