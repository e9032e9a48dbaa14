"""Template deduction: sites whose names mean nothing, layouts that share a host, odd rows, and brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimloom.llm import queries, template

WORDS = "red green blue stone river tree cloud house road field lamp door".split()
PAGE = "page_id long, url string, html string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(n))


def layout_a(rng):
    """(html, article) of a page whose elements and labels tell nothing."""
    body = [prose(rng, rng.randint(12, 40)) for _ in range(rng.randint(2, 5))]
    notes = "".join(f"<div class=q4><p>{prose(rng, 1)}</p><div class=q9>wrote</div><div class=q5>{prose(rng, rng.randint(9, 14))}</div></div>" for _ in range(rng.randint(0, 4)))
    paragraphs = "".join(f"<p>{x}</p>" for x in body)
    return f"<body><div class=q1><p>Evening Post</p></div><div class=q2>{paragraphs}<p>Write to us today about this</p></div><div class=q3>{notes}</div><div class=q6>Printed at the mill</div></body>", "\n\n".join(body)


def layout_b(rng):
    body = [prose(rng, rng.randint(12, 40)) for _ in range(rng.randint(2, 5))]
    paragraphs = "".join(f"<section><p>{x}</p></section>" for x in body)
    return f"<body><div class=z1><ul><li>up</li><li>down</li></ul></div><div class=z7>{paragraphs}</div><div class=z8>All rights kept by the house</div></body>", "\n\n".join(body)


def site(seed, n=30, host="h.example"):
    rng = random.Random(seed)
    made = [(layout_a if k % 5 < 3 else layout_b)(rng) for k in range(n)]
    return [(k, f"http://{host}/{k}", html) for k, (html, _) in enumerate(made)], [text for _, text in made]


def texts(spark, rows):
    return template.extract(spark.createDataFrame(rows, PAGE)).collect()


def test_two_layouts_without_names_are_read_by_their_slots(spark):
    rows, want = site(1)
    got = {r.page_id: r.text for r in texts(spark, rows)}
    assert [got[k] for k in range(len(rows))] == want
    alone = [template.main_text(html) for _, _, html in rows]
    assert all(x != y for x, y in zip(alone, want, strict=True))  # elements alone can't tell


@pytest.mark.parametrize("change", ["twice", "null", "same"])
def test_repeated_rows_and_null_ids_leave_the_template(spark, change):
    rows, want = site(2)
    rows = {"twice": rows + rows, "null": [(None, u, h) for _, u, h in rows], "same": [(7, u, h) for _, u, h in rows]}[change]
    assert Counter(r.text for r in texts(spark, rows)) == Counter(want * (2 if change == "twice" else 1))


def test_copies_of_one_page_are_read_by_their_elements(spark):
    html, text = "<nav>menu</nav><article><p>one long story of the town</p><p>and its end</p></article><footer>f</footer>", "one long story of the town\n\nand its end"
    assert {r.text for r in texts(spark, [(k, "http://c.example/", html) for k in range(20)])} == {text}


def test_deduction_equals_brute_force(spark):
    rows, _ = site(3, 24)
    pages = [[t for _, t in template.page_tokens(*template.blocks(html))] for _, _, html in rows]
    counts = [Counter(x) for x in pages]
    by_vector = defaultdict(list)
    for token in set().union(*pages):
        by_vector[tuple(c[token] for c in counts)].append(token)
    want = set()
    for vector, tokens in by_vector.items():
        share = [t for t in tokens if sum(map(bool, vector)) >= len(rows) * (template.TEXT_SHARE if t % 2 else template.LEAST_SHARE)]
        if len(share) >= template.LEAST_TOKENS and sum(map(bool, vector)) >= template.LEAST_PAGES:
            orders = {tuple(t for t in page if t in set(share)) for page in pages} - {()}
            first = {x[: len(share)] for x in orders}
            if len(first) == 1 and all(x == next(iter(first)) * (len(x) // len(share)) for x in orders):
                want.add(frozenset(share))
    found = template.templates(spark.createDataFrame(rows, PAGE).select(F.lit("h").alias("_host"), F.col("html").alias("_html"))).first()
    got = defaultdict(set)
    for c in found["template"]["classes"]:
        got[c["number"]].add(c["token"])
    assert {frozenset(x) for x in got.values()} == want and len(want) == 3


def test_nested_instances():
    assert template._nested([0, 9], 2, [1, 2, 3], 3)
    assert not template._nested([0, 2], 2, [1, 3], 2)


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows, want = site(4)
    monkeypatch.setattr(template, "BROADCAST", -1)
    monkeypatch.setattr(template, "SALTED", 4)
    got = {r.page_id: r.text for r in texts(spark, [*rows, (99, "http://alone.example/", "<p>x</p>"), (98, None, None)])}
    assert [got[k] for k in range(len(rows))] == want and got[99] == "x" and got[98] == ""


def test_names_of_columns_may_clash(spark):
    rows, want = site(5, 12)
    pages = spark.createDataFrame(rows, PAGE).withColumns({c: F.lit(1) for c in ("host", "_host", "_html", "template", "_salt", "classes", "row")})
    assert sorted(r.text for r in template.extract(pages).collect()) == sorted(want)


def test_deep_and_long_pages(spark):
    deep = "<div class=a>" * 3000 + "<p>inside</p>" + "</div>" * 3000
    long = "<article>" + "<p>word of the page</p>" * 20000 + "</article>"
    got = {r.page_id: r.text for r in texts(spark, [(1, "http://a/", deep), (2, "http://a/", long)])}
    assert got[1] == "inside" and got[2].count("word") == 20000


def test_query(spark, tmp_path):
    rows, want = site(6)
    spark.createDataFrame([*rows, (None, None, None)], PAGE).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op3_html_template(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.where("page_id IS NOT NULL").collect()) == [(k, x, len(x)) for k, x in enumerate(want)]
    assert got.where("page_id IS NULL").first()["text"] == ""
