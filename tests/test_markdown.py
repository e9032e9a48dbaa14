"""The markdown scan against the rules as they are read upwards from a line, over all short documents of an alphabet."""

import itertools
import re

import pytest

from claimloom.operators import markdown


def fenced(lines):
    """For each line whether it is code, by looking for each opener's first closer."""
    code, at = [False] * len(lines), 0
    mark = lambda x: re.match(r" {0,3}(```+|~~~+)(.*)", x)
    while at < len(lines):
        if m := mark(lines[at]):
            end = next((k for k in range(at + 1, len(lines)) if (c := mark(lines[k])) and c[1][0] == m[1][0] and len(c[1]) >= len(m[1]) and not c[2].strip()), len(lines) - 1)
            code[at : end + 1] = [True] * (end + 1 - at)
            at = end
        at += 1
    return code


def is_atx(x):
    return bool(re.match(r"#{1,6}( |$)", x))


def is_break(x):
    return bool(re.match(r" {0,3}\S", x)) and len(b := "".join(x.split())) >= 3 and set(b) in ({"-"}, {"*"}, {"_"})


def container(x):
    """What stands behind a list or quotation mark; None without one."""
    m = re.match(r" *(>|[-+*](?= |$)|\d{1,9}[.)](?= |$))(.*)", x)
    return m and m[2].strip()


def brute(text):
    lines, code, found, floor = text.splitlines(), fenced(text.splitlines()), [], 0
    for k, line in enumerate(lines):
        if code[k]:
            continue
        if is_atx(line):
            found.append((k, k + 1, len(line) - len(line.lstrip("#"))))
            floor = k + 1
        elif re.match(r" {0,3}(=+|-+)\s*$", line):
            run, held = [], None
            for j in range(k - 1, floor - 1, -1):
                if code[j] or not lines[j].strip() or is_atx(lines[j]) or is_break(lines[j]):
                    break
                if (held := container(lines[j])) is not None:
                    break
                run.insert(0, j)
            start = next((j for j in run if not lines[j].startswith("    ")), None)
            if start is None or held or lines[start].lstrip().startswith("<") or held == "" and lines[start].startswith(" "):
                continue
            found.append((start, k + 1, 1 if "=" in line else 2))
            floor = k + 1
    return found


ALPHABET = ["", "a", "    a", "# a", "#a", "---", "--", "- a", "-", "> q", "===", "```", "````", "~~~", "   ~~~ x", "<b>", " b", "1. x", "* * *"]


def test_headings_of_all_short_documents():
    for n in (1, 2, 3):
        for lines in itertools.product(ALPHABET, repeat=n):
            text = "\n".join(lines)
            assert [x[1:4] for x in markdown.scan(text) if x[0] == "heading"] == brute(text), lines


def test_headings_of_longer_documents():
    import random

    rng = random.Random(6)
    for _ in range(20_000):
        text = "\n".join(rng.choice(ALPHABET) for _ in range(rng.randint(4, 12)))
        assert [x[1:4] for x in markdown.scan(text) if x[0] == "heading"] == brute(text), text
        code = fenced(text.splitlines())
        spans = [x for x in markdown.scan(text) if x[0] in ("fence", "unclosed")]
        assert {k for x in spans for k in range(x[1], x[2])} == {k for k, c in enumerate(code) if c}
        assert [x[1] for x in markdown.scan(text) if x[0] == "bullet"] == [k for k, x in enumerate(text.splitlines()) if not code[k] and x.lstrip().startswith("- ")]


@pytest.mark.parametrize("title, want", [("## foo ##", "foo"), ("# foo#", "foo#"), ("#", ""), ("### ###", ""), ("# a \\#", "a \\#")])
def test_titles(title, want):
    assert [x[4] for x in markdown.scan(title)] == [want]


def test_rows_of_odd_documents(spark):
    long = "# t\n" + "x\n" * 300_000 + "end\n---\n"
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "# A\n\n## Plan (v2)\ntext\n## Plan (v2)\n# Ünï  cod\n```\n# no", 9), (4, long, 9), (4, long, 9)], "doc_id long, text string, start long")
    found = markdown.spans(docs)
    assert sorted((r.doc_id, r.start, r.body_end, r.title) for r in markdown.sections(found.where("doc_id = 3")).collect()) == [(3, 0, 5, "A"), (3, 2, 4, "Plan (v2)"), (3, 4, 5, "Plan (v2)"), (3, 5, 8, "Ünï  cod")]
    assert sorted((r.anchor, r.line) for r in markdown.anchors(found.where("doc_id = 3")).collect()) == sorted([("a", 0), ("plan-v2", 2), ("plan-(v2)", 2), ("plan-v2-1", 4), ("ünï-cod", 5)])
    assert found.where("doc_id = 4").count() == 4 and found.where("doc_id < 3").count() == 0
    assert [r.keyword for r in markdown.sections_without(found, docs.where("doc_id = 2"), spark.createDataFrame([("Plan",)], "keyword string")).collect()] == ["Plan"]
    assert markdown.spans(docs.where("false")).count() == 0


def test_policy_items(spark):
    text = "# Rules\n- [a_1] if `x`\n  and\t`y`\n\n* [b] s\nplain\n2. [c] t\n```\n- [no] code\n```\n- [d]  u \n- [E] no\n  - [f] nested"
    got = markdown.policy_items(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    assert sorted((r.line, r.name, r.sentence, r.relations) for r in got.collect()) == [(2, "a_1", "if `x` and\t`y`", ["x", "y"]), (5, "b", "s", []), (7, "c", "t", []), (11, "d", "u", []), (13, "f", "nested", [])]
