"""Policy files as tables, and globs against a plain matcher."""

import random
import re
import unicodedata

import pytest

from claimloom.operators import globs
from claimloom.sources import policy


def wrote(tmp_path, text, name="policy.md"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_aliases(spark, tmp_path):
    nfd = unicodedata.normalize("NFD", "게재연도")
    at = wrote(tmp_path, f"# a\n\n- `{nfd}` -> `year` # `no` -> `comment`\n* `발행` -> `year`\n- `a` → `b`\n- note `x`\nwords\n")
    assert rows(policy.aliases(spark, at)) == [("게재연도", "year"), ("발행", "year")]
    assert [(r.line, r.warning) for r in policy.warnings(spark, "aliases", at).collect()] == [(5, "not a mapping: `a` → `b`")]


@pytest.mark.parametrize("text, error", [("- `a` -> `b`\n- `a` -> `c`", "several"), ("- `a` -> `a`", "itself"), ("- `a` -> `b`\n- `b` -> `c`", "both")])
def test_aliases_that_can_not_hold(spark, tmp_path, text, error):
    with pytest.raises(ValueError, match=error):
        policy.aliases(spark, wrote(tmp_path, text))


def test_the_other_kinds(spark, tmp_path):
    at = wrote(tmp_path, "- 유형: 코호트 ⊂ 관찰\n- t: `a <: b` <: c d\n- t: x ⊂ x\n- none\n")
    assert rows(policy.hierarchy(spark, at)) == [("t", "a <: b", "c d"), ("유형", "코호트", "관찰")]
    assert [r.line for r in policy.warnings(spark, "hierarchy", at).orderBy("line").collect()] == [3, 4]
    at = wrote(tmp_path, "- `a b` : amount as cost (억=1e8, 만 = 10000) # c\n- d : date as day\n- e : colour as x\n- f : date as y (a=1)\n- g : amount as z (a=0.5)\n- h : date as 날\nbroken\n")
    assert rows(policy.types(spark, at)) == [("a b", "amount", "cost", {"억": 10**8, "만": 10**4}), ("d", "date", "day", None)]
    assert policy.warnings(spark, "types", at).count() == 5
    at = wrote(tmp_path, "- `a` = `b` = `a`\n`x`\n- `z` = `z`\n- `q` = w\n- `p\x1b` = `r`\nwords\n")
    assert [r.members for r in policy.synonyms(spark, at).collect()] == [["a", "b"]] and policy.warnings(spark, "synonyms", at).count() == 4
    at = wrote(tmp_path, "- drafts/\n* no bullet\n*.md\n- `with space.md`\n# c\n*.md\n")
    assert rows(policy.ignore_globs(spark, at)) == [("* no bullet",), ("*.md",), ("drafts/",), ("with space.md",)]
    at = wrote(tmp_path, "# Questions\n- [q1] What?\n2. b: Why?\n- plain one\ntext\n- [x] box\n")
    assert rows(policy.questions(spark, at)) == [("b", "Why?"), ("q1", "What?"), ("q3", "plain one")]
    at = wrote(tmp_path, "- `a b` c\nd e\n\n# x\n- f\n- d\n")
    assert rows(policy.names(spark, at)) == [("a b",), ("d",), ("f",)]


def test_files_are_partitions_and_nothing_is_empty(spark, tmp_path):
    for k in range(3):
        wrote(tmp_path, f"- `a{k}` -> `b`", f"{k}.md")
    wrote(tmp_path, "- `no` -> `no`", ".hidden")
    got = policy.read(spark, "aliases", str(tmp_path))
    assert got.rdd.getNumPartitions() == 3 and len({r.file for r in got.collect()}) == 3
    assert policy.names(spark, f"file://{tmp_path}/absent").count() == 0


def matcher(pattern):
    """Patterns cut into wildcards and letters, by the rules in their own words."""
    pattern += "**" if pattern.endswith("/") else ""
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return re.compile("".join(meaning.get(x, re.escape(x)) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]", pattern)), re.DOTALL)


def test_globs_equal_every_glob_on_every_path(spark):
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("ab.+(é") for _ in range(rng.randint(1, 3)))
    paths = sorted({"/".join([rng.choice(["sources", "runs/sources", "x"]), *[name() for _ in range(rng.randint(1, 3))]]) for _ in range(600)})
    wild = lambda: rng.choice([name(), name(), "*", "**", "?" + name(), name() + "*", "*" + name()])
    patterns = sorted({"/".join(wild() for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", "/"]) for _ in range(2500)} | {"sources/**", "**/a", "x/", "[ab]", "a\\b"})
    want = {(p, g) for g in patterns for m in [matcher(g)] for p in paths if any(m.fullmatch(x) for x in [p, *[p[len(r) + 1 :] for r in globs.ROOTS if p.startswith(f"{r}/")][:1]])}
    got = globs.matches(spark.createDataFrame([(p,) for p in [*paths, paths[0]]], "path string"), spark.createDataFrame([(g,) for g in patterns], "pattern string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 1000
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
