"""Contained names, identity classes and components against plain loops."""

import random

from claimloom.operators import graph, names


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_contained_names_equal_all_pairs(spark):
    rng = random.Random(13)
    made = sorted({"".join(rng.choice("aab é.B") for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"common", *[f"common {k}" for k in range(60)], "", "...", "aaaa"})
    df = spark.createDataFrame([(n,) for n in [*made, made[3], None]], "name string")
    fold = {n: "".join(c for c in n.lower() if c not in " ·_-/().,") for n in made}
    norms = {f for f in fold.values() if f}
    within = {(a, b) for a in norms for b in norms if a != b and a in b}
    assert rows(names.contained(df)) == within and len(within) > 500
    first = {f: min(n for n in made if fold[n] == f) for f in norms}
    want = {("equal", first[fold[n]], n) for n in made if fold[n] and n != first[fold[n]]} | {("contained", first[a], first[b]) for a, b in within}
    assert rows(names.pair_audit(df)) == want
    assert names.pair_audit(df.where("false")).count() == 0


def test_identity_classes_equal_union_find(spark):
    rng = random.Random(14)
    records = [(k, rng.choice([None, "", f"d{rng.randrange(60)}"]), rng.choice([None, f"p{rng.randrange(60)}"]), rng.choice([None, None, None, "d1"])) for k in range(150)]
    records += [(200 + k, "hub", None, None) for k in range(40)] + [records[0]]
    label = {r[0]: r[0] for r in records}
    changed = True
    while changed:
        changed = False
        for a in records:
            for b in records:
                if any(x and x == y for x, y in zip(a[1:], b[1:], strict=True)) and label[a[0]] != label[b[0]]:
                    label[a[0]] = label[b[0]] = min(label[a[0]], label[b[0]])
                    changed = True
    want = set()
    for r in records:
        held = {x for x in records if label[x[0]] == label[r[0]]}
        odd = ",".join(kind for k, kind in enumerate(("doi", "pmid", "arxiv"), 1) if len({x[k] for x in held if x[k]}) > 1)
        want.add((r[0], label[r[0]], len({x[0] for x in held}), odd))
    df = spark.createDataFrame(records, "record long, doi string, pmid string, arxiv string")
    assert rows(names.identity_classes(df)) == want
    assert names.identity_classes(df.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(f"n{k:03}", f"n{k + 1:03}") for k in range(64)]
    random.Random(1).shuffle(chain)
    assert rows(graph.components(spark.createDataFrame([*chain, ("x", "x")], "u string, v string"))) == {(f"n{k:03}", "n000") for k in range(65)} | {("x", "x")}
