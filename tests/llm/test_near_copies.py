"""The pipeline's near-duplicate stage against brute force over planted copies of known similarity."""

import random

import pyarrow as pa

import corpus_pipeline
from claimloom.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def planted():
    """Texts with copies of which 1 to 16 words in 200 are others, and a chain of copies of copies."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for edits in range(1, 17):
        text = [word() for _ in range(200)]
        copy = list(text)
        for k in rng.sample(range(196), edits):
            copy[k] = word()
        texts += [" ".join(text), " ".join(copy)]
    chain = [word() for _ in range(200)]
    for _ in range(5):
        texts.append(" ".join(chain))
        chain[rng.randrange(200)] = word()
        chain[rng.randrange(200)] = word()
    return texts


def by_brute_force(texts):
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similarity(texts[a], texts[b]) >= 0.8 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return set(label)


def test_copies_of_similarity_up_to_the_bound_go_and_others_stay(spark):
    texts = planted()
    near = [similarity(a, b) for a, b in zip(texts[0:32:2], texts[1:32:2], strict=True)]
    assert sum(0.8 <= s < 0.95 for s in near) >= 3 and sum(0.6 < s < 0.8 for s in near) >= 3
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(by_brute_force(texts))


def test_pairs_beside_the_hub_and_hot_keys(spark, monkeypatch):
    """All texts share every key, so that the exact similarity alone decides, over chunks of a key."""
    monkeypatch.setattr(near_copies, "CHUNK", 7)
    texts = planted()
    rows = [(near_copies.node_of(w := near_copies.words_of(t.encode())), len(near_copies.shingles(w)), [1, 2]) for t in texts]
    distinct = spark.createDataFrame(rows, "node long, n int, keys array<long>")
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    links = near_copies.links(distinct, docs, "text")
    parts = near_copies.components(links, "a", "b")
    linked = {r.node: r.label for r in parts.collect()}
    assert len({linked.get(node, node) for node, _, _ in rows}) == len(by_brute_force(texts))


def test_edited_copies_of_one_text(spark, monkeypatch):
    """Copies near and far from one text, some of which share their edits, and no turns: pruning and pairs decide the rest."""
    monkeypatch.setattr(near_copies, "CHUNK", 7)
    monkeypatch.setattr(near_copies, "TURNS", 0)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for edits in (0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 12, 20):
        copy = list(base)
        for k in rng.sample(range(120), edits):
            copy[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
        if edits >= 4:  # another copy with the same edits and one more
            copy[rng.randrange(120)] = "again"
            texts += [" ".join(copy), " ".join(copy[:100])]
    rows = [(near_copies.node_of(w := near_copies.words_of(t.encode())), len(near_copies.shingles(w)), [1, 2]) for t in texts]
    distinct = spark.createDataFrame(rows, "node long, n int, keys array<long>")
    links = near_copies.links(distinct, spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    linked = {r.node: r.label for r in near_copies.components(links, "a", "b").collect()}
    assert len({linked.get(node, node) for node, _, _ in rows}) == len(by_brute_force(texts))


def test_bit_planes_propose_pairs_and_the_similarity_decides(spark, monkeypatch):
    """Without any minima the fingerprints' classes alone propose: alike texts go, others of the same fingerprint stay."""
    real = near_copies._keyed
    monkeypatch.setattr(near_copies, "_keyed", lambda words: [real(words)[0], pa.array([[]] * len(words), pa.list_(pa.int64())), *real(words)[2:]])
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(6):
        text = " ".join(word() for _ in range(4000))
        texts += [text, text + " end"]
    often = " ".join(word() for _ in range(11))
    texts += [" ".join([*[often] * 200, *[word() for _ in range(40)]]) for _ in range(2)]
    apart = [(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert max(apart) <= simhash.RADIUS and similarity(*texts[-2:]) < 0.8
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 4, 6, 8, 10, 12, 13]
