"""Licence scan, prefix trie and source divergence against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimloom.llm import divergence, license_scan, license_texts, prefix_trie, queries

DOCS = "doc_id long, text string, lang string, source string, n long, term string, value string, _text string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], DOCS).repartition(3)


# licence scan

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_base(text):
    words, places, labels = PLAIN.findall(lowered(text)), [], set()
    for phrase, label in license_texts.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def brute_labels(index, words):
    """Labels of notices with a window anywhere that covers enough and holds the phrases, every word and start tried."""
    out = set()
    for (label, text, must), idf_sum in zip(index.notices, index.whole, strict=True):
        size = len(text) + 3 * license_scan.SLACK
        for low in range(-size, len(words)):
            window = words[max(0, low) : max(0, low + size)]
            if sum(index.idf[w] for w in set(window) & set(text)) >= license_scan.COVER * idf_sum and all(any(window[i : i + len(p)] == p for i in range(len(window))) for p in must):
                out.add(label)
                break
    return out


def licensed_texts(rng):
    filler = "the of and copy software work version terms über naïve 4 0 license under notice".split()
    noise = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts, planted = [], []
    for k in range(120):
        label, notice, must = rng.choice(license_texts.NOTICES)
        words = notice.split()
        fixed = {w for p in must for w in p.split()}
        if len(words) > 20:  # a few words changed, none of a mandatory phrase
            for _ in range(2):
                at = rng.randrange(len(words))
                if not set(PLAIN.findall(lowered(words[at]))) & fixed:
                    words[at] = rng.choice(filler) if k % 2 else ""
        texts.append(noise(rng.randint(0, 60)) + rng.choice([" ", "\n// ", " ** "]) + " ".join(words) + " " + noise(rng.randint(0, 60)))
        planted.append(label)
    return texts, planted


def test_licence_labels_and_base_places(spark):
    rng = random.Random(5)
    texts, planted = licensed_texts(rng)
    clean = [" ".join(rng.choice("under the mit apache license version by nc und der cc terms of this".split()) for _ in range(80)) for _ in range(60)]
    odd = [None, "", " \t", "UNDER the MIT-license under the mit license", "cc by nc cc by nc", "under the mit", "İ ΣΑΣ cc by nc"]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts + clean + odd)]
    got = {r.doc_id: r for r in license_scan.find(documents(spark, rows), {"doc_id": F.col("doc_id")}).collect()}
    found = {w: sum(w in {x.encode() for x in PLAIN.findall(lowered(t))} for _, t, *_ in rows) for w in license_scan.Index(license_texts.NOTICES, {}, 0, {}).vocabulary}
    index = license_scan.Index(license_texts.NOTICES, license_texts.PHRASES, len(rows), found)
    for k, t, *_ in rows:
        r, base = got[k], brute_base(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base, t
        assert set(r.labels) == set(base[4]) | brute_labels(index, [w.encode() for w in PLAIN.findall(lowered(t))]), t
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert all(planted[k] in got[k].labels for k in range(len(texts)))


def test_licence_places_of_a_very_long_text(spark):
    notice = next(t for label, t, _ in license_texts.NOTICES if label == "isc")
    text = "word " * 300_000 + notice + " x" * 200_000 + " under the mit license" + " y" * 70_000 + " Apache License, Version 2"
    row = license_scan.find(documents(spark, [(1, text, "en", "s")]), {"doc_id": F.col("doc_id")}).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == brute_base(text)
    assert row.labels == ["apache-2", "isc", "mit"]
    assert license_scan.find(documents(spark, []), {"doc_id": F.col("doc_id")}).count() == 0


# prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    below = {v: [u for u in members if u[: len(v)] == v] for v in members}
    children = Counter(u[:-1] for u in members if u)
    out = []
    for v, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(v))
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below[v] if u)
        out.append((min(cs), len(v), min(members[v[:-1]]) if v else None, len(cs), children[v], sum(not children[u] for u in below[v]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows, tmp):
    spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, node long, pos string").repartition(3).write.mode("overwrite").parquet(f"{tmp}/conversations.parquet")
    got = queries.op12_prefix_trie(spark, str(tmp))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_trie_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 30), *range(100, 120), *range(201, 215), 300]:
        for turn in range(rng.choice([1, 2, 3, 4, 7, 9])):
            rows.append((c, turn if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "", None, "ünï"])))
    rows += rows[:5] + [(None, 1, "user", "lost")]
    assert trie_rows(spark, rows, tmp_path) == brute_trie(rows)


def test_trie_of_a_long_and_a_hot_conversation(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t % 7}") for c in (100, 101, 102, 117) for t in range(70 if c == 117 else 11)] + [(c, 0, "user", "same") for c in range(200, 260)]
    assert trie_rows(spark, rows, tmp_path) == brute_trie(rows)


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark, tmp_path):
    assert trie_rows(spark, [], tmp_path / "a") == []
    one = [(c, 0, "user", "x" * 1_000_000) for c in (1, 2, 5)]
    assert trie_rows(spark, one, tmp_path / "b") == brute_trie(one)


def test_a_node_with_many_ends_is_hashed_in_pieces(spark, monkeypatch):
    ends = spark.range(30_000).select(F.lit(7).cast("long").alias("node"), (F.col("id") * 3 - 100).alias("conv_id")).repartition(5)
    got = prefix_trie.end_digests(ends.union(spark.createDataFrame([(8, -4)], "node long, conv_id long"))).collect()
    want = {7: ",".join(str(i * 3 - 100) for i in range(30_000)), 8: "-4"}
    assert {r.node: r.sha256 for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


# source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_report(rows, most=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in [(t or "", g or "", s or "") for _, t, g, s in rows]:
        terms = TERM.findall(lowered(text))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups.add((lang, source))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = sorted(s for g, s in groups if g == lang)
        share = {}
        for s in [*sources, None]:
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            total = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}
        gap = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pair = [(sum(gap(share[s][t], share[x][t]) for t in kept), x) for x in sources if x != s]
            term = [(gap(share[s][t], share[None][t]), t) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < most]
    return sorted(out)


def speech(rng, n):
    words = "the Of and über é straße it's data DATA x9y ñ term один".split() + [f"w{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    rows = [(k, " ".join(rng.choice(words[: rng.choice([8, 30, len(words)])]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "c", None])) for k in range(n)]
    return [*rows, (900, None, "en", "d"), (901, "", "fr", "a"), (902, "... 12 \x00", "fr", "b"), (903, None, None, "é"), rows[0], (904, "alone", "it", "a")]


@pytest.mark.parametrize("width", [1 << 16, 64])
def test_divergence_equals_brute_force(spark, width):
    """A sketch far too small lets all terms pass, and changes nothing."""
    rows = speech(random.Random(2), 150)
    got = divergence.report(documents(spark, rows), most_terms=20, width=width)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_report(rows, 20)


def test_the_sketch_is_never_too_low(spark):
    rows = speech(random.Random(4), 120)
    docs = documents(spark, rows).select(F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("text", F.lit("")).alias("_text"))
    table = divergence.sketch(docs, 1 << 10)
    truth = defaultdict(Counter)
    for _, t, g, _ in rows:
        truth[(g or "").encode()].update({w.encode() for w in TERM.findall(lowered(t))})
    for lang, counts in truth.items():
        terms = list(counts)
        least = [min(int(row[a]) for row, a in zip(table, at, strict=True)) for at in zip(*divergence._places(lang, terms, 1 << 10), strict=True)]
        assert all(x >= min(divergence.LEAST, counts[t]) for t, x in zip(terms, least, strict=True))
    assert (table < divergence.LEAST).any()


def test_divergence_of_an_empty_table_and_a_very_long_text(spark):
    assert divergence.report(documents(spark, [])).count() == 0
    rows = [(k, "alpha beta " * (200_000 if k == 1 else 2), "en", "ab"[k % 2]) for k in range(6)]
    assert sorted(map(tuple, divergence.report(documents(spark, rows)).collect())) == brute_report(rows)
