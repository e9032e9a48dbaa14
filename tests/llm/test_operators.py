"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimloom.llm import bpe, hmm, langid, mixing, pii, quality, queries, simhash, suffix_dedup, template, topk
from claimloom.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, fp string, keys string, n string"
WORDS = "the of and alpha beta gamma delta über été ñandú tion ing re".split()


def corpus(spark, n=60, seed=1):
    """Rows with nulls, empty and repeated texts, copies and clashing extra columns."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randint(0, 90)))
        if k % 9 == 4:
            text = rows[rng.randrange(k)][1] or "copy"
        if k % 13 == 6:
            text += " " + (rows[k - 1][1] or "")
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(text), 1, "x", "x", "x", "x"))
    rows += [(1000, None, None, None, None, None, None, None, None, None), (1001, "", "en", "a", 0, None, None, None, None, None), (1002, " \t\n", None, "b", 0, None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hmm_base_and_likelihood(spark):
    docs = corpus(spark)
    got = hmm.score(docs, fold("doc_id", 7) != 2, {"doc_id": F.col("doc_id")}, states=3, vocabulary=8, rounds=2).collect()
    texts = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"]) for r in docs.collect()]
    counts = Counter(w for k, t in texts if zlib.crc32(str(k).encode()) % 7 != 2 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((k, len(t), sum(w in counts for w in t), total) for k, t in texts)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = {k: sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t) for k, t in texts}
    assert all(abs(base[r.doc_id] - r.base_score) < 1e-8 and r.score < 0 for r in got)


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T
    texts = [np.array(x, "<i4") for x in ([0, 1, 4, 2], [3], [2, 2, 1, 0, 0])]
    layout = hmm.Layout(texts)
    _, scale, _ = hmm.forward(layout, start, move, emit)
    logs = np.bincount(layout.lane, weights=np.log(scale))
    starts, moves, gamma = hmm.expected(layout, start, move, emit)
    sums, want_moves = [], np.zeros((3, 3))
    for t in texts:
        paths = {p: start[p[0]] * math.prod(move[a, b] for a, b in itertools.pairwise(p)) * math.prod(emit[s, q] for s, q in zip(t, p, strict=True)) for p in itertools.product(range(3), repeat=len(t))}
        sums.append(sum(paths.values()))
        for p, w in paths.items():
            for a, b in itertools.pairwise(p):
                want_moves[a, b] += w / sums[-1]
    assert np.allclose(logs, np.log([sums[k] for k in layout.order]))
    assert np.allclose(moves, want_moves) and np.allclose(gamma.sum(axis=1), 1) and math.isclose(starts.sum(), 3)


def test_hmm_beats_the_base_on_held_out_text(spark):
    rng = random.Random(4)
    kinds = [["ab", "cd", "ef", "gh"], ["uv", "wx", "yz", "st"]]
    rows = [(k, " ".join(rng.choice(kinds[k % 2]) for _ in range(40))) for k in range(120)]
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), fold("doc_id", 7) != 2, {"held": fold("doc_id", 7) == 2}, states=2).where("held").collect()
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got) + 5 * len(got)


def test_mixing_matches_sql_and_targets(spark, tmp_path):
    docs = corpus(spark, 200)
    docs.write.parquet(f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    got = mixing.mix(stored).toPandas().sort_values(["doc_id", "size"]).reset_index(drop=True)
    want = duckdb.sql(mixing.MIX_SQL.format(docs=f"'{tmp_path}/d/*.parquet'")).df().sort_values(["doc_id", "size"]).reset_index(drop=True)[list(got.columns)]
    assert (got == want).all().all()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all()
    mixed = mixing.mixed(stored)
    assert mixed.columns == docs.columns and mixed.count() == got.epochs.sum()


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000], [0, 5], [7], [0, 0], [3, 3000, 3, 3000, 50, 1]])
def test_water_filling_is_the_fixed_point(spark, sizes):
    rows = spark.createDataFrame([(False, f"s{k}", n) for k, n in enumerate(sizes)], "no_source boolean, src string, source_size long")
    got = [r.target for r in mixing.source_targets(rows).orderBy("src").collect()]
    weights, caps, total, clamped = [k % 3 + 1 for k in range(len(sizes))], [3 * n for n in sizes], sum(sizes), set()
    while True:
        free = sum(w for k, w in enumerate(weights) if k not in clamped)
        left = total - sum(caps[k] for k in clamped)
        want = [caps[k] if k in clamped else left * weights[k] / free for k in range(len(sizes))]
        over = {k for k, t in enumerate(want) if t > caps[k] + 1e-9}
        if not over:
            break
        clamped |= over
    assert np.allclose(got, want)


def test_template_words_are_no_slots(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(12):
        body = [" ".join(rng.choice(WORDS) + str(rng.random()) for _ in range(12)) for _ in range(3)]
        extra = "".join(f"<div><p>{b}</p></div>" for b in body)
        rows.append((k, "http://h.example/x", f"<body><div><p>Daily   Gazette of the town</p></div><div>{extra}</div><div><p>Printed at the old mill by hand</p></div></body>"))
        want[k] = "\n\n".join(body)
    rows += [(100, "http://other.example/", "<article><p>a&amp;b <b>c</p><p>d"), (101, None, None), (102, "nonsense", ""), (102, "nonsense", "")]
    got = template.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("classes", F.lit(2)))
    texts = {r.page_id: r.text for r in got.collect()}
    assert {k: texts[k] for k in want} == want
    assert texts[100] == "a&b c\n\nd" and texts[101] == "" and texts[102] == "" and got.count() == len(rows)
    assert template.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)


def test_quality_counts_and_outliers(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(120)), "en", "s") for k in range(150)]
    junk = [(500 + k, " ".join(rng.choice(WORDS) + "###$$$" for _ in range(120)), "en", "s") for k in range(20)]
    odd = [(900, None, None, None), (901, "a b c d e a b c d e\nx\n\nx #\nx", "en", "s"), (902, "é ü #|| " * 3, None, "s"), (903, "", "de", None), rows[0]]
    docs = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("clash"))
    got = quality.quality(docs).collect()
    for r in got:
        text = {x[0]: x[1] for x in rows + junk + odd}[r.doc_id] or ""
        want = brute_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.doc_id < 500) or 900 < r.doc_id
    kept = {r.doc_id for r in got if r.kept}
    assert {k for k, *_ in rows} == kept and len(got) == len(rows + junk + odd)
    assert quality.good_documents(docs).columns == docs.columns and quality.good_documents(docs).count() == 151
    assert quality.quality(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "x " * 40, "a b c d e f a b c d e f", "a b a b a b a b", "p q r s t u v p q r s t"])
def test_repeated_words(text):
    assert quality.repeated_words(text.encode().split()) == brute_quality(text)[4]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(d)))
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((*m.span(), kind))
    return pii.in_order(out)


def test_pii_base_spans():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("01234567890123456789..@@++-- ()aZ_%é\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("x" * 200_000 + "@" * 10 + "1" * 200_000) == []


def test_pii_query(spark, tmp_path):
    texts = {1: "a@b.co, 4111 1111 1111 1111, 1.2.3.4 +49 30 1234567 c@d.org", 2: None, 3: "no", 4: "call (555) 123-4567 or x@y.zz"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op5_pii_spans(spark, str(tmp_path)).collect():
        want = brute_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in want) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(r.spans.split(","))


def test_pii_candidates_and_thresholds(spark):
    trained = pii.model()
    assert trained.report["precision"] > 0.97 and trained.report["recall"] > 0.95
    texts = {1: "call (555) 123-4567 now", 2: "mail jo.doe at example dot com ok", 3: "it was 2024-01-15 and 1,234,567 came", 4: 'token = "c9c98ab9d99cb9ca91c9afc9929999d9d9999449" e', 5: None, 6: "", 7: "a@b.co 4111 1111 1111 1111, 1.2.3.4 +49 30 1234567"}
    got = {r.id: r for r in pii.find(spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("spans", F.lit(1)), keep={"id": F.col("id")}, redact=True).collect()}
    assert got[1].redacted == "call [PHONE] now" and got[2].redacted == "mail [EMAIL] ok" and got[3].spans == [] and got[4].redacted == 'token = "[SECRET]" e'
    assert got[5].redacted is None and got[6].spans == [] and got[7].redacted == "[EMAIL] [CARD], [IP] [PHONE]"


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_top_k_matches_brute_force(spark, scale):
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1, 1) * scale for _ in range(7)]) for k in range(330)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (500, None), (600, [1.0, None]), (700, [float("nan")] * 7), (800, [float("inf")] * 7), (900, []), (1000, [0.5, 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("score", F.lit(1)), F.col("id") % 100 == 0, chunk=2)
    good = {k: [math.floor(1024 * x) for x in v] for k, v in rows if v and len(v) == 7 and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (k for k in good if k % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), k) for k, v in good.items() if k != q)[:10]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    ids = np.arange(20 * topk.BLOCK)
    vectors = np.repeat(np.arange(20), topk.BLOCK)[:, None] * 50 + rng.integers(0, 9, (len(ids), 4))
    best = topk.Best(1, 10)
    scored = topk.search_block_at_a_time(best, np.ones((1, 4), np.int64), np.array([-1]), np.full(1, topk._LEAST), topk.cut(ids, vectors))
    assert scored == 1 and set(best.id[0]) <= set(range(19 * topk.BLOCK, 20 * topk.BLOCK))


def test_most_blocks_of_clustered_vectors_are_left_out(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(16, 24))
    x = centers[rng.integers(0, 16, 16_000)] + rng.normal(size=(16_000, 24)) * 0.05
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    counted = spark.sparkContext.accumulator(0)
    got = topk.top_k(rows, F.col("id") % 100 == 0, counted=counted).collect()
    whole = np.floor(1024 * x).astype(np.int64)
    score = whole[::100] @ whole.T
    score[np.arange(160), np.arange(160) * 100] = -(1 << 60)
    want = {(100 * q, k + 1, int(i), int(score[q, i])) for q in range(160) for k, i in enumerate(np.lexsort((np.arange(len(x)), -score[q]))[:10])}
    assert {tuple(r) for r in got} == want
    assert counted.value < 0.3 * 160 * 16_000 / topk.BLOCK


def test_many_sizes_and_the_query(spark, tmp_path):
    rows = [(k, [float(k % 7)] * (1 + k // 2 % 1300)) for k in range(0, 5200)]
    spark.createDataFrame([*rows, (None, [1.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op6_exact_top_k(spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    own = {k: len(v) for k, v in rows}
    assert sorted((r.query_id, r.vec_id) for r in got.collect()) == sorted((q, k) for q in range(0, 5200, 100) for k in range(max(0, q - 2601), 5200) if k != q and own[k] == own[q])


def brute_repeats(docs):
    first = {}
    for k, t in docs:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], 1 << 62), k)
    out = []
    for k, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        out.append((k, len(t), sum(gone), sum(bool(g) and (not j or not gone[j - 1]) for j, g in enumerate(gone)), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, monkeypatch, small):
    if small:  # every buffer runs over
        for name, value in (("PIECE", 64), ("HELD", 30), ("HELD_NEAR", 5), ("AT_ONCE", 20), ("AT_ONCE_BYTES", 300), ("JUDGED", 40)):
            monkeypatch.setattr(suffix_dedup, name, value)
    docs = corpus(spark, 70, seed=8)
    more = spark.createDataFrame([(2000, "a" * 400), (2001, "b" * 30 + "a" * 120), (2002, "ab" * 90), (2003, "ab" * 90), (1000, "same id, other text, and fifty bytes are needed here for it to count at all")], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    if not small:
        assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_string_buckets():
    rng = np.random.default_rng(3)
    pieces = ["".join(rng.choice(list("ab"), 70)).encode() for _ in range(30)] + [b"a" * 90, b"a" * 60]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    bucket = suffix_dedup.string_buckets(text, np.array([len(p) for p in pieces]))
    strings, at = [], 0
    for p in pieces:
        strings += [(bucket[at + k], p[k : k + 50]) for k in range(len(p) - 49)]
        at += len(p)
    assert len({b for b, _ in strings}) == len({s for _, s in strings}) == len(set(strings))
    assert [s for _, s in sorted(strings)] == sorted(s for _, s in strings)  # identifiers keep the order of the strings


def brute_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    docs = corpus(spark, 80)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id").collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    print_of = {k: brute_fingerprint(t) for k, t in texts}
    parent = {k: k for k in print_of}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(print_of), 2):
        if (print_of[a] ^ print_of[b]).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert sorted((r.doc_id, r.f, r.component_id) for r in got) == sorted((k, f"{print_of[k]:016x}", root(k)) for k, _ in texts)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({root(k) for k in print_of})
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_bit_sliced_runs_and_hot_keys(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    values = np.unique([int(base[rng.integers(4)]) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for _ in range(150)])
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "RUN", 32)
    signed = [int(v) - (1 << 64) if v >= 1 << 63 else int(v) for v in values.tolist()]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    label = {r.node: r.label for r in simhash.components(simhash.links(frame, len(signed))).collect()}
    parts = {v: {v} for v in signed}
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and parts[a] is not parts[b]:
            parts[a] |= parts[b]
            for v in parts[b]:
                parts[v] = parts[a]
    assert all(label.get(v, v) == min(parts[v]) for v in signed)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901)], "fp long, hub long")
    assert {(r.node, r.label) for r in simhash.components(chain).collect()} == {(k, 0) for k in range(201)} | {(900, 900), (901, 900)}


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe_file())


def test_bpe_equals_the_library(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdeéèüßΣσİı日本'’s t#$%0123456789²½\x00\x1c\x85​　́😀ﬁÅ\n\t|") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "<|", "the ", "thing", "s's", " 'll"]) for _ in range(8)) for _ in range(200)] + ["supercalifragilistic" * 500, "", "cióneciónja ÀÉ", "a" * 3000]
    vocabulary, tokenizer = bpe.parsed(open(queries.word_bpe_file()).read()), library()
    for text, ids in zip(texts, vocabulary.encode_texts(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert tokenizer.decode(want, skip_special_tokens=False) == vocabulary.decode(ids)


def test_bpe_decode_leaves_out_ids_without_a_name(spark):
    vocabulary = bpe.parsed(open(queries.word_bpe_file()).read())
    ids = np.array([320, 10**6, 321, 2**32 - 1], "<u4")
    rows = spark.createDataFrame([(1, bytearray(ids.tobytes())), (2, None), (3, bytearray())], "doc_id long, ids binary")
    got = dict(map(tuple, bpe.decode(rows, queries.word_bpe_file(), keep={"doc_id": F.col("doc_id")}).collect()))
    assert got == {1: library().decode([320, 321], skip_special_tokens=False), 2: "", 3: ""} and vocabulary.decode(b"") == ""


def test_bpe_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids int")
    encoded = bpe.encode(docs, queries.word_bpe_file(), keep={"doc_id": F.col("doc_id")})
    assert encoded.columns == ["doc_id", "n_tokens", "ids"] and encoded.count() == 0
    assert bpe.decode(encoded, queries.word_bpe_file()).count() == 0


def test_bpe_query(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = library()
    want = []
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, queries.op9_bpe_trie(spark, str(tmp_path)).collect())) == sorted(want)


def test_language_id(spark):
    rng = random.Random(7)
    kinds = {"xx": ["lorem", "ipsum", "dolor"], "yy": ["tak", "nej", "måske"]}
    rows = [(k, " ".join(rng.choice(kinds[lang]) for _ in range(20)), lang) for k in range(80) for lang in ("xx" if k % 2 else "yy",)]
    rows += [(200, None, "xx"), (201, "123 !!", "yy"), (202, "tak tak", None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    held = fold("doc_id", 4) == 2
    got = defaultdict(list)
    for r in langid.predict(docs, langid.train(docs.where(~held)), keep={"doc_id": F.col("doc_id")}).collect():
        got[r.doc_id].append(r)
    assert all(r.lang_pred == lang and 0 < r.score <= 1 for k, _, lang in rows[:80] for r in got[k]) and len(got[0]) == 2
    assert got[200][0].lang_pred == got[201][0].lang_pred == "und" and got[202][0].lang_pred == "yy"
    assert langid.predict(docs, langid.train(docs.where("false")), keep={}).where("lang_pred <> 'und'").count() == 0
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, max_langs=1)
