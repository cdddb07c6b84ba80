"""Joins, repeated strings and searches against brute force, with nulls, ties and repeated rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_topk, jaccard_join, spotsigs, suffix_dedup

WORDS = [f"w{k}" for k in range(400)]


def near_copies(seed, n_words=90, copies=60):
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(n_words)]
    out = [base]
    for _ in range(copies):
        x = list(base if rng.random() < 0.6 else rng.choice(out))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            x[rng.randrange(len(x))] = rng.choice(WORDS)
        out.append(x)
    return [" ".join(x) for x in out]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = near_copies(1) + near_copies(2, 25, 40) + near_copies(3, 400, 20)
    texts += [None, "", "  ", "One", "one", "one two", "One  TWO\n", "a b c", "A b c", "x" * 5000, "é ü\x0b\x1c z"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) + " " + "shared passage words " * 8 for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def shingles(text, n):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute_components(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_components(spark, corpus, n, num, den):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").withColumn("n", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs, n, num, den).collect()}
    want = brute_components(corpus, n, num, den)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < len(want)


def test_jaccard_blocks_of_a_cluster(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 7)
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs, 3, 9, 10).collect()}
    assert got == brute_components(corpus, 3, 9, 10)


def test_jaccard_empty_and_repeated_rows(spark):
    assert jaccard_join.jaccard_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (2, "A b c d"), (None, "a b c d"), (9, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard_join.jaccard_classes(docs).collect())
    assert got == [(-1, 2), (2, 2), (4, 2), (4, 2), (9, 9)]


def test_jaccard_different_texts_of_null_or_equal_id(spark):
    """Families whose classes share a null id, or an id with other texts: every link is verified on the right sets."""
    rng = random.Random(12)
    base = [[rng.choice(WORDS) for _ in range(100)] for _ in range(8)]
    copy = lambda x: " ".join([*x[:-1], rng.choice(WORDS)])
    rows = [(None, copy(x)) for x in base for _ in range(3)] + [(100 + k, copy(x)) for k, x in enumerate(base[:4])]
    rows += [(7, copy(x)) for x in base[4:]] + [(200 + k, copy(x)) for k, x in enumerate(base[4:])]
    rows += [(None, " ".join(rng.choice(WORDS) for _ in range(50))), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs, 3, 9, 10).collect())
    plain = brute_components(list(enumerate((t for _, t in rows))), 3, 9, 10)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[plain[k][1]] = min(i, least.get(plain[k][1], i))
    assert got == Counter((i, plain[k][0], least.get(plain[k][1], i)) for k, (i, _) in enumerate(rows))
    assert sum(n for (i, _, c), n in got.items() if i is None and c is not None) == 24


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark = [False] * len(b)
        for q in range(len(b) - 99):
            if b[q : q + 100] in seen:
                mark[q : q + 100] = [True] * 100
            else:
                seen.add(b[q : q + 100])
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out[i] = (len(b), sum(mark), sum(m and (z == 0 or not mark[z - 1]) for z, m in enumerate(mark)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [16384, 2])
def test_repeated_strings(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(260))
    rows = corpus + [(1000 + k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(40))) + passage[rng.randrange(60) : 260 - rng.randrange(60)] + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(40)))) for k in range(40)]
    rows += [(2000, "z" * 700), (2001, "ab" * 333), (2002, passage[:99]), (2003, passage[:100]), (2004, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("s", F.lit(1)).repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicated(docs).collect()}
    want = brute_removed(rows)
    assert got == want
    assert any(0 < w[1] < w[0] for w in want.values())


def test_repeated_strings_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, twice, null_twice = make(150), make(300), make(240)
    rows = [(5, twice)] * 3 + [(7, make(50) + twice[20:200])] + [(9, make(40) + passage), (9, passage + make(60)), (9, "short")] + [(9, "short")]
    rows += [(None, null_twice)] * 2 + [(None, make(90) + null_twice[:120]), (None, make(200)), (None, None), (2**63 - 1, make(110)), (3, passage[10:140]), (-4, "")]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = brute_removed([(k, t) for k, (_, t) in enumerate(order)])
    assert got == Counter((order[k][0], *w) for k, w in want.items())
    assert sum(n for r, n in got.items() if r[0] == 5 and r[2] == 0) == 1


def test_repeated_strings_empty_table(spark):
    assert suffix_dedup.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_exact_topk_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "HELD", 1 << 16 if block > 16 else 1)
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) * (1 + k % 7) for _ in range(8)]) for k in range(300)]
    rows += [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (None, [1.0] * 8), (303, [float("inf")] * 8), (304, [0.0] * 8), (350, [1.0] * 8), (350, [1.0] * 8), (351, [1.0, 2.0]), (400, [2.0, 1.0]), (450, [1e20] * 8), (451, [1e20] * 7 + [-1e20]), (452, [-1e150] * 8), (500, [1e160] + [1.0] * 7)]
    rows += [(600 + k, [math.cos(k), math.sin(k)]) for k in range(120)]  # equal lengths
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    use = exact_topk.usable(df)
    got = {}
    for r in exact_topk.search(use, use.filter(F.col("id") % 50 == 0), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        s = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, max(-(2**63), min(-x, 2**63 - 1))) for k, (x, i) in enumerate(s)]
    empty = exact_topk.usable(spark.createDataFrame([], "vec_id bigint, embedding array<double>"))
    assert exact_topk.search(empty, empty, 5).count() == 0


def test_topk_order_keys():
    scores = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 2**200, -(2**200), 2**200 + 1]
    assert sorted(scores, key=exact_topk.order_key) == sorted(scores)


def test_topk_prunes_by_length_and_coordinates():
    import numpy as np

    rng = np.random.default_rng(0)
    c = np.floor(rng.normal(0, 40, (3000, 16)) * rng.lognormal(0, 1, 3000)[:, None])
    c = c[np.argsort(-np.linalg.norm(c, axis=1))]
    cn, cid = np.linalg.norm(c, axis=1), np.arange(3000)
    q = np.vstack([c[::300] * 2, np.zeros((1, 16))])
    qn, qid = np.linalg.norm(q, axis=1), np.arange(len(q)) + 10000
    theta = np.array([np.sort(q[i] @ c.T)[-5] for i in range(len(q))])
    got = dict(exact_topk.search_block(q, qn, qid, theta, c, cn, cid, 5))
    for i in range(len(q)):
        want = sorted(zip(-(q[i] @ c.T), cid))[:5]
        assert [(-s, v) for s, v in got[i]] == [(int(s), int(v)) for s, v in want]


def test_fingerprints(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").withColumn("signatures", F.lit(0))
    rows = {r["doc_id"]: r for r in spotsigs.with_next(docs, 7).collect()}
    ids = sorted(rows, reverse=True)
    for k, i in enumerate(ids):
        nxt = ids[(k + 1) % len(ids)]
        assert rows[i]["next_text"] == rows[nxt]["text"]
        assert rows[i]["next_signatures"] == rows[nxt]["signatures"]
    by_text = {}
    for r in rows.values():
        assert r["signatures"] == by_text.setdefault(r["text"], r["signatures"]) and r["signatures"]
    assert spotsigs.with_next(docs.limit(0), 7).count() == 0


def test_spot_pairs(spark):
    rng = random.Random(4)
    texts = []
    for k in range(8):
        base = [w for _ in range(60) for w in (rng.choice(["the", "of", "a"]), rng.choice(WORDS))]
        texts += [" ".join(base), " ".join(base), " ".join(base[:-4]), " ".join(base[:60])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sigs = {r["id"]: set(r["s"]) for r in docs.select(F.col("doc_id").alias("id"), spotsigs.signatures(F.col("text")).alias("s")).collect()}
    classes = {}
    for i in sorted(sigs):
        classes.setdefault(frozenset(sigs[i]), i)
    want = {(i, j) for i in classes.values() for j in classes.values() if i < j and len(sigs[i] & sigs[j]) >= 0.8 * len(sigs[i] | sigs[j])}
    got = {(r["id_a"], r["id_b"]) for r in spotsigs.near_pairs(docs).collect()}
    assert got == want and want
    assert Counter(len(p) for p in got) == {2: len(want)}


def plain_signatures(text, chain=2):
    """Sets of (anchor, next content words), or of word shingles where there is no chain."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [k for k, w in enumerate(words) if w not in spotsigs.ANCHORS]
    found = set()
    for k, w in enumerate(words):
        later = [words[j] for j in content if j > k][:chain]
        if w in spotsigs.ANCHORS and later:
            found.add((w, *later))
    return found or {tuple(words[k : k + spotsigs.SHINGLE]) for k in range(max(len(words) - spotsigs.SHINGLE, 0) + 1)}


def test_spot_signatures_with_marks_capitals_and_runs_of_anchors(spark):
    rng = random.Random(6)
    base = [rng.choice(["the", "of", "a", "on", "für", *WORDS[:9]]) for _ in range(120)]
    dirty = [f"{w.upper() if rng.random() < 0.5 else w.title()}{rng.choice(['&&&', ',', '!!', ''])}" for w in base]
    plain = [rng.choice(WORDS) for _ in range(80)]
    texts = [" ".join(base), " ".join(dirty), "THE!! OF!! AND!! Cat", "the of", "Of THE  (man) of\tthe  house", " ".join(plain), " ".join(plain[:-2]), "one", "one two three four", "", None]
    sigs = [r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    sets = [plain_signatures(t) for t in texts]
    assert [len(s) for s in sigs] == [len(s) for s in sets]
    assert all(len(set(a) & set(b)) == len(x & y) for a, x in zip(sigs, sets) for b, y in zip(sigs, sets))
    assert sigs[0] == sigs[1] and len(set(sigs[5]) & set(sigs[6])) == 76
    han = [r["s"] for r in spark.createDataFrame([("这是一个没有空格的中文句子示例文本",), ("这是一个没有空格的中文句子示例文字",)], "text string").select(spotsigs.signatures(F.col("text")).alias("s")).collect()]
    assert len(han[0]) > 10 and len(set(han[0]) & set(han[1])) == len(han[0]) - 1
    marks = [r["s"] for r in spark.createDataFrame([("&& %% !! ?? ;;",), ("&& %% !! ?? ::",)], "text string").select(spotsigs.signatures(F.col("text")).alias("s")).collect()]
    assert len(set(marks[0]) & set(marks[1])) == 2
