"""Secret scans, classifiers, language model, mixing, piece sampling and the pipeline against plain versions."""

import collections
import hashlib
import math
import random
import re
import statistics
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import katz, mixing, piece_sampling, quality_fm, secret_scan, spotsigs, toxicity
from lodestone.llm.common import text_buffers

HEXES = "0123456789abcdef"
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    s = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(s)]


def test_secret_spans(spark):
    rng = random.Random(1)
    rand = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    texts = [
        None, "", "plain words only", f"é token = \"{rand(HEXES, 40)}\" ü", "TOKEN:'abc' token=abcdef", "ſecret=abcdefgh passwd : zzzzzz.zz", f"AKIA{rand('ABCDEF0123', 16)}x AKIAAA", rand(HEXES, 23) + " " + rand(HEXES, 24) + "g" + rand(HEXES, 30),
        f"key {rand('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', 44)} end", "user_account_table_index_2024_backup_value", "password=secret=abcdefgh", "api_key==aaaaaa apikey=bbbbbb", "x" * 50000, "123456789012345678901234567890",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id bigint, text string").withColumn("spans", F.lit(3))
    rows = secret_scan.scan(df).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        want = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        got = [s for s in r["spans"].split(",") if s]
        assert [s for s in got if not s.startswith("markov")] == want
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["n_markov"] == 1 and by[9]["n_markov"] == 0 and by[2]["n_markov"] == 0
    masked = {r["doc_id"]: r["text"] for r in secret_scan.masked(df.drop("spans")).collect()}
    assert masked[3] == "é [SECRET]\" ü" and masked[2] == texts[2] and masked[0] is None
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_markov_scores_every_run_and_what_base_spans_leave(spark):
    m = secret_scan.MarkovPair.trained(secret_scan.labelled_samples())
    sure = lambda s: m.ratio(s.encode()) >= max(m.least_total, m.least_mean * len(s))
    rng = random.Random(2)
    rand = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = [rand(lower + upper, n) for n in (24, 32, 40, 64) * 8] + [rand(lower + upper + "0123456789", n) for n in (16, 17, 18, 19) * 8] + ["user_account_table_index", "requestHandlerFactory", "Geschwindigkeitsbegrenzung", "unwahrscheinlichkeit", rand("XYZQKW", 15)]
    runs += ["1" * 16, "=" * 30]
    key, other, digest = rand(lower + upper, 40), rand(lower + upper + "0123456789", 30), rand(HEXES, 26)
    texts = [f"see {r} here" for r in runs] + [f"é {key}-{digest}/{other} x", f"{digest}-{other}"]
    got = {r["doc_id"]: {x for x in r["spans"].split(",") if x.startswith("markov")} for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for k, r in enumerate(runs):
        assert bool(got[k]) == (len(r) >= 16 and sure(r)), r
    assert all(any(map(sure, runs[a:b])) for a, b in ((0, 32), (32, 64))) and not any(map(sure, runs[64:68]))
    assert sure(key) and sure(other)
    assert got[len(runs)] == {"markov:2:42", "markov:70:100"}
    assert got[len(runs) + 1] == {"markov:27:57"}


def test_markov_ratio_on_held_out_samples():
    m = secret_scan.MarkovPair.trained(secret_scan.labelled_samples())
    for s, y in secret_scan.labelled_samples(300, seed=123):
        if len(s) >= 20:
            assert (m.ratio(s.encode()) >= max(m.least_total, m.least_mean * len(s))) == bool(y)


def test_factorisation_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    m = quality_fm.FactorisationMachine()
    m.w, m.v, m.w0 = rng.normal(size=m.w.shape), rng.normal(size=m.v.shape), 0.3
    data, off = text_buffers(pa.array(["a b b c", "", None, "Zz! 9"]))
    r = quality_fm.features(data, off, 0, 4)
    for k, got in enumerate(m.margin(r)):
        x = np.zeros(len(m.w))
        x[r.idx[r.ptr[k] : r.ptr[k + 1]]] = r.val[r.ptr[k] : r.ptr[k + 1]]
        x[quality_fm.BUCKETS :] = m.dense(r.stats[k : k + 1])[0]
        on = np.flatnonzero(x)
        pair = sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for a, i in enumerate(on) for j in on[a + 1 :])
        assert got == pytest.approx(m.w0 + float(m.w @ x) + pair)


@pytest.mark.parametrize("query,label", [(quality_fm.op5_quality_classifier, "quality"), (toxicity.op6_toxicity, "toxic")])
def test_held_out_accuracy(spark, query, label):
    sf = "/root/testdata/sf0.01"
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == 1) == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    assert (got.predicted == got[label]).mean() >= 0.95
    fold, held = (3, 1) if label == "quality" else (5, 0)
    assert all(zlib.crc32(str(i).encode()) % fold == held for i in got.doc_id)


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for fit, score in ((lambda: quality_fm.fit(quality_fm.training_sample(docs, labels, "quality", 3, 1, 10)), quality_fm.scored), (lambda: toxicity.fitted_on(docs, labels), toxicity.scored)):
        assert all(0 <= r["score"] <= 1 for r in score(docs, fit()).collect())


def test_maximal_segments_match_their_definition():
    rng = np.random.default_rng(2)

    def slow(x, a, z):
        """The best segment (shortest of equals), then left and right of it."""
        best = max(((sum(x[i:j]), i - j, -i, i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, _, i, j = best
        return slow(x, a, i) + [(i, j)] + slow(x, j, z)

    for _ in range(150):
        x = np.round(rng.normal(-0.3, 1, rng.integers(0, 12)), 3)
        assert [(a, b) for _, a, b in toxicity.segments(x)] == slow(x.tolist(), 0, len(x))


def test_katz_against_brute_force_and_normalised(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    texts, at = [], 0
    while at < len(words):
        n = rng.randrange(0, 30)
        texts.append(" ".join(words[at : at + n]).upper() if n % 2 else " ".join(words[at : at + n]))
        at += n
    texts += [None, "", "never seen words", texts[0]]
    df = spark.createDataFrame([(i, t, i % 7 == 2) for i, t in enumerate(texts)], "doc_id bigint, text string, held boolean").repartition(5)
    rows = {r["doc_id"]: r for r in katz.score_texts(df).collect()}
    tok = {i: (t or "").lower().split() + [None] for i, t in enumerate(texts)}
    train = [i for i in tok if i % 7 != 2]
    u, b = collections.Counter(w for i in train for w in tok[i]), collections.Counter(p for i in train for p in zip([None] + tok[i], tok[i]))
    hist = lambda c: np.array([sum(v == k for v in c.values()) for k in range(katz.RANKS + 1)])
    n = sum(u.values())
    m = katz.Model(hist(u), hist(b), n, len(u))
    p1 = {w: float(m.p1(np.array([c]))[0]) for w, c in u.items()}
    assert sum(p1.values()) + m.unknown == pytest.approx(1)
    d = lambda c: float(m.discounted(np.array([c]))[0])
    seen, low = collections.Counter(), collections.Counter()
    for (a, c), k in b.items():
        seen[a] += d(k) / u[a]
        low[a] += p1[c]

    def p(a, c):
        if (a, c) in b:
            return (1 if 1 - seen[a] >= 1e-12 else u[a] / (u[a] + 1)) * d(b[a, c]) / u[a]
        if a not in u:
            return p1.get(c, m.unknown)
        left = 1 - seen[a] if 1 - seen[a] >= 1e-12 else 1 / (u[a] + 1)
        return left / (1 - low[a]) * p1.get(c, m.unknown)

    for a in list(u)[:20]:
        assert sum(p(a, c) for c in u) + p(a, "never") == pytest.approx(1)
    for i, t in tok.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in u for w in t), n)
        assert r["score"] == pytest.approx(sum(math.log10(p(a, c)) for a, c in zip([None] + t, t)))
        assert r["base_score"] == pytest.approx(sum(math.log10((u.get(w, 0) + 1) / (n + len(u) + 1)) for w in t))
    assert katz.score_texts(df.limit(0)).count() == 0


def test_good_turing_by_hand():
    """Counts of counts where the plain estimate fails: n5 > n4, and things seen 6 times are missing."""
    n = np.zeros(katz.RANKS + 1)
    n[[1, 2, 3, 4, 5, 8]] = 120, 40, 24, 10, 16, 9
    z = {1: 120.0, 2: 40.0, 3: 24.0, 4: 10.0, 5: 16 / 2.0, 8: 9 / 3.0}  # gaps: 4..8 around 5, 5..11 around 8
    xs, ys = [math.log(r) for r in z], [math.log(v) for v in z.values()]
    b, a = statistics.linear_regression(xs, ys)
    smooth = lambda r: math.exp(a + b * math.log(r))
    spare = 6 * smooth(6) / smooth(1)
    want = [((r + 1) * smooth(r + 1) / (r * smooth(r)) - spare) / (1 - spare) for r in range(1, 6)]
    got = katz.discounts(n)
    assert list(got[1:6]) == pytest.approx(want) and (got[0], got[6]) == (0, 1)
    assert all(0 < x < 1 for x in want) and want == sorted(want)
    absolute = (120 / (120 + 2 * 40))
    assert max(abs(x - (r - absolute) / r) for r, x in enumerate(got[1:6], 1)) > 0.01
    for odd in ([0, 7], [0], [0, 0, 0, 5], [0, 1, 50, 900]):
        n = np.zeros(katz.RANKS + 1)
        n[: len(odd)] = odd
        assert ((katz.discounts(n)[1:6] > 0) & (katz.discounts(n)[1:6] < 1)).all()


def test_budgets_go_to_siblings_first():
    t = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 300, ("b", "z", "4"): 1000}
    even = lambda path, n: 1.0
    assert mixing.budgets(t, 400, even, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "3"): 100, ("b", "z", "4"): 200}
    assert mixing.budgets(t, 1000, even, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 300, ("b", "z", "4"): 590}
    assert sum(mixing.budgets(t, 10**6, even, 2).values()) == 2820 and mixing.budgets({}, 5, even, 1) == {}


def plain_mixture(rows, share, weight, most, seed, order):
    """n_copies of every row: budgets handed down the tree, then whole epochs and the prefix of the seeded order."""
    leaf = lambda r: (r["domain"], r["lang"] or "", r["source"] or "")
    leaves = {}
    for k, r in enumerate(rows):
        leaves.setdefault(leaf(r), []).append(k)
    tokens = {p: sum(rows[k]["n_tokens"] for k in ks) for p, ks in leaves.items()}
    plan = mixing.budgets(tokens, int(share * sum(tokens.values())), weight, most)
    out = {}
    for p, ks in leaves.items():
        full, rest = divmod(plan[p], tokens[p]) if tokens[p] else (most, 0)
        so_far = 0
        for k in sorted(ks, key=lambda k: (order[k], rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0, rows[k]["text"] or "")):
            so_far += rows[k]["n_tokens"]
            out[k] = full + (so_far <= rest and full < most)
    return out


@pytest.mark.parametrize("bins", [4096, 4])
def test_mixture_takes_token_prefixes(spark, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BINS", bins)
    rng = random.Random(6)
    rows = [(i if i % 40 else None, "w " * rng.randrange(0, 40), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", None])) for i in range(500)] + [(7, None, "en", "s1")] + [(9, "same row of six words here", "en", "s1")] * 30
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("domain", F.lit("clash")).withColumn("_order", F.lit(3))
    weight = mixing.stated({"domain": {f"domain{k}": 1.0 + k for k in range(4)}, "lang": {"en": 3.0, "de": 1.0, "": 0.5}}, mixing.tempered(0.5))
    out = [r.asDict() for r in mixing.mixed(docs.drop("_order"), 0.8, weight).collect()]
    assert len(out) == len(rows) and collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(r[:2] for r in rows)
    # the order is that of the hash of seed, epoch, id and text
    leaf = lambda r: (r["domain"], r["lang"] or "", r["source"] or "")
    tokens = collections.Counter()
    for r in out:
        tokens[leaf(r)] += r["n_tokens"]
    plan = mixing.budgets(dict(tokens), int(0.8 * sum(tokens.values())), weight, 2)
    full = {p: plan[p] // n if n else 2 for p, n in tokens.items()}
    keyed = spark.createDataFrame([(k, full[leaf(r)], str(r["doc_id"]) if r["doc_id"] is not None else "", r["text"] or "") for k, r in enumerate(out)], "k int, f bigint, i string, t string")
    order = {r["k"]: r["h"] for r in keyed.select("k", F.xxhash64(F.lit(11), "f", "i", "t").alias("h")).collect()}
    assert plain_mixture(out, 0.8, weight, 2, 11, order) == {k: r["n_copies"] for k, r in enumerate(out)}
    taken = collections.Counter()
    for r in out:
        taken[leaf(r)] += r["n_tokens"] * r["n_copies"]
    assert all(b - 40 < taken[p] <= b for p, b in plan.items())
    again = mixing.mixed(docs.drop("_order").repartition(7), 0.8, weight).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["n_copies"]) for r in again) == collections.Counter((r["doc_id"], r["text"], r["n_copies"]) for r in out)
    assert mixing.mixed(docs.limit(0), 0.8, weight).count() == 0


def test_planted_secrets_are_found_and_prose_is_left(spark):
    """Random strings of every alphabet planted in real texts: recall and false alarms of the model alone."""
    rng = random.Random(8)
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("doc_id").collect() if r["text"]]
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF"]
    rows, planted = [], []
    for k in range(300):
        words = rng.choice(docs).split(" ")[:200]
        key = "".join(rng.choice(alphabets[k % 5]) for _ in range(rng.choice([20, 24, 32, 40, 64])))
        at = rng.randrange(len(words) + 1)
        before = " ".join(words[:at])
        planted.append((len(before) + (1 if at else 0), key))
        rows.append((k, " ".join([*words[:at], key, *words[at:]])))
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    hit = sum(f"markov:{s}:{s + len(key)}" in got[k].split(",") for k, (s, key) in enumerate(planted))
    every = sum(x.startswith("markov") for v in got.values() for x in v.split(",") if x)
    clean = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id bigint, text string")
    false = secret_scan.scan(clean).agg(F.sum("n_markov")).first()[0]
    assert hit / len(planted) >= 0.95 and hit / every >= 0.95 and false <= 2, (hit, every, false)


def test_operators_on_odd_rows(spark):
    """Null ids and texts, repeated rows, a long text and columns with clashing names give a row each; empty tables none."""
    long = "word other thing " * 20000
    rows = [(None, "one text"), (None, None), (1, "the a b"), (1, "the a b"), (2, ""), (3, long), (4, "Å ü \u3000 😀 " * 3), (-(2**63), "least id"), (2**63 - 1, "most")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("score", "held", "s", "n", "blob", "key", "vocab", "_key", "_block", "fingerprint")})
    lab = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = piece_sampling.model_bytes()
    for f in (
        lambda d: secret_scan.scan(d), lambda d: toxicity.scored(d, toxicity.fitted_on(d, lab)), lambda d: quality_fm.scored(d, quality_fm.fit(quality_fm.training_sample(d, lab, "quality", 3, 1, 10))),
        lambda d: katz.score_texts(d.withColumn("held", F.lit(False))), lambda d: katz.score_texts(d.withColumn("held", F.lit(True))), lambda d: spotsigs.with_next(d, 3), lambda d: piece_sampling.encoded(d, model).filter("sample = 1"),
    ):
        assert f(docs).count() == len(rows) and f(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(5, "only row of the table")], "doc_id bigint, text string")
    r = spotsigs.with_next(one, 3).first()
    assert r["next_text"] == "only row of the table"
    got = katz.score_texts(docs.withColumn("held", F.lit(True))).agg(F.max("train_tokens"), F.max("n_known")).first()
    assert tuple(got) == (0, 0)


def test_fingerprint_query_against_a_plain_version(spark, tmp_path):
    rng = random.Random(3)
    texts = ["the cat sat on the mat " * 3, "The dog of the house! and a bone", "", None, "é😀x", "a", "one two three four five", "the cat sat on the mat " * 3] + [" ".join(rng.choice(["the", "of", "cat", "dog", "sun", "a", "tree"]) for _ in range(rng.randrange(60))) for _ in range(30)]
    rows = [(k * 3 - 20, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in spotsigs.op10_document_fingerprints(spark, str(tmp_path)).collect()}
    ids = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    edited = {i: text[i][: len(text[i]) - len(text[i]) // 2] + text[ids[(k + 1) % len(ids)]][: len(text[i]) // 2] for k, i in enumerate(ids)}
    every = [*text.values(), *edited.values()]
    sigs = {r["t"]: set(r["s"]) for r in spark.createDataFrame([(t,) for t in set(every)], "t string").select("t", spotsigs.signatures(F.col("t")).alias("s")).collect()}
    like = lambda a, b: len(sigs[a] & sigs[b]) / len(sigs[a] | sigs[b])
    print_of = lambda t: ",".join(str(x) for x in sorted(sigs[t]))
    for k, i in enumerate(ids):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text[i]), hashlib.sha256(edited[i].encode()).hexdigest(), print_of(text[i]), print_of(edited[i]))
        assert r["near_edited"] == pytest.approx(like(text[i], edited[i])) and r["near_next"] == pytest.approx(like(text[i], text[ids[(k + 1) % len(ids)]]))


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a text without an id here", "en", "s1", 3), (1, None, None, None, 0), (2, "same words in both of them " * 4, "en", "s1", 9), (2, "same words in both of them " * 4, "en", "s1", 9), (3, "", "de", "s2", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() >= 0 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert k == 4 or out.columns == docs.columns
    kept = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in kept) == {None: 1, 1: 1, 2: 1, 3: 1}


VOCAB = [" ", "a", "b", " a", "ab", "ba", "aab", " ab", "é"]
LOGP = np.log(np.array([0.1, 0.12, 0.13, 0.15, 0.1, 0.1, 0.08, 0.1, 0.05] + [1e-4] * 256))


def tiny():
    text = [v.encode() for v in VOCAB] + [bytes([i]) for i in range(256)]
    return piece_sampling.Pieces.of(text, LOGP, np.arange(len(VOCAB)), np.arange(len(VOCAB), len(VOCAB) + 256))


def segmentations(s):
    if not s:
        return {(): 0.0}
    out = {}
    for i, v in enumerate(VOCAB):
        if s.startswith(v):
            out |= {(i,) + r: LOGP[i] + x for r, x in segmentations(s[len(v) :]).items()}
    if s[0] not in VOCAB:
        b = s[0].encode()
        out |= {tuple(len(VOCAB) + c for c in b) + r: len(b) * LOGP[-1] + x for r, x in segmentations(s[1:]).items()}
    return out


@pytest.mark.parametrize("text", ["aab ba\nx", "abab é", "", "ab", "  a", "日a"])
def test_samples_follow_the_lattice(text):
    want = segmentations(" " + text) if text else {(): 0.0}
    z = math.log(sum(map(math.exp, want.values())))
    p = {k: math.exp(v - z) for k, v in want.items()}
    n, k = 3000, 3
    data, off = text_buffers(pa.array([text] * n))
    lat, found = piece_sampling.sample_texts(tiny(), data, off, 0, n, piece_sampling.row_keys(pa.array(np.arange(n)), 5), k)
    first, pairs, total = collections.Counter(), collections.Counter(), 0.0
    for own in found:
        ids = [tuple(lat.ids(x.path)) for x in own]
        assert len(set(ids)) == len(ids) == min(k, len(p))
        assert [x.score for x in own] == sorted((x.score for x in own), reverse=True)
        for i, x in zip(ids, own):
            assert x.logp == pytest.approx(math.log(p[i]), abs=1e-9)
            total += p[i] / math.exp(x.inclusion) / n
            assert tiny().decode(np.array(i, np.int64)) == text
        first[ids[0]] += 1
        pairs[tuple(ids[:2])] += 1
    assert total == pytest.approx(1, abs=0.05)
    for i, q in p.items():
        assert abs(first[i] - n * q) <= 5 * math.sqrt(n * q * (1 - q)) + 1
        for j, r in p.items():
            if i != j:
                e = n * q * r / (1 - q)
                assert abs(pairs[i, j] - e) <= 5 * math.sqrt(e) + 1


def test_encoding_round_trip(spark):
    model = piece_sampling.model_bytes()
    texts = ["Hello world\n\ttab", None, "", " ", "▁ mark  two", "日本語 é 😀", "a" * 3000, "Hello world\n\ttab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    out = piece_sampling.decoded(piece_sampling.encoded(df, model), model).collect()
    assert all(r["round_trip"] and r["decoded"] == (r["text"] or "") for r in out)
    again = {(r["doc_id"], r["sample"]): r["ids_sha256"] for r in piece_sampling.encoded(df.repartition(3), model).collect()}
    assert again == {(r["doc_id"], r["sample"]): r["ids_sha256"] for r in out}
    count = collections.Counter(r["doc_id"] for r in out)
    assert count[0] == 3 and count[1] == count[2] == 1
    assert piece_sampling.encoded(df.limit(0), model).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        ids = collections.Counter(r["doc_id"] for r in rows)
        assert set(ids) <= set(before) and rows
        if k == 1:
            sets = {}
            for r in rows:
                w = r["text"].lower().split()
                sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
            for a in sets:
                for b in sets:
                    assert a >= b or not 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
        if k == 2:
            assert len(rows) == len(before) and not any("token = \"" in r["text"] and re.search("[0-9a-f]{24}", r["text"]) for r in rows)
        before = {r["doc_id"]: r["text"] for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert last.filter("not round_trip").count() == 0 and set(r["doc_id"] for r in last.collect()) == set(before)
