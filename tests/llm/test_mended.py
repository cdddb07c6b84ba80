"""Texts with very many secrets, near copies without ids, names that the target weights leave out."""

import time

from lodestone.llm import mixing, secret_scan

import corpus_pipeline


def key_dump(n):
    return " ".join(f"{k:026x}+some_identifier_name_{k % 10}" for k in range(10**20, 10**20 + n))


def test_scan_is_linear_in_the_spans_of_a_text():
    import pyarrow as pa

    model = secret_scan.MarkovPair.trained(secret_scan.labelled_samples())

    def seconds(text):
        began = time.process_time()
        found = list(secret_scan.scanned(pa.record_batch([pa.array([text])], ["text"]), "text", model))
        return time.process_time() - began, len(found[0][2])

    seconds(key_dump(100))
    (short, n), (long, m) = seconds(key_dump(4000)), seconds(key_dump(8000))
    assert (n, m) == (4000, 8000) and len(key_dump(8000)) >= 399_999
    assert long < 2 and long < 3 * short + 0.1
    within, _ = seconds("password=" + ".".join(f"{k:026x}" for k in range(10**20, 10**20 + 16000)))  # one long span over all others
    assert within < 2


def test_left_over_equals_plain_version():
    import random

    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        buf = np.frombuffer("".join(rng.choice("ab+-/") for _ in range(60)).encode(), np.uint8)
        spans = [(p, p + rng.randrange(1, 15)) for p in (rng.randrange(0, 60) for _ in range(rng.randrange(0, 6)))]
        a = rng.randrange(0, 30)
        b = rng.randrange(a + 1, 61)
        free = [k for k in range(a, b) if not any(p <= k < q for p, q in spans)]
        want = []
        for k in free:
            if want and want[-1][1] == k:
                want[-1][1] = k + 1
            else:
                want.append([k, k + 1])
        out = []
        for x, y in want:
            while x < y and x > a and secret_scan.JOIN[buf[x]]:
                x += 1
            while x < y and y < b and secret_scan.JOIN[buf[y - 1]]:
                y -= 1
            if x < y:
                out.append((x, y))
        assert list(secret_scan.left_over(buf, a, b, *secret_scan.joined(spans))) == out


NEAR = " ".join(f"word{k}" for k in range(120))


def stays(spark, tmp_path, *rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()), key=str)


def test_near_copies_without_ids(spark, tmp_path):
    a, b, c = NEAR, NEAR + " more", "one " + NEAR
    assert len(stays(spark, tmp_path, (None, a), (None, b), (None, c))) == 1
    other = "quite another text " * 30
    assert stays(spark, tmp_path, (None, a), (8, b), (None, other)) == sorted([(8, b), (None, other)], key=str)
    assert stays(spark, tmp_path, (None, None), (None, ""), (3, ""), (3, "")) == sorted([(None, None), (None, ""), (3, "")], key=str)


def test_names_without_a_weight_share_the_rest(spark):
    weight = mixing.production()
    t = {("domain0", "en", "a"): 1000, ("domain0", "zh", "b"): 500, ("domain0", "", "c"): 500, ("domain9", "en", "d"): 1000}
    plan = mixing.budgets(t, 1500, weight, 2)
    assert sum(plan.values()) in (1498, 1499, 1500) and all(plan.values())
    rest = 1500 * mixing.REST / (1 + mixing.REST)  # of the one stated domain's weight, and again among languages
    assert plan["domain9", "en", "d"] == int(rest) and plan["domain0", "zh", "b"] == plan["domain0", "", "c"] == int((1500 - rest) * mixing.REST / (1 + mixing.REST) / 2)
    assert mixing.budgets(t, 10**6, weight, 2) == {k: 2 * n for k, n in t.items()}
    assert mixing.budgets({("x", "zh", "s"): 100, ("y", "zh", "s"): 300}, 200, weight, 1) == {("x", "zh", "s"): 50, ("y", "zh", "s"): 150}
    docs = spark.createDataFrame([(k, "w " * 20, "zh" if k % 2 else "en", "s") for k in range(400)], "doc_id bigint, text string, lang string, source string")
    taken = {r["lang"]: r["n"] for r in mixing.mixed(docs, 0.9, weight).groupBy("lang").agg({"n_copies": "sum"}).withColumnRenamed("sum(n_copies)", "n").collect()}
    assert taken["zh"] > 0 and abs(taken["en"] + taken["zh"] - 360) <= 2
