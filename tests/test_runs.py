"""The whole run and the places of text, on small tables of odd rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import policies, regions
from lodestone.plans import full_run

TEXTS = {
    1: "一份普通的文件。", 2: "mail a@b.co please", 3: "he said kill them all", 4: "a news article on how to make a bomb", 5: "姓名：张三丰，电话 13812345678", 6: None, 7: "", 8: "大家到市中心集合。改成绩也行。没有别的", 9: "nothing here",
}


def run(spark, **kw):
    docs = spark.createDataFrame([(k, t, k in (3, 5)) for k, t in TEXTS.items()], "doc_id bigint, text string, out boolean")
    return full_run.run(docs, **kw)


def test_dispositions_follow_the_highest_floor(spark):
    r = run(spark)
    got = {x["doc_id"]: x for x in r.decisions.collect()}
    assert {k: v["disposition"] for k, v in got.items()} == {1: "P0", 2: "P1", 3: "P3", 4: "P3", 5: "P3", 6: "P0", 7: "P0", 8: "P3", 9: "P0"}
    assert got[3]["actions"] == "manual_review_required,hold_delivery" and got[3]["escalation"] == "hard_case_or_boundary_risk" and got[3]["priority"] == "high"
    assert "privacy_doc:exclude_from_training" in got[5]["reasons"] and "hard_case:heuristic" in got[5]["reasons"] and got[5]["trust"] == "degraded"
    assert {x["category"] for x in r.events.filter("doc_id = 1").collect()} == {"content_document", "privacy_document"}
    a = {x["doc_id"]: x for x in r.annotation().collect()}
    assert a[2]["redacted"] == "mail <EMAIL> please" and a[2]["delivery"] == "deliver" and a[5]["delivery"] == "hold" and a[6]["n_targets"] == 0
    u = {x["doc_id"]: x for x in r.audit().collect()}
    assert u[4]["document_type"] == "news_report" and u[4]["n_localised"] >= 1 and u[1]["audit_summary"] == "P0 / allow with 2 evidence events."
    r.done()
    only = run(spark, profile="privacy_only")
    assert {x["doc_id"]: x["disposition"] for x in only.decisions.collect()}[3] == "P0"
    with pytest.raises(ValueError):
        run(spark, profile="none")


def test_what_circulates_and_what_a_model_says(spark):
    answers = spark.createDataFrame(
        [(8, 0, "大家到市中心集合", "self_harm", "content.self_harm", "odd", None, ""), (9, 0, "not in it", "violence", "content.violent", "high", 0.9, "")],
        "doc_id bigint, window int, text string, risk_type string, policy_tag string, severity string, confidence double, explanation string",
    )
    r = run(spark, answers=answers)
    local = {(x["doc_id"], x["risk_type"], x["degraded"]) for x in r.localised.collect()}
    assert (9, "general_content_safety", True) in local  # its window has an answer that is not in the text
    assert any(i == 8 for i, _, _ in local)
    got = {x["doc_id"]: x for x in r.decisions.collect()}
    assert got[9]["disposition"] == "P3" and "content_localization:degraded" in got[9]["reasons"]
    docs = spark.createDataFrame([(1, True), (2, False), (3, None)], "doc_id bigint, out boolean")
    none = lambda s: spark.createDataFrame([], s)
    pieces = spark.createDataFrame([(k, "content", "reject") for k in (1, 2, 3)], "doc_id bigint, chain string, action string")
    events = none("doc_id bigint, category string, risk_type string, policy_tag string, severity string, confidence double, disputed boolean, suggestion string")
    cases = none("doc_id bigint, content_status string, privacy_status string, confidence double, recommended string, requires_manual_review boolean")
    d = full_run.decided(docs, pieces, none("doc_id bigint, degraded boolean, severity string"), none("doc_id bigint, chain string, action string, may_raise boolean, confidence double, review boolean"), events, cases, F.col("out"))
    assert {x["doc_id"]: x["disposition"] for x in d.collect()} == {1: "P5", 2: "P4", 3: "P4"}


def test_model_labels_are_put_right(spark):
    rows = [("到市中心集合", "", "self_harm", "content.self_harm"), ("考试答案", "", "self_harm", "x"), ("some words", "", "self_harm", "x"), ("some words", "of suicide", "self_harm", "x"), ("w", "", " ", ""), ("w", "", "violence", "content.v")]
    df = spark.createDataFrame(rows, "t string, e string, r string, p string")
    got = [tuple(x) for x in df.select(*full_run.relabelled(F.col("t"), F.col("e"), F.col("r"), F.col("p"))).collect()]
    assert got == [("political_sensitive", "content.political"), ("illegal_instruction", "content.illegal_instruction"), ("general_content_safety", "content.localized"), ("self_harm", "x"), ("general_content_safety", "content.localized"), ("violence", "content.v")]


BOX = "struct<x:double,y:double,w:double,h:double>"
BLOCK = f"image_id bigint, block int, text string, box {BOX}, confidence double, char_boxes array<{BOX}>"
INSTANCE = f"image_id bigint, instance int, text string, box {BOX}, confidence double, source string, char_boxes array<{BOX}>"


def test_regions_of_odd_spans(spark):
    at = lambda y, w=100.0, h=20.0: (0.0, float(y), w, h)
    blocks = spark.createDataFrame(
        [(1, 0, "Call 138-1234 now", at(0), 0.9, None), (1, 1, None, at(30), 0.5, None), (1, 2, "first line\n\n second", at(60, 100.0, 60.0), 0.8, None), (1, 3, "---", at(200), 0.7, None), (2, 0, "only block", at(0), 0.9, None), (3, 0, "", at(0), 0.9, None)], BLOCK
    )
    instances = spark.createDataFrame([(1, 0, "Second", (5.0, 5.0, 40.0, 10.0), 0.9, "char", [(5.0 + k, 5.0, 1.0, 10.0) for k in range(6)]), (1, 1, "  ", at(0), 0.9, "char", None), (1, 2, None, at(0), 0.9, None, None)], INSTANCE)
    images = spark.createDataFrame([(1, 1000.0, 1000.0), (2, None, None)], "image_id bigint, width double, height double")
    spans = spark.createDataFrame(
        [(1, 1, "second", None, None), (1, 2, None, 5, 13), (1, 3, "1381234", None, None), (1, 4, "not there at all", None, None), (1, 5, None, None, None), (1, 6, None, 900, 950), (1, 7, "x", 5, 2), (2, 1, "block", None, None), (3, 1, "word", None, None), (4, 1, "word", 0, 3), (1, 8, None, 4, 25)],
        "image_id bigint, span_id int, text string, start int, end int",
    )
    got = {(r["image_id"], r["span_id"]): (r["stage"], r["source"]) for r in regions.span_regions(spans, blocks, instances, images).collect()}
    assert got == {
        (1, 1): (1, "spotting_char_boxes"),
        (1, 2): (2, "char_span_weighted_estimate"),
        (1, 3): (3, "text_match_weighted_estimate"),
        (1, 4): (3, "text_match_full_block"),  # a block without words is held by any text
        (1, 7): (2, "char_span_weighted_estimate"),  # an end before the start: one character
        (1, 8): (2, "char_span_multi_block_union"),
    }  # (2, 1) and (3, 1): pictures without a size are as large as their one block, of which any region is too much
    units = [(r["unit"], r["start"], r["end"], r["box"]["y"]) for r in regions.ocr_units(blocks).filter("image_id = 1").orderBy("start").collect()]
    assert units == [("block_0001", 0, 17, 0.0), ("block_0003_line_0001", 18, 28, 60.0), ("block_0003_line_0003", 30, 37, 90.0), ("block_0004", 38, 41, 200.0)]
    chars = regions.offset_map(blocks).filter("image_id = 1").orderBy("index").collect()
    assert "".join(r["char"] for r in chars) == "Call 138-1234 now\nfirst line\n\n second\n---" and [r["index"] for r in chars] == list(range(41)) and [r["index"] for r in chars if r["virtual"]] == [17, 37]
    assert regions.span_regions(spans.limit(0), blocks.limit(0), instances.limit(0), images.limit(0)).count() == 0


def test_policies_in_plain_text(spark):
    df = spark.createDataFrame([("content.hate.group", 1), ("content.violent x", 2), ("Jailbreak_attempt", 3), ("other", 4), (None, 5)], "t string, k int")
    met = lambda said: {r["k"] for r in df.filter(policies.text_policy(said, F.col("t"))).collect()}
    assert met("please keep hate") == met("") == set()
    assert met("Exclude hate") == {1} and met("禁止 violent and porn") == {2} and met("block prompt injection, hate") == {1, 3}
    assert met("reject ALL of it") == {1, 2, 3, 4, 5} and met("排除全部") == {1, 2, 3, 4, 5}


def test_candidates_lose_no_pair(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    words += [w[: len(w) // 2] for w in words[:20]] + [w[:3] + "x" + w[3:] for w in words[20:40]] + ["a", "b", "", "ab"]
    spans = spark.createDataFrame([(k % 2, k, w) for k, w in enumerate(words)], "image_id bigint, span_id int, norm string")
    units = spark.createDataFrame([(k % 2, k, w) for k, w in enumerate(reversed(words))], "image_id bigint, unit_id int, norm string")
    run = lambda: sorted(map(tuple, regions.alike(spans, units).collect()))
    plain = run()
    monkeypatch.setattr(regions, "FEW", 0)
    assert run() == plain and len(plain) > 200
    two = lambda t: {t[i : i + 2] for i in range(max(len(t) - 1, 1))}
    want = {(k % 2, k, j) for k, a in enumerate(words) for j, b in enumerate(reversed(words)) if a and b and k % 2 == j % 2 and (a in b or b in a or len(two(a) & two(b)) / len(two(a) | two(b)) >= 0.56)}
    assert {x[:3] for x in plain} == want
