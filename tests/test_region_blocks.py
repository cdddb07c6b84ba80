"""Spans and units of a large picture meet in blocks."""

import random

from lodestone.operators import regions


def test_blocks_give_the_pairs_of_plain_comparison(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé𐐨") for _ in range(rng.randrange(1, 25))) for _ in range(50)] + ["a", "ab", "aa", "", "ab"]
    words += [w[2:9] for w in words[:15]] + [w[:4] + "x" + w[4:] for w in words[15:30]]
    spans = spark.createDataFrame([(1, k, w) for k, w in enumerate(words)] + [(None, 0, "abc")], "image_id bigint, span_id int, norm string")
    units = spark.createDataFrame([(1, k, w) for k, w in enumerate(reversed(words))] + [(None, 0, "abc"), (1, 3, "abcd")], "image_id bigint, unit_id int, norm string")
    run = lambda: sorted(map(tuple, regions.alike(spans, units).collect()))
    plain = run()
    monkeypatch.setattr(regions, "FEW", 0)
    monkeypatch.setattr(regions, "TILE", 7)
    assert run() == plain and len(plain) > 150
    assert {x[3] for x in plain} == {True, False}
