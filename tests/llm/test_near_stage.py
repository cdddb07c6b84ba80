"""The stage of near copies: only texts that may go, or whose id is not theirs alone, leave their tasks."""

import random

import corpus_pipeline


def _moved(spark):
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    every = spark._jsc.sc().statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_texts_that_stay_are_not_moved(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, texts[7]), (101, texts[8] + " end"), (200, "one two"), (200, "one two"), (200, "three four"), (None, "five six"), (None, "five six"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = corpus_pipeline.one_of_each_group(spark, docs, "")
    before = _moved(spark)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted(set(rows) - {(100, texts[7]), (101, texts[8] + " end")}, key=str)
    assert _moved(spark) - before < sum(map(len, texts)) / 4
