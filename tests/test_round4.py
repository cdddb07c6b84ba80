"""What round 3's findings on sizes asked for."""

from lodestone.operators import evidence, privacy
from lodestone.plans import profiles
from lodestone.queries import QUERIES


def test_points_and_frames_group_lines_once(spark, sf_dir):
    """F16: the query reads its steps' tables, not the line items once for each use."""
    assert not [f for f in QUERIES["track_flags"](spark, sf_dir).inputFiles() if "lineitem" in f]


def test_a_large_source_is_joined_in_blocks(spark, monkeypatch):
    """one source with most rows is many keys, and each pair comes once; sources of one side alone and null ones go."""
    monkeypatch.setattr(evidence, "DOC_BLOCK", 16, raising=False)
    monkeypatch.setattr(evidence, "HIT_BLOCK", 8, raising=False)
    docs = [(k, 1 if k < 200 else k % 5) for k in range(220)] + [(500, None), (7, 1)]
    hits = [(k, 1 if k < 90 else k % 7) for k in range(100)] + [(900, None), (3, 1)]
    got = evidence.of_own_source(spark.createDataFrame(hits, "hit bigint, source_id bigint"), spark.createDataFrame(docs, "doc_id bigint, source_id bigint"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where hits are many
    parts = got.rdd.glom().map(len).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted((r.doc_id, r.hit) for r in got.collect()) == sorted((d, h) for d, s in docs for h, t in hits if s == t and s is not None)
    assert max(parts) < sum(parts) / 2


def test_a_run_recalls_once(spark, monkeypatch):
    """the recall kernel sees each document once, whatever is compared of its findings."""
    real, seen = privacy.recall, spark.sparkContext.accumulator(0)

    def counted(docs):
        def passed(batches):
            for p in batches:
                seen.add(len(p))
                yield p

        return real(docs.mapInPandas(passed, docs.schema))

    monkeypatch.setattr(privacy, "recall", counted)
    docs = spark.createDataFrame([(k, f"write to a{k}@example.com or 1381234567{k % 10}") for k in range(40)], "doc_id bigint, text string")
    assert profiles.run(docs).events.count() >= 40
    assert seen.value == 40
