"""What the findings of round 3 were about, on small tables."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import kernels
from lodestone.operators import dedup, evidence, privacy


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_rules_that_the_sql_of_the_run_does_not_know_still_count(spark):
    d = docs(spark, "un skeitberch ton", "call 050 48451681 now", "parent ionauxpa", "a@b.co")
    got = {(r["doc_id"], r["risk_type"], r["match"]) for r in privacy.post_processed(privacy.recall(d)).collect()}
    assert got == {(0, "secret", "skeitberch"), (1, "phone_number", "050 48451681"), (2, "person_name", "ionauxpa"), (2, "parent_contact", "ionauxpa"), (3, "email", "a@b.co")}
    assert [r["kinds"] for r in privacy.combined_identity(privacy.post_processed(privacy.recall(d))).collect()] == [["parent_contact", "person_name"]]


@pytest.mark.parametrize("turned", [False, True])
def test_of_events_of_equal_order_the_smallest_id_counts(spark, turned):
    rows = [(3000, 7000, [3000, 6000]), (6000, 7000, [6000])]
    e = spark.createDataFrame(rows[::-1] if turned else rows, "event_id bigint, ord bigint, finding_refs array<bigint>").coalesce(1)
    got = evidence.target_events(spark.createDataFrame([(6000, -1), (7, -1)], "finding_id bigint, event_id bigint"), e).collect()
    assert {(r["finding_id"], r["event_id"]) for r in got} == {(6000, 3000), (7, -1)}


def test_target_events_where_all_documents_have_labels(spark, tmp_path):
    spark.range(1, 7001).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(0).alias("toxic")).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{tmp_path}/labels.parquet/*.parquet')")
    want = dict(con.execute(entry.oracle_sql()["target_events"]).fetchall())
    assert {r["finding_id"]: r["event_id"] for r in entry.queries()["target_events"](spark, str(tmp_path)).collect()} == want


def test_texts_without_a_near_copy_do_not_move_for_near_pairs(spark, monkeypatch):
    """Of many texts of one small vocabulary only those with a partner reach the comparison of sets."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(150)]
    texts += [t + " tail" for t in texts[:5]]
    sizes, real = {}, dedup.tiled

    def noted(members, size):
        sizes[size] = members.count()
        return real(members, size)

    monkeypatch.setattr(dedup, "tiled", noted)
    rows = dedup.near_pairs(docs(spark, *texts)).collect()
    assert {(r["a"], r["b"]) for r in rows} == {(k, 150 + k) for k in range(5)} and len(rows) == 5
    assert sizes[dedup.TILE] < sizes[8 * dedup.TILE] / 2


def test_composition_holds_few_texts_at_once(spark):
    """A batch goes on in parts, with every row in its place."""
    texts = ["e\u0301" * (k % 5) + str(k) if k % 7 else None for k in range(300)]
    d = docs(spark, *texts).coalesce(1)
    got = {r["doc_id"]: r["text"] for r in kernels.nfc(d).collect()}
    assert got == {k: t and t.replace("e\u0301", "\u00e9") for k, t in enumerate(texts)}

    class Rows:
        schema = d.schema

        def mapInArrow(self, kernel, schema):
            return [b.num_rows for b in kernel(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})]))]

    assert sum(kernels.nfc(Rows())) == 300 and max(kernels.nfc(Rows())) <= 64
