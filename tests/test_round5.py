"""What round 4's findings asked for."""

import pytest
from pyspark.sql import functions as F

from lodestone.queries import QUERIES


def plans(spark, start: int) -> list[str]:
    """Physical plans of the session's executions from number ``start`` on."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [x.physicalPlanDescription() for x in (found.apply(k) for k in range(found.size())) if x.executionId() >= start]


@pytest.mark.parametrize("query", ["run_annotation", "run_audit"])
def test_no_table_of_documents_is_broadcast(spark, sf_dir, query):
    """tables as long as the documents meet by key; the driver holds none of them, whatever their files' sizes say."""
    first = spark.range(1)
    first.collect()
    store = spark._jsparkSession.sharedState().statusStore().executionsList()
    start = max((store.apply(k).executionId() for k in range(store.size())), default=-1) + 1
    df = QUERIES[query](spark, sf_dir)
    assert df.count() == 200 and len(df.collect()) == 200
    made = plans(spark, start)
    assert len(made) > 5 and not [p for p in made if "Broadcast" in p]


def test_every_document_has_assessment_events(spark, sf_dir):
    """events of both assessments are there, one of each a document, beside those of findings."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    got = QUERIES["evidence_events"](spark, sf_dir).groupBy("category").agg(F.sum("events").alias("n")).collect()
    by = {r["category"]: r["n"] for r in got}
    assert by["content_document"] == by["privacy_document"] == n and by["privacy"] > 0
