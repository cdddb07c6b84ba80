"""From documents to sampled token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of documents. Stages call the operators of lodestone.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, mixing, piece_sampling, secret_scan, toxicity
from lodestone.llm.common import among, bitmap, shared_dir, written

#: texts that a worker of the last stage gets at once; its lattices need the rest of the memory
BATCH_BYTES = 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels, does not reject."""
    model = toxicity.fitted_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).filter("predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of 0.8 or more): that of the smallest id.

    A null id says nothing of a document, so its text stands in for one, behind all ids that are given; documents that
    share an id stay or go together. Only texts that may go, or whose id is not theirs alone, leave their tasks.
    """
    stand_in = F.lit(1 << 62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1)
    key = F.coalesce(F.col("doc_id").cast("bigint"), stand_in)
    verdict = jaccard_join.jaccard_classes(docs.select(key.alias("doc_id"), "text"), n=5, num=4, den=5)
    lots = verdict.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("_stays"), F.count("*").alias("n"))
    unsure = written(lots.filter("not _stays or n > 1").select("_id", "_stays"), "unsure")
    may = among(bitmap(unsure, "_id"), key)
    settled = docs.filter(may).join(unsure, key == F.col("_id"), "left").filter(F.coalesce("_stays", F.lit(True))).dropDuplicates(["doc_id", "text"])
    return docs.filter(~may).unionByName(settled.select(*docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    out = secret_scan.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, as often as it takes them."""
    mixed = mixing.mixed(docs, mixing.SHARE, mixing.production()).filter("n_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("n_copies").cast("int")))).select(*docs.columns)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, with their piece ids."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # holds for what the session runs later too
    return piece_sampling.encoded(docs.select("doc_id", "lang", "source", "text"), piece_sampling.model_bytes(), keep_text=False, lean=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", one_of_each_group),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("pieces", sample_pieces),
]

#: the models and the search of the first and last stages are not SQL; tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
