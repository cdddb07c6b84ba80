"""Labelled rows for the classifiers: which are held out, and a bounded sample to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod


def training_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, most: int, seed: int = 17) -> DataFrame:
    """doc_id, text, y of labelled rows outside the held-out fold, about ``most`` of them.

    Above ``most`` usable labels, those are kept whose seeded hash falls under a
    threshold, so no sort or single task is needed. What is kept is broadcast: ``most``
    bounds it. An id with several labels takes the largest.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(crc_mod("doc_id", fold) != held)
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = most / max(1, usable.count())
    if share < 1:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")
