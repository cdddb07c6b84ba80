"""Tables between the steps of an operator: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def merged(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the documents, sorted and merged.

    Sizes are guessed by those of Parquet files, where a column of few values takes next to nothing: without the hint
    tables of millions of rows would be sent through the driver.
    """
    return left.join(right.hint("merge"), on, how)


class Steps:
    """Tables of one operator's steps, in a folder of their own; :meth:`leave` deletes all but those that are still read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
        self._made: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, from a table: the plan so far ends there, and a lost executor costs one step."""
        path = f"{self.folder}/{len(self._made)}"
        df.write.parquet(path)
        self._made.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._step = path
        return out

    def free(self) -> None:
        """Shuffle files of steps that are done go, once the driver has forgotten their plans."""
        gc.collect()
        self.spark._jvm.System.gc()

    def leave(self, *tables: DataFrame) -> None:
        """Delete every table of these steps but the given ones."""
        used = {t._step for t in tables}
        for path in self._made:
            if path not in used:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        self._made = [p for p in self._made if p in used]
