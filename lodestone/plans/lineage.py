"""Lineage of a run: START, COMPLETE and FAIL of each step with the rows it wrote, as a table.

A step writes its result through :meth:`Lineage.step`; an observation counts the rows on
their way, so nothing is read twice. Events are files of one row in the shared folder: a run
that dies leaves its START behind.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import shared_folder

EVENT = "run_id string, namespace string, step string, state string, at_ms bigint, inputs array<string>, outputs array<string>, rows bigint, error string"


class Lineage:
    """Events of one run."""

    def __init__(self, spark: SparkSession, namespace: str = "lodestone", folder: str | None = None):
        self.spark, self.namespace = spark, namespace
        self.folder = folder or f"{shared_folder(spark)}/lineage-{uuid.uuid4().hex}"

    def emit(self, run_id: str, step: str, state: str, inputs: list[str], outputs: list[str], rows: int | None = None, error: str | None = None) -> None:
        row = (run_id, self.namespace, step, state, int(time.time() * 1000), inputs, outputs, rows, error)
        self.spark.createDataFrame([row], EVENT).write.mode("append").json(self.folder)

    def step(self, name: str, make: Callable[[], DataFrame], path: str, inputs: list[str] | None = None) -> DataFrame:
        """Make a step's table, write it to ``path`` as Parquet and read it again; what goes wrong is an event and goes on."""
        run_id, inputs = uuid.uuid4().hex, inputs or []
        self.emit(run_id, name, "START", inputs, [path])
        try:
            df = make()
            seen = Observation(f"{name}-{run_id}")
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
            rows = seen.get["rows"]
        except Exception as e:
            self.emit(run_id, name, "FAIL", inputs, [path], error=f"{type(e).__name__}: {e}"[:1000])
            raise
        self.emit(run_id, name, "COMPLETE", inputs, [path], rows)
        return self.spark.read.schema(df.schema).parquet(path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).json(self.folder)

    def runs(self) -> DataFrame:
        """step, run_id, state (of the last event), rows, seconds, error; a run without an end is RUNNING."""
        e = self.events().groupBy("step", "run_id").agg(F.max_by(F.struct("state", "rows", "error"), F.struct("at_ms", (F.col("state") != "START").cast("int"))).alias("x"), ((F.max("at_ms") - F.min("at_ms")) / 1000).alias("seconds"))
        return e.select("step", "run_id", F.when(F.col("x.state") == "START", "RUNNING").otherwise(F.col("x.state")).alias("state"), "x.rows", "seconds", "x.error")
