"""Parquet tables of a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, count: int, *keys: str, each: int = 20_000) -> DataFrame:
    """rows by keys over as many tasks as there are cores, and more so that a task has about `each` of the `count` rows.

    For rows that are few bytes where they are read and far more later: by its bytes Spark
    would give them all to a few tasks, and a task's share would grow with the input."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // each)), *keys)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below the checkpoint folder that all executors share; on one machine, a temporary folder of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = at.get() if at.isDefined() else None
    if not top and spark.sparkContext.master.startswith("local"):  # one machine: its disk is shared by all there is
        import tempfile

        top = "file://" + tempfile.mkdtemp(prefix="stratalith-")
        spark.sparkContext.setCheckpointDir(top)
    if not top:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
