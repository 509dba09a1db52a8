"""Results of files as they come, stored once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import ProjectStore


def store_each(stream: DataFrame, store: ProjectStore, project_id: str, table: str, transform: Callable[[DataFrame], DataFrame], checkpoint: str, source: str | None = None) -> StreamingQuery:
    """Writes what transform makes of each batch to one of the store's tables of data, until nothing new is there.

    A batch goes in under the stream's name (source, else its checkpoint) and the
    batch's number.  Spark gives a batch that it doesn't know to be done the same number
    and rows again, and the store takes it one time; so a stream that is killed at any
    point and started again leaves each file's result once.
    """
    name = source or checkpoint

    def save(batch: DataFrame, number: int) -> None:
        store.append(table, transform(batch).withColumn("project_id", F.lit(project_id)), once=(name, number), project_id=project_id)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(store: ProjectStore, table: str, source: str) -> DataFrame:
    """(batch, at, commit) of a stream's batches that the store has, to be polled."""
    return store.logs[table].entries().filter(F.col("source") == source).select("batch", "at", "commit").orderBy("batch")
