"""Exact vector retrieval by inner product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUERY_BLOCK = 4096  # queries that are sent to all tasks at once
TILE = 1024  # vectors compared with them at once


def query_blocks(queries: DataFrame, query_id: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of at most `most` queries at a time; queries without a vector are left out."""
    ids, rows = [], []
    for r in queries.select(F.col(query_id).cast("long"), F.col("query").cast("array<double>")).filter("query is not null").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == most:
            yield np.array(ids, np.int64), np.array(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows)


def best(q: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by score and then the smaller id."""
    order = np.lexsort((vec, -score, q))
    q, score, vec = q[order], score[order], vec[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[place < k], score[place < k], vec[place < k]


def top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vec_id: str = "vec_id", digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """For each query (query_id, query) its k nearest rows of vectors (vec_id, embedding): (query_id, vec_id, score, place).

    Queries go out in blocks of bounded size, one pass over the vectors for each.
    A task multiplies tiles of vectors with a block and gives k rows a query, so what
    is shuffled doesn't grow with the vectors.  Scores are rounded before they are
    compared, and ties go to the smaller id; ids are whole numbers; vectors that are
    null are left out; all must have the same length.
    """
    session = vectors.sparkSession
    given = vectors.select(F.col(vec_id).cast("long"), F.col("embedding").cast("array<double>")).filter("embedding is not null")
    out = session.createDataFrame([], "q long, v long, score double")
    for ids, matrix in query_blocks(queries, query_id, block):
        shared = session.sparkContext.broadcast((ids, np.ascontiguousarray(matrix.T)))

        def near(batches, shared=shared):
            own, m = shared.value
            pool = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            least = np.full(len(own), -np.inf)  # of each query's k best so far
            for batch in batches:
                vec = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                for i in range(0, len(vec), TILE):
                    score = np.round(x[i : i + TILE] @ m, digits)
                    if len(score) >= k:
                        np.maximum(least, np.partition(score, len(score) - k, axis=0)[len(score) - k], out=least)
                    v, q = np.nonzero(score >= least)
                    pool = best(np.concatenate((pool[0], q)), np.concatenate((pool[1], score[v, q])), np.concatenate((pool[2], vec[i : i + TILE][v])), k)
            yield pa.RecordBatch.from_arrays([pa.array(own[pool[0]]), pa.array(pool[2]), pa.array(pool[1])], names=["q", "v", "score"])

        out = out.unionByName(given.mapInArrow(near, "q long, v long, score double"))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "v"))
    named = out.withColumn("place", place).filter(F.col("place") <= k)
    return named.select(F.col("q").alias(query_id), F.col("v").alias(vec_id), F.round("score", digits).alias("score"), "place")
