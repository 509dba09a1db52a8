"""Embeddings of texts by a pluggable function, in Arrow batches, and stores of them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS, BATCH = 384, 64
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of hashed words, of length 1; a text without words is all zeros.  The same everywhere, and needs no model."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            row[h % dimensions] += 1 if h >> 31 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def embedded(rows: DataFrame, text: str, embedder: Embedder = hashing_embedder, batch: int = BATCH) -> DataFrame:
    """rows with an array `embedding`; null texts count as empty.  The embedder gets at most `batch` texts at once."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["embedding array<float>"]

    def run(batches):
        for part in batches:
            texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            vectors = [embedder(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            flat = np.concatenate(vectors).astype(np.float32) if vectors else np.zeros((0, 1), np.float32)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * flat.shape[1])
            array = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([*part.columns, array], names=[*part.schema.names, "embedding"])

    return rows.mapInArrow(run, ", ".join(names))


def vector_store(files: DataFrame, chunker: Callable[[DataFrame], DataFrame], embedder: Embedder = hashing_embedder) -> DataFrame:
    """(chunk_id, body, embedding) of files (path, content): chunks of them, embedded."""
    chunks = chunker(files).select(F.concat_ws(":", "path", "chunk").alias("chunk_id"), "body")
    return embedded(chunks, "body", embedder)
