"""Token-id files with Simple-8b words.

A file is a Parquet table, as only Spark reaches every store, with rows (shard,
chunk, payload); shards are ranges of doc_id, chunks follow one another within.
A payload begins with MAGIC and the sizes of seven parts:

    doc ids     int64, a null's place has -2**63
    counts      uint32, ids of each document
    ranks       uint32, the chunk's distinct ids, the most frequent first
    words       uint64, Simple-8b words of the ids' ranks
    raw         uint32, which words are bare numbers after an escape
    offsets     uint64, numbers before every STRIDE-th word
    check       uint32, crc32 of the ids

Ranks are small where ids are frequent, so more of them fit in a word.

Null text counts as empty, and so gives the end id alone.  Documents are in
ascending order of doc_id, null first, then of text; rows with equal doc_id are
separate documents; further columns are ignored; an empty table gives an empty
file.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import simple8b
from .token_ids import WordTokens, vocabulary

MAGIC, STRIDE = b"TIDS8B01", 1024
END = 1
CHUNK_IDS, CHUNK_BYTES = 1_000_000, 2 << 20
SHARD_BYTES = 32 << 20
NO_ID = -(2**63)


def pack_chunk(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    # ids are below a vocabulary's size, so a table by id is small
    n = np.bincount(ids)
    values = np.flatnonzero(n)
    values = values[np.argsort(-n[values], kind="stable")]
    rank = np.zeros(len(n), np.uint64)
    rank[values] = np.arange(len(values), dtype=np.uint64)
    words, raw = simple8b.encode(rank[ids] if len(ids) else np.zeros(0, np.uint64))
    sizes = simple8b.COUNTS[(words >> np.uint64(60)).astype(np.int64)]
    sizes[raw], sizes[raw - 1] = 1, 0
    before = (np.cumsum(sizes) - sizes)[::STRIDE].astype(np.uint64)
    keys = np.array([NO_ID if i is None else i for i in doc_ids], np.int64)
    parts = (keys, counts.astype(np.uint32), values.astype(np.uint32), words, raw.astype(np.uint32), before, np.array([zlib.crc32(ids.astype("<u4").tobytes())], np.uint32))
    return MAGIC + B.joined(*(p.tobytes() for p in parts))


def parts_of(payload: bytes) -> list[np.ndarray]:
    if payload[:8] != MAGIC:
        raise ValueError("not a chunk of token ids")
    kinds = (np.int64, np.uint32, np.uint32, np.uint64, np.uint32, np.uint64, np.uint32)
    return [np.frombuffer(p, k) for p, k in zip(B.parted(payload[8:], 7), kinds, strict=True)]


def unpack_chunk(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    keys, counts, ranks, words, raw, _, check = parts_of(payload)
    ids = ranks[simple8b.decode(words, raw.astype(np.int64)).astype(np.int64)] if len(words) else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check[0]:
        raise ValueError("a chunk of token ids is damaged")
    return [None if k == NO_ID else k for k in keys.tolist()], counts.astype(np.int64), ids


def ids_between(payload: bytes, start: int, stop: int) -> np.ndarray:
    """Some of a chunk's ids, decoded from the nearest offset on."""
    _, _, ranks, words, raw, before, _ = parts_of(payload)
    first = max(0, int(np.searchsorted(before, start, side="right")) - 1)
    last = int(np.searchsorted(before, stop, side="left"))
    lo, hi = first * STRIDE, min(len(words), last * STRIDE)
    raw = raw.astype(np.int64)
    if lo and lo in set(raw.tolist()):
        lo -= 1  # the escape stands before it
        skip = int(before[first])
    else:
        skip = int(before[first]) if len(before) else 0
    if hi in set(raw.tolist()):
        hi += 1
    mine = raw[(raw >= lo) & (raw < hi)] - lo
    return ranks[simple8b.decode(words[lo:hi], mine).astype(np.int64)][start - skip : stop - skip]


def in_order(docs: DataFrame, part_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id and text, dealt out by ranges of doc_id and sorted."""
    two = docs.select(F.col("doc_id").cast("long"), "text")
    size = two.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, round(size / part_bytes))
    return two.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")


def groups_of_rows(batches, most: int):
    """Lists of doc_ids and of texts' bytes, of about `most` bytes each."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append((t.as_py() or "").encode())
            held += len(texts[-1]) + 32
            if held >= most:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def write_token_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    tokenizer = tokenizer or vocabulary()

    def encode(batches):
        from pyspark import TaskContext

        words, shard = WordTokens.of(tokenizer), TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(groups_of_rows(batches, CHUNK_BYTES)):
            tokens, counts = words.encode(texts, end)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([pack_chunk(ids, counts, tokens)], pa.binary())], names=["shard", "chunk", "payload"])
        words.clear()

    in_order(docs).mapInArrow(encode, "shard int, chunk int, payload binary").write.option("compression", "none").parquet(path)


def read_token_ids(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row for each document: doc_id, start, n_tokens, ids_crc32, and its ids if asked for."""
    files = spark.read.schema("shard int, chunk int, payload binary").parquet(path)

    def count(batches):
        for batch in batches:
            n = [int(parts_of(x.as_py())[1].sum(dtype=np.int64)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["shard", "chunk", "n"])

    chunks = files.mapInArrow(count, "shard int, chunk int, n long")
    per_shard = chunks.groupBy("shard").agg(F.sum("n").alias("n")).collect()  # a row for each file
    total, base = 0, {}
    for row in sorted(per_shard, key=lambda r: r["shard"]):
        base[row["shard"]] = total
        total += row["n"]
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.uint32()))] * ids

    def decode(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        at, out = base[table.column("shard")[0].as_py()], [[] for _ in kinds]
        for x in table.column("payload"):
            docs, counts, tokens = unpack_chunk(x.as_py())
            stops = np.cumsum(counts)
            for d, a, b in zip(docs, (stops - counts).tolist(), stops.tolist(), strict=True):
                mine = tokens[a:b]
                for col, value in zip(out, (d, at + a, b - a, zlib.crc32(mine.astype("<u4").tobytes()), mine), strict=False):
                    col.append(value)
            at += len(tokens)
        return pa.table({name: pa.array(col, kind) for col, (name, kind) in zip(out, kinds, strict=True)})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    if ids:
        kinds[-1] = ("ids", pa.list_(pa.int64()))
    return files.groupBy("shard").applyInArrow(decode, schema)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = B.shared_dir(spark, "token-ids")
    write_token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_ids(spark, path)
