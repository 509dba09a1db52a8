"""Blocks of documents: what the hashing operators of this subpackage work on.

A block is one row that holds some documents' texts, compressed; it is written
once to the shared folder, so that every later round reads the same blocks even
after an executor is lost.  A *round* sends, from each block, the sorted hashes
of some units (windows, n-grams, chunks) to buckets by their leading bits, and
gets back a few bits for each of them in the same order.

A unit that occurs in many documents of a block is sent once, so a bucket gets
at most one entry for a hash and block, however common the hash is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "block long, raw long, ids binary, lens binary, data binary"
ENTRIES = "bucket int, block long, blob binary"
ANSWERS = "block long, bucket int, answer binary"
#: Text bytes of a block, and text bytes behind a bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20


#: The doc_id of rows that have none: the newest of all.
NULL_ID = 2**63 - 1


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a table, below the checkpoint folder that all executors share."""
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


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df, written to the shared folder (or a path) and read back: cuts the lineage."""
    path = path or shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_row(docs: DataFrame, row: str) -> DataFrame:
    """docs with a column `row`, unique and in order of doc_id (null last), then of text; the doc_id itself if that is unique and never null."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    return stored(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()), "rows")


def packed(x: np.ndarray) -> bytes:
    """An unsigned array as compressed byte planes."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unpacked(b: bytes, kind=np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1) if len(raw) else np.zeros(0, kind)


def packed_sorted(h: np.ndarray) -> bytes:
    return packed(np.diff(h, prepend=np.uint64(0)))


def unpacked_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=np.uint64)


def joined(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def parted(b: bytes, n: int) -> list[bytes]:
    at, out = 4 * n, []
    for size in np.frombuffer(b, np.uint32, n).tolist():
        out.append(b[at : at + size])
        at += size
    return out


class Block:
    """Documents of a block in ascending order of id, then of text."""

    def __init__(self, number: int, ids: np.ndarray, texts: list[bytes] | None = None, lens=None, data: bytes = b""):
        self.number, self.ids = number, ids
        self.data = b"".join(texts) if texts is not None else data
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) if texts is not None else lens
        self.ends = np.cumsum(lens, dtype=np.int64)
        self.starts = self.ends - lens

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            yield self.data[a:b]


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES, path: str | None = None, first: int = 0) -> DataFrame:
    """Writes docs (doc_id, text) as blocks with numbers from `first` on, to a path or a new folder.  A null text counts as empty, a null doc_id as NULL_ID."""

    def pack(batches):
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def out():
            nonlocal ids, texts, held, count
            order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
            row = {
                "block": first + (part << 32) + count,
                "raw": held,
                "ids": np.array([ids[i] for i in order], np.int64).tobytes(),
                "lens": np.array([len(texts[i]) for i in order], np.int64).tobytes(),
                "data": zstandard.ZstdCompressor(5).compress(b"".join(texts[i] for i in order)),
            }
            count += 1
            ids, texts, held = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        SCHEMA = pa.schema([("block", pa.int64()), ("raw", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                raw = (t.as_py() or "").encode()
                ids.append(i.as_py())
                texts.append(raw)
                held += len(raw) + 16
                if held >= block_bytes:
                    yield out()
        if ids:
            yield out()

    two = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    return stored(two.mapInArrow(pack, BLOCKS), "blocks", path)


def id_array(ids: np.ndarray) -> pa.Array:
    """doc_ids as they were, null again where they were null."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def block_rows(batches, extra: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Block and the extra columns' values, one at a time."""
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            block = Block(
                cols["block"][i].as_py(),
                np.frombuffer(cols["ids"][i].as_py(), np.int64),
                lens=np.frombuffer(cols["lens"][i].as_py(), np.int64),
                data=zstandard.ZstdDecompressor().decompress(cols["data"][i].as_py()),
            )
            yield (block, *(cols[e][i].as_py() for e in extra))


def bucket_bits(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """So many leading bits of a hash give the bucket that a bucket stands for bucket_bytes of text."""
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    return max(4, int(np.ceil(np.log2(max(raw / bucket_bytes, 1)))))


def bucket_slices(h: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of sorted hashes, for buckets that have any."""
    edges = np.searchsorted(h, (np.arange(1, 1 << bits, dtype=np.uint64)) << np.uint64(64 - bits)) if len(h) else np.zeros((1 << bits) - 1, int)
    edges = np.concatenate(([0], edges, [len(h)]))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, int(edges[b]), int(edges[b + 1])


def entry_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int64()), pa.array(x, pa.binary())], names=["bucket", "block", "blob"])


def answers(entries: DataFrame, judge: Callable[[list[bytes], np.ndarray], list[bytes]]) -> DataFrame:
    """judge gets a bucket's blobs and their blocks, and returns an answer for each; then one row for each block: its answers."""

    def reduce(table: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in table.column("blob")]
        out = judge(blobs, table.column("block").to_numpy())
        return pa.table([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "answer"])

    each = entries.groupBy("bucket").applyInArrow(reduce, ANSWERS)
    return each.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("got"))


def with_answers(blocks: DataFrame, name: str, got: DataFrame) -> DataFrame:
    return blocks.join(got.withColumnRenamed("got", name), "block", "left")


def gathered(got: list | None, kind=np.uint8) -> np.ndarray:
    """The answers of a block's buckets in one array, in order of hash."""
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x["answer"]), kind) for x in sorted(got or (), key=lambda x: x["bucket"])]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def answer(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x.tobytes())


class WordHashes(dict):
    """64-bit hashes of words one by one; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


SPACES = [0x20, *range(0x09, 0x0E)]
IN_WORD = np.ones(256, bool)
IN_WORD[SPACES] = False
#: A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
#: Of the eight bytes from a word's place on, those that are its own, by how many they are.
OWN_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
PIECE_WORDS = 1 << 17


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, parted by spaces; where their words start and end; how many words each text has."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    inside = IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(lens + 1)))
    return data, starts, ends, np.diff(np.searchsorted(starts, bounds, side="right"))


def word_hashes(texts: list[bytes], fold: bool = False, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' words, one text after the other, and how many each has; fold: A-Z as a-z; other: hashes that owe nothing to the first.

    A word is read eight bytes at a time.  Each eight are mixed by a bijection of
    their own, which isn't linear, before they are summed, and the word's length
    goes in as well; so no pattern of places cancels out, however long the word.
    Works piece by piece, so memory stays in proportion to the texts."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, starts, ends, counts = word_spans(texts)
    data = np.concatenate((FOLDED.take(data) if fold else data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # from every place on
    seed = np.uint64(0x8CB92BA72F3D8DD7 if other else 0x452821E638D01377)
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), PIECE_WORDS):
        first, size = starts[i : i + PIECE_WORDS], ends[i : i + PIECE_WORDS] - starts[i : i + PIECE_WORDS]
        n = (size + 7) >> 3
        if n.max(initial=1) == 1:
            at, nth, left = first, np.zeros(1, np.uint64), size
        else:
            upto = np.cumsum(n) - n
            nth = np.arange(int(n.sum())) - np.repeat(upto, n)
            at, left = np.repeat(first, n) + 8 * nth, np.minimum(8, np.repeat(size, n) - 8 * nth)
            nth = nth.astype(np.uint64)
        x = mixed((eights.take(at) & OWN_BYTES.take(left)) ^ mixed(seed + nth * GOLDEN))
        x = x if len(nth) == 1 and len(x) == len(size) else np.add.reduceat(x, upto)
        out[i : i + PIECE_WORDS] = mixed(x ^ (seed + size.astype(np.uint64) * GOLDEN))
    return out, counts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the runs of n values that start at each place; the last n-1 places are left out."""
    k = len(x) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(k, np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64))
    for i in range(n):
        h = (h ^ x[i : i + k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return mixed(h)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each place, where the smallest of the w values from there on is; of equal values the last."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # the place sits in the low bits, so that a plain minimum carries it along
    bits = np.uint64(max(1, int(len(x)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    y = (x & ~low) | (low - np.arange(len(x), dtype=np.uint64))
    span = 1
    while span * 2 <= w:
        y = np.minimum(y[: len(y) - span], y[span:])
        span *= 2
    if span < w:
        y = np.minimum(y[: len(y) - (w - span)], y[w - span :])
    return (low - (y[:n] & low)).astype(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of this width from one of the starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0
