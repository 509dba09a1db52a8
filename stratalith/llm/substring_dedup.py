"""Substring dedup by a log-structured index of word-window fingerprints.

The fingerprint of a window of WINDOW words is its anchor: the smallest hash of the
ANCHOR-word runs in it.  Equal windows have equal fingerprints, and windows that
follow one another mostly share theirs, so a fifth as many are kept as there are words.
Documents come in batches, in blocks (blocks.py), and a batch is compared in two rounds:

1. *Merge-join.*  The batch's fingerprints go to buckets by their leading bits, where
   sorted runs of former batches lie.  A bucket finds which of the batch's occur
   twice, and which blocks of history have them.
2. *Verification.*  Windows with such fingerprints, of the batch and of those blocks
   of history, are compared by two 64-bit hashes of all their words, each made of
   word hashes that owe nothing to the other's; the smallest doc_id wins.

Then the batch's fingerprints become a run of the index, and ``compact`` merges the
runs into one.  Runs are stored in Spark's bucketed layout, so a batch's fingerprints
move to history, and history never moves, but when a compaction splits buckets that
have grown.

Results for odd input: null or empty text has no words and nothing is removed;
rows with equal doc_id are read as separate documents of equal age, none of
which removes from another; rows with a null doc_id are newer than all others; other
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

WINDOW, ANCHOR = 13, 5
BATCHES = 2  # of the query, by ranges of doc_id
RUN_BYTES = 16 << 20  # of a bucket's history, from which on a compaction splits it
OLD = -(2**62)  # the doc_id of all that is in the index: older than any batch
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
RUN = "bucket int, blob binary"
COMMITS = "number int, run string, blocks string, replaces boolean, bits int"


class Windows:
    """Words and windows of a block."""

    def __init__(self, block: B.Block, window: int, anchor: int):
        self.block = block
        x, self.counts = B.word_hashes(list(block.texts()))
        self.x = B.mixed(x)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        n = max(0, len(self.x) - window + 1)
        self.valid = self.row[:n] == self.row[window - 1 : window - 1 + n]
        g = B.grams(self.x, anchor)
        self.place = B.sliding_argmin(g, window - anchor + 1)
        used = np.zeros(len(g), bool)
        used[self.place[self.valid]] = True
        at = np.flatnonzero(used)
        # mixed again: anchors are small hashes, and the leading bits choose the bucket
        self.anchors, self.of = np.unique(B.mixed(g[at]), return_inverse=True)  # of: an anchor's number, by its place in at
        self.number = np.zeros(len(g), np.int64)
        self.number[at] = self.of
        docs = block.ids[self.row[at]]
        low, high = np.full(len(self.anchors), B.NULL_ID), np.full(len(self.anchors), -(2**63))
        np.minimum.at(low, self.of, docs)
        np.maximum.at(high, self.of, docs)
        self.several = low < high  # anchors of more than one document here
        self.window, self.ids = window, block.ids

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        if not len(self.anchors):
            return np.zeros(0, np.int64)
        hit = self.several | (shared[: len(self.anchors)] > 0 if len(shared) else False)
        return np.flatnonzero(self.valid & hit[self.number[self.place]]) if len(self.valid) else np.zeros(0, np.int64)

    def having(self, hits: np.ndarray) -> np.ndarray:
        """Windows whose fingerprint is among the sorted hits."""
        if not len(self.anchors) or not len(hits):
            return np.zeros(0, np.int64)
        yes = hits[np.minimum(np.searchsorted(hits, self.anchors), len(hits) - 1)] == self.anchors
        return np.flatnonzero(self.valid & yes[self.number[self.place]])

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the windows at these places: hash pairs (distinct, sorted), their first documents, and each window's pair."""
        h1, h2 = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        y = B.mixed(B.word_hashes(list(self.block.texts()), other=True)[0]) if len(at) else self.x
        for i in range(self.window):
            h1 = (h1 ^ self.x[at + i]) * np.uint64(0x9FB21C651E98DF25)
            h1 ^= h1 >> np.uint64(29)
            h2 = (h2 + y[at + i]) * np.uint64(0xD6E8FEB86659FD93)
            h2 ^= h2 >> np.uint64(32)
        h1, h2 = B.mixed(h1), B.mixed(h2)
        docs = self.ids[self.row[at]]
        order = np.lexsort((docs, h2, h1))
        new = new_pairs(h1[order], h2[order])
        pair = np.empty(len(at), np.int64)
        pair[order] = np.cumsum(new) - 1
        first = order[new]
        return h1[first], h2[first], docs[first], pair


def new_pairs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which of the sorted pairs differ from the one before."""
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return new


def window_blob(h1, h2, docs) -> bytes:
    low = int(docs.min()) if len(docs) else 0
    return B.joined(B.packed_sorted(h1), B.packed(h2), np.int64(low).tobytes(), B.packed((docs - low).astype(np.uint64)))


def read_window_blob(blob: bytes):
    a, b, low, c = B.parted(blob, 4)
    return B.unpacked_sorted(a), B.unpacked(b), B.unpacked(c).astype(np.int64) + np.frombuffer(low, np.int64)[0]


def judge_windows(blobs: list[bytes], _) -> list[bytes]:
    parts = [read_window_blob(x) for x in blobs]
    h1, h2, docs = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((docs, h2, h1))
    new = new_pairs(h1[order], h2[order])
    first = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    older = np.zeros(len(h1), np.uint8)
    older[order] = first < docs[order]
    return [B.answer(x) for x in np.split(older, np.cumsum([len(p[0]) for p in parts])[:-1])]


def run_blob(h: np.ndarray, block: np.ndarray) -> bytes:
    return B.joined(B.packed_sorted(h), B.packed(block.astype(np.uint64)))


def read_run(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of some runs and their blocks, one run after the other."""
    parts = [B.parted(x, 2) for x in blobs]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *(B.unpacked_sorted(a) for a, _ in parts)]), np.concatenate([none, *(B.unpacked(b) for _, b in parts)]).astype(np.int64)


def run_of_batch(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h = [B.unpacked_sorted(x.as_py()) for x in table.column("blob")]
    return np.concatenate(h), np.repeat(table.column("block").to_numpy(), [len(x) for x in h])


def run_of_runs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return read_run([x.as_py() for x in table.column("blob")])


def merge(h: np.ndarray, block: np.ndarray, bits: int) -> pa.Table:
    """A sorted run for each bucket by this many leading bits."""
    order = np.lexsort((block, h))
    h, block = h[order], block[order]
    out = [(b, run_blob(h[i:j], block[i:j])) for b, i, j in B.bucket_slices(h, bits)]
    return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])


def merged(rows: DataFrame, bits: int, read) -> DataFrame:
    """Runs of rows, whose buckets may be coarser."""
    return rows.groupBy("bucket").applyInArrow(lambda t: merge(*read(t), bits), RUN)


def pair(one: DataFrame, other: DataFrame, bits: int) -> DataFrame:
    """Two runs merged."""
    return one.groupBy("bucket").cogroup(other.groupBy("bucket")).applyInArrow(lambda a, b: merge(*run_of_runs(pa.concat_tables([a, b])), bits), RUN)


class FingerprintIndex:
    """Blocks and fingerprints of former batches, below path.

    A run is a table (bucket, blob) in Spark's bucketed layout, with 2 ** bits buckets
    by leading bits; a blob has sorted fingerprints and the block of each.  A run counts
    once a row of the commits table names it, which is written last: what a crash leaves
    before that is never read, and adding the batch again does no harm.  A commit that
    replaces stands for all runs before it.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int = 4):
        self.spark, self.path, self.first_bits = spark, path.rstrip("/"), bits
        self.load()

    def load(self) -> None:
        try:  # a row for each batch and compaction since the index was made
            rows = sorted(self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").collect(), key=lambda r: r["number"])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        self.number, self.runs, self.batches, self.bits = len(rows), [], [], self.first_bits
        for r in rows:
            self.runs, self.bits = ([] if r["replaces"] else self.runs) + [r["run"]], r["bits"]
            if r["blocks"]:
                self.batches.append(r["blocks"])

    def commit(self, run: str, blocks: str | None, bits: int) -> None:
        row = self.spark.createDataFrame([(self.number, run, blocks, blocks is None, bits)], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.load()

    def write(self, rows: DataFrame, bits: int) -> str:
        run = name = f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(1 << bits, "bucket").option("path", f"{self.path}/{run}").option("compression", "none").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay
        return run

    def scan(self, run: str) -> DataFrame:
        """A run, as a bucketed scan."""
        name = f"read_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (bucket INT, blob BINARY) USING PARQUET CLUSTERED BY (bucket) INTO {1 << self.bits} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(name)

    def history(self) -> list[DataFrame]:
        return [self.scan(r) for r in self.runs]

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(B.BLOCKS).parquet(*self.batches)

    def place(self) -> tuple[str, int]:
        """For the next batch: where its blocks go, and the first of their numbers."""
        return f"{self.path}/blocks-{uuid.uuid4().hex}", self.number << 48

    def add(self, entries: DataFrame, blocks: str) -> None:
        """Makes a batch's fingerprints (bucket, block, blob) a run."""
        self.commit(self.write(merged(entries, self.bits, run_of_batch), self.bits), blocks, self.bits)

    def compact(self, run_bytes: int = RUN_BYTES) -> None:
        """Merges all runs into one, two at a time; with more buckets if they have grown beyond run_bytes on average.

        Two runs of equal buckets are merged where they lie; only a change of buckets moves them.
        """
        if not self.runs:
            return
        run = self.runs[0]
        for other in self.runs[1:]:
            run = self.write(pair(self.scan(run), self.scan(other), self.bits), self.bits)
        size = self.scan(run).agg(F.sum(F.octet_length("blob"))).first()[0] or 0
        bits = max(self.bits, int(np.ceil(np.log2(max(size / run_bytes, 1)))))
        if bits > self.bits:
            run = self.write(merged(self.scan(run), bits, run_of_runs), bits)
        if run != self.runs[0]:
            self.commit(run, None, bits)


MET = "block long, bucket int, answer binary, past boolean"


def met(table: pa.Table, old: tuple[np.ndarray, np.ndarray], inside: bool) -> pa.Table:
    """Of a bucket: which fingerprints of each block of the batch are in a run or (inside) in the batch again; and of each block of history, those that the batch has."""
    parts = [B.unpacked_sorted(x.as_py()) for x in table.column("blob")]
    if not parts:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.bool_())], names=["block", "bucket", "answer", "past"])
    h, (past, block) = np.concatenate(parts), old
    values, of, times = np.unique(h, return_inverse=True, return_counts=True)
    hit = values[np.minimum(np.searchsorted(values, past), len(values) - 1)] == past
    past, block = past[hit], block[hit]
    shared = (times > 1) & inside
    shared[np.searchsorted(values, past)] = True
    out = [B.answer(x) for x in np.split(shared[of].view(np.uint8), np.cumsum([len(p) for p in parts])[:-1])]
    order = np.lexsort((past, block))
    past, block = past[order], block[order]
    edge = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    back = [B.answer(x) for x in np.split(past, edge[1:])] if len(block) else []
    n, b = len(out), table.column("bucket")[0].as_py()
    blocks = np.concatenate((table.column("block").to_numpy(), block[edge]))
    return pa.table([pa.array(blocks, pa.int64()), pa.array(np.full(len(blocks), b), pa.int32()), pa.array(out + back, pa.binary()), pa.array(np.arange(len(blocks)) >= n)], names=["block", "bucket", "answer", "past"])


def meetings(entries: DataFrame, history: list[DataFrame]) -> DataFrame:
    if not history:
        return entries.groupBy("bucket").applyInArrow(lambda t: met(t, read_run([]), True), MET)
    with_run = lambda inside: lambda t, old: met(t, run_of_runs(old), inside)
    each = [entries.groupBy("bucket").cogroup(run.groupBy("bucket")).applyInArrow(with_run(k == 0), MET) for k, run in enumerate(history)]
    return reduce(DataFrame.unionByName, each)


def either(got: list | None) -> np.ndarray:
    """Whether a block's fingerprints are shared, by the answers of one run or another."""
    flags: dict[int, np.ndarray] = {}
    for x in got or ():
        mine = B.gathered([x])
        flags[x["bucket"]] = mine | flags[x["bucket"]] if x["bucket"] in flags else mine
    return np.concatenate([flags[b] for b in sorted(flags)]) if flags else np.zeros(0, np.uint8)


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True, index: FingerprintIndex | None = None, learn: bool = True, block_bytes: int = B.BLOCK_BYTES, bits: int | None = None) -> DataFrame:
    """Removes each word covered by a window that starts in an older document too.

    Older: with a smaller doc_id, or in the index.  With an index and learn, the
    batch becomes a run of it.  Returns RESULT; kept_text only if texts.  Kept words
    are joined by one space.  bits: of the number of buckets, without an index.
    """
    place, first = index.place() if index else (None, 0)
    blocks = B.blocks_of(docs, block_bytes, path=place, first=first)
    bits = index.bits if index else bits or B.bucket_bits(blocks)

    def send_anchors(batches):
        for (block,) in B.block_rows(batches):
            h = Windows(block, window, anchor).anchors
            if rows := [(b, block.number, B.packed_sorted(h[i:j])) for b, i, j in B.bucket_slices(h, bits)]:
                yield B.entry_batch(rows)

    def sent(w: Windows, at: np.ndarray, old: bool):
        h1, h2, docs, _ = w.keys(at)
        docs = np.full(len(docs), OLD) if old else docs
        if rows := [(b, w.block.number, window_blob(h1[i:j], h2[i:j], docs[i:j])) for b, i, j in B.bucket_slices(h1, bits)]:
            yield B.entry_batch(rows)

    def send_windows(batches):
        for block, shared in B.block_rows(batches, ("shared",)):
            w = Windows(block, window, anchor)
            yield from sent(w, w.candidates(either(shared)), False)

    def send_past(batches):
        for block, hits in B.block_rows(batches, ("hits",)):
            w = Windows(block, window, anchor)
            yield from sent(w, w.having(B.gathered(hits, np.uint64)), True)

    anchors = blocks.mapInArrow(send_anchors, B.ENTRIES)
    past = index.history() if index else []
    found = meetings(anchors, past)
    one = lambda rows: rows.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("got"))
    if past:
        found = B.stored(found, "met")  # two readers
    judged = B.with_answers(blocks, "shared", one(found.filter("not past")))
    windows = judged.mapInArrow(send_windows, B.ENTRIES)
    if past:
        touched = index.blocks().join(one(found.filter("past")).withColumnRenamed("got", "hits"), "block")
        windows = windows.unionByName(touched.mapInArrow(send_past, B.ENTRIES))
    both = B.with_answers(judged, "older", B.answers(windows, judge_windows))

    def finish(batches):
        for block, shared, older in B.block_rows(batches, ("shared", "older")):
            w = Windows(block, window, anchor)
            at = w.candidates(either(shared))
            _, _, low, pair = w.keys(at)
            old = B.gathered(older).astype(bool) if len(at) else np.zeros(0, bool)
            hit = at[(old[pair] if len(old) else False) | (low[pair] < block.ids[w.row[at]])] if len(at) else at
            gone = B.covered(hit, window, len(w.x))
            out, end = [], 0
            for t, count in zip(block.texts(), w.counts.tolist(), strict=True):
                words, mine = t.split(), gone[end : end + count]
                end += count
                n = int(mine.sum())
                kept = b" ".join(words if not n else [x for x, g in zip(words, mine.tolist(), strict=True) if not g])
                out.append((count, n, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([B.id_array(block.ids), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = both.mapInArrow(finish, RESULT)
    if index and learn:
        out = B.stored(out, "deduped")  # before the batch itself becomes history
        index.add(anchors, place)
    return out


def in_batches(docs: DataFrame, index: FingerprintIndex, batches: int = BATCHES, texts: bool = True) -> DataFrame:
    """substring_dedup by ranges of doc_id, the oldest first, through an index, which is compacted at the end.

    Equal doc_ids are always in the same batch.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    edges = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)})
    # a doc_id's batch is the number of edges below it; null comes last
    number = reduce(lambda n, e: n + (F.coalesce(F.col("doc_id"), F.lit(B.NULL_ID)) > F.lit(e)).cast("int"), edges, F.lit(0))
    out = [substring_dedup(docs.filter(number == k), texts=texts, index=index) for k in range(len(edges) + 1)]
    index.compact()
    return reduce(DataFrame.unionByName, out)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(size / B.BUCKET_BYTES, 1)))))
    index = FingerprintIndex(spark, B.shared_dir(spark, "fingerprints"), bits)
    return in_batches(docs, index, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
           FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)),
s AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER w AS win, count(*) OVER w AS n FROM t
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
f AS (SELECT doc_id, pos, word, CAST(n = {WINDOW} AND min(doc_id) OVER (PARTITION BY win) < doc_id AS INTEGER) AS hit FROM s),
c AS (SELECT doc_id, pos, word, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT doc_id, count(*) AS n, sum(gone) AS gone, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_words, CAST(coalesce(a.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""
