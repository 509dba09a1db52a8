"""Language-model scores by deleted interpolation.

P(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1)

with maximum-likelihood estimates from the training documents and weights l
that depend on the bucket (power of two) of c(v), how often the context was
seen.  The weights are learned by expectation-maximisation on held-out counts:
each training token is held out in turn, so that its own occurrence is deleted
from the counts that predict it (c - 1 over n - 1).

Counting works on blocks (blocks.py): each block sends the distinct hashes of its
words and word pairs with their training counts to buckets, and gets the
corpus's counts back in the same order.  What EM needs is a histogram of the
estimates' ratios for each bucket of contexts, as wide as the logarithm of the corpus.

Every text, null or empty too, has an end token; the first word's context is
the begin of text.  Rows with equal doc_id are separate documents; rows with a
null doc_id are learned from and scored; further columns are ignored; an empty table gives an
empty result; with nothing to learn from, all estimates are 1 / (V + 1).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

BEGIN, END_HASH = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
BUCKETS = 24  # of context counts: 0, 1, 2-3, 4-7, ...
STEP = 4  # bins of an estimate's ratio to the uniform one, for each power of two
ROUNDS = 50
BLOCK_BYTES = 10 << 20  # the larger a block, the fewer units are distinct in it
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
MODULUS, HELD_OUT = 7, 2


def held_out(ids: np.ndarray, modulus: int = MODULUS, rest: int = HELD_OUT) -> np.ndarray:
    return np.array([i != B.NULL_ID and zlib.crc32(b"%d" % i) % modulus == rest for i in ids.tolist()], bool)


class Tokens:
    """Words and word pairs of a block, as places in the sorted distinct hashes of both."""

    def __init__(self, block: B.Block):
        x, counts = B.word_hashes(list(block.texts()), fold=True)
        x = B.mixed(x)
        self.n = counts + 1
        stops = np.cumsum(self.n)
        total = int(stops[-1]) if len(stops) else 0
        self.row = np.repeat(np.arange(len(counts), dtype=np.int32), self.n)
        last = np.zeros(total, bool)
        last[stops - 1] = True
        word = np.full(total, END_HASH)
        word[~last] = x
        context = np.empty(total, np.uint64)
        context[1:] = word[:-1]
        context[stops - self.n] = BEGIN
        pair = B.mixed((context * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0xA4093822299F31D0)))
        self.out = held_out(block.ids)
        self.learn = ~self.out[self.row]
        starts = np.flatnonzero(np.append(True, last[:-1])) if total else np.zeros(0, np.int64)
        # the begin counts as a unit of its own: a text's first context
        every = np.concatenate((word, pair, np.full(len(starts), BEGIN)))
        learn = np.concatenate((self.learn, self.learn, ~self.out))
        self.hashes, place = np.unique(every, return_inverse=True)
        self.counts = np.bincount(place, weights=learn, minlength=len(self.hashes)).astype(np.uint32)
        self.word, self.pair = place[:total], place[total : 2 * total]
        self.context = np.empty(total, np.int64)
        self.context[1:] = self.word[:-1]
        if total:
            self.context[starts] = place[2 * total :]
        self.is_word = np.zeros(len(self.hashes), bool)
        self.is_word[self.word] = True


def estimates(t: Tokens, c: np.ndarray, total: int, types: int, deleted: bool):
    """Of each token: context bucket, pair, unigram and uniform estimate.  deleted: without the token itself."""
    cw, cp, cc = (c[x].astype(np.float64) for x in (t.word, t.pair, t.context))
    one = 1.0 if deleted else 0.0
    bucket = np.minimum(np.floor(np.log2(cc - one + 1)), BUCKETS - 1).astype(np.int64)
    p2 = np.where(cc - one > 0, (cp - one) / np.maximum(cc - one, 1), 0.0)
    p1 = (cw - one) / max(total - one, 1)
    return bucket, p2, p1, 1.0 / (types + 1)


def bin_range(total: int, types: int) -> tuple[int, int]:
    """Of the quarters of log2 that ratios to 1 / (types + 1) fall into, one below the lowest, and how many bins there are; no ratio but 0 is below (types + 1) / total or above types + 1."""
    high = STEP * np.log2(types + 1)
    low = int(np.floor(high - STEP * np.log2(max(total, 1)))) - 1
    return low, int(np.ceil(high)) - low + 1


def binned(x: np.ndarray, low: int, bins: int) -> np.ndarray:
    """The first bin is for a ratio of 0."""
    return np.where(x > 0, np.clip(np.rint(STEP * np.log2(np.where(x > 0, x, 1))) - low, 1, bins - 1), 0).astype(np.int64)


def value_of(b: np.ndarray, low: int) -> np.ndarray:
    return np.where(b > 0, 2.0 ** ((b + low) / STEP), 0.0)


def learned_weights(histogram: dict[tuple[int, int, int], int], low: int) -> np.ndarray:
    """Weights (pair, unigram, uniform) for each bucket of contexts, by EM on (bucket, bin of pair/uniform, bin of unigram/uniform) counts."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    for k in range(BUCKETS):
        mine = [(b2, b1, n) for (kk, b2, b1), n in histogram.items() if kk == k]
        if not mine:
            weights[k] = weights[k - 1] if k else [0.0, 0.9, 0.1]
            continue
        b2, b1, n = (np.array(x) for x in zip(*mine, strict=True))
        p = np.stack((value_of(b2, low), value_of(b1, low), np.ones(len(n))))
        w = weights[k]
        for _ in range(ROUNDS):
            share = w[:, None] * p
            share /= share.sum(axis=0)
            w = (share * n).sum(axis=1) / n.sum()
        w = np.maximum(w, 1e-6)
        weights[k] = w / w.sum()
    return weights


def count_units(blocks: DataFrame) -> DataFrame:
    """Blocks with `counts`: for each bucket the corpus counts of the block's units, in order of hash; and (in bucket order) how many of the block's words are the first block's with them."""
    bits = B.bucket_bits(blocks)

    def send(batches):
        for (block,) in B.block_rows(batches):
            t = Tokens(block)
            rows = [(b, block.number, B.joined(B.packed_sorted(t.hashes[i:j]), B.packed(t.counts[i:j]), np.packbits(t.is_word[i:j]).tobytes())) for b, i, j in B.bucket_slices(t.hashes, bits)]
            if rows:
                yield B.entry_batch(rows)

    def judge(blobs, _):
        parts = []
        for x in blobs:
            a, b, c = B.parted(x, 3)
            h = B.unpacked_sorted(a)
            parts.append((h, B.unpacked(b, np.uint32), np.unpackbits(np.frombuffer(c, np.uint8), count=len(h))))
        h, n, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
        values, of = np.unique(h, return_inverse=True)
        total = np.bincount(of, weights=n, minlength=len(values)).astype(np.uint64)
        # a trained word is reported as a type once, by the first run that has it
        types = np.zeros(len(h), bool)
        first = np.full(len(values), len(h))
        np.minimum.at(first, of, np.arange(len(h)))
        types[first] = True
        types &= (total[of] > 0) & (w > 0)
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        return [B.joined(np.int64(ty.sum()).tobytes(), B.packed(c)) for c, ty in zip(np.split(total[of], ends), np.split(types, ends), strict=True)]

    return B.with_answers(blocks, "counts", B.answers(blocks.mapInArrow(send, B.ENTRIES), judge))


def counts_of(got) -> tuple[np.ndarray, int]:
    parts = [B.parted(x["answer"], 2) for x in sorted(got or (), key=lambda x: x["bucket"])]
    c = np.concatenate([B.unpacked(p[1]) for p in parts]) if parts else np.zeros(0, np.uint64)
    return c, sum(int(np.frombuffer(p[0], np.int64)[0]) for p in parts)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Returns RESULT: one row for each document."""
    blocks = B.blocks_of(docs, BLOCK_BYTES)
    counted = B.stored(count_units(blocks), "counted")

    def totals(batches):
        for batch in batches:
            for ids, lens, data, got in zip(*(batch.column(c) for c in ("ids", "lens", "data", "counts")), strict=True):
                block = B.Block(0, np.frombuffer(ids.as_py(), np.int64), lens=np.frombuffer(lens.as_py(), np.int64), data=B.zstandard.ZstdDecompressor().decompress(data.as_py()))
                out = held_out(block.ids)
                n = sum(len(t.split()) + 1 for t, o in zip(block.texts(), out.tolist(), strict=True) if not o)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([counts_of(got.as_py())[1]], pa.int64())], names=["n", "types"])

    sums = counted.mapInArrow(totals, "n long, types long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    total, types = int(sums[0]), int(sums[1])
    low, width = bin_range(total, types)

    def gather(batches):
        size = BUCKETS * width * width
        got = np.zeros(size, np.int64)
        for block, counts in B.block_rows(batches, ("counts",)):
            t = Tokens(block)
            c, _ = counts_of(counts)
            if not t.learn.any():
                continue
            k, p2, p1, p0 = estimates(t, c, total, types, deleted=True)
            at = (k * width + binned(p2 / p0, low, width)) * width + binned(p1 / p0, low, width)
            got += np.bincount(at[t.learn], minlength=size)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], names=["bin", "n"])

    bins = counted.mapInArrow(gather, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BUCKETS * width * width rows at most
    histogram = {(r["bin"] // (width * width), r["bin"] // width % width, r["bin"] % width): r["n"] for r in bins}
    weights = learned_weights(histogram, low)

    def score(batches):
        for block, counts in B.block_rows(batches, ("counts",)):
            t = Tokens(block)
            c, _ = counts_of(counts)
            k, p2, p1, p0 = estimates(t, c, total, types, deleted=False)
            w = weights[k]
            logp = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
            base = np.log10((c[t.word].astype(np.float64) + 1) / (total + types + 1))
            rows = len(block.ids)
            add = lambda x: np.bincount(t.row, weights=x, minlength=rows)
            known = add(c[t.word] > 0).astype(np.int64)
            cols = [B.id_array(block.ids), pa.array(t.out), pa.array(t.n), pa.array(known), pa.array(np.full(rows, total)), pa.array(add(base)), pa.array(add(logp))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(score, RESULT)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
