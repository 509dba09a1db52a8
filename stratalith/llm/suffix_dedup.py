"""Removal of byte strings that occur in an earlier document, by longest previous factors.

A byte goes if a string of WIDTH bytes that covers it also starts in a document
with a smaller doc_id: if the place's longest previous factor, counted over
earlier documents alone, reaches WIDTH.  A suffix array of the whole corpus is
never built: the suffixes are dealt out so that all that could match by WIDTH
bytes meet in one bucket.

1. *Chunks.*  Cut points that depend on the content split each document; pairs of
   neighbouring chunks are compared by 128-bit hashes.  What lies in a pair that
   an earlier document has is settled, which covers most of any long copy.
2. *Anchors.*  Of the other strings, each has an anchor, the smallest hash of the
   GRAM-byte runs in it.  Anchors that only one document has are settled too.
3. *Previous factors.*  What is around the remaining anchors is sent to the anchor's
   bucket.  Its suffixes are ordered there by their first WIDTH bytes, with the
   lengths that neighbours share.  The nearest suffixes before and after each one
   in that order that are of a smaller document (the previous and next smaller
   places) give its longest previous factor, of up to WIDTH bytes.  An anchor in very
   many places sends its strings one by one to the buckets of their own hashes.

Null text counts as empty; rows with equal doc_id are documents of equal age;
rows with a null doc_id are newer than all others; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import blocks as B

WIDTH, GRAM = 50, 24
CHUNK_MASK = 255  # a cut every 256 bytes on average
HOT = 4096  # contexts of one anchor, over all blocks, from which on it is dealt out by whole strings
BLOCK_BYTES = 2 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def words8(data: bytes) -> np.ndarray:
    """At each place the 8 bytes from there on, big-endian; zeros follow the end."""
    buf = data + bytes(8)
    return np.ndarray((len(data),), ">u8", buf, strides=(1,)).astype(np.uint64)


def grams(data: bytes) -> np.ndarray:
    """A hash of the GRAM (three times eight) bytes from each place on."""
    v = words8(data)
    n = max(0, len(data) - GRAM + 1)
    a, b, c = v[:n], v[8 : 8 + n], v[16 : 16 + n]
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return B.mixed(h ^ (h >> np.uint64(32)) ^ (c * np.uint64(0x9FB21C651E98DF25)))


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """How many leading bytes are zero in each 64-bit number."""
    out = np.zeros(len(x), np.int64)
    for k in range(8):
        out += x < np.uint64(1 << (8 * k)) if k else x == 0
    return out


def suffix_order(data: bytes, at: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at these places by their first `width` bytes, then by doc; and how many of these bytes each shares with the one before it.

    Eight bytes are compared at a time, and only suffixes that are still tied are
    ordered further.  No suffix may be shorter than `width`.
    """
    v = words8(data)
    first = v[at]
    order = np.argsort(first)
    s = first[order]
    common = np.zeros(len(at), np.int64)
    common[1:] = np.minimum(equal_bytes(s[1:] ^ s[:-1]), width)
    depth = 8
    while True:
        tied = common >= min(depth, width)
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        idx = np.flatnonzero(inside)
        mine = order[idx]
        group = np.cumsum(~tied)[idx]
        if depth >= width:
            order[idx] = mine[np.lexsort((doc[mine], group))]
            return order, common
        w = v[at[mine] + depth]
        if width - depth < 8:
            w = w >> np.uint64(8 * (8 - width + depth)) << np.uint64(8 * (8 - width + depth))
        sub = np.lexsort((w, group))
        order[idx], w = mine[sub], w[sub]
        same = np.flatnonzero(group[1:] == group[:-1]) + 1
        common[idx[same]] = depth + np.minimum(equal_bytes(w[same] ^ w[same - 1]), width - depth)
        depth += 8


def smaller_before(doc: np.ndarray, common: np.ndarray) -> np.ndarray:
    """In suffix order: what each suffix shares with the nearest one before it that has a smaller document; 0 if there is none.

    All places look back at once.  One whose candidate isn't smaller goes on to that
    one's own candidate, as everything between the two is no smaller either.
    """
    back, share = np.arange(-1, len(doc) - 1), common.copy()
    todo = np.arange(len(doc))
    while True:
        todo = todo[back[todo] >= 0]
        todo = todo[doc[back[todo]] >= doc[todo]]
        if not len(todo):
            return np.where(back >= 0, share, 0)
        at = back[todo]
        share[todo], back[todo] = np.minimum(share[todo], share[at]), back[at]


def previous_factors(doc: np.ndarray, common: np.ndarray) -> np.ndarray:
    """In suffix order: the length of each suffix's longest previous factor in a smaller document, from the previous and the next smaller place."""
    after = smaller_before(doc[::-1], np.append(0, common[:0:-1])[: len(doc)])[::-1]
    return np.maximum(smaller_before(doc, common), after)


class Strings:
    """Bytes of a block and its strings of `width` bytes."""

    def __init__(self, block: B.Block, width: int):
        self.block, self.width, data = block, width, block.data
        self.g = grams(data)
        n = max(0, len(data) - width + 1)
        self.row = np.repeat(np.arange(len(block.ids), dtype=np.int32), block.ends - block.starts)
        self.valid = self.row[:n] == self.row[width - 1 : width - 1 + n]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the pairs of neighbouring chunks."""
        cut = np.flatnonzero((self.g & np.uint64(CHUNK_MASK)) == 0)
        b = self.block
        keep = b.ends - b.starts >= self.width
        cut = np.unique(np.concatenate((cut, b.starts[keep], b.ends[keep])))
        starts, ends, rows = [], [], []
        for i in np.flatnonzero(keep).tolist():
            lo, hi = np.searchsorted(cut, (b.starts[i], b.ends[i]))
            c = cut[lo : hi + 1]
            starts.append(c[:-2] if len(c) > 2 else c[:1])
            ends.append(c[2:] if len(c) > 2 else c[-1:])
            rows.append(np.full(len(starts[-1]), i))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else none for x in (starts, ends, rows))

    def pair_keys(self):
        s, e, rows = self.pairs()
        ok = e - s >= self.width
        s, e, rows = s[ok], e[ok], rows[ok]
        data = self.block.data
        h = [xxhash.xxh3_128_intdigest(data[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        h1, h2 = np.array([x >> 64 for x in h], np.uint64), np.array([x & (2**64 - 1) for x in h], np.uint64)
        docs = self.block.ids[rows] if len(rows) else np.zeros(0, np.int64)
        order = np.lexsort((docs, h2, h1))
        new = np.ones(len(h), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        pair = np.empty(len(h), np.int64)
        pair[order] = np.cumsum(new) - 1
        first = order[new]
        return (h1[first], h2[first], docs[first]), (s, e, docs, pair)

    def settle(self, older: np.ndarray) -> np.ndarray:
        """Marks strings in pairs of chunks that an earlier document has."""
        (_, _, low), (s, e, docs, pair) = self.pair_keys()
        out = np.zeros(len(self.valid) + 1, np.int32)
        if len(s):
            hit = (older[pair] > 0 if len(older) else False) | (low[pair] < docs)
            np.add.at(out, s[hit], 1)
            np.add.at(out, e[hit] - self.width + 1, -1)
        return np.cumsum(out[:-1]) > 0

    def open_anchors(self, settled: np.ndarray):
        """Distinct anchors of the strings not settled; how many places each has; the strings' anchors' places and numbers."""
        at = np.flatnonzero(self.valid & ~settled)
        place = B.sliding_argmin(self.g, self.width - GRAM + 1)[at] if len(at) else at
        used = np.zeros(len(self.g), bool)
        used[place] = True
        spots = np.flatnonzero(used)
        # mixed again: anchors are small hashes, and the leading bits choose the bucket
        anchors, of, n = np.unique(B.mixed(self.g[spots]), return_inverse=True, return_counts=True)
        number = np.zeros(len(self.g), np.int32)
        number[spots] = of
        return anchors, n, at, place, number[place]

    def contexts(self, settled: np.ndarray, shared: np.ndarray, bits: int):
        """What is around anchors that other places have: distinct (bucket, bytes) with the first document; and of each occurrence its start, number of strings, document and context."""
        anchors, n, at, place, number = self.open_anchors(settled)
        if not len(at):
            return [], [], []
        kind = np.maximum(shared[: len(anchors)] if len(shared) else 0, (n > 1).astype(np.uint8))
        pick = kind[number] > 0
        at, place, number = at[pick], place[pick], number[pick]
        hot = kind[number] > 1
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | hot[1:]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(first) else first
        starts, ends = at[first], at[last] + self.width if len(at) else at
        docs = self.block.ids[self.row[starts]] if len(starts) else starts
        h, hots = anchors[number[first]] if len(first) else anchors[:0], hot[first]
        data, found, keys, of = self.block.data, {}, [], []
        shift = 64 - bits
        for a, b, d, x, whole, p in zip(starts.tolist(), ends.tolist(), docs.tolist(), h.tolist(), hots.tolist(), place[first].tolist(), strict=True):
            text = data[a:b]
            key = ((xxhash.xxh3_64_intdigest(text) if whole else x) >> shift, 0 if whole else p - a, text)
            at_ = found.setdefault(key, len(keys))
            if at_ == len(keys):
                keys.append([key, d])
            elif d < keys[at_][1]:
                keys[at_][1] = d
            of.append(at_)
        order = sorted(range(len(keys)), key=lambda i: keys[i][0])
        back = np.empty(len(keys), np.int64)
        back[order] = np.arange(len(keys))
        return [keys[i] for i in order], (starts, ends, docs), back[np.array(of, np.int64)]


def pair_blob(h1, h2, docs) -> bytes:
    return B.joined(B.packed_sorted(h1), B.packed(h2), B.packed(docs.astype(np.uint64)))


def judge_pairs(blobs: list[bytes], _) -> list[bytes]:
    parts = []
    for x in blobs:
        a, b, c = B.parted(x, 3)
        parts.append((B.unpacked_sorted(a), B.unpacked(b), B.unpacked(c).astype(np.int64)))
    h1, h2, docs = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((docs, h2, h1))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    older = np.zeros(len(h1), np.uint8)
    older[order] = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1] < docs[order]
    return [B.answer(x) for x in np.split(older, np.cumsum([len(p[0]) for p in parts])[:-1])]


def anchor_judge(hot: int):
    def judge(blobs: list[bytes], _) -> list[bytes]:
        parts = []
        for x in blobs:
            a, b = B.parted(x, 2)
            parts.append((B.unpacked_sorted(a), B.unpacked(b, np.uint32)))
        h, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
        values, of, times = np.unique(h, return_inverse=True, return_counts=True)
        total = np.bincount(of, weights=n, minlength=len(values))
        kind = (times > 1).astype(np.uint8)
        kind[total > hot] = 2
        return [B.answer(x) for x in np.split(kind[of], np.cumsum([len(p[0]) for p in parts])[:-1])]

    return judge


def context_judge(width: int):
    def judge(blobs: list[bytes], _) -> list[bytes]:
        lens, docs, spots, texts, counts = [], [], [], [], []
        for x in blobs:
            a, b, c, d = B.parted(x, 4)
            n = np.frombuffer(a, np.uint16).astype(np.int64)
            raw = zstandard.ZstdDecompressor().decompress(c)
            ends = np.cumsum(n)
            texts += [raw[i:j] for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            lens.append(n)
            docs.append(np.frombuffer(b, np.int64))
            spots.append(np.frombuffer(d, np.uint8))
            counts.append(int((n - width + 1).sum()))
        n, d, spot = (np.concatenate(v) for v in (lens, docs, spots))
        # equal contexts count once, for their first document
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
        first = np.full(len(number), 2**63 - 1)
        np.minimum.at(first, of, d)
        one = np.full(len(number), 0)
        one[of] = np.arange(len(of))
        # only contexts that share an anchor with another text can match in part
        anchors: dict[bytes, int] = {}
        mine = np.fromiter((anchors.setdefault(texts[i][s : s + GRAM], len(anchors)) for i, s in zip(one.tolist(), spot[one].tolist(), strict=True)), np.int64, len(one))
        open_ = np.flatnonzero(np.bincount(mine, minlength=len(anchors))[mine] > 1) if len(one) else one
        strings = n[one] - width + 1
        begin = np.cumsum(strings) - strings
        partial = np.zeros(int(strings.sum()), bool)
        if len(open_):
            m = n[one][open_]
            k = m - width + 1
            at = np.repeat(np.cumsum(m) - m - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            doc = np.repeat(first[open_], k)
            order, common = suffix_order(b"".join(texts[i] for i in one[open_].tolist()), at, doc, width)
            hit = np.empty(len(at), bool)
            hit[order] = previous_factors(doc[order], common) >= width
            partial[np.repeat(begin[open_] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))] = hit
        k = n - width + 1
        flags = partial[np.repeat(begin[of] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))] | np.repeat(d > first[of], k)
        return [B.answer(x) for x in np.split(flags.view(np.uint8), np.cumsum(counts)[:-1])]

    return judge


def suffix_dedup(docs: DataFrame, width: int = WIDTH, texts: bool = True, hot: int = HOT, block_bytes: int = BLOCK_BYTES, bits: int | None = None) -> DataFrame:
    """Removes each byte covered by a string of `width` bytes (25 or more) that starts in an earlier document too.  Returns RESULT.

    hot: places of an anchor from which on its strings are dealt out one by one;
    bits: of the number of buckets, which else follows the size of the texts."""
    if width <= GRAM:
        raise ValueError(f"width must be over {GRAM}")
    blocks = B.blocks_of(docs, block_bytes)
    bits = bits or B.bucket_bits(blocks)

    def send_pairs(batches):
        for (block,) in B.block_rows(batches):
            (h1, h2, low), _ = Strings(block, width).pair_keys()
            if rows := [(b, block.number, pair_blob(h1[i:j], h2[i:j], low[i:j])) for b, i, j in B.bucket_slices(h1, bits)]:
                yield B.entry_batch(rows)

    def send_anchors(batches):
        for block, chunks in B.block_rows(batches, ("chunks",)):
            s = Strings(block, width)
            h, n, *_ = s.open_anchors(s.settle(B.gathered(chunks)))
            n = np.minimum(n, 2**31).astype(np.uint32)
            if rows := [(b, block.number, B.joined(B.packed_sorted(h[i:j]), B.packed(n[i:j]))) for b, i, j in B.bucket_slices(h, bits)]:
                yield B.entry_batch(rows)

    def send_contexts(batches):
        for block, chunks, shared in B.block_rows(batches, ("chunks", "shared")):
            s = Strings(block, width)
            keys, *_ = s.contexts(s.settle(B.gathered(chunks)), B.gathered(shared), bits)
            rows, i = [], 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j][0][0] == keys[i][0][0]:
                    j += 1
                part = keys[i:j]
                blob = B.joined(np.array([len(k[2]) for k, _ in part], np.uint16).tobytes(), np.array([d for _, d in part], np.int64).tobytes(), zstandard.ZstdCompressor(3).compress(b"".join(k[2] for k, _ in part)), np.array([k[1] for k, _ in part], np.uint8).tobytes())
                rows.append((part[0][0][0], block.number, blob))
                i = j
            if rows:
                yield B.entry_batch(rows)

    one = B.with_answers(blocks, "chunks", B.answers(blocks.mapInArrow(send_pairs, B.ENTRIES), judge_pairs))
    two = B.with_answers(one, "shared", B.answers(one.mapInArrow(send_anchors, B.ENTRIES), anchor_judge(hot)))
    three = B.with_answers(two, "factors", B.answers(two.mapInArrow(send_contexts, B.ENTRIES), context_judge(width)))

    def finish(batches):
        for block, chunks, shared, factors in B.block_rows(batches, ("chunks", "shared", "factors")):
            s = Strings(block, width)
            hit = s.settle(B.gathered(chunks))
            keys, places, of = s.contexts(hit, B.gathered(shared), bits)
            if len(keys):
                starts, ends, docs = places
                flags = B.gathered(factors).astype(bool)
                sizes = np.array([len(k[2]) for k, _ in keys], np.int64) - width + 1
                begin = np.cumsum(sizes) - sizes
                low = np.array([d for _, d in keys], np.int64)
                n = ends - starts - width + 1
                index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                here = np.repeat(starts, n) + index
                yes = np.repeat(docs > low[of], n) | flags[np.repeat(begin[of], n) + index]
                hit[here[yes]] = True
            hit &= s.valid
            gone = B.covered(np.flatnonzero(hit), width, len(block.data))
            raw = np.frombuffer(block.data, np.uint8)
            out = []
            for i, (a, b) in enumerate(zip(block.starts.tolist(), block.ends.tolist(), strict=True)):
                mine = gone[a:b]
                n = int(mine.sum())
                kept = raw[a:b][~mine].tobytes() if n else block.data[a:b]
                out.append((b - a, n, len(B.runs(mine)[0]) if n else 0, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([B.id_array(block.ids), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return three.mapInArrow(finish, RESULT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs, texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
