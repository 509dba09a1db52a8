"""Benchmark decontamination: rare seeds join documents to items, then Smith-Waterman alignment.

Benchmark items come to the driver in blocks of at most ITEM_BYTES of text, one
at a time, and each block is broadcast, so memory is bounded whatever the
benchmark's size.  For a block, one pass over the documents looks for copies.

A copy is found if its alignment score reaches LEAST of the best possible one for
min(words, LONG) words and it has SEED words of the item in a row, an n-gram.  An
n-gram that at most FEW items have is a rare seed: each of its hits names its items.
One that more items have, a stock phrase, is never joined on.  It counts only close to
rare words of an item, which a copy can't do without: it takes a certain number m of
matching words.  An item's words that the corpus has stand by how often it has them;
without RARE of the rarest n - m + RARE of them, within what an alignment spans, fewer
than m words are left to match.  So nothing is lost, and what all items share makes no
candidates.  (The corpus is counted only if a block has stock phrases.)
No alignment can score more than its words that the item has, at MATCH each, less the
others at GAP, which rules out most candidates; the words around the others are aligned
with the item.

Words are compared without case and outer punctuation; tokens of punctuation
alone don't count.  Items of fewer words than SEED have themselves as seed and
one hit is enough.  Null or empty texts and items match nothing; rows with equal
ids, or without one, are looked at each by itself (of each document's and item's id
the best row is given); further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

SEED, LEAST, LONG = 3, 0.5, 30
FEW, RARE = 4, 4
MATCH, MISMATCH, GAP = 2, -1, -1
ITEM_BYTES = 2 << 20
PART_BYTES = 1 << 20
BITMAP = 22
EDGES = ".,!?;:%*$#&|\"'()[]<>-_~^/\\=+{}`…«»“”‘’–—"
RESULT = "doc_id long, item_id long, similarity double, start_word long, end_word long"


class PlainHashes(B.WordHashes):
    """Hashes of words without case and outer punctuation; 0 if nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        w = word.decode(errors="replace").lower().strip(EDGES)
        h = self[word] = xxhash.xxh3_64_intdigest(w.encode()) if w else 0
        return h


class Items:
    """A block of items: their words, each item's different words and n-grams, rare and stock n-grams, and all words of the block; all sorted."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        hashes = PlainHashes()
        self.ids, self.words = [], []
        for i, text in rows:
            x = hashes.of((text or "").encode().split())
            if (x := x[x != 0]).size:
                self.ids.append(i)
                self.words.append(B.mixed(x))
        self.grams = [np.unique(B.grams(x, SEED)) for x in self.words]
        self.vocabulary = [np.unique(x) for x in self.words]
        # rare n-grams with their items, and those that more items have
        each, times = np.unique(np.concatenate(self.grams), return_counts=True) if self.words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.stock = each[times > FEW]
        rare = [g[~np.isin(g, self.stock)] for g in self.grams]
        keys = np.concatenate([np.zeros(0, np.uint64), *rare])
        order = np.argsort(keys, kind="stable")
        self.keys, self.item = keys[order], np.repeat(np.arange(len(rare)), [len(g) for g in rare])[order]
        self.all_words = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        # one- and two-word items: their whole sequence
        self.short = [k for k, x in enumerate(self.words) if len(x) < SEED]

    def seeds(self, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seed words in order, the item of each, and how many seeds each item's copies must have; counts: how often the corpus has each of all_words."""
        keys, items, need = [], [], np.zeros(len(self.words), np.int64)
        for k, x in enumerate(self.words):
            if len(x) < SEED:
                continue
            n = counts[np.searchsorted(self.all_words, x)]
            x, n = x[n > 0], n[n > 0]
            matches = max(1, int(np.ceil(least * min(len(self.words[k]), LONG))))
            if len(x) < matches:  # too few of its words are anywhere
                continue
            need[k] = min(RARE, matches)
            rarest = np.argsort(n, kind="stable")[: len(x) - matches + int(need[k])]
            keys.append(np.unique(x[rarest]))
            items.append(np.full(len(keys[-1]), k))
        keys, items = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (keys, items))
        order = np.argsort(keys, kind="stable")
        return keys[order].astype(np.uint64), items[order].astype(np.int64), need


def local_alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of sequences a and b, and where in b it starts and ends."""
    n = len(b)
    j = np.arange(n + 1)
    h, begin = np.zeros(n + 1, np.int64), j.copy()
    best = (0, 0, 0)
    for x in a:
        diag = h[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = h[1:] + GAP
        t = np.zeros(n + 1, np.int64)
        t[1:] = np.maximum(np.maximum(diag, up), 0)
        origin = j.copy()
        origin[1:] = np.where(t[1:] == 0, j[1:], np.where(diag >= up, begin[:-1], begin[1:]))
        # a gap in a costs as much for each word: a running maximum of score plus place
        lead = np.maximum.accumulate(t - GAP * j)
        h_new = lead + GAP * j
        source = np.maximum.accumulate(np.where(t - GAP * j == lead, j, 0))
        begin = origin[source]
        h = np.maximum(h_new, 0)
        begin[h == 0] = j[h == 0]
        k = int(h.argmax())
        if h[k] > best[0]:
            best = (int(h[k]), int(begin[k]), k)
    return best


def highest(words: np.ndarray, vocabulary: np.ndarray) -> int:
    """A score that no alignment of a part of the words reaches beyond: the best sum over a run of them, with MATCH for a word of the (sorted) vocabulary and GAP for another."""
    known = vocabulary[np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)] == words
    total = np.cumsum(np.where(known, MATCH, GAP))
    return int((total - np.minimum(np.minimum.accumulate(np.append(0, total[:-1])), 0)).max(initial=0))


def item_blocks(bench: DataFrame, most: int = ITEM_BYTES) -> Iterator[Items]:
    rows, held = [], 0
    for r in bench.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        rows.append((r[0], r[1]))
        held += len(r[1] or "") * 4 + 64
        if held >= most:
            yield Items(rows)
            rows, held = [], 0
    if rows:
        yield Items(rows)


def plain_words(batches):
    """Groups of documents: ids, word hashes without zeros, each word's document and place in it."""
    from .minhash_dedup import text_groups

    hashes = PlainHashes()
    for rows, texts in text_groups(batches, PART_BYTES):
        words = [t.split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        x = hashes.of([w for ws in words for w in ws])
        row = np.repeat(np.arange(len(words)), counts)
        place = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
        full = x != 0
        yield [r["doc_id"] for r in rows], B.mixed(x[full]), row[full], place[full]


def found_at(keys: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which of the values g are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(g), bool)
    # a bitmap of leading bits rules most of them out
    shift = np.uint64(64 - BITMAP)
    bitmap = np.zeros(1 << BITMAP, bool)
    bitmap[(keys >> shift).astype(np.int64)] = True
    out = bitmap[(g >> shift).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = keys[np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)] == g[at]
    return out


def leaks(docs: DataFrame, bench: DataFrame, least: float = LEAST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Returns RESULT: one row for each document and item of which it has a copy, with the best alignment."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], RESULT)
    for items in item_blocks(bench, item_bytes):
        out = out.unionByName(block_leaks(docs, items, least))
    return out


def word_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often the documents have each word of a block of items; tasks send a row for each such word at most."""
    words = docs.sparkSession.sparkContext.broadcast(items.all_words)

    def count(batches):
        total = np.zeros(len(words.value), np.int64)
        for _, x, _, _ in plain_words(batches):
            total += np.bincount(np.searchsorted(words.value, x[found_at(words.value, x)]), minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["word", "n"])

    out = np.zeros(len(items.all_words), np.int64)
    if len(out):
        for r in docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            out[r["word"]] = r["n"]
    return out


def crowded(row: np.ndarray, item: np.ndarray, pos: np.ndarray, need: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Which seeds, in order of document, item and place, lie among so many of their document and item as that needs, within its span."""
    out = np.zeros(len(pos), bool)
    for t in np.unique(need[item]).tolist():
        mine = np.flatnonzero(need[item] == t)
        if len(mine) < t:
            continue
        a, b = mine[: len(mine) - t + 1], mine[t - 1 :]
        ok = (row[a] == row[b]) & (item[a] == item[b]) & (pos[b] - pos[a] <= span[item[a]])
        out[mine[B.covered(np.flatnonzero(ok), t, len(mine))]] = True
    return out


def named(keys: np.ndarray, items: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and items: each place of `at`, whose value is among the sorted keys, with all items of that."""
    lo, hi = np.searchsorted(keys, values[at]), np.searchsorted(keys, values[at], side="right")
    n = hi - lo
    return np.repeat(at, n), items[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def block_leaks(docs: DataFrame, items: Items, least: float) -> DataFrame:
    seeds = items.seeds(word_counts(docs, items), least) if len(items.stock) else None
    shared = docs.sparkSession.sparkContext.broadcast((items, seeds))

    def search(batches):
        b, seeds = shared.value
        length = np.array([len(w) for w in b.words], np.int64)
        # an alignment has n matches at most, and each further word of the document takes 1 from what they score
        spans = (MATCH + 1) * length - np.floor(least * MATCH * np.minimum(length, LONG)).astype(np.int64)
        short_keys = {tuple(b.words[k].tolist()): [] for k in b.short}
        for k in b.short:
            short_keys[tuple(b.words[k].tolist())].append(k)
        for ids, x, row, place in plain_words(batches):
            got: dict[tuple[int | None, int | None], tuple] = {}
            g = B.grams(x, SEED)
            whole = row[: len(g)] == row[SEED - 1 : SEED - 1 + len(g)]
            pos, item = named(b.keys, b.item, g, np.flatnonzero(whole & found_at(b.keys, g)))
            if seeds is not None and len(stock := np.flatnonzero(whole & found_at(b.stock, g))):
                # rare words within reach of a stock phrase
                keys, seed_item, need = seeds
                reach = int(spans.max())
                close = B.covered(np.maximum(stock - reach, 0), 2 * reach + SEED, len(x))
                more, its = named(keys, seed_item, x, np.flatnonzero(close & found_at(keys, x)))
                order = np.lexsort((more, its, row[more]))
                more, its = more[order], its[order]
                many = crowded(row[more], its, more, need, spans)
                pos, item = np.concatenate((pos, more[many])), np.concatenate((item, its[many]))
            order = np.lexsort((pos, item, row[pos]))
            pos, item = pos[order], item[order]
            doc = row[pos]
            # a new group where the document or item changes or more lies between than an alignment spans
            new = np.ones(len(pos), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > spans[item[1:]])
            firsts = np.flatnonzero(new).tolist()
            edge = np.searchsorted(row, np.arange(len(ids) + 1))
            for s, e in zip(firsts, [*firsts[1:], len(pos)] if firsts else [], strict=True):
                k, d = int(item[s]), int(doc[s])
                words, span, enough = b.words[k], int(spans[k]), least * min(len(b.words[k]), LONG) * MATCH
                a0, a1 = max(int(edge[d]), int(pos[s]) - span), min(int(edge[d + 1]), int(pos[e - 1]) + SEED + span)
                # windows that overlap by what an alignment spans at most
                for w0 in range(a0, a1, 4 * len(words) + 64):
                    w1 = min(a1, w0 + 4 * len(words) + 64 + span)
                    if highest(x[w0:w1], b.vocabulary[k]) < enough or not np.isin(B.grams(x[w0:w1], SEED), b.grams[k]).any():
                        continue
                    score, f, t = local_alignment(words, x[w0:w1])
                    if score > 0 and score >= enough:
                        value = (score / (MATCH * len(words)), int(place[w0 + f]), int(place[w0 + t - 1]) + 1)
                        key = (ids[d], b.ids[k])
                        if key not in got or value[0] > got[key][0]:
                            got[key] = value
            for size in {len(w) for w in short_keys}:
                g = B.grams(x, size)
                for words, ks in short_keys.items():
                    if len(words) == size:
                        want = B.grams(np.array(words, np.uint64), size)[0]
                        for p in np.flatnonzero((g == want) & (row[: len(g)] == row[size - 1 : size - 1 + len(g)])).tolist():
                            for k in ks:
                                got.setdefault((ids[row[p]], b.ids[k]), (1.0, int(place[p]), int(place[p + size - 1]) + 1))
            if got:
                cols = zip(*((d, i, *v) for (d, i), v in got.items()), strict=True)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "end_word"])

    return docs.mapInArrow(search, RESULT)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, bench)
