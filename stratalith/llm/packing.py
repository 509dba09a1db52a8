"""Order-preserving packing into windows of at most SIZE tokens.

Documents stay in order of doc_id, so a packing is a choice of cuts in their
joined ids.  Cuts may be at document ends, at sentence ends, or, where neither
is near, at every GRID-th token.  With p the place of a cut, a window from i to
j costs its padding SIZE - (p[j] - p[i]) and a penalty for the kind of cut at j,
so the best cost up to j is SIZE - p[j] + penalty[j] plus the least of
cost[i] + p[i] among the i with p[j] - p[i] <= SIZE: a minimum over a sliding
window, kept in a monotone queue.

Ranges of doc_id are packed side by side; only the last window of a range is
left short.  Null text counts as empty (the end id alone); equal doc_ids are
separate documents in order of text; null doc_ids come first; further columns
are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .token_ids import WordTokens, vocabulary
from .token_output import CHUNK_BYTES, groups_of_rows, in_order

SIZE, END = 4096, 2
GRID = 64
SENTENCE_CUT, HARD_CUT = 4, 24  # as many tokens of padding as a cut there is worth
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, in order, and the penalty of each."""
    natural = np.union1d(doc_ends, sentence_ends)
    edges = np.unique(np.concatenate(([0], natural, [total])))
    gaps = np.diff(edges)
    n = np.maximum(0, (gaps - 1) // grid)  # places to add within each gap
    extra = np.repeat(edges[:-1], n) + grid * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1)
    places = np.union1d(edges[1:], extra)
    penalty = np.full(len(places), HARD_CUT)
    penalty[np.isin(places, sentence_ends)] = SENTENCE_CUT
    penalty[np.isin(places, doc_ends)] = 0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """The chosen cuts, the last place included.  Neighbouring places must be at most `size` apart."""
    p = [0, *places.tolist()]
    cost, back = [0] * len(p), [0] * len(p)
    queue = deque([(0, 0)])  # (cost + place, number), rising in both
    for j, extra in enumerate(penalty.tolist(), 1):
        while p[j] - p[queue[0][1]] > size:
            queue.popleft()
        least, back[j] = queue[0]
        cost[j] = least + size - p[j] + extra
        key = cost[j] + p[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(p) - 1
    while j:
        out.append(p[j])
        j = back[j]
    return out[::-1]


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """One row for each piece of a document.  Returns RESULT."""
    tokenizer = tokenizer or vocabulary()

    def windows(batches):
        from pyspark import TaskContext

        words, part = WordTokens.of(tokenizer), TaskContext.get().partitionId()
        stops = np.array([i for i in map(words.tokenizer.token_to_id, (".</w>", "!</w>", "?</w>", ".", "!", "?")) if i is not None], np.uint32)
        sequence = 0
        # documents not yet packed to their end: id, tokens in all, tokens already packed, and the rest of the ids
        names, totals, done, held = [], [], [], np.zeros(0, np.uint32)

        def flush(last: bool):
            nonlocal sequence, names, totals, done, held
            left = np.array(totals, np.int64) - np.array(done, np.int64)
            ends = np.cumsum(left)
            places, penalty = cuts(ends, np.flatnonzero(np.isin(held, stops)) + 1, len(held))
            chosen = best_cuts(places, penalty, size)
            if not last:
                chosen.pop()  # the next documents may fill it
            out, a = [], 0
            for b in chosen:
                first, end_ = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b, side="left"))
                for i in range(first, end_ + 1):
                    lo, hi = max(a, int(ends[i] - left[i])), min(b, int(ends[i]))
                    crc = zlib.crc32(held[lo:hi].astype("<u4").tobytes())
                    out.append((names[i], done[i] + lo - int(ends[i] - left[i]), hi - lo, crc, totals[i], (part << 32) + sequence, lo - a))
                sequence += 1
                a = b
            keep = int(np.searchsorted(ends, a, side="right"))
            if keep < len(names):
                done[keep] += a - int(ends[keep] - left[keep])
            names, totals, done, held = names[keep:], totals[keep:], done[keep:], held[a:]
            names_ = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names_) if out else None

        for ids, texts in groups_of_rows(batches, CHUNK_BYTES):
            tokens, counts = words.encode(texts, end)
            names, totals, done = names + ids, totals + counts.tolist(), done + [0] * len(ids)
            held = np.concatenate((held, tokens))
            if (rows := flush(False)) is not None:
                yield rows
        words.clear()
        if len(held) and (rows := flush(True)) is not None:
            yield rows

    return in_order(docs).mapInArrow(windows, RESULT)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
