"""SimHash near-dedup by a Gray-order hierarchical index.

1. A document's fingerprint has 64 bits; a bit is 1 if it is set in over half of the
   hashes of its shingles.
2. Documents with equal fingerprints are one entry of the index from here on.
3. Two fingerprints that differ in at most three bits agree in one of four blocks of
   bits.  So the index has four orders; in each, another block leads.  What shares
   the leading block is a cell, and only cells are dealt out to tasks.  A cell of over
   CELL fingerprints is split by four blocks of its other bits, and so on, until all
   cells are small: a cell of k bits left has at most 2^k members.
4. In a task, a cell's fingerprints stand in order of their Gray rank, in which
   neighbours share long bit patterns.  FAN neighbours make a node, which holds the
   bits that all of them share and the mask of those; FAN nodes make a node of the next
   level, up to the cell.  Pairs of nodes are followed from the top: a pair's count
   grows by the differences on bits that its nodes know and the pair above didn't, and
   a pair of whole groups goes when it is over the limit.
5. A task gives a link from each fingerprint to the least one that it is joined with
   there, never its pairs; links between tasks meet in connected components.

A null or blank text has fingerprint 0, which is linked like any other; fewer words than
a shingle are one shingle.  Every row is a document: rows with equal or null doc_id stay
(null counts for no component, unless it has nothing else: then component_id is null).
Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .minhash_dedup import components, text_groups

WORDS, SEED, MOST = 3, 42, 3
GROUP_BYTES = 1 << 20  # text taken at once
PIECE = 1 << 16  # shingles of a long text counted at once
FAN = 8  # children of a node
CELL = 1 << 14  # fingerprints of a cell
AT_ONCE = 1 << 16  # fingerprints of several cells that a task takes together
STEP = 1 << 13  # pairs of nodes followed at once
#: Bit j of byte value v.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(words) - n + 1)


def fingerprints(texts: list[bytes], n: int) -> np.ndarray:
    """How often each byte value stands at each of a hash's 8 places tells how often each bit is set."""
    counts, sizes = np.zeros((len(texts), 8 * 256)), np.zeros(len(texts))
    column = np.arange(8) * 256
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z alone, and ASCII white space alone
        for a in range(0, max(1, len(words) - n + 1), PIECE):
            h = shingle_hashes(words[a : a + PIECE + n - 1], n)
            counts[i] += np.bincount((h.view(np.uint8).reshape(-1, 8) + column).ravel(), minlength=8 * 256)
            sizes[i] += len(h)
    ones = (counts.reshape(-1, 8, 256) @ BITS).reshape(-1, 64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprinted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp), a row for each row of docs."""

    def each(batches):
        for rows, texts in text_groups(batches, GROUP_BYTES):
            ids = pa.array([r["doc_id"] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(fingerprints(texts, words).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def block_sizes(bits: int) -> list[int]:
    return [bits // 4 + (j < bits % 4) for j in range(4)]


def with_blocks_first(rows: DataFrame, fixed_bits: set[int]) -> DataFrame:
    """Each row (path, fixed, code, fp) four times: another block of the bits behind the first `fixed` ones (one of fixed_bits) leads those.

    All rows of a path have had their bits moved alike, so differences stay what they were."""
    out = []
    for fixed in sorted(fixed_bits):
        left, at = 64 - fixed, 0
        moved = []
        for j, size in enumerate(block_sizes(left)):
            low = F.col("code").bitwiseAND(F.lit((1 << left) - 1 if left < 64 else -1))
            high = F.col("code").bitwiseAND(F.lit(-(1 << left) if left < 64 else 0))
            turned = F.shiftleft(low, at).bitwiseOR(F.shiftrightunsigned(low, left - at)) if at else low
            turned = turned.bitwiseAND(F.lit((1 << left) - 1 if left < 64 else -1))
            moved.append(F.struct(F.concat("path", F.lit(f"{j}")).alias("path"), F.lit(fixed + size).alias("fixed"), high.bitwiseOR(turned).alias("code"), "fp"))
            at += size
        out.append(F.when(F.col("fixed") == fixed, F.array(*moved)))
    return rows.select(F.explode(F.coalesce(*out)).alias("x")).select("x.*")


def cell_of() -> Column:
    """Of rows that share path and leading bits; should two cells have one number, more is compared and nothing lost."""
    return F.xxhash64("path", F.expr("shiftrightunsigned(code, 64 - fixed)"))


def gray_rank(code: Column) -> Column:
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def cells(entries: DataFrame, most: int) -> DataFrame:
    """(cell, code, fp): each entry (fp) in the four or more cells in which it meets all that is near."""
    done, fixed_bits = None, {0}
    rows = entries.select(F.lit("").alias("path"), F.lit(0).alias("fixed"), F.col("fp").alias("code"), "fp")
    while True:
        dealt = with_blocks_first(rows, fixed_bits).withColumn("cell", cell_of())
        large = B.stored(dealt.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("cell"), "large-cells")
        if large.isEmpty():
            last = dealt.select("cell", "code", "fp")
            return last if done is None else done.unionByName(last)
        dealt = B.stored(dealt, "cells")
        small = dealt.join(large, "cell", "left_anti").select("cell", "code", "fp")
        done = small if done is None else done.unionByName(small)
        rows = dealt.join(large, "cell", "left_semi").select("path", "fixed", "code", "fp")
        fixed_bits = {f + size for f in fixed_bits for size in block_sizes(64 - f)}


class Level:
    """Nodes of one level: where their children start and how many they are, the bits all below share, and those bits' mask."""

    def __init__(self, first: np.ndarray, count: np.ndarray, cell: np.ndarray, pattern: np.ndarray, mask: np.ndarray):
        self.first, self.count, self.cell, self.pattern, self.mask = first, count, cell, pattern, mask


def above(level: Level) -> Level:
    """FAN neighbours of a cell under one node."""
    new = np.append(True, level.cell[1:] != level.cell[:-1])
    starts = np.flatnonzero(new)
    place = np.arange(len(level.cell)) - np.repeat(starts, np.diff(starts, append=len(level.cell)))
    first = np.flatnonzero(place % FAN == 0)
    ones = np.bitwise_and.reduceat(level.pattern, first)
    zeros = np.bitwise_and.reduceat(~level.pattern & level.mask, first)
    return Level(first, np.diff(first, append=len(level.cell)), level.cell[first], ones, ones | zeros)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """label: the least place that each place is joined with, after links between the places a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def near(cell: np.ndarray, codes: np.ndarray, most: int) -> np.ndarray:
    """For codes in order of cell and Gray rank, the least place that each is linked with, by links within the cells."""
    label = np.arange(len(codes))
    levels = [Level(label, np.ones(len(codes), np.int64), cell, codes, np.full(len(codes), ~np.uint64(0)))]
    while len(levels[-1].cell) > 1 and (levels[-1].cell[1:] == levels[-1].cell[:-1]).any():
        levels.append(above(levels[-1]))
    top = levels[-1]
    todo = [(len(levels) - 1, np.arange(len(top.cell)), np.arange(len(top.cell)), np.zeros(len(top.cell), np.uint64), np.zeros(len(top.cell), np.int64))]
    while todo:
        k, i, j, known, differ = todo.pop()
        if k == 0:
            joined(label, i, j)
            continue
        if len(i) > STEP:
            todo += [(k, i[s : s + STEP], j[s : s + STEP], known[s : s + STEP], differ[s : s + STEP]) for s in range(0, len(i), STEP)]
            continue
        up, low = levels[k], levels[k - 1]
        n = up.count[i] * up.count[j]
        pair = np.repeat(np.arange(len(i)), n)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        a = up.first[i][pair] + nth // up.count[j][pair]
        b = up.first[j][pair] + nth % up.count[j][pair]
        once = a < b if k == 1 else a <= b  # nodes of one pair stand apart, or are the same
        pair, a, b = pair[once], a[once], b[once]
        both = low.mask[a] & low.mask[b]
        total = differ[pair] + np.bitwise_count((low.pattern[a] ^ low.pattern[b]) & both & ~known[pair])
        ok = total <= most
        if ok.any():
            todo.append((k - 1, a[ok], b[ok], both[ok], total[ok]))
    return label


def links_of(dealt: DataFrame, most: int, least_rows: int = AT_ONCE) -> DataFrame:
    """Links (a, b) from cells, a task's cells taken some at a time but whole."""
    gray = dealt.withColumn("gray", gray_rank(F.col("code"))).repartition("cell").sortWithinPartitions("cell", "gray").drop("gray")

    def linked(t: pa.Table) -> pa.RecordBatch:
        cell, code, fp = (t.column(c).to_numpy() for c in ("cell", "code", "fp"))
        root = near(cell, code.view(np.uint64), most)
        far = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[root[far]])], names=["a", "b"])

    def each(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < least_rows:
                continue
            t = pa.Table.from_batches(held)
            cell = t.column("cell").to_numpy()
            cut = int(np.searchsorted(cell == cell[-1], True))  # the last cell may go on
            if cut:
                yield linked(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            n = t.num_rows - cut
        if n:
            yield linked(pa.Table.from_batches(held))

    return gray.mapInArrow(each, "a long, b long")


def simhash_dedup(docs: DataFrame, words: int = WORDS, most: int = MOST, cell: int = CELL) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id (smallest doc_id reachable by links of at most `most` differing bits, at most three), kept."""
    if not 0 <= most <= 3 or cell < 8:
        raise ValueError("links are found for at most 3 differing bits, in cells of at least 8 fingerprints")
    fps = B.stored(fingerprinted(docs, words), "fingerprints")
    entries = B.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    links = B.stored(links_of(cells(entries, cell), most), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = components(links, ends)
    known = entries.join(labels, entries.fp == labels.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(least, "component").select("fp", "component_id")
    # many documents may have one fingerprint; the adaptive plan splits those
    out = fps.join(named.hint("merge"), "fp")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", kept.alias("kept"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
