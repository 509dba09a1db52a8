"""MinHash near-dedup with odd sketches.

1. Each document gets its shingle set's 128-bit hash, ROWS * BANDS MinHash values
   folded into band keys, and an odd sketch: a bitmap in which the minimum of each
   of SAMPLES bins of its hashes flips one bit.  If two sets share a share J of
   their samples, the XOR of their bitmaps has about (1 - J) * 2 * samples flips,
   so its population count tells J, most precisely when J is high.
2. Documents with equal sets are one class; its smallest doc_id represents it.
3. Representatives with an equal band meet: all pairs in a group of at most SMALL
   members, in a larger one only a star of each member and CENTRES centres.
   Pairs whose sketches say that J is well below the threshold go; the rest
   is confirmed on full sets, and confirmed links give components.
4. In large groups that are still in several components, each member outside the
   largest one meets all members of other components, by sketches, in tiles of bounded
   size; what the sketches allow is confirmed in the tile, on full sets, and the tile
   gives only links that join components.  So no pair that shares a band is left out
   but those whose ends are already joined, and no list of pairs is written.

With 5 rows and 28 bands a pair at J = 0.85 shares no band with probability
7e-8, at 0.8 with 1.5e-5.
The sketch's slack is four standard deviations of the sample and four of the count.

Null or empty text has an empty set and is linked with nothing; fewer words than
a shingle make one shingle.  Every row is a document: with repeated or null doc_ids, rows
are numbered by doc_id (null last) and text, the first row of a component is kept, and
its doc_id, null if it has none, is the component's; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

WORDS, PERCENT = 3, 85  # the contract's; other uses take five words and 80
ROWS, BANDS = 5, 28
SKETCH_BITS, SAMPLES = 4096, 2048
SAMPLE_SEED = np.uint64(0x452821E638D01377)
CENTRES = 3  # of a large band group
SMALL = 24  # members of a band group up to which all are paired
LABELS = 500_000  # rows in a file of component labels
TILE, TILE_SHINGLES = 1024, 1 << 19  # queries, or targets, compared at once, and their shingles
PART_BYTES = 1 << 20
SIGNATURE = "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, sketch binary"


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other; and how many each has."""
    x, counts = B.word_hashes(texts, fold=True)
    x = B.mixed(x)
    row = np.repeat(np.arange(len(texts)), counts)
    g = B.grams(x, n)
    ok = row[: len(g)] == row[n - 1 : n - 1 + len(g)]
    h, r = g[ok], row[: len(g)][ok]
    ends = np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    one = np.array([B.grams(x[ends[i] - counts[i] : ends[i]], int(counts[i]), 1)[0] for i in short.tolist()], np.uint64)
    if len(short):
        h, r = np.concatenate((h, one)), np.concatenate((r, short))
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    stops = np.cumsum(np.bincount(r, minlength=len(texts))).tolist()
    for a, b in zip([0, *stops], stops, strict=False):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.bincount(r[new], minlength=len(texts))


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**32, k, np.uint32) | np.uint32(1), r.integers(0, 2**32, k, np.uint32)


def signatures(h: np.ndarray, counts: np.ndarray, rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and odd sketches (texts x bytes) of sets that aren't empty."""
    k = rows * bands
    a, b = permutations(k)
    starts = np.cumsum(counts) - counts
    x = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    low = np.empty((k, len(counts)), np.uint32)
    for i in range(k):
        y = x * a[i] + b[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        low[i] = np.minimum.reduceat(y, starts)
    keys = np.empty((len(counts), bands), np.uint64)
    for j in range(bands):
        key = np.full(len(counts), np.uint64(j + 1))
        for i in range(rows):
            key = B.mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ low[j * rows + i])
        keys[:, j] = key
    return keys, sketches(h, counts)


def sketches(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Odd sketches (texts x bytes): of each of SAMPLES bins of a set's hashes, the smallest one flips a bit."""
    u = B.mixed(h ^ SAMPLE_SEED)
    stops = np.cumsum(counts)
    for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True):
        u[a:b].sort()
    row = np.repeat(np.arange(len(counts)), counts)
    bins = u >> np.uint64(64 - SAMPLES.bit_length() + 1)
    least = np.ones(len(u), bool)
    least[1:] = (bins[1:] != bins[:-1]) | (row[1:] != row[:-1])
    row, spot = row[least], (B.mixed(u[least]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    out = np.empty((len(counts), SKETCH_BITS // 8), np.uint8)
    for i in range(0, len(counts), 1024):
        n = min(1024, len(counts) - i)
        mine = slice(*np.searchsorted(row, (i, i + n)).tolist())
        flips = np.bincount((row[mine] - i) * SKETCH_BITS + spot[mine], minlength=n * SKETCH_BITS)
        out[i : i + n] = np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)
    return out


def most_flips(percent: int, sizes: np.ndarray) -> np.ndarray:
    """The largest XOR population count that pairs at the threshold show; sizes: the sum of both sets' sizes.

    A pair's union has at most sizes / (1 + J) members, of which a share of 1 - J is
    in one set only; each bin that differs holds one of those as its minimum.  Such a
    bin flips a second bit if the other set has something in it too.  Four standard
    deviations are allowed for each time, and four again for flips that cancel.
    """
    j = percent / 100
    union = sizes / (1 + j)
    bins = np.minimum(union, SAMPLES)
    differ = np.minimum((1 - j) * union, bins * (1 - j) + 4 * np.sqrt(bins * j * (1 - j)))
    second = differ * (1 - np.exp(-union / SAMPLES))
    flips = differ + np.minimum(differ, second + 4 * np.sqrt(second) + 4)
    p = (1 - (1 - 2 / SKETCH_BITS) ** flips) / 2
    return np.minimum(flips + 1e-6, SKETCH_BITS * p + 4 * np.sqrt(SKETCH_BITS * p * (1 - p)) + 1)


def text_groups(batches, most: int):
    """Lists of rows (as dicts without text) and of texts, about `most` bytes each."""
    rows, texts, held = [], [], 0
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        cols = [batch.column(n).to_pylist() for n in names]
        for i, t in enumerate(batch.column("text")):
            rows.append({n: c[i] for n, c in zip(names, cols, strict=True)})
            texts.append((t.as_py() or "").encode())
            held += len(texts[-1]) + 64
            if held >= most:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def signed(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    def sign(batches):
        for meta, texts in text_groups(batches, PART_BYTES):
            h, n = shingle_sets(texts, words)
            full = np.flatnonzero(n)
            ends = np.cumsum(n)
            ids = pa.array([m["doc_id"] for m in meta], pa.int64())
            sets = np.zeros((len(texts), 2), np.int64)
            for i in full.tolist():
                sets[i] = np.frombuffer(xxhash.xxh3_128_digest(h[ends[i] - n[i] : ends[i]].tobytes()), np.int64)
            bands_of, sketch_of = [None] * len(texts), [None] * len(texts)
            if len(full):
                keys, sketches = signatures(h, n[full], rows, bands)
                for j, i in enumerate(full.tolist()):
                    bands_of[i], sketch_of[i] = keys[j].view(np.int64), sketches[j].tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sets[:, 0]), pa.array(sets[:, 1]), pa.array(bands_of, pa.list_(pa.int64())), pa.array(sketch_of, pa.binary())], names=["doc_id", "n_shingles", "set1", "set2", "bands", "sketch"])

    return docs.mapInArrow(sign, SIGNATURE)


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach from each node (id).

    Each round takes the smallest label among neighbours, then that label's label
    of the round before; what a round leaves is written to the shared folder, in
    files of about LABELS rows.
    """
    both = B.stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    parts = both.count() // LABELS + 1
    now = B.stored(nodes.select("id", F.col("id").alias("component")).coalesce(parts), "labels")
    while True:
        low = both.join(now, both.b == now.id).groupBy("a").agg(F.min("component").alias("low"))
        step = now.join(low, now.id == low.a, "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("low", "component")).alias("near"))
        far = now.select(F.col("id").alias("at"), F.col("component").alias("next"))
        new = step.join(far, step.near == far.at, "left").select("id", "was", F.least("near", F.coalesce("next", "near")).alias("component"))
        new = B.stored(new.coalesce(parts), "labels")
        now = new.select("id", "component")
        if new.filter("component < was").isEmpty():
            return now


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after further links (a, b) have joined some components."""
    of = lambda k: labels.select(F.col("id").alias(k), F.col("component").alias(f"c{k}"))
    between = B.stored(links.join(of("a"), "a").join(of("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
    ends = between.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    new = components(between, ends).toDF("component", "least")
    return labels.join(new, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two sorted sets share."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have that similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # all texts are shuffled once; the two joins move those of the candidates alone
    text = B.stored(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi"), "texts")
    # shuffled joins: a centre in many pairs is a hot key, which the adaptive plan splits
    with_a = pairs.join(text.withColumnRenamed("text", "text_a").hint("merge"), pairs.a == F.col("doc_id")).drop("doc_id")
    with_b = with_a.join(text.hint("merge"), with_a.b == F.col("doc_id")).drop("doc_id")

    def check(batches):
        kept = {}

        def set_of(key, t: str):
            if key not in kept:
                if len(kept) > 500:
                    kept.clear()
                kept[key] = shingle_sets([(t or "").encode()], words)[0]
            return kept[key]

        for batch in batches:
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "text_a", "text"))
            yes = []
            for i in range(batch.num_rows):
                x, y = set_of(a[i].as_py(), ta[i].as_py()), set_of(b[i].as_py(), tb[i].as_py())
                # sizes alone may rule a pair out
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = common(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    yes.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(yes, pa.int64())), b.take(pa.array(yes, pa.int64()))], names=["a", "b"])

    return with_b.mapInArrow(check, "a long, b long")


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose set sizes and odd sketches allow that similarity."""
    s = sketches.select("id", "n_shingles", "sketch")
    one = pairs.join(s.toDF("a", "na", "sa").hint("merge"), "a").join(s.toDF("b", "nb", "sb").hint("merge"), "b")
    one = one.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def sift(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            sizes = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yes = pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= most_flips(percent, sizes))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(yes), batch.column("b").filter(yes)], names=["a", "b"])

    return one.mapInArrow(sift, "a long, b long")


TILE_KEYS = ["band", "c", "s"]
ASKS, ANSWERS = 1, 2  # what a row does in a tile: a query, a target, or both
TILE_VALUES = ["id", "component", "n_shingles", "sketch", "bands"]
TILE_COLUMNS = "band long, c int, s int, id long, component long, role int"


def whole_tiles(batches):
    """A table for each tile, from batches that are sorted by tile."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        key = np.stack([t.column(k).to_numpy() for k in TILE_KEYS])
        edge = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))).tolist()
        for i, j in zip(edge, edge[1:], strict=False):
            yield t.slice(i, j - i)
        held = t.slice(edge[-1])  # may go on in the next batch
    if held is not None and held.num_rows:
        yield held


def near_in_tile(t: pa.Table, percent: int):
    """Rows (a, b) of a tile, some at a time: a query and a target of another component whose sketches allow the similarity.

    Two documents may meet in several band groups; only the first band that they share counts.
    """
    comp, size, role = (t.column(k).to_numpy() for k in ("component", "n_shingles", "role"))
    sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    band = t.column("band")[0].as_py()
    q, g = np.flatnonzero(role & ASKS), np.flatnonzero(role & ANSWERS)
    both = role == ASKS | ANSWERS
    for k in range(0, len(q), 64):
        m = q[k : k + 64]
        low, high = np.minimum(size[m][:, None], size[g]), np.maximum(size[m][:, None], size[g])
        a, b = np.nonzero((comp[m][:, None] != comp[g]) & (low * 100 >= high * percent))
        a, b = m[a], g[b]
        once = ~(both[a] & both[b]) | (a < b)  # two that do both would meet twice
        a, b = a[once], b[once]
        flips = np.bitwise_count(sk[a] ^ sk[b]).sum(axis=1)
        near = flips <= most_flips(percent, size[a] + size[b])
        a, b, flips = a[near], b[near], flips[near]
        first = (bands[a] == bands[b]).argmax(axis=1)
        mine = bands[a, first] == band
        order = np.argsort(flips[mine], kind="stable")
        yield a[mine][order], b[mine][order]


def likely_apart(members: DataFrame, labels: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """One row (TILE_COLUMNS) for each tile and document that has a partner there: a member of another component whose sketch allows that similarity.

    A group's queries are its members outside the largest component, its targets
    are all; both are dealt out to tiles, bounded in members and in shingles, so that
    a group of any size is spread.  A tile gives its documents, never its pairs.
    """
    named = members.join(labels, "id")
    parts = named.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    major = F.struct("n", "component")
    group = parts.groupBy("band").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("n").alias("top"), F.max_by("w", major).alias("top_w"), F.max_by("component", major).alias("major"), F.count("*").alias("parts"))
    tiled = lambda n, w: F.ceil(F.greatest(n / TILE, w / TILE_SHINGLES)).cast("int")
    n, w, top, top_w = (F.col(k) for k in ("n", "w", "top", "top_w"))
    group = group.filter("parts > 1").select("band", "major", tiled(n - top, w - top_w).alias("chunks"), tiled(n, w).alias("slices"))
    # sketches are joined once for each document, not once for each of its bands
    each = named.join(group, "band").groupBy("id").agg(F.min("component").alias("component"), F.collect_list(F.struct("band", "major", "chunks", "slices")).alias("at"))
    rows = each.join(reps.select("id", "n_shingles", "sketch", "bands").hint("merge"), "id").select(F.explode("at").alias("one"), "*").select("one.*", *TILE_VALUES)
    hashed = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    up_to = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    queries = rows.filter("component <> major").select("band", hashed("chunks").alias("c"), up_to("slices").alias("s"), F.lit(ASKS).alias("role"), *TILE_VALUES)
    targets = rows.select("band", up_to("chunks").alias("c"), hashed("slices").alias("s"), F.lit(ANSWERS).alias("role"), *TILE_VALUES)
    dealt = queries.unionByName(targets).repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)

    def compare(batches):
        for t in whole_tiles(batches):
            found = np.zeros(t.num_rows, bool)
            for a, b in near_in_tile(t, percent):
                found[a] = found[b] = True
            if found.any():
                t = t.filter(pa.array(found))
                _, first, of = np.unique(t.column("id").to_numpy(), return_index=True, return_inverse=True)
                role = np.zeros(len(first), np.int32)
                np.bitwise_or.at(role, of, t.column("role").to_numpy())
                t = t.take(pa.array(first)).select([*TILE_KEYS, "id", "component"])
                yield from t.append_column("role", pa.array(role)).combine_chunks().to_batches()

    return dealt.mapInArrow(compare, TILE_COLUMNS)


def links_apart(apart: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components, from the rows that likely_apart gives.

    Texts travel to the tiles, where pairs are compared on full sets, the likeliest
    first; a pair whose components the tile has joined already is skipped, as it can't
    change the result.  So a tile gives fewer links than it has components.
    """
    each = apart.groupBy("id").agg(F.min("component").alias("component"), F.collect_list(F.struct(*TILE_KEYS, "role")).alias("at"))
    full = each.join(reps.select("id", "n_shingles", "sketch", "bands").hint("merge"), "id").join(docs.select(F.col("doc_id").alias("id"), "text").hint("merge"), "id")
    rows = full.select(F.explode("at").alias("one"), "*").select("one.*", *TILE_VALUES, "text").repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)

    def compare(batches):
        for t in whole_tiles(batches):
            ids, comp = t.column("id").to_numpy(), t.column("component").to_numpy()
            text, sets, root, out = t.column("text"), {}, {}, []

            def top(c):
                while root.get(c, c) != c:
                    root[c] = c = root.get(root[c], root[c])
                return c

            def set_of(i):
                if i not in sets:
                    sets[i] = shingle_sets([(text[i].as_py() or "").encode()], words)[0]
                return sets[i]

            for a, b in near_in_tile(t, percent):
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    ci, cj = top(int(comp[i])), top(int(comp[j]))
                    if ci == cj:
                        continue
                    x, y = set_of(i), set_of(j)
                    both = common(x, y)
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        root[ci] = cj
                        out.append((ids[i], ids[j]))
            if out:
                lo, hi = (pa.array([f(p) for p in out], pa.int64()) for f in (min, max))
                yield pa.RecordBatch.from_arrays([lo, hi], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, centres: int = CENTRES, small: int = SMALL) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, class_id (the smallest document with an equal set)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = B.stored(signed(docs, words, rows, bands), "signatures")
    if not sigs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1").isEmpty():
        numbered = B.by_row(docs, "row")
        found = near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text"), words, percent, rows, bands, centres, small)
        of = lambda name: numbered.select(F.col("row").alias(f"{name}_row"), F.col("doc_id").alias(name))
        found = found.toDF("a_row", "n_shingles", "b_row", "kept", "c_row").join(of("a"), "a_row").join(of("b"), "b_row").join(of("c"), "c_row")
        return found.select(F.col("a").alias("doc_id"), "n_shingles", F.col("b").alias("component_id"), "kept", F.col("c").alias("class_id"))
    full = sigs.filter("n_shingles > 0")
    classes = full.groupBy("set1", "set2").agg(F.min("doc_id").alias("id"))
    reps = full.join(classes, full.doc_id == classes.id, "left_semi").withColumnRenamed("doc_id", "id")
    reps = B.stored(reps.select("id", "n_shingles", "bands", "sketch"), "representatives")
    grouped = reps.select("id", "n_shingles", F.explode("bands").alias("band"))
    big = grouped.groupBy("band").agg(F.count("*").alias("n"), *[F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"c{k}") for k in range(centres)]).filter("n > 1")
    members = B.stored(grouped.join(big, "band"), "members")
    nodes = members.select("id").distinct()
    few = members.filter(F.col("n") <= small).select("band", "id")
    pairs = few.join(few.toDF("band", "other").hint("merge"), "band").filter("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    many = members.filter(F.col("n") > small)
    stars = many.select("id", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(centres)]))).alias("c")).filter("id <> c")
    pairs = pairs.union(stars.select(F.least("id", "c"), F.greatest("id", "c"))).distinct()
    links = B.stored(confirmed(B.stored(likely(pairs, reps, percent), "likely"), docs, words, percent), "links")
    labels = components(links, nodes)
    apart = B.stored(likely_apart(many.select("band", "id", "n_shingles"), labels, reps, percent), "apart")
    if not apart.isEmpty():
        more = B.stored(links_apart(apart, reps, docs, words, percent), "links")
        labels = joined_components(labels, more)
    classed = sigs.join(classes, ["set1", "set2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("id")).otherwise(F.col("doc_id")).alias("class_id"))
    out = classed.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), (F.col("doc_id") == F.coalesce("component", "class_id")).alias("kept"), "class_id")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, WORDS, PERCENT)
