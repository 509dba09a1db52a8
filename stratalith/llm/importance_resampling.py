"""Target-distribution importance resampling over hashed n-grams.

1. Texts of over CHUNK bytes are split at word boundaries and dealt out over tasks; a
   chunk owns the positions at which its words start and carries the n-1 words that
   follow it, so each run of words is counted once, in the chunk that it starts in.
   Shorter texts are one chunk each and stay where they are.
2. Each chunk is written with the counts of its features by bucket.
3. Bucket totals of documents and of the target give each bucket's gain (a table of
   `buckets` numbers, the only thing that tasks get from the driver).
4. Chunks' counts and gains are summed by document; a document's score is its floored
   mean gain plus Gumbel noise of its doc_id, so that the highest scores are a draw
   without replacement in proportion to the importance weights.
5. Ranks come from one sort by ranges: a row's place in its range plus the rows of all
   ranges before.

Every row of docs is a document: rows with equal doc_id are ranked each for itself (ties
by doc_id, null last, then by an arbitrary number of the row); null doc_ids make noise as
the text "null".  A null or blank text has no features and weight 0.  Further columns are
ignored; with an empty target all its counts are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import blocks as B

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
CHUNK = 1 << 20  # bytes
GROUP_BYTES = 1 << 20
CACHED = 200_000  # features whose buckets are remembered
#: Bytes of words stay, A-Z as a-z; all others part words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CHUNKS = "row long, doc_id long, body binary, carry binary"
COUNTED = "row long, doc_id long, n_words long, buckets array<int>, counts array<int>"


def chunks(text: bytes, carried: int, most: int):
    """(body, carry) of a text of words parted by spaces; the carry are the words that follow the body."""
    a = 0
    while a < len(text):
        b = text.find(b" ", a + most)
        b = b if b >= 0 else len(text)
        yield text[a:b], b" ".join(m[0] for m in islice(re.compile(rb"\S+").finditer(text, b), carried))
        a = b + 1


def split_long(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Chunks of (row, doc_id, text), dealt out anew."""

    def each(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = text.as_py().encode().translate(WORD_BYTES)
                for body, carry in chunks(words, n - 1, most):
                    yield pa.RecordBatch.from_pylist([{"row": row.as_py(), "doc_id": doc_id.as_py(), "body": body, "carry": carry}], schema=SCHEMA)

    SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("body", pa.binary()), ("carry", pa.binary())])
    return rows.mapInArrow(each, CHUNKS).repartition("row", F.xxhash64("body"))


class Buckets(dict):
    """Buckets of features by their bytes; forgets all when it holds too many."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.n
        return b


def counted(chunks: DataFrame, n: int, buckets: int) -> DataFrame:
    """COUNTED rows of CHUNKS rows: the features that start in each chunk, by bucket."""

    def some(ids, docs, bodies):
        nth, found, own = [], [], np.zeros(len(ids), np.int64)
        for i, (body, carry) in enumerate(bodies):
            words = body.split()
            own[i] = m = len(words)
            after = words + carry.split()
            runs = list(words)
            for k in range(2, n + 1):
                runs += list(map(b" ".join, zip(*(after[j:] for j in range(k)), strict=False)))[:m]
            found += map(known.__getitem__, runs)
            nth.append(len(runs))
        key = np.repeat(np.arange(len(ids), dtype=np.int64) * buckets, nth) + np.array(found, np.int64)
        both, times = np.unique(key, return_counts=True)
        ends = np.searchsorted(both, np.arange(len(ids) + 1, dtype=np.int64) * buckets).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (both % buckets, times)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array(own), *lists], names=["row", "doc_id", "n_words", "buckets", "counts"])

    known = Buckets(buckets)

    def each(batches):
        ids, docs, bodies, held = [], [], [], 0
        for batch in batches:
            for row, doc_id, body, carry in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids.append(row.as_py())
                docs.append(doc_id.as_py())
                bodies.append((body.as_py().translate(WORD_BYTES), carry.as_py()))
                held += len(bodies[-1][0]) + 64
                if held >= GROUP_BYTES:
                    yield some(ids, docs, bodies)
                    ids, docs, bodies, held = [], [], [], 0
        if ids:
            yield some(ids, docs, bodies)

    return chunks.mapInArrow(each, COUNTED)


def features(docs: DataFrame, n: int = 1, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """COUNTED rows of docs (doc_id, text), written: one for each chunk, and so for each text of at most `chunk` bytes."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.octet_length("text") > chunk
    short = rows.filter(~long).select("row", "doc_id", F.col("text").cast("binary").alias("body"), F.lit(b"").alias("carry"))
    # numbers of their own for the others, as the two readings need not number rows alike
    cut = split_long(rows.filter(long).withColumn("row", -1 - F.col("row")), n, chunk)
    return B.stored(counted(short, n, buckets).unionByName(counted(cut, n, buckets)), "features")


def totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket over all rows; tasks send a row for each bucket at most."""

    def each(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            at, times = (batch.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            n += np.bincount(at, weights=times, minlength=buckets).astype(np.int64)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full])], names=["bucket", "n"])

    sums = counted.select("buckets", "counts").mapInArrow(each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the log ratio of a bucket's share of the target and its share of the source, one added to each count."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = (float((t + 1) * (s_all + b)) / float((s + 1) * (t_all + b)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, total): counts and gains, summed over each document's chunks."""

    def each(batches):
        for batch in batches:
            lists = batch.column("buckets")
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            times = batch.column("counts").flatten().to_numpy().astype(np.int64)
            upto = [np.concatenate(([0], np.cumsum(x)))[ends] for x in (times, gain[lists.flatten().to_numpy()] * times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_words"), *(pa.array(np.diff(x)) for x in upto)], names=["row", "doc_id", "n_words", "n_features", "total"])

    each_chunk = counted.mapInArrow(each, "row long, doc_id long, n_words long, n_features long, total long")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "total")]
    whole = each_chunk.filter("row >= 0")
    cut = each_chunk.filter("row < 0").groupBy("row").agg(F.min("doc_id").alias("doc_id"), *sums)
    return whole.unionByName(cut)


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """One row for each document: doc_id, n_features, weight, score, rank (null if it isn't drawn).

    docs: doc_id and text; target: text.  Of the documents with least_words words, percent in a hundred are drawn."""
    if n < 1 or buckets < 1 or chunk < 1:
        raise ValueError("n, buckets and chunk must be at least 1")
    mine = features(docs, n, buckets, chunk)
    aim = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets, chunk)
    gain = gains(totals(mine, buckets), totals(aim, buckets))
    rows = weighed(mine, gain)
    mean = F.expr("if(n_features > 0, (total - pmod(total, n_features)) div n_features, 0)")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = rows.select("row", "doc_id", "n_features", mean.alias("weight"), (F.col("n_words") >= least_words).alias("fit")).withColumn("score", F.col("weight") + noise)
    order = [F.desc("fit"), F.desc("score"), F.col("doc_id").asc_nulls_last(), "row"]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = B.stored(placed, "placed")
    # a place is the number of its range and, below 2^33, that in its range
    ranges = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fit"))
    before = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select("range", F.coalesce(before, F.lit(0)).alias("before"), F.floor(F.sum("fit").over(W.partitionBy()) * percent / 100).alias("most"))
    out = placed.withColumn("range", F.shiftright("place", 33)).join(ranges, "range")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= F.col("most")), rank).alias("rank"))


#: CRC-32 by a table of 256 entries that the first part makes; hex digits become numbers by their place in a string.
OP12_SQL = """
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) x(i)) y),
words AS (SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
          UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words) x),
bytes AS (SELECT word, list_transform(range(len(h) // 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(h, CAST(2 * i + 1 AS INT), 1)) - 1) + strpos('0123456789ABCDEF', substr(h, CAST(2 * i + 2 AS INT), 1)) - 1 AS BIGINT)) AS b FROM hexed),
crc AS (SELECT word, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(t[(xor(c, x) % 256) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, tab),
feature AS (SELECT side, doc_id, bucket, count(*) AS n FROM words JOIN crc USING (word) GROUP BY ALL),
bucket AS (SELECT bucket, CAST(sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS BIGINT) AS s, CAST(sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS BIGINT) AS t FROM feature GROUP BY bucket),
whole AS (SELECT CAST(sum(s) AS BIGINT) AS s_all, CAST(sum(t) AS BIGINT) AS t_all FROM bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM bucket, whole),
weight AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM feature JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
doc AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
               list_reduce(list_transform(range(8), lambda i: CAST(strpos('0123456789abcdef', substr(sha256('2024:' || d.doc_id), CAST(i + 1 AS INT), 1)) - 1 AS BIGINT)), lambda a, x: 16 * a + x) AS h
        FROM documents d LEFT JOIN weight w ON d.doc_id = w.doc_id),
scored AS (SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM doc),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (10 * fit) // 100 THEN CAST(place AS BIGINT) END AS "rank" FROM placed
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
