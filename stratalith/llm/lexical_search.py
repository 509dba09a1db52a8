"""Ranked lexical search by threshold-seeded joins: the k best documents of each item.

A term's weight w falls with the documents that hold it; a posting's value v grows with
its count in the document and falls with the document's length; a score is the sum of
w * v over an item's terms, in whole numbers.

1. Documents are written with their terms and counts, as far as items may ask for them:
   a bitmap of FILTER_BITS bits of the items' terms decides, whatever their number.
   N and L count all terms of all documents.
2. Of each term its k highest values are stored, with their documents.  Their last
   one times w is reached by k documents, so the highest such product of an item's
   terms is a lower bound of its kth score.  The stored documents themselves are
   scored exactly; their kth score is another, closer bound.
3. An item's terms stand by what they can add at most, w times the term's highest value.
   Terms from which on all that can still be added is below CUT of the bound are cut:
   who holds none of the others can't be among the k best.  With CUT at 1 the fewest
   postings would be read, but whoever holds one of those terms would stay possible.
4. The other terms' postings give candidates.  What a candidate has from them, plus all
   that the cut terms could add, must reach the bound; what is left is scored exactly.

A bound is only ever used to drop what lies strictly below it, so ties stay.  Equal
scores stand by ascending doc_id, null last; repeated rows of docs are documents each,
repeated or null item_ids items each.  Null or blank texts have no terms: as documents
they are found by nothing, as items they find nothing.  Further columns are ignored; an
empty table on either side gives an empty result.  Values are 64-bit integers; a document
whose 90 * n * N overflows them raises.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import blocks as B
from .importance_resampling import WORD_BYTES

BEST = 10
CUT = 0.4
FILTER_BITS = 1 << 22
TERMS = "row long, id long, n long, terms array<string>, counts array<int>"
GROUP_ROWS = 512


class Wanted(dict):
    """Whether an item may hold a term; remembers a bounded number of them."""

    def __init__(self, bitmap: np.ndarray):
        self.bits = np.unpackbits(bitmap.view(np.uint8), bitorder="little")

    def __missing__(self, term: bytes) -> bool:
        if len(self) > 200_000:
            self.clear()
        yes = self[term] = bool(self.bits[zlib.crc32(term) % FILTER_BITS])
        return yes


def terms_of(rows: DataFrame, key: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """A row (TERMS) for each row of key and text, written: all its terms' number, and the different ones that the bitmap allows with their counts."""

    def each(batches):
        wanted = Wanted(bitmap) if bitmap is not None else None

        def out():
            ends = np.cumsum([0, *map(len, terms)], dtype=np.int32)
            flat = [pa.array([t for x in terms for t in x], pa.binary()).cast(pa.string()), pa.array([c for x in terms for c in x.values()], pa.int32())]
            lists = [pa.ListArray.from_arrays(pa.array(ends), f) for f in flat]
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], names=["row", "id", "n", "terms", "counts"])

        row, ids, n, terms = [], [], [], []
        for batch in batches:
            for r, i, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                words = (text.as_py() or "").encode().translate(WORD_BYTES).split()
                found = Counter(words)
                row.append(r.as_py())
                ids.append(i.as_py())
                n.append(len(words))
                terms.append({t: c for t, c in found.items() if wanted[t]} if wanted is not None else found)
                if len(row) == GROUP_ROWS:
                    yield out()
                    row, ids, n, terms = [], [], [], []
        if row:
            yield out()

    three = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), "text")
    return B.stored(three.mapInArrow(each, TERMS), "terms")


def filter_of(items: DataFrame) -> np.ndarray:
    """A bitmap of the items' terms: at most FILTER_BITS / 64 rows come to the driver."""
    spot = items.select(F.explode("terms").alias("term")).select((F.crc32(F.encode("term", "UTF-8")) % FILTER_BITS).alias("spot"))
    bit = F.expr("shiftleft(1L, cast(spot % 64 as int))")
    words = spot.groupBy(F.expr("spot div 64").alias("at")).agg(F.bit_or(bit).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        out[r["at"]] = r["bits"]
    return out


def value(count: Column, n: Column, docs: int, terms: int) -> Column:
    """What a term's count adds to a score, before the term's weight."""
    x = F.struct(count.cast("long").alias("count"), (10 + F.call_function("div", 90 * n * F.lit(docs), F.lit(terms))).alias("m"))
    return F.call_function("div", 1_000_000_000 * x["count"], 1000 * x["count"] + 8 * x["m"])


class Index:
    """Documents by their terms, N and L, the stored best values and the weights of terms."""

    def __init__(self, docs: DataFrame, bitmap: np.ndarray | None = None, best: int = BEST):
        self.best = best
        self.docs = terms_of(docs, "doc_id", bitmap)
        sums = self.docs.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        self.n_docs, self.n_terms = sums["docs"], max(sums["terms"], 1)
        each = self.docs.select("row", "id", "n", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        self.postings = each.select(F.col("x.terms").alias("term"), "row", "id", value(F.col("x.counts"), F.col("n"), self.n_docs, self.n_terms).alias("v"))
        place = F.row_number().over(W.partitionBy("term").orderBy(F.desc("v"), F.col("id").asc_nulls_last(), "row"))
        self.top = B.stored(self.postings.withColumn("place", place).filter(F.col("place") <= best).select("term", "place", "row", "v"), "best-values")
        w = F.floor(1000 * F.log((2.0 * self.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
        kth = self.top.groupBy("term").agg(F.max("v").alias("highest"), F.max(F.when(F.col("place") == best, F.col("v"))).alias("kth"))
        df = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        self.weights = B.stored(df.join(kth, "term").select("term", "df", w.alias("w"), "highest", "kth"), "weights")

    def scored(self, pairs: DataFrame, weights: DataFrame) -> DataFrame:
        """(item, row, id, score) of pairs (item, row); weights: (item, by_term) with each item's weights by term."""
        v = lambda x: value(x["counts"], F.col("n"), self.n_docs, self.n_terms)
        total = F.aggregate(F.arrays_zip("terms", "counts"), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(F.col("by_term")[x["terms"]], F.lit(0).cast("long")) * v(x))
        return pairs.join(self.docs, "row").join(weights, "item").select("item", "row", "id", total.alias("score"))


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents (doc_id, text) of each item (item_id, text), at most `best`, with scores above 0."""
    if best < 1:
        raise ValueError("best must be at least 1")
    asked = terms_of(items, "item_id")
    index = Index(docs, filter_of(asked), best)
    each = asked.select(F.col("row").alias("item"), F.explode("terms").alias("term")).join(index.weights, "term")
    each = B.stored(each.select("item", "term", "w", (F.col("w") * F.col("highest")).alias("most"), (F.col("w") * F.col("kth")).alias("kth")), "item-terms")
    weights = B.stored(each.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("by_term")), "item-weights")

    # lower bounds of the kth score
    seeds = each.join(index.top.select("term", "row"), "term").select("item", "row").distinct()
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))
    reached = index.scored(seeds, weights).withColumn("place", place).filter(F.col("place") == best).select("item", F.col("score").alias("reached"))
    bound = each.groupBy("item").agg(F.max("kth").alias("kth")).join(reached, "item", "left").select("item", F.greatest(F.lit(1).cast("long"), "kth", "reached").alias("bound"))
    bound = B.stored(bound, "bounds")

    # what the terms from each one on can add
    rest = F.sum("most").over(W.partitionBy("item").orderBy(F.desc("most"), "term").rowsBetween(0, W.unboundedFollowing))
    ordered = B.stored(each.withColumn("rest", rest).join(bound, "item"), "ordered-terms")
    goes = F.col("rest") < CUT * F.col("bound")
    asking = ordered.filter(~goes).select("item", "term", "w")
    cut = ordered.groupBy("item").agg(F.first("bound").alias("bound"), F.coalesce(F.sum(F.when(goes, F.col("most"))), F.lit(0)).alias("cut"))

    found = index.postings.join(asking, "term").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("v")).alias("part"))
    candidates = B.stored(found.join(cut, "item").filter(F.col("part") + F.col("cut") >= F.col("bound")).select("item", "row"), "candidates")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row"))
    ranked = index.scored(candidates, weights).withColumnRenamed("id", "doc_id").filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= best)
    return ranked.join(asked.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: Every document against every item.
OP11_SQL = """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) x, whole),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
           FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST("rank" AS INTEGER) AS "rank", doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS "rank" FROM scores WHERE score > 0) x WHERE "rank" <= 10
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
