"""Queries over whole corpora of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators import graphs
from ..operators.chunking import overlapping, windows
from ..operators.vectors import top_k
from ..sources.tables import table
from .registry import query


@query(
    """
    WITH f AS (SELECT lang AS language,
                      len(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x) <> '')) AS loc
               FROM documents)
    SELECT language, CAST(count(*) AS BIGINT) AS files, CAST(sum(loc) AS BIGINT) AS loc,
           round(100.0 * sum(loc) / (SELECT sum(loc) FROM f), 1) AS pct
    FROM f GROUP BY language
    """
)
def lang_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines by language and each language's share of all."""
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), X.loc_nonblank("text").alias("loc"))
    per = files.groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    share = F.round(F.lit(100.0) * F.col("loc") / F.sum("loc").over(W.partitionBy()), 1)
    return per.withColumn("pct", share).orderBy(F.desc("loc"), "language")


@query(
    """
    SELECT vec_id, score, place FROM (SELECT e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
      CAST(row_number() OVER (ORDER BY round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS INTEGER) AS place
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) x WHERE place <= 10
    """
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of one query vector."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return top_k(q, e, 10).select("vec_id", "score", "place")


@query(
    """
    SELECT query_id, vec_id, score, place FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
      CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS INTEGER) AS place
      FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q) x WHERE place <= 5
    """
)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query; the queries are the vectors whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return top_k(q, e, 5)


@query(
    """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    w AS (SELECT doc_id, lines, unnest(range(0, len(lines), 50)) AS s FROM l)
    SELECT doc_id, CAST(s // 50 AS BIGINT) AS chunk, CAST(s + 1 AS BIGINT) AS start_line, CAST(least(s + 50, len(lines)) AS BIGINT) AS end_line, sha256(array_to_string(lines[s + 1:s + 50], chr(10))) AS digest
    FROM w WHERE trim(translate(array_to_string(lines[s + 1:s + 50], chr(10)), chr(10) || chr(9) || chr(13), '   ')) <> ''
    """
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 lines of every document."""
    return windows(table(spark, sf_dir, "documents"), "doc_id", "text", 50).select("doc_id", "chunk", "start_line", "end_line", F.sha2("body", 256).alias("digest"))


@query()
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 2000 characters that overlap by four lines."""
    return overlapping(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk", F.length("body").cast("long").alias("size"))


@query(
    """
    WITH e AS (SELECT DISTINCT n_nationkey AS src, n_regionkey * 5 AS dst FROM nation)
    SELECT node, min(other) AS component FROM (
      WITH RECURSIVE both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, other) AS (SELECT src, src FROM both_ways UNION SELECT r.node, b.dst FROM r JOIN both_ways b ON r.other = b.src)
      SELECT node, other FROM r) x GROUP BY node
    """
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of a graph of nations."""
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") * 5).alias("dst"))
    return graphs.components(e)


@query(
    """
    WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation),
    r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
    SELECT a.src AS node, min(a.dst) AS "cycle" FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src
    """
)
def graph_cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on directed cycles."""
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("dst"))
    return graphs.cycle_nodes(e)


@query(
    """
    WITH RECURSIVE r(start, path, cur, n) AS (SELECT n_nationkey, [n_nationkey], n_nationkey, 0 FROM nation WHERE n_nationkey < 5
      UNION ALL SELECT start, list_append(path, (cur * 2 + 1) % 25), (cur * 2 + 1) % 25, n + 1 FROM r WHERE n < 6 AND NOT list_contains(path, (cur * 2 + 1) % 25))
    SELECT start, CAST(n AS BIGINT) AS length, array_to_string(path, '>') AS path
    FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, array_to_string(path, '>') DESC) AS k FROM r) x WHERE k = 1
    """
)
def graph_longest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest simple paths from five entry points."""
    n = table(spark, sf_dir, "nation")
    e = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst"))
    return graphs.longest_paths(e, n.filter("n_nationkey < 5").select(F.col("n_nationkey").alias("node")), 6)
