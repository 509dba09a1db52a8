"""Graph measures by iterated joins; rounds are cut by tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def _cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back.

    A checkpoint would carry over what the optimizer derived of its columns, which
    grows by powers over the rounds, and would compute df twice.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sources(edges: DataFrame, seed: int) -> DataFrame:
    """(node, root): of the nodes that reach a node, itself included, the one of least priority; every node is an end of an edge.

    A root reaches its node, so a root's own root does too: each round follows an
    edge and then jumps there.  Priorities are hashes, whatever order the nodes were
    named in; so long paths and rings should take rounds near the logarithm of their length.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    now = _cut(nodes.withColumn("root", F.struct(F.xxhash64("node", F.lit(seed)).alias("p"), F.col("node").alias("n"))))
    while True:
        low = edges.join(now, edges.src == now.node).groupBy("dst").agg(F.min("root").alias("low"))
        step = now.join(low, now.node == low.dst, "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("low", "root")).alias("root"))
        far = step.select(F.col("node").alias("at"), F.col("root").alias("far"))
        new = _cut(step.join(far, F.col("root.n") == F.col("at")).select("node", "was", F.least("root", "far").alias("root")))
        now = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            return now.select("node", F.col("root.n").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (src, dst), taken both ways, reach; isolated nodes must come as loops."""
    both = _cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    found = _sources(both, 0)
    return found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes on a directed cycle, named by the smallest node of their strongly connected component.

    Nodes that share the root that reaches them and the root that they reach, with
    both the same, are a component; the rest goes on with the edges between nodes that
    share both.  State is a row a node, never one a pair.
    """
    left = _cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    loops = left.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle"))
    left, found, seed = left.filter("src <> dst"), None, 0
    while not left.isEmpty():
        # what nothing leads to, or what leads nowhere, lies on no cycle
        left = _cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        ahead = _sources(left, seed)
        inside = _within(left, ahead)
        back = _sources(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seed).withColumnRenamed("root", "other")
        marks = _cut(ahead.join(back, "node"))
        same = marks.filter("root = other")
        names = same.groupBy("root").agg(F.min("node").alias("cycle"), F.count("*").alias("n")).filter("n > 1")
        got = _cut(same.join(names, "root").select("node", "cycle"))
        found = got if found is None else found.union(got)
        left = _cut(_within(inside, marks.filter("root <> other").select("node", F.struct("root", "other").alias("root"))))
        seed += 1
    if found is None:
        return loops
    return found.union(loops.join(found, "node", "left_anti"))


def _within(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges whose ends have the same root."""
    a, b = roots.select(F.col("node").alias("src"), F.col("root").alias("a")), roots.select(F.col("node").alias("dst"), F.col("root").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a = b").select("src", "dst")


def longest_paths(edges: DataFrame, starts: DataFrame, most: int = 8) -> DataFrame:
    """(start, length, path): the longest simple path of at most `most` edges from each start (node); ties by the path's text."""
    paths = starts.select(F.col("node").alias("start"), F.array("node").alias("path"))
    out = paths
    for _ in range(most):
        paths = _cut(paths.join(edges, F.element_at("path", -1) == edges.src).filter(~F.array_contains("path", F.col("dst"))).select("start", F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
        out = out.union(paths)
    key = F.struct(F.size("path").alias("n"), F.array_join("path", ">").alias("t"))
    return out.groupBy("start").agg(F.max(key).alias("best")).select("start", (F.col("best.n") - 1).cast("long").alias("length"), F.col("best.t").alias("path"))
