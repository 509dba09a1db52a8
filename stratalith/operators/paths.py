"""Longest simple paths: cycles are condensed, and what is left is worked off layer by layer from its ends.

A simple path never comes back to a strongly connected component that it has left.  So
the longest path from a node is a simple path inside its component, an edge out of
it, and the longest path from where that leads.  A component of one node has no inside;
in a larger one all simple paths are searched, cut by a bound, in one task: that is
exact, and in the worst case exponential in the nodes of this one component.  A node
keeps the inside of its path and the next node after it, never the whole path.

Of paths of one length the first in order of its nodes stands.  Edges may repeat; nulls
are left out; a start that no edge names is a path of one node.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graphs import _cut, cycle_nodes

STEPS = "node string, length long, inside array<string>, next string"


def inside_paths(start: str, links: dict[str, list[str]], out: dict[str, tuple[int, str]]) -> tuple[int, list[str], str | None]:
    """(length, inside, next) of the longest path from a node of a component; out: for a node, the longest way on outside it (nodes, first node)."""
    most_out = max((n for n, _ in out.values()), default=0)
    best: tuple[int, list[str], str | None] = (0, [], None)

    def better(length: int, inside: list[str], after: str | None) -> bool:
        return length > best[0] or length == best[0] and [*inside, after or ""] < [*best[1], best[2] or ""]

    def reachable(node: str, seen: set[str]) -> int:
        found, todo = {node}, [node]
        while todo:
            for b in links.get(todo.pop(), ()):
                if b not in seen and b not in found:
                    found.add(b)
                    todo.append(b)
        return len(found) - 1

    stack: list[tuple[list[str], frozenset[str]]] = [([start], frozenset([start]))]
    while stack:
        path, seen = stack.pop()
        n, after = out.get(path[-1], (0, None))
        if better(len(path) + n, path, after):
            best = (len(path) + n, path, after)
        if len(path) + reachable(path[-1], set(seen)) + most_out < best[0]:
            continue  # can't become longer
        stack += [([*path, b], seen | {b}) for b in links.get(path[-1], ()) if b not in seen]
    return best


def _searched(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one component: (node, other, length, next); other: a node that it leads to inside, else null, and then the longest way on outside."""
    links: dict[str, list[str]] = {}
    out: dict[str, tuple[int, str]] = {}
    for node, other, length, after in rows[["node", "other", "length", "next"]].itertuples(index=False):
        links.setdefault(node, [])
        if isinstance(other, str):
            links[node].append(other)
        elif isinstance(after, str):
            out[node] = (int(length), after)
    found = [(node, *inside_paths(node, links, out)) for node in links]
    return pd.DataFrame([(a, n, inside, after) for a, n, inside, after in found], columns=["node", "length", "inside", "next"])


def steps(edges: DataFrame) -> DataFrame:
    """STEPS of all nodes that edges (src, dst) name: the longest simple path's length in nodes, its part inside the node's component, and where it goes on."""
    edges = _cut(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).filter("src is not null and dst is not null and src <> dst").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    named = _cut(nodes.join(cycle_nodes(edges), "node", "left").select("node", F.coalesce("cycle", "node").alias("part")))
    of = lambda k: named.select(F.col("node").alias(k), F.col("part").alias(f"{k}_part"))
    both = _cut(edges.join(of("src"), "src").join(of("dst"), "dst"))
    inner, outer = both.filter("src_part = dst_part"), both.filter("src_part <> dst_part")
    large = inner.select(F.col("src_part").alias("part")).distinct()
    done, left = None, named.select("part").distinct()
    ways = outer  # ways out of components that aren't worked off
    while True:
        # a layer: components all of whose ways lead to what is done
        open_ = ways if done is None else ways.join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
        ready = _cut(left.join(open_.select(F.col("src_part").alias("part")).distinct(), "part", "left_anti"))
        if ready.isEmpty():
            return done if done is not None else edges.sparkSession.createDataFrame([], STEPS)
        layer = named.join(ready, "part")
        if done is None:
            after = layer.withColumn("length", F.lit(0).cast("long")).withColumn("next", F.lit(None).cast("string"))
        else:
            here = outer.join(ready.select(F.col("part").alias("src_part")), "src_part").join(done.select(F.col("node").alias("dst"), "length"), "dst")
            first = W.partitionBy("src").orderBy(F.desc("length"), "dst")
            here = here.withColumn("n", F.row_number().over(first)).filter("n = 1").select(F.col("src").alias("node"), "length", F.col("dst").alias("next"))
            after = layer.join(here, "node", "left").select("node", "part", F.coalesce("length", F.lit(0).cast("long")).alias("length"), "next")
        after = _cut(after)
        single = after.join(large, "part", "left_anti").select("node", (F.col("length") + 1).alias("length"), F.array("node").alias("inside"), "next")
        wide = after.join(large, "part", "left_semi")
        within = inner.join(ready.select(F.col("part").alias("src_part")), "src_part").select(F.col("src_part").alias("part"), F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("next"))
        rows = within.unionByName(wide.withColumn("other", F.lit(None).cast("string")).select(*within.columns))
        new = single.unionByName(rows.groupBy("part").applyInPandas(_searched, STEPS))
        done = _cut(new if done is None else done.unionByName(new))
        left = _cut(left.join(ready, "part", "left_anti"))
        ways = _cut(ways.join(ready.select(F.col("part").alias("src_part")), "src_part", "left_anti"))


def longest_from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, length, path) of the longest simple path from each start (node); length in nodes."""
    known = steps(edges)
    begun = starts.select(F.col("node").cast("string").alias("start")).distinct()
    now = begun.join(known, begun.start == known.node, "left").select("start", F.coalesce("inside", F.array("start")).alias("path"), "next")
    while True:
        now = _cut(now)
        if now.filter("next is not null").isEmpty():
            return now.select("start", F.size("path").cast("long").alias("length"), "path")
        on = known.select(F.col("node").alias("next"), F.col("inside"), F.col("next").alias("then"))
        now = now.join(on, "next", "left").select("start", F.concat("path", F.coalesce("inside", F.array().cast("array<string>"))).alias("path"), F.col("then").alias("next"))


def entry_points(nodes: DataFrame, edges: DataFrame, most: int | None = 5) -> DataFrame:
    """(graph, node): the first `most` nodes (graph, place, node) of each graph that nothing leads to."""
    free = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    place = F.row_number().over(W.partitionBy("graph").orderBy("place", "node"))
    return free.withColumn("n", place).filter(F.lit(True) if most is None else F.col("n") <= most).select("graph", "node")


#: What a node of each type adds to a path's impact, besides 1.
IMPACT = {"file": 1.0, "class": 2.0, "function": 0.5}


def critical_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, least: int = 3) -> DataFrame:
    """(start, length, path, impact) of the longest paths from the starts that have `least` nodes; nodes: (node, type)."""
    found = longest_from(edges, starts).filter(F.col("length") >= least)
    each = found.select("start", F.explode("path").alias("node")).join(nodes.select("node", "type").distinct(), "node", "left")
    adds = F.lit(0.0)
    for kind, v in IMPACT.items():
        adds = F.when(F.col("type") == kind, F.lit(v)).otherwise(adds)
    sums = each.groupBy("start").agg(F.sum(adds).alias("adds"))
    return found.join(sums, "start").select("start", "length", "path", (F.col("length") + F.col("adds")).alias("impact"))
