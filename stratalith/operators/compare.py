"""Comparisons of an original and a transformed system: one row of each measure, by joins on names.

Names are compared as they are; null names are left out, and repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def names_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col(name).alias("name")).filter("name is not null").distinct()


def name_sets(one: DataFrame, other: DataFrame, name: str = "name") -> DataFrame:
    """(name, side): preserved, removed or added; one full outer join."""
    a, b = names_of(one, name).withColumn("a", F.lit(True)), names_of(other, name).withColumn("b", F.lit(True))
    side = F.when(F.col("a") & F.col("b"), "preserved").when(F.col("a"), "removed").otherwise("added")
    return a.join(b, "name", "full").select("name", side.alias("side"))


def schema_comparison(one: DataFrame, other: DataFrame, name: str = "name") -> DataFrame:
    """One row: schema_count_change, preserved_schemas, new_schemas, modernization_applied."""
    sides = name_sets(one, other, name).agg(*[F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("preserved", "removed", "added")])
    original, transformed = F.col("preserved") + F.col("removed"), F.col("preserved") + F.col("added")
    return sides.select((transformed - original).alias("schema_count_change"), F.col("preserved").alias("preserved_schemas"), F.col("added").alias("new_schemas"), ((original > 0) & (transformed > 0)).alias("modernization_applied"))


def endpoint_comparison(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: original and transformed numbers of endpoints, whether none was lost, and the score (100 at most)."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    both = n(one, "original_endpoints").crossJoin(n(other, "transformed_endpoints"))  # a row each
    score = F.least(F.lit(100.0), F.col("transformed_endpoints") / F.greatest("original_endpoints", F.lit(1)) * 100)
    return both.withColumn("endpoint_preservation", F.col("transformed_endpoints") >= F.col("original_endpoints")).withColumn("modernization_score", F.round(score, 4))


#: The share of targets that must be found.
ENOUGH = 0.7


def migration_success(targets: DataFrame, frameworks: DataFrame) -> DataFrame:
    """One row of targets (kind, technology) and frameworks (name) found: the kinds met, their share in per cent, and whether that is enough.

    Both sides are rule tables: a target is met if some framework's name holds it, in any case.
    """
    found = frameworks.select(F.lower("name").alias("framework")).distinct()
    met = targets.join(found, F.contains("framework", F.lower("technology")), "left_semi").select("kind").withColumn("hit", F.lit(1))
    each = targets.select("kind").distinct().join(met.distinct(), "kind", "left")
    out = each.agg(F.count("*").alias("n"), F.count("hit").alias("k"), F.array_sort(F.collect_list(F.when(F.col("hit") == 1, F.col("kind")))).alias("success_indicators"))
    share = F.col("k") / F.greatest("n", F.lit(1))
    return out.select("success_indicators", F.round(share * 100, 4).alias("migration_completeness"), (F.col("k") >= F.col("n") * ENOUGH).alias("overall_success"))


def structural_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row from name_sets of nodes and of edges: shares preserved, and .6 of the nodes' with .4 of the edges'; what was empty counts as kept."""
    def kept(sides: DataFrame, c: str) -> DataFrame:
        n, k = F.count(F.when(F.col("side") != "added", 1)), F.count(F.when(F.col("side") == "preserved", 1))
        return sides.agg(F.when(n == 0, 1.0).otherwise(k / n).alias(c))

    both = kept(nodes, "node_preservation").crossJoin(kept(edges, "edge_preservation"))  # a row each
    return both.withColumn("structural_score", F.round(0.6 * F.col("node_preservation") + 0.4 * F.col("edge_preservation"), 4))
