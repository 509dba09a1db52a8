"""What a transformation has kept: names of source files looked for in their transformed counterparts, and routes.

A file's counterpart is the transformed file of its project with the same name but for
folder, extension and case; of several the last by path.  A file without one is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files that are looked at, verdicts by share, and what a project must reach.
CODE = (".java", ".py", ".js", ".ts", ".jsx", ".tsx", ".cs", ".go", ".rb", ".php", ".kt")
PRESERVED, PARTIAL, ENOUGH, ROUTES = 0.8, 0.5, 0.75, 0.9


def stem(path: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?<=.)\.[^.]*$", ""))


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_preservation(originals: DataFrame, transformed: DataFrame, names: DataFrame, new_names: DataFrame) -> DataFrame:
    """(project, path, counterpart, total, kept, missing, score, verdict) of each code file that isn't empty.

    originals and transformed: (project, path, content); names and new_names: (path, name) of their classes and functions.
    A file without names of its own has all of them if it has a counterpart."""
    code = originals.filter(extension("path").isin(*CODE) & (F.coalesce("content", F.lit("")) != "")).select("project", "path", stem("path").alias("stem"))
    last = transformed.groupBy("project", stem("path").alias("stem")).agg(F.max("path").alias("counterpart"))
    pairs = code.join(last, ["project", "stem"], "left").drop("stem")
    wanted = pairs.join(names.select("path", "name").distinct(), "path")
    found = new_names.select(F.col("path").alias("counterpart"), "name", F.lit(True).alias("there")).distinct()
    each = wanted.join(found, ["counterpart", "name"], "left").groupBy("path").agg(F.count("*").alias("total"), F.count("there").alias("kept"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("name")))).alias("missing"))
    rows = pairs.join(each, "path", "left").withColumns({"total": F.coalesce("total", F.lit(0)), "kept": F.coalesce("kept", F.lit(0)), "missing": F.coalesce("missing", F.array().cast("array<string>"))})
    score = F.when(F.col("counterpart").isNull(), 0.0).when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("kept") / F.col("total"), 3))
    verdict = F.when(F.col("score") >= PRESERVED, "preserved").when(F.col("score") >= PARTIAL, "partial").otherwise("lost")
    return rows.withColumn("score", score).withColumn("verdict", verdict).select("project", "path", "counterpart", "total", "kept", "missing", "score", "verdict")


def route_preservation(routes: DataFrame, new_routes: DataFrame) -> DataFrame:
    """(project, routes, routes_kept, route_share) of endpoints (project, method, route); a project without any has them all."""
    old, new = (x.select("project", "method", "route").distinct() for x in (routes, new_routes))
    both = old.join(new.withColumn("there", F.lit(True)), ["project", "method", "route"], "left")
    return both.groupBy("project").agg(F.count("*").alias("routes"), F.count("there").alias("routes_kept")).withColumn("route_share", F.round(F.col("routes_kept") / F.col("routes"), 3))


def preservation_report(files: DataFrame, routes: DataFrame) -> DataFrame:
    """(project, files_checked, files_passed, score, route_share, passed) from file_preservation and route_preservation rows."""
    sums = files.groupBy("project").agg(F.count("*").alias("files_checked"), F.count_if(F.col("verdict") == "preserved").alias("files_passed"), F.round(F.avg("score"), 3).alias("score"))
    share = F.coalesce("route_share", F.lit(1.0))
    return sums.join(routes, "project", "left").select("project", "files_checked", "files_passed", "score", share.alias("route_share"), ((F.col("score") >= ENOUGH) & (share >= ROUTES)).alias("passed"))
