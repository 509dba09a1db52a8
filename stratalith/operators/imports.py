"""Imports resolved to files, and the typed graph of files, classes and functions.

An import names whole segments of a path: a.b.C is found in a file .../a/b/C.ext, or in
the first file below a folder .../a/b/C.  A path's runs of as many segments as imports of its
project ask for are the index, however many those are, one
row for each run and project, with its first file's place in the project; so resolving is an equi-join
with at most one partner, whatever a run's number of files, and the index is made of numbers by hashes.  A relative import counts from the
importing file's folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graphs import _cut


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def segments(run: Column) -> Column:
    return F.size(F.split(run, "/"))


def runs_of(paths: DataFrame) -> DataFrame:
    """paths with (run): all runs of `segments` segments of each path, without the file's extension, a row each; those from the path's start also with a slash before."""
    parts = paths.withColumn("parts", F.split(F.concat(F.lit("/"), stem(F.col("path"))), "/"))
    # the first part is empty, and alone it is no run
    first = F.when(F.col("segments") == 1, 2).otherwise(1)
    starts = F.sequence(first, F.size("parts") - F.col("segments") + 1)
    each = parts.filter(F.size("parts") - F.col("segments") + 1 >= first).withColumn("start", F.explode(starts))
    return each.withColumn("run", F.array_join(F.slice("parts", F.col("start"), F.col("segments")), "/")).drop("parts", "start")


def placed(files: DataFrame) -> DataFrame:
    """(project, path, place): files that have a file_no, by it and by path numbered from 1 in their project."""
    order = W.partitionBy("project").orderBy("file_no", "path")
    return files.filter("file_no is not null").select("project", "path", F.row_number().over(order).alias("place"))


def index_of(places: DataFrame, asked: DataFrame) -> DataFrame:
    """(project, run, place): the first file whose path holds a run of segments; runs as long as one that is asked for in the project."""
    lengths = asked.select("project", segments(F.col("run")).alias("segments")).distinct()
    each = runs_of(places.join(lengths, "project"))
    return each.groupBy("project", "run").agg(F.min("place").alias("place"))


def without_dots(path: Column) -> Column:
    """a/b/../c as a/c; .. beyond the start goes."""
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((s == ".") | (s == ""), acc).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def wanted(path: Column, name: Column) -> Column:
    """The run of segments that an import in a file asks for."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    relative = F.concat(F.lit("/"), without_dots(F.concat(folder, F.lit("/"), name)))
    dotted = F.replace(F.regexp_replace(name, r"\.\*$", ""), F.lit("."), F.lit("/"))
    return F.when(name.rlike(r"^\.\.?/"), stem(relative)).when(name.contains("/"), name).otherwise(dotted)


def resolved(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, src, dst, import): imports (project, path, name) with the file that each names; a file doesn't import itself."""
    asked = _cut(imports.select("project", F.col("path").alias("src"), F.col("name").alias("import"), wanted(F.col("path"), F.col("name")).alias("run")).distinct())
    places = placed(files)
    found = asked.join(index_of(places, asked), ["project", "run"]).join(places.withColumnRenamed("path", "dst"), ["project", "place"])
    return found.filter("src <> dst").select("project", "src", "dst", "import")


def parents_of(head: Column, language: Column) -> Column:
    """Names of what a class in this head inherits from."""
    python = F.split(F.regexp_extract(head, r"\bclass \w+\(([^)]*)\)", 1), ",")
    sharp = F.split(F.regexp_extract(head, r"\bclass \w+ ?: ?([\w<>., ]+)", 1), ",")
    other = F.array(F.regexp_extract(head, r"\bclass \w+(?:<[^>]*>)? extends ([\w.]+)", 1))
    names = F.when(language == "Python", python).when(language == "C#", sharp).otherwise(other)
    return F.filter(F.transform(names, F.trim), lambda n: n.rlike(r"^[\w.]+(<.*>)?$"))


def typed_graph(files: DataFrame, units: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, type, path, project) and edges (project, src, dst, kind, weight) of files, their classes and functions.

    Kinds: contains 1.0, import 0.5, inheritance 2.0.  A parent class is a node of its own, without a file.
    """
    own = files.select("project", "path")
    defined = symbols.filter(F.col("kind").isin("class", "function", "method")).join(own, "path")
    kind = F.when(F.col("kind") == "class", F.lit("class")).otherwise(F.lit("function"))
    parts = defined.select("project", "path", "unit", kind.alias("type"), "name").withColumn("id", F.concat_ws(":", "type", "path", "name"))
    inherits = parts.filter("type = 'class'").join(units.select("path", "unit", F.explode(parents_of(F.col("head"), F.col("language"))).alias("parent")), ["path", "unit"])
    parent = F.concat(F.lit("class:"), F.col("project").cast("string"), F.lit(":"), F.col("parent"))
    names = symbols.filter(F.col("kind").isin("import", "require")).join(own, "path").select("project", "path", "name")

    edge = lambda rows, src, dst, kind, weight: rows.select("project", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    edges = edge(parts, F.col("path"), F.col("id"), "contains", 1.0)
    edges = edges.unionByName(edge(inherits, F.col("id"), parent, "inheritance", 2.0))
    edges = edges.unionByName(edge(resolved(files, names), F.col("src"), F.col("dst"), "import", 0.5)).distinct()
    nodes = own.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("file").alias("type"), "path", "project")
    nodes = nodes.unionByName(parts.select("id", "name", "type", "path", "project")).unionByName(inherits.select(parent.alias("id"), F.col("parent").alias("name"), F.lit("class").alias("type"), F.lit("").alias("path"), "project"))
    return nodes.distinct(), edges
