"""Matches in texts, names and lists: column expressions and DataFrame operators that stay in the JVM.

Null texts have no matches; equal rows are kept as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, CLOSE = "\x01", "\x02"  # mark a match; in texts they count as spaces


def pascal_case(name: str | Column) -> Column:
    """snake_case as PascalCase; the tail of each part is lower-cased."""
    return F.array_join(F.transform(F.split(name, "_"), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(s.substr(F.lit(2), F.length(s))))), "")


def camel_case(name: str | Column) -> Column:
    p = pascal_case(name)
    return F.concat(F.lower(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))


def label(technology: str | Column, category: str | Column, names: dict[tuple[str, str], str]) -> Column:
    """The label of a technology in a category, else the technology in title case."""
    out = F.initcap(F.regexp_replace(technology, "[_-]", " "))
    for (t, c), v in names.items():
        out = F.when((F.lower(technology) == t) & (F.lower(category) == c), F.lit(v)).otherwise(out)
    return out


def matches(files: DataFrame, text: str, pattern: str, around: int = 100) -> DataFrame:
    """files' other columns with match, line (1-based) and context: `around` characters on both sides, trimmed.

    One row for each match of the regular expression.  A text is cut before its matches,
    and rows carry their own piece alone: where they stand comes from sums over the
    pieces before, and a context from the ends of at most `around` pieces on each side.
    So time and memory grow with the text, not with its matches times its length.
    """
    kept = [F.col(f"`{c}`") for c in files.columns if c != text]
    clean = F.translate(F.col(text), OPEN + CLOSE, "  ")
    marked = F.split(F.regexp_replace(clean, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN)
    numbered = files.withColumn("_row", F.monotonically_increasing_id())  # before the pieces are rows
    rows = numbered.select(*kept, "_row", F.posexplode(marked).alias("_k", "_part"))
    piece = F.replace("_part", F.lit(CLOSE), F.lit(""))
    order = W.partitionBy("_row").orderBy("_k")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    tail = F.when(F.length("_piece") > around, F.right("_piece", F.lit(around))).otherwise(F.col("_piece"))
    head = F.substring("_piece", 1, around)
    rows = rows.withColumn("_piece", piece).withColumn("match", F.when(F.col("_k") > 0, F.substring_index("_part", CLOSE, 1)))
    newlines = F.length("_piece") - F.length(F.replace("_piece", F.lit("\n"), F.lit("")))
    size = F.length("match") + around
    rows = rows.select(
        *kept, "_k", "match", size.alias("_size"), F.substring(F.col("_piece"), F.lit(1), size).alias("_own"), (F.coalesce(F.sum(newlines).over(before), F.lit(0)) + 1).cast("long").alias("line"),
        F.array_join(F.collect_list(tail).over(order.rowsBetween(-around, -1)), "").alias("_left"), F.array_join(F.collect_list(head).over(order.rowsBetween(1, around)), "").alias("_right"),
    ).filter("_k > 0")
    left = F.right("_left", F.lit(around))
    # what follows the match goes on in the next pieces only where its own piece has ended
    context = F.concat(left, F.substring(F.concat("_own", F.when(F.length("_own") < F.col("_size"), F.col("_right")).otherwise("")), F.lit(1), F.col("_size")))
    return rows.select(*kept, "match", "line", F.trim(context).alias("context"))


def manifests(files: DataFrame, names: Iterable[str], path: str = "path") -> DataFrame:
    """Rows whose file name is one of the dependency manifests."""
    return files.filter(F.element_at(F.split(path, r"[/\\]"), -1).isin(*names))


def having_extension(files: DataFrame, extensions: Iterable[str], path: str = "path") -> DataFrame:
    """Rows whose path ends with one of the extensions, in any case."""
    return files.filter(F.lower(F.concat(F.lit("."), F.regexp_extract(path, r"\.([^./\\]+)$", 1))).isin(*extensions))


def where_given(rows: DataFrame, column: str, value) -> DataFrame:
    """Rows with that value, or all rows if the value is None."""
    return rows if value is None else rows.filter(F.col(column) == F.lit(value))


def following_definition(lines: DataFrame, key: str, number: str, line: str, is_start: Column, is_definition: Column) -> DataFrame:
    """Lines that start something, with the next line of the same file that defines something (null if none): columns of lines, next_line, next_text."""
    w = W.partitionBy(key).orderBy(number).rowsBetween(1, W.unboundedFollowing)
    found = F.first(F.when(is_definition, F.struct(F.col(number).alias("n"), F.col(line).alias("t"))), ignorenulls=True).over(w)
    return lines.withColumn("_next", found).filter(is_start).withColumn("next_line", F.col("_next.n")).withColumn("next_text", F.col("_next.t")).drop("_next")


def uncovered_lines(lines: DataFrame, chunks: DataFrame, key: str, number: str) -> DataFrame:
    """Lines that lie in no chunk [start_line, end_line] of the same file.

    A file's chunks travel as one array, so the join is on the key alone and no
    pairs of lines and chunks are made.
    """
    spans = chunks.groupBy(key).agg(F.collect_list(F.struct("start_line", "end_line")).alias("_spans"))
    inside = F.exists("_spans", lambda s: (F.col(number) >= s["start_line"]) & (F.col(number) <= s["end_line"]))
    return lines.join(spans, key, "left").filter(~F.coalesce(inside, F.lit(False))).drop("_spans")


def mentioning(tables: DataFrame, name: str, queries: DataFrame, text: str) -> DataFrame:
    """(table, query) pairs where the query joins and names the table as a word.

    Queries are cut into words, so the join is an equi-join on names, not a nested loop.
    """
    words = queries.filter(F.upper(text).contains("JOIN")).select("*", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), 1))).alias("_word"))
    return tables.withColumn("_word", F.lower(name)).join(words, "_word").drop("_word")


def list_difference(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Adds preserved, missing and added: what two array columns share, and what only the first or only the second has; sorted."""
    return rows.withColumn("preserved", F.array_sort(F.array_intersect(one, other))).withColumn("missing", F.array_sort(F.array_except(one, other))).withColumn("added", F.array_sort(F.array_except(other, one)))


def sections(texts: DataFrame, key: str, text: str, heading: str, bullet: str = r"^\s*[-*]\s+(.*)$") -> DataFrame:
    """(key, section, items): the bullets under each heading (a regular expression whose first group is its name), in order of lines."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    name = F.regexp_extract("line", heading, 1)
    named = lines.withColumn("section", F.last(F.when(name != "", name), ignorenulls=True).over(W.partitionBy(key).orderBy("n")))
    item = F.regexp_extract("line", bullet, 1)
    hits = named.filter(F.col("section").isNotNull() & (item != "")).withColumn("item", item)
    return hits.groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda s: s["item"]).alias("items"))


def first_by_priority(frames: list[DataFrame], key: str) -> DataFrame:
    """Of frames with equal columns, for each key the rows of the first frame that has any."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("_rank", F.lit(k))
        out = f if out is None else out.unionByName(f)
    return out.withColumn("_least", F.min("_rank").over(W.partitionBy(key))).filter("_rank = _least").drop("_rank", "_least")


#: What makes a chunk complex, and factors by kind of chunk.
COMPLEXITY = (r"if\s+", r"for\s+", r"while\s+", r"try\s*\{", r"catch\s*\(", r"switch\s*\(", r"case\s+", r"else\s+", r"elif\s+")
FACTORS = {"function": 1.0, "class": 1.2, "generic": 0.8, "remaining": 0.5}


def chunk_complexity(text: str, kind: str) -> Column:
    """One, and a tenth for each match, times the kind's factor; ten at most."""
    n = sum((F.regexp_count(F.col(text), F.lit(f"(?i){p}")) for p in COMPLEXITY), F.lit(0))
    factor = F.lit(1.0)
    for k, v in FACTORS.items():
        factor = F.when(F.col(kind) == k, F.lit(v)).otherwise(factor)
    return F.least(F.lit(10.0), (F.lit(1.0) + n * F.lit(0.1)) * factor)


def system_complexity(files: Column, components: Column, apis: Column, tables: Column, integration: Column) -> Column:
    """0 to 100, cut to a whole number."""
    part = lambda c, each, most: F.least(c * F.lit(each), F.lit(float(most)))
    return (part(files, 0.5, 25) + part(components, 0.8, 25) + part(apis, 2.0, 20) + part(tables, 1.5, 15) + F.when(integration, 15.0).otherwise(0.0)).cast("int")
