"""Summaries of a corpus, what its files call and share, and the driver of validators.

Null texts hold nothing; ties go by name.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(rows: DataFrame, value: Column | str, place: Column | str, between: str, most: int | None = None) -> Column:
    """An aggregate: values in order of place, joined; the first `most` of them."""
    value, place = (F.col(c) if isinstance(c, str) else c for c in (value, place))
    each = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), value.alias("v")))), lambda s: s["v"])
    return F.array_join(F.slice(each, 1, most) if most else each, between)


def project_summary(files: DataFrame, language: str = "language", loc: str = "loc") -> DataFrame:
    """One row: files, lines, and a text that names the languages by number of files."""
    per = files.groupBy(language).agg(F.count("*").alias("n"), F.sum(loc).alias("loc"))
    name = F.concat(F.coalesce(F.col(language), F.lit("other")), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    place = F.struct((-F.col("n")).alias("a"), F.col(language).alias("b"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), ordered(per, name, place, ", ").alias("languages"))
    text = F.concat(F.lit("Files: "), F.col("files").cast("string"), F.lit("; lines: "), F.col("loc").cast("string"), F.lit("; languages: "), "languages")
    return out.select("files", "loc", text.alias("summary"))


RAG_CHARACTERS = 600


def prompt_context(stack: dict[str, str], components: Column, apis: Column, tables: Column, related: Column) -> Column:
    """The context lines of a prompt: target stack, counts, and the beginning of related text if there is any."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(0)).cast("string"))
    parts = [F.lit("CONTEXT INFORMATION:"), F.lit(f"Target stack: {json.dumps(stack)}"), line("Components", components), line("API endpoints", apis), line("Database tables", tables)]
    parts.append(F.when(F.coalesce(related, F.lit("")) != "", F.concat(F.lit("Related context:\n"), F.substring(related, 1, RAG_CHARACTERS))))
    return F.concat_ws("\n", *parts)


def documentation(files: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: a text with files, at most 40 classes and 60 functions by name, from (path), (path, name) and (path, name)."""
    names = lambda df, most, alias: df.select("name").distinct().agg(ordered(df, "name", "name", ", ", most).alias(alias))
    one = files.agg(F.count("*").alias("n")).crossJoin(names(classes, 40, "c")).crossJoin(names(functions, 60, "f"))  # a row each
    return one.select(F.concat(F.lit("# Codebase\n\nFiles: "), F.col("n").cast("string"), F.lit("\n\nClasses: "), "c", F.lit("\n\nFunctions: "), "f").alias("documentation"))


CALL = r"\b([A-Za-z_]\w*)\s*\("


def call_edges(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst, name, calls): files (path, content) that call a function (path, name, ordinal) of another file.

    Of functions with equal names the first counts (ordinal, then path); calls are
    counted per file before the join, so it is one row for each file and name.
    """
    first = functions.groupBy("name").agg(F.min(F.struct("ordinal", "path"))["path"].alias("dst"))
    calls = files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(CALL), F.lit(1))).alias("name")).groupBy("src", "name").agg(F.count("*").alias("calls"))
    return calls.join(first, "name").filter("src <> dst").select("src", "dst", "name", "calls")


def inheritance_edges(classes: DataFrame) -> DataFrame:
    """(src, dst, name): files of classes (path, name, parent, ordinal) and of the first class that bears the parent's name."""
    first = classes.groupBy(F.col("name").alias("parent")).agg(F.min(F.struct("ordinal", "path"))["path"].alias("dst"))
    return classes.filter("parent is not null").join(first, "parent").select(F.col("path").alias("src"), "dst", F.col("parent").alias("name"))


def file_dependencies(imports: DataFrame) -> DataFrame:
    """(path, n_out, n_in, level, mutual): one row for each file in edges (src, dst): imports both ways, coupling level by imports alone, files that import each other."""
    edges = imports.select("src", "dst").filter("src <> dst").distinct()
    ends = edges.select(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("dst").alias("other")).union(edges.select("dst", F.lit(0), F.lit(1), "src"))
    pair = ends.groupBy("path", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    out = pair.groupBy("path").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count(F.when((F.col("o") > 0) & (F.col("i") > 0), 1)).alias("mutual"))
    # fixed values: a tenth for each import; below 0.3 is low, below 0.6 medium
    return out.withColumn("level", F.when(F.col("n_out") < 3, "Low").when(F.col("n_out") < 6, "Medium").otherwise("High"))


# What stands for a language if no technology was sure: extensions, plain name, name if the mark is found, where it is looked for.
FALLBACKS = (((".js", ".jsx", ".ts", ".tsx"), "JavaScript", "React", "extension"), ((".py",), "Python", "FastAPI", "fastapi"), ((".java",), "Java", "Spring Boot", "spring"), ((".cs",), "C#", "C#", ""))


def stack_fallback(files: DataFrame, detected: DataFrame) -> DataFrame:
    """(technology): those detected, or by extension if there are none, from files (path, content)."""
    ext = F.lower(F.concat(F.lit("."), F.regexp_extract("path", r"\.([^./\\]+)$", 1)))
    low = F.lower(F.coalesce("content", F.lit("")))
    sums = []
    for k, (exts, _, _, mark) in enumerate(FALLBACKS):
        sums.append(F.max(ext.isin(*exts)).alias(f"has{k}"))
        sums.append((F.max(ext.isin(".jsx", ".tsx")) if mark == "extension" else F.max(low.contains(mark))).alias(f"mark{k}"))
    one = files.agg(*sums)
    names = F.array(*[F.when(F.col(f"has{k}"), F.when(F.col(f"mark{k}"), better).otherwise(plain)) for k, (_, plain, better, _) in enumerate(FALLBACKS)])
    guessed = one.select(F.explode(F.array_compact(names)).alias("technology"))
    any_ = detected.limit(1).select(F.lit(1).alias("any"))
    return detected.select("technology").unionByName(guessed.join(any_, F.lit(True), "left_anti"))


def grouped_entities(entities: DataFrame, domains: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """entities (name) with the first domain that has a keyword in the name, else general."""
    domain = F.lit("general")
    for name, words in reversed(domains):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower("name").contains(w)
        domain = F.when(hit, F.lit(name)).otherwise(domain)
    return entities.withColumn("domain", domain)


def with_override(static: DataFrame, override: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """static's rows, where an override of the same key has a value that isn't null or empty, with that."""
    given = override.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    value = lambda c: F.coalesce(F.when(F.col(f"_{c}").cast("string") != "", F.col(f"_{c}")), F.col(c)).alias(c)
    rest = [c for c in static.columns if c not in columns]
    return static.join(given, key, "left").select(*rest, *[value(c) for c in columns])


VALIDATION = "rule_type string, status string, score double, threshold double, passed boolean, message string, recommendations array<string>"
SECURITY = "security_check"
Validator = Callable[[dict[str, DataFrame]], tuple[float, list[str]]]


class Validators:
    """Validators by rule type: each takes the analysis's DataFrames and gives a score and recommendations."""

    def __init__(self):
        self.known: dict[str, Validator] = {}

    def register(self, rule_type: str, f: Validator) -> None:
        self.known[rule_type] = f

    def run(self, spark, frames: dict[str, DataFrame], criteria: list[tuple[str, float]]) -> tuple[DataFrame, str]:
        """A row (VALIDATION) for each criterion (rule type, threshold), and the overall status.

        A validator that fails gives a row that asks for review, and the others go on.
        """
        rows = []
        for rule, threshold in criteria:
            try:
                score, advice = self.known[rule](frames)
                passed = score >= threshold
                rows.append((rule, "approved" if passed else "rejected", float(score), threshold, passed, f"score {score:.2f} of {threshold:.2f}", advice))
            except Exception as e:
                rows.append((rule, "requires_review", 0.0, threshold, False, f"Validation error: {e}", ["Manual review required due to validation error"]))
        return spark.createDataFrame(rows, VALIDATION), overall([(r[0], r[2], r[4]) for r in rows])


def overall(rows: list[tuple[str, float, bool]]) -> str:
    """The status that (rule type, score, passed) rows give: security that scored nothing asks for review, else the share that passed decides."""
    safe = [r for r in rows if r[0] == SECURITY]
    if safe and all(score == 0 and not passed for _, score, passed in safe):
        return "requires_review"
    share = sum(r[2] for r in rows) / len(rows) if rows else 1.0
    return "approved" if share >= 0.7 else "requires_review" if share >= 0.4 else "rejected"


def recommendations_of(validations: DataFrame) -> DataFrame:
    """(recommendation), each once, in order of first mention."""
    each = validations.withColumn("_k", F.monotonically_increasing_id()).select("_k", F.posexplode("recommendations").alias("_i", "recommendation"))
    return each.groupBy("recommendation").agg(F.min(F.struct("_k", "_i")).alias("_at")).orderBy("_at").select("recommendation")
