"""An audit of projects: measures from stored results and tables, and checks over them by a table of rules.

Every measure is one aggregate, so a project's audit is a row however many files it has;
every check is an expression over that row.  What a project has no data for is null, and
a check that needs it is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is read of each kind of result, of its JSON.
RESULTS = {
    "ingestion": "total_files long",
    "parsing": "total_functions long, total_classes long, parse_success_rate double, frameworks_detected array<string>, total_endpoints long",
    "analysis": "apis array<struct<path string, method string, file string>>",
    "agentic_analysis": "api_analysis struct<endpoints array<struct<path string, method string, file string>>>",
    "transformation_results": "total_files_processed long, successful_transformations long, failed_transformations long",
    "selected_stack": "names array<string>",
    "mappings": "items array<struct<status string, file_count long>>",
    "test_scripts": "scripts array<struct<content string>>",
}
# Words that decide, names of unfinished work, endings of backups, and technologies that are current or dated.
DECISIONS = r"(?i)\b(if|elif|else|for|while|case|catch|except|and|or)\b|&&|\|\|"
UNFINISHED = r"(?i)\b(TODO|FIXME|PLACEHOLDER|HACK|XXX)\b"
BACKUPS = (".bak", ".old", ".backup", ".orig")
MODERN = (
    "react", "vue", "angular", "next.js", "nextjs", "nuxt", "svelte", "spring boot", "fastapi", "django", "flask", "express", "nestjs", "nest.js",
    "asp.net core", ".net core", ".net 6", ".net 7", ".net 8", "postgresql", "postgres", "mongodb", "redis", "mysql 8", "kafka", "rabbitmq", "kubernetes", "docker",
    "java 17", "java 21", "python 3", "node 18", "node 20", "typescript", "kotlin", "go", "rust",
)
DATED = ("java ee", "ejb", "struts", "jsf", "jsp", "weblogic", "websphere", "jboss", "coldfusion", "perl", "php 5", "python 2", "angular.js", "angularjs", "backbone", "jquery ui", "ext js")
LARGE, GOD_CLASSES, STUB = 500, 5, 50


def _validated(kind: str, otherwise: str) -> tuple[tuple[str, str], ...]:
    """A ladder: what the validator of that kind said, else by its score, else something else."""
    v = f"validations['{kind}']"
    return (("pass", f"{v}.passed"), ("fail", f"not {v}.passed"), ("pass", f"{v}.score >= 70"), ("warn", f"{v}.score >= 40"), ("fail", f"{v}.score < 40"), (otherwise, "true"))


#: Checks by section: a label, and a ladder of states and the conditions under which they hold; the first that holds counts.
CHECKS: tuple[tuple[str, str, tuple[tuple[str, str], ...]], ...] = (
    ("1 code quality", "complexity", (("skip", "avg_complexity is null"), ("pass", "avg_complexity <= 5"), ("warn", "avg_complexity <= 10"), ("fail", "true"))),
    ("1 code quality", "linting", (("skip", "parsed_files = 0"), ("pass", "violations = 0"), ("warn", "violations <= 5"), ("fail", "true"))),
    ("1 code quality", "smells", (("warn", "god_files > 0 or large_files > 0"), ("pass", "true"))),
    ("1 code quality", "overall gate", (*_validated("code_quality", "skip")[:-1], ("warn", "god_files > 0 or large_files > 0"), ("pass", "true"))),
    ("2 architecture", "circular dependencies", (("pass", "validations['architecture_compliance'].evidence like '%No circular%'"), ("warn", "lower(validations['architecture_compliance'].evidence) like '%circular%'"), ("pass", "components > 0"), ("skip", "true"))),
    ("2 architecture", "layer isolation", (("skip", "layers < 2"), *_validated("architecture_compliance", "pass"))),
    ("2 architecture", "complex components", (("warn", "complex_components > 0"), ("pass", "components > 0"), ("skip", "true"))),
    ("2 architecture", "frameworks", (("skip", "frameworks = 0"), ("pass", "true"))),
    ("3 dependencies", "coupling", _validated("dependency_health", "skip")),
    ("3 dependencies", "end of life", (("skip", "targets = 0"), ("warn", "dated_targets > 0"), ("pass", "modern_targets > 0"), ("warn", "true"))),
    ("3 dependencies", "modern versions", (("skip", "targets = 0"), ("pass", "modern_targets > 0"), ("warn", "true"))),
    ("3 dependencies", "known vulnerabilities", (("skip", "true"),)),
    ("4 tests", "scripts", (("fail", "test_scripts = 0"), ("pass", "coalesce(validations['test_coverage_readiness'].passed, true)"), ("warn", "true"))),
    ("4 tests", "mockable endpoints", (("skip", "endpoints = 0"), ("pass", "true"))),
    ("4 tests", "validation suite", (("pass", "validations_passed >= 0.7 * validations_total and validations_total > 0"), ("warn", "true"))),
    ("4 tests", "empty stubs", (("skip", "test_scripts = 0"), ("warn", "empty_stubs > 0"), ("pass", "true"))),
    ("5 transformation", "completeness", (*_validated("transformation_completeness", "skip")[:-1], ("pass", "completed_mappings > 0"), ("skip", "true"))),
    ("5 transformation", "entry points", (("skip", "endpoints = 0"), ("pass", "true"))),
    ("5 transformation", "rules parity", (("skip", "rules_total = 0"), ("pass", "rules_mapped >= rules_total"), ("warn", "rules_mapped > 0"), ("fail", "true"))),
    ("5 transformation", "unfinished work", (("warn", "unfinished_files > 0"), ("skip", "parsed_files = 0"), ("pass", "true"))),
    ("6 files", "inventory", (("skip", "total_files = 0"), *_validated("file_coverage", "skip")[:-1], ("pass", "parsed_files >= total_files"), ("warn", "true"))),
    ("6 files", "orphaned logic", (("skip", "endpoint_files = 0"), ("pass", "true"))),
    ("6 files", "folders", (("skip", "layers = 0"), ("pass", "true"))),
    ("6 files", "backups", (("fail", "backup_files > 0"), ("pass", "true"))),
)


def file_measures(files: DataFrame) -> DataFrame:
    """One row for each project of files (project_id, path, content, loc, classes, functions, errors): sums, means and numbers of files."""
    lines = F.greatest(F.coalesce("loc", F.size(F.split("content", "\n")).cast("long")), F.lit(1).cast("long"))
    decisions = F.regexp_count("content", F.lit(DECISIONS))
    complexity = F.round(1 + decisions / lines * 100, 2)
    kept = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - decisions / lines * 50 - F.length("content") / lines / 10))
    has = F.coalesce("content", F.lit("")) != ""
    ends = F.lit(False)
    for e in BACKUPS:
        ends = ends | F.col("path").endswith(e)
    return files.groupBy("project_id").agg(
        F.count("*").alias("parsed_files"),
        F.round(F.avg(F.when(has, complexity)), 2).alias("avg_complexity"),
        F.max(F.when(has, complexity)).alias("max_complexity"),
        F.round(F.avg(F.when(has, F.round(kept, 2))), 2).alias("avg_maintainability"),
        F.sum("classes").alias("file_classes"),
        F.sum("functions").alias("file_functions"),
        F.sum("errors").alias("violations"),
        F.count_if(F.col("loc") > LARGE).alias("large_files"),
        F.count_if(F.col("classes") > GOD_CLASSES).alias("god_files"),
        F.count_if(has & F.col("content").rlike(UNFINISHED)).alias("unfinished_files"),
        F.count_if(ends).alias("backup_files"),
    )


def result_measures(results: DataFrame) -> DataFrame:
    """One row for each project of the latest results (project_id, result_type, data)."""
    data = lambda kind: F.from_json(F.max(F.when(F.col("result_type") == kind, F.col("data"))), RESULTS[kind])
    row = results.groupBy("project_id").agg(*[data(k).alias(k) for k in RESULTS])
    apis = F.when(F.size("analysis.apis") > 0, F.col("analysis.apis")).otherwise(F.col("agentic_analysis.api_analysis.endpoints"))
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    has = lambda words: lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(x), w))
    done = F.filter("mappings.items", lambda m: m["status"].isin("completed", "complete"))
    return row.select(
        "project_id",
        F.col("ingestion.total_files").alias("ingested"),
        F.col("parsing.total_functions").alias("result_functions"),
        F.col("parsing.total_classes").alias("result_classes"),
        "parsing.parse_success_rate",
        n("parsing.frameworks_detected").alias("frameworks"),
        n(apis).alias("endpoints"),
        n(F.array_distinct(F.filter(F.transform(apis, lambda a: a["file"]), lambda f: f != ""))).alias("endpoint_files"),
        F.coalesce("transformation_results.total_files_processed", F.lit(0)).alias("output_files"),
        F.coalesce("transformation_results.successful_transformations", F.lit(0)).alias("transformed_files"),
        n("selected_stack.names").alias("targets"),
        n(F.filter("selected_stack.names", has(MODERN))).alias("modern_targets"),
        n(F.filter("selected_stack.names", has(DATED))).alias("dated_targets"),
        n(done).alias("completed_mappings"),
        n(F.filter(done, lambda m: m["file_count"] > 1)).alias("consolidated_files"),
        n(F.filter("mappings.items", lambda m: m["status"].isin("retired", "deprecated", "skipped"))).alias("retired_files"),
        n("test_scripts.scripts").alias("test_scripts"),
        n(F.filter("test_scripts.scripts", lambda s: F.length(F.coalesce(s["content"], F.lit(""))) < STUB)).alias("empty_stubs"),
    )


def audit_measures(projects: DataFrame, results: DataFrame, files: DataFrame, components: DataFrame, validations: DataFrame) -> DataFrame:
    """A row of measures for each project (project_id): of its latest results, its files (see file_measures), its components
    (project_id, layer, name, complexity) and its validations (project_id, validation_type, score, passed, evidence)."""
    said = F.struct("score", "passed", "evidence")
    checked = validations.groupBy("project_id").agg(F.count("*").alias("validations_total"), F.count_if("passed").alias("validations_passed"), F.map_from_entries(F.collect_list(F.struct("validation_type", said))).alias("validations"))
    parts = components.groupBy("project_id").agg(F.count("*").alias("components"), F.countDistinct("layer").alias("layers"), F.count_if(F.col("complexity") == "high").alias("complex_components"))
    all_ = projects.select("project_id").distinct()
    for m in (result_measures(results), file_measures(files), parts, checked):
        all_ = all_.join(m, "project_id", "left")
    zero = ("parsed_files", "violations", "large_files", "god_files", "unfinished_files", "backup_files", "components", "layers", "complex_components", "validations_total", "validations_passed", "frameworks", "endpoints", "endpoint_files", "output_files", "transformed_files", "targets", "modern_targets", "dated_targets", "completed_mappings", "consolidated_files", "retired_files", "test_scripts", "empty_stubs")
    all_ = all_.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit(0)) for x in c], F.lit(0))
    total = first("result_functions", "file_functions") + first("result_classes", "file_classes")
    share = F.when((total > 0) & (F.col("output_files") > 0), F.round(total * F.col("transformed_files") / F.col("output_files")).cast("long")).otherwise(F.col("endpoints"))
    return all_.withColumns({
        "total_files": first("ingested"),
        "total_functions": first("result_functions", "file_functions"),
        "total_classes": first("result_classes", "file_classes"),
        "rules_total": total,
        "rules_mapped": share,
        "approval_rate": F.when(F.col("validations_total") > 0, F.round(F.col("validations_passed") / F.col("validations_total") * 100, 1)).otherwise(F.lit(0.0)),
        "migrated_files": F.when(F.col("transformed_files") > 0, F.col("transformed_files")).otherwise(F.col("parsed_files")),
    }).drop("ingested", "result_functions", "result_classes", "file_functions", "file_classes")


def state(ladder: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit("skip")
    for says, condition in reversed(ladder):
        out = F.when(F.expr(condition), F.lit(says)).otherwise(out)
    return out


def audit_checks(measures: DataFrame, checks=CHECKS) -> DataFrame:
    """(project_id, section, check, state) of all checks, from one row of measures a project."""
    rows = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(label).alias("check"), state(ladder).alias("state")) for section, label, ladder in checks])
    return measures.select("project_id", F.explode(rows).alias("x")).select("project_id", "x.*")


def audit_sections(checked: DataFrame) -> DataFrame:
    """(project_id, section, passed, warned, failed, skipped) of each section."""
    n = lambda s: F.count_if(F.col("state") == s)
    return checked.groupBy("project_id", "section").agg(n("pass").alias("passed"), n("warn").alias("warned"), n("fail").alias("failed"), n("skip").alias("skipped"))
