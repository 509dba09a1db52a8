"""The audit of projects, from a store that holds their files and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, lexing, symbols
from ..operators.graphs import _cut
from ..sources.store import ProjectStore
from ..sources.tables import shared_dir
from .code_analysis import _WANT, ENDPOINTS, by_hand
from .project_corpus import PROJECT_SQL, project_files
from .registry import query


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Projects, results, files, components and validations; results go through a store, where newer ones replace stale ones."""
    files = project_files(spark, sf_dir).withColumn("project_id", F.concat(F.lit("p"), F.col("project").cast("string")))
    units = _cut(lexing.code_units(files))
    named = symbols.code_symbols(units).groupBy("path").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind").isin("function", "method")).alias("functions"))
    k = F.col("project") % 7
    rows = files.join(named, "path", "left").select(
        "project_id", "path", "content", F.when(F.col("path").endswith("OrderService.java"), F.lit(501)).otherwise(F.size(F.split("content", "\n"))).cast("long").alias("loc"),
        F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("functions", F.lit(0)).alias("functions"), F.when(F.col("path").endswith(".md"), k).otherwise(F.lit(0)).alias("errors"),
    )
    each = _cut(files.groupBy("project_id", "project").agg(F.count("*").alias("n")))  # read for each kind of result
    projects = each.select("project_id", "project")
    p = F.col("project")
    apis = symbols.endpoints(units).join(files.select("project_id", "path"), "path").groupBy("project_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("route").alias("path"), "method", F.col("path").alias("file"))).alias("apis"))).alias("data"))
    item = lambda status, n: F.struct(F.lit(status).alias("status"), F.lit(n).alias("file_count"))
    script = lambda n: F.struct(F.repeat(F.lit("x"), F.lit(n)).alias("content"))
    as_json = lambda kind, value, name: each.select("project_id", F.lit(kind).alias("result_type"), F.to_json(F.struct(value.alias(name))).alias("data"), "project")
    none = F.array().cast("array<string>")
    fresh = [
        as_json("ingestion", F.col("n") + p % 2, "total_files"),
        as_json("parsing", F.when(p % 3 == 0, none).otherwise(F.array(F.lit("Spring"))), "frameworks_detected"),
        as_json("selected_stack", F.when(p % 3 == 0, none).when(p % 3 == 1, F.array(F.lit("React 18"))).otherwise(F.array(F.lit("Struts 1"), F.lit("React"))), "names"),
        as_json("mappings", F.array(item("completed", 2), item("retired", 1)), "items").filter("project % 2 = 1"),
        as_json("test_scripts", F.when(p % 4 == 1, F.array(script(60))).otherwise(F.array(script(60), script(1))), "scripts").filter("project % 4 > 0"),
    ]
    done = each.select("project_id", F.lit("transformation_results").alias("result_type"), F.to_json(F.struct(F.lit(10).alias("total_files_processed"), (p % 11).alias("successful_transformations"))).alias("data"), "project")
    s = ProjectStore(spark, shared_dir(spark, "audit"))
    s.append("results", as_json("ingestion", F.lit(999), "total_files"))
    news = done
    for f in fresh:
        news = news.unionByName(f)
    s.append("results", news.drop("project").unionByName(apis.select("project_id", F.lit("analysis").alias("result_type"), "data")))
    components = files.select("project_id", F.get(F.split("path", "/"), F.lit(1)).alias("layer"), F.col("path").alias("name"), F.when(F.col("path").endswith(".java"), "high").otherwise("low").alias("complexity"))
    said = lambda kind, passed, score, evidence: projects.select("project_id", F.lit(kind).alias("validation_type"), passed.alias("passed"), score.cast("double").alias("score"), evidence.alias("evidence"), "project")
    checks = said("code_quality", p % 2 == 0, p % 100, F.lit(None).cast("string"))
    checks = checks.unionByName(said("architecture_compliance", F.lit(None).cast("boolean"), p * 13 % 100, F.when(p % 3 == 0, "No circular dependencies").when(p % 3 == 1, "Circular: a, b")))
    checks = checks.unionByName(said("transformation_completeness", p % 4 < 2, F.lit(50), F.lit("")).filter("project % 5 = 0"))
    return projects, s.results(), rows, components, checks.drop("project")


#: Measures by means of their own: lists of matches, hand-made symbols and endpoints.
_MEASURES = f"""{PROJECT_SQL}, {_WANT}, {by_hand("routes", "framework, method, route, name, line", ENDPOINTS)},
f AS (SELECT project, path, kind, content, CASE WHEN path LIKE '%OrderService.java' THEN 501 ELSE len(string_split(content, chr(10))) END AS loc,
  len(regexp_extract_all(content, '(?i)\\b(if|elif|else|for|while|case|catch|except|and|or)\\b|&&|\\|\\|')) AS d FROM project_files),
g AS (SELECT project, count(*) AS parsed_files, round(avg(round(1 + CAST(d AS DOUBLE) / loc * 100, 2)), 2) AS avg_complexity, max(round(1 + CAST(d AS DOUBLE) / loc * 100, 2)) AS max_complexity,
  round(avg(round(greatest(0, least(100, 100 - CAST(d AS DOUBLE) / loc * 50 - CAST(length(content) AS DOUBLE) / loc / 10)), 2)), 2) AS avg_maintainability,
  CAST(sum(CASE WHEN loc > 500 THEN 1 ELSE 0 END) AS BIGINT) AS large_files, CAST(sum(CASE WHEN path LIKE '%.md' THEN project % 7 ELSE 0 END) AS BIGINT) AS violations,
  count(DISTINCT split_part(path, '/', 2)) AS layers, count(*) FILTER (WHERE path LIKE '%.java') AS complex_components FROM f GROUP BY project),
s AS (SELECT project, count(*) FILTER (WHERE symbol = 'class') AS total_classes, count(*) FILTER (WHERE symbol IN ('function', 'method')) AS total_functions FROM project_files JOIN want USING (kind) GROUP BY project),
e AS (SELECT project, count(*) AS endpoints, count(DISTINCT path) AS endpoint_files FROM project_files JOIN routes USING (kind) GROUP BY project),
m AS (SELECT project, g.parsed_files, avg_complexity, max_complexity, avg_maintainability, large_files, violations, layers, complex_components, total_classes, total_functions, coalesce(endpoints, 0) AS endpoints, coalesce(endpoint_files, 0) AS endpoint_files,
  g.parsed_files + project % 2 AS total_files, CAST(round((total_classes + total_functions) * CAST(project % 11 AS DOUBLE) / 10) AS BIGINT) AS rules_mapped, total_classes + total_functions AS rules_total FROM g JOIN s USING (project) LEFT JOIN e USING (project))"""


@query(f"WITH {_MEASURES} SELECT 'p' || project AS project_id, parsed_files, avg_complexity, max_complexity, avg_maintainability, large_files, violations, layers, complex_components, total_classes, total_functions, endpoints, endpoint_files, total_files, rules_mapped FROM m")
def audit_measure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each project's audit."""
    names = "project_id, parsed_files, avg_complexity, max_complexity, avg_maintainability, large_files, violations, layers, complex_components, total_classes, total_functions, endpoints, endpoint_files, total_files, rules_mapped"
    return audit.audit_measures(*_inputs(spark, sf_dir)).select(*names.split(", "))


_FAIL_BY_SCORE = "CASE WHEN {0} >= 70 THEN 'pass' WHEN {0} >= 40 THEN 'warn' ELSE 'fail' END"
_STATES = {
    "complexity": "CASE WHEN avg_complexity > 10 THEN 'fail' WHEN avg_complexity > 5 THEN 'warn' ELSE 'pass' END",
    "linting": "CASE WHEN violations > 5 THEN 'fail' WHEN violations > 0 THEN 'warn' ELSE 'pass' END",
    "smells": "CASE WHEN large_files > 0 THEN 'warn' ELSE 'pass' END",
    "overall gate": "CASE WHEN project % 2 = 0 THEN 'pass' ELSE 'fail' END",
    "circular dependencies": "CASE WHEN project % 3 = 1 THEN 'warn' ELSE 'pass' END",
    "layer isolation": "CASE WHEN layers < 2 THEN 'skip' ELSE " + _FAIL_BY_SCORE.format("(project * 13 % 100)") + " END",
    "complex components": "CASE WHEN complex_components > 0 THEN 'warn' ELSE 'pass' END",
    "frameworks": "CASE WHEN project % 3 = 0 THEN 'skip' ELSE 'pass' END",
    "coupling": "'skip'",
    "end of life": "CASE project % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'pass' ELSE 'warn' END",
    "modern versions": "CASE WHEN project % 3 = 0 THEN 'skip' ELSE 'pass' END",
    "known vulnerabilities": "'skip'",
    "scripts": "CASE WHEN project % 4 = 0 THEN 'fail' ELSE 'pass' END",
    "mockable endpoints": "CASE WHEN endpoints = 0 THEN 'skip' ELSE 'pass' END",
    "validation suite": "'warn'",
    "empty stubs": "CASE project % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'pass' ELSE 'warn' END",
    "completeness": "CASE WHEN project % 5 = 0 THEN CASE WHEN project % 4 < 2 THEN 'pass' ELSE 'fail' END WHEN project % 2 = 1 THEN 'pass' ELSE 'skip' END",
    "entry points": "CASE WHEN endpoints = 0 THEN 'skip' ELSE 'pass' END",
    "rules parity": "CASE WHEN rules_total = 0 THEN 'skip' WHEN rules_mapped >= rules_total THEN 'pass' WHEN rules_mapped > 0 THEN 'warn' ELSE 'fail' END",
    "unfinished work": "'pass'",
    "inventory": "CASE WHEN project % 2 = 1 THEN 'warn' ELSE 'pass' END",
    "orphaned logic": "CASE WHEN endpoint_files = 0 THEN 'skip' ELSE 'pass' END",
    "folders": "CASE WHEN layers = 0 THEN 'skip' ELSE 'pass' END",
    "backups": "'pass'",
}


@query(f"WITH {_MEASURES} SELECT 'p' || project AS project_id, x.check_name, x.state FROM m, LATERAL (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v})' for k, v in _STATES.items())}) x(check_name, state)")
def audit_check_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 checks of each project."""
    checked = audit.audit_checks(audit.audit_measures(*_inputs(spark, sf_dir)))
    return checked.select("project_id", F.col("check").alias("check_name"), "state")
