"""Queries that apply the DataFrame operators to files and tables; their SQL is written apart from them, mostly by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, confidence, embedding, matches, splitting, summaries, validators
from ..operators.ddl import ddl_objects
from ..operators.python_code import python_symbols
from ..sources import store
from ..sources.tables import table
from .code_corpus import CODE
from .registry import query
from .sql_plan import _OTHER, in_dialect, run_sql

_CODE = in_dialect(CODE, _OTHER)


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic files: file_id, path, content."""
    return run_sql(spark, sf_dir, f"WITH {CODE} SELECT file_id, path, content FROM code")


@query(
    f"""WITH {_CODE}, p AS (SELECT path, content, unnest(range(1, length(content) + 1)) AS i FROM code)
    SELECT path, CAST(length(substr(content, 1, i - 1)) - length(replace(substr(content, 1, i - 1), chr(10), '')) + 1 AS BIGINT) AS line,
      trim(substr(content, greatest(1, i - 100), i + 106 - greatest(1, i - 100))) AS context FROM p WHERE substr(content, i, 6) = 'import'"""
)
def match_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files say import: the line, and a hundred characters on both sides."""
    return matches.matches(code(spark, sf_dir), "content", "import").select("path", "line", "context")


@query(
    """SELECT p_partkey, array_to_string(list_transform(w, lambda s: upper(s[1]) || lower(s[2:])), '') AS pascal,
      lower(w[1]) || array_to_string(list_transform(w[2:], lambda s: upper(s[1]) || lower(s[2:])), '') AS camel
    FROM (SELECT p_partkey, string_split(concat(p_type, '_', lower(p_brand)), '_') AS w FROM part)"""
)
def name_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in PascalCase and camelCase."""
    name = F.concat_ws("_", "p_type", F.lower("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", matches.pascal_case(name).alias("pascal"), matches.camel_case(name).alias("camel"))


# Names of dependency manifests.
MANIFESTS = ("pom.xml", "build.gradle", "build.gradle.kts", "package.json", "requirements.txt", "setup.py", "pyproject.toml", "Cargo.toml", "go.mod", "application.properties", "application.yml", "persistence.xml", "web.xml")
_TREE = "SELECT p_partkey, concat('svc', p_partkey, '/', CASE p_partkey % 5 WHEN 0 THEN 'pom.xml' WHEN 1 THEN 'src/main.GO' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'go.mod.txt' ELSE 'app/web.xml' END) AS path, p_name AS content FROM part"


@query("SELECT path, content FROM (SELECT concat('svc', p_partkey, '/', CASE p_partkey % 5 WHEN 0 THEN 'pom.xml' WHEN 2 THEN 'go.mod' ELSE 'app/web.xml' END) AS path, p_name AS content FROM part WHERE p_partkey % 5 IN (0, 2, 4)) x")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency manifests among files."""
    return matches.manifests(run_sql(spark, sf_dir, _TREE), MANIFESTS).select("path", "content")


@query("SELECT concat('svc', p_partkey, '/src/main.GO') AS path FROM part WHERE p_partkey % 5 = 1")
def files_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files by extension, in any case; no folder is asked for."""
    return matches.where_given(matches.having_extension(run_sql(spark, sf_dir, _TREE), (".go", ".java")), "content", None).select("path")


@query(
    f"""WITH {_CODE}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS n FROM code)
    SELECT a.path, CAST(a.n AS INTEGER) AS n, CAST(min(b.n) AS INTEGER) AS next_line, trim(arg_min(b.line, b.n)) AS next_text
    FROM l a LEFT JOIN l b ON a.path = b.path AND b.n > a.n AND regexp_matches(b.line, '^ *(public|def) ') WHERE starts_with(ltrim(a.line), '@') GROUP BY a.path, a.n"""
)
def following_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated lines and the next line that defines something."""
    lines = code(spark, sf_dir).select("path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    got = matches.following_definition(lines, "path", "n", "line", F.ltrim("line").startswith("@"), F.regexp("line", F.lit("^ *(public|def) ")))
    return got.select("path", "n", "next_line", F.trim("next_text").alias("next_text"))


@query("SELECT doc_id, CAST(len(list_filter(range(len(string_split(text, chr(10)))), lambda k: k % 10 >= 7)) AS BIGINT) AS uncovered FROM documents WHERE len(string_split(text, chr(10))) > 7")
def uncovered_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents outside chunks that hold the first seven of every ten."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    chunks = lines.filter("n % 10 = 0").select("doc_id", F.col("n").alias("start_line"), (F.col("n") + 6).alias("end_line"))
    return matches.uncovered_lines(lines.select("doc_id", "n"), chunks, "doc_id", "n").groupBy("doc_id").agg(F.count("*").alias("uncovered"))


_QUERIES = "SELECT event_id, concat('select x from a', CASE WHEN event_id % 2 = 0 THEN ' Join ' ELSE ', ' END, upper(event_type), '_log l, ', event_type, ' on 1 = 1') AS q FROM events"


@query("SELECT event_type AS name, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY event_type UNION ALL SELECT 'a', count(*) FROM events WHERE event_id % 2 = 0")
def join_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many joining queries name each table as a word."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().union(spark.createDataFrame([("a",)], "name string"))
    return matches.mentioning(names, "name", run_sql(spark, sf_dir, _QUERIES), "q").groupBy("name").agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3),
    j AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS k, coalesce(a.l_suppkey, b.l_suppkey) AS s, a.l_suppkey AS x, b.l_suppkey AS y FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey)
    SELECT k AS l_orderkey, coalesce(string_agg(s::VARCHAR, ',' ORDER BY s) FILTER (x IS NOT NULL AND y IS NOT NULL), '') AS preserved,
      coalesce(string_agg(s::VARCHAR, ',' ORDER BY s) FILTER (y IS NULL), '') AS missing, coalesce(string_agg(s::VARCHAR, ',' ORDER BY s) FILTER (x IS NULL), '') AS added FROM j GROUP BY k"""
)
def name_list_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two lists of each order share, and what only one has."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(n <= 3, s)).alias("a"), F.collect_set(F.when(n >= 3, s)).alias("b"))
    got = matches.list_difference(lists, "a", "b")
    return got.select("l_orderkey", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("preserved", "missing", "added")])


@query("SELECT n_nationkey AS id, 'Rules' AS section, concat('keep ', n_name, '|second') AS items FROM nation UNION ALL SELECT n_nationkey, 'Verdict', 'good' FROM nation WHERE n_nationkey % 2 = 0")
def reply_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets under the headings of replies."""
    text = F.concat(F.lit("intro\n- not in a section\n## Rules\n- keep "), "n_name", F.lit("\nprose\n  * second\n## Verdict\n"), F.when(F.col("n_nationkey") % 2 == 0, "- good").otherwise("none"))
    replies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), text.alias("text"))
    return matches.sections(replies, "id", "text", r"^##\s+(\w+)").select("id", "section", F.array_join("items", "|").alias("items"))


@query(
    """SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders o WHERE o_orderstatus = 'P'
      OR (o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P'))
      OR (o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus IN ('P', 'F'))) GROUP BY 1, 2"""
)
def fallback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key the rows of the first source that has any."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    got = matches.first_by_priority([o.filter(F.col("o_orderstatus") == s) for s in "PFO"], "o_custkey")
    return got.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))


_COUNTS = " + ".join(f"len(regexp_extract_all(content, '(?i){p}'))" for p in (r"if\s+", r"for\s+", r"while\s+", r"try\s*\{", r"catch\s*\(", r"switch\s*\(", r"case\s+", r"else\s+", r"elif\s+"))


@query(
    f"""WITH {_CODE} SELECT path, round(least(10, (1 + 0.1 * ({_COUNTS})) * CASE WHEN path LIKE '%.py' THEN 1.0 WHEN path LIKE '%.java' THEN 1.2 WHEN path LIKE '%.md' THEN 0.5 ELSE 0.8 END)::DOUBLE, 6) AS score FROM code"""
)
def chunk_complexities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of files taken as chunks."""
    p = F.col("path")
    kind = F.when(p.endswith(".py"), "function").when(p.endswith(".java"), "class").when(p.endswith(".md"), "remaining").otherwise("generic")
    return code(spark, sf_dir).withColumn("kind", kind).select("path", F.round(matches.chunk_complexity("content", "kind"), 6).alias("score"))


@query(
    """SELECT n_nationkey, CAST(floor(least(25, 0.5 * c) + least(25, 0.8 * s) + least(20, 2 * (n_nationkey % 13)) + least(15, 1.5 * (n_nationkey % 12)) + (n_nationkey % 2) * 15) AS INTEGER) AS complexity
    FROM (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation) x"""
)
def system_complexities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of systems by their counts."""
    count = lambda t, k, name: table(spark, sf_dir, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias(name))
    rows = table(spark, sf_dir, "nation").select("n_nationkey").join(count("customer", "c_nationkey", "c"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "s"), "n_nationkey", "left").fillna(0)
    k = F.col("n_nationkey")
    return rows.select("n_nationkey", matches.system_complexity(F.col("c"), F.col("s"), k % 13, k % 12, k % 2 == 1).alias("complexity"))


# Rows of an analysis each: counts and flags by arithmetic on a key, so that every branch is met.
_ANALYSES = """SELECT c_custkey AS id, c_custkey % 2 = 0 AS has_complexity, c_custkey % 3 = 0 AS has_patterns, c_custkey % 5 > 1 AS has_security, c_custkey % 7 > 2 AS has_dependencies,
  c_custkey % 11 > 4 AS has_metrics, c_custkey % 13 > 6 AS has_quality_score, c_custkey % 4 = 1 AS has_insights, c_custkey % 6 AS n_errors, c_custkey % 60 AS cyclomatic, c_custkey % 8 AS n_patterns,
  (c_custkey % 10) / 10.0 AS pattern_confidence, c_custkey % 5 AS n_pattern_types, c_custkey % 6 AS n_layers, c_custkey % 40 AS layer_files, c_custkey % 30 AS largest_layer, c_custkey % 14 AS n_components,
  c_custkey % 5 AS n_cycles, c_custkey % 12 AS n_coupled, c_custkey % 4 AS n_high_coupling, c_custkey % 3 > 0 AS has_imports, c_custkey % 4 > 0 AS has_cycles, c_custkey % 5 > 0 AS has_coupling,
  c_custkey % 4 AS n_vulnerabilities, (c_custkey % 7) / 7.0 AS vulnerability_confidence, c_custkey % 5 AS n_security_patterns, c_custkey % 2 = 1 AS has_vulnerabilities, c_custkey % 3 = 1 AS has_security_patterns,
  c_custkey % 5 = 1 AS has_risk, c_custkey % 7 = 1 AS has_overall_risk, c_custkey % 11 = 1 AS has_risk_factors, c_custkey % 15 AS n_imports, c_custkey % 9 AS n_external, c_custkey % 8 AS n_recommendations,
  c_custkey % 3 AS n_actionable, c_custkey % 2 AS n_prioritised FROM customer"""


def _flags(*names: str) -> str:
    return "(" + " + ".join(f"CAST({n} AS INTEGER)" for n in names) + ")"


@query(
    f"""WITH a AS ({_ANALYSES}), b AS (SELECT *,
      0.3 * {_flags('has_complexity', 'has_patterns', 'has_security', 'has_dependencies')} / 4 + 0.3 * {_flags('has_metrics', 'has_quality_score', 'has_insights')} / 3 + 0.2 * greatest(0, 1 - 0.2 * n_errors)
      + 0.2 * (CASE WHEN has_complexity AND cyclomatic BETWEEN 1 AND 50 THEN 0.3 ELSE 0 END + CASE WHEN has_complexity AND n_patterns > 0 THEN 0.3 ELSE 0 END + CASE WHEN has_security THEN 0.4 ELSE 0 END) AS analysis,
      0.4 * least(1, n_patterns / 5) + CASE WHEN n_patterns > 0 THEN 0.4 * pattern_confidence ELSE 0 END + 0.2 * least(1, n_pattern_types / 3) AS patterns FROM a)
    SELECT id, round(analysis::DOUBLE, 6) AS analysis, round(patterns::DOUBLE, 6) AS patterns,
      round((0.3 * least(1, n_layers / 4) + 0.2 * least(1, n_components / 10) + CASE WHEN has_dependencies THEN 0.3 * (0.3 * {_flags('has_imports')} + 0.3 * {_flags('has_cycles')} + 0.4 * {_flags('has_coupling')}) ELSE 0 END
        + 0.2 * (CASE WHEN layer_files > 0 AND largest_layer / layer_files < 0.8 THEN 0.4 ELSE 0 END + CASE WHEN has_dependencies THEN CASE WHEN n_cycles = 0 THEN 0.3 WHEN n_cycles < 3 THEN 0.1 ELSE 0 END
          + CASE WHEN n_coupled > 0 AND n_high_coupling / n_coupled < 0.3 THEN 0.3 ELSE 0 END ELSE 0 END))::DOUBLE, 6) AS architecture,
      round((0.1 * {_flags('has_vulnerabilities', 'has_security_patterns', 'has_risk')} + 0.3 * CASE WHEN n_vulnerabilities > 0 THEN vulnerability_confidence ELSE 0.8 END + 0.2 * least(1, n_security_patterns / 3)
        + CASE WHEN has_risk THEN 0.1 * {_flags('has_overall_risk', 'has_risk_factors')} ELSE 0 END)::DOUBLE, 6) AS security,
      round((0.3 * least(1, n_imports / 10) + 0.2 * {_flags('has_cycles')} + 0.3 * least(1, n_coupled / 10) + 0.2 * least(1, n_external / 5))::DOUBLE, 6) AS dependencies,
      round((0.3 * least(1, n_recommendations / 5) + 0.15 * (analysis + patterns) + CASE WHEN n_recommendations > 0 THEN 0.2 * n_actionable / n_recommendations + 0.2 * n_prioritised / n_recommendations ELSE 0 END)::DOUBLE, 6) AS recommendations,
      round(least(0.95, least(0.5, n_components * 0.05) + least(0.45, n_imports * 0.03))::DOUBLE, 3) AS graph,
      round(least(1, CASE WHEN n_layers > 0 THEN n_cycles / n_layers ELSE 0.5 END + 0.2 * {_flags('has_metrics')} + 0.1 * {_flags('has_risk')} + 0.1 * {_flags('has_imports')})::DOUBLE, 6) AS tools FROM b"""
)
def category_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of analyses by category."""
    scores = {"analysis": confidence.analysis(), "patterns": confidence.patterns(), "architecture": confidence.architecture(), "security": confidence.security(), "dependencies": confidence.dependencies(), "recommendations": confidence.recommendations(), "tools": confidence.tools("n_cycles", "n_layers", "has_metrics", "has_risk", "has_imports")}
    return run_sql(spark, sf_dir, _ANALYSES).select("id", *[F.round(c, 6).alias(k) for k, c in scores.items()], confidence.graph("n_components", "n_imports").alias("graph"))


@query(
    """SELECT p_partkey AS id, 0 AS ordinal, concat('q', p_partkey) AS name, 'String' AS type, 'query' AS location FROM part UNION ALL SELECT p_partkey, 1, 'id', 'Long', 'path' FROM part
    UNION ALL SELECT p_partkey, 3, 'body', concat('Order', p_partkey), 'body' FROM part UNION ALL SELECT p_partkey, 4, 'token', 'String', 'header' FROM part"""
)
def parameters_by_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated parameters of methods; commas in brackets don't part them."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('@RequestParam(name = "q, r") String q'), k, F.lit(", @PathVariable Long id, int[a, b] plain, @RequestBody Order"), k, F.lit(" body, @RequestHeader(value = f(1, 2)) String token"))
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("parameters"))
    return splitting.annotated_parameters(methods, "id", "parameters")


@query("SELECT p_partkey AS id, 0 AS ordinal, 'id' AS name, 'int' AS type FROM part UNION ALL SELECT p_partkey, 1, concat('n', p_partkey), 'string' FROM part UNION ALL SELECT p_partkey, 2, 'tail', 'string' FROM part")
def parameters_of_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters in routes of three styles."""
    routes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/a/<int:id>/b/{n"), F.col("p_partkey").cast("string"), F.lit("}/:tail")).alias("route"))
    return splitting.route_parameters(routes, "id", "route").drop("location")


@query("SELECT n_nationkey AS id, 'User' AS model, 'name' AS name, 'str' AS type FROM nation UNION ALL SELECT n_nationkey, 'User', 'age', 'int' FROM nation UNION ALL SELECT n_nationkey, concat('Order', n_nationkey), 'total', 'BigDecimal' FROM nation")
def fields_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of model classes."""
    text = F.concat(F.lit("x: int = 1\nclass User(Base):\n    name: str\n    age: int = 3\n\n    def f(self): pass\npublic class Order"), F.col("n_nationkey").cast("string"), F.lit(" {\n  private BigDecimal total;\n}\n"))
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), text.alias("content"))
    return splitting.model_fields(files, "id", "content").drop("ordinal")




def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "name")
    return p.filter("p_size < 20 and p_partkey % 3 > 0"), p.filter("p_size > 30 and p_partkey % 3 < 2")


_SIDES = "a AS (SELECT DISTINCT p_brand FROM part WHERE p_size < 20 AND p_partkey % 3 > 0), b AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 30 AND p_partkey % 3 < 2)"


@query(
    f"""WITH {_SIDES} SELECT (SELECT count(*) FROM b) - (SELECT count(*) FROM a) AS schema_count_change, (SELECT count(*) FROM a WHERE p_brand IN (SELECT p_brand FROM b)) AS preserved_schemas,
    (SELECT count(*) FROM b WHERE p_brand NOT IN (SELECT p_brand FROM a)) AS new_schemas, true AS modernization_applied"""
)
def schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names kept, lost and new between two systems."""
    return compare.schema_comparison(*_sides(spark, sf_dir))


@query(
    """SELECT a AS original_endpoints, b AS transformed_endpoints, b >= a AS endpoint_preservation, round(least(100, 100.0 * b / greatest(a, 1)), 4) AS modernization_score
    FROM (SELECT count(*) FILTER (p_size < 20 AND p_partkey % 3 > 0) AS a, count(*) FILTER (p_size > 30 AND p_partkey % 3 < 2) AS b FROM part) x"""
)
def endpoint_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of endpoints before and after."""
    return compare.endpoint_comparison(*_sides(spark, sf_dir))


@query(
    """SELECT 'backend,database,messaging' AS success_indicators, 75.0::DOUBLE AS migration_completeness, true AS overall_success
    WHERE (SELECT count(*) FROM part WHERE lower(p_type) LIKE '%econ%') > 0 AND (SELECT count(*) FROM part WHERE lower(p_type) LIKE '%standard%') > 0"""
)
def migration_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which targets of a migration some framework's name holds."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"))
    targets = spark.createDataFrame([("backend", "ECON"), ("database", "Standard"), ("frontend", "no such"), ("messaging", "e")], "kind string, technology string")
    got = compare.migration_success(targets, p)
    return got.withColumn("success_indicators", F.array_join("success_indicators", ","))


@query(f"WITH {_SIDES} SELECT k AS node_preservation, k AS edge_preservation, round(k, 4) AS structural_score FROM (SELECT CAST((SELECT count(*) FROM a WHERE p_brand IN (SELECT p_brand FROM b)) AS DOUBLE) / (SELECT count(*) FROM a) AS k) x")
def structure_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of nodes and edges that a transformation kept; here both are the same names."""
    sides = compare.name_sets(*_sides(spark, sf_dir))
    return compare.structural_score(sides, sides)


@query(f"WITH {_CODE} SELECT path, CAST(length(content) AS BIGINT) AS size, CAST(1 AS BIGINT) AS first_line FROM code WHERE content <> ''")
def transform_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces for a transformer hold every character of a file once."""
    return splitting.transform_chunks(code(spark, sf_dir), 60).groupBy("path").agg(F.sum(F.length("body")).cast("long").alias("size"), F.min("start_line").cast("long").alias("first_line"))


@query()
def code_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut at imports and definitions."""
    return splitting.code_chunks(code(spark, sf_dir)).drop("body")


@query(f"WITH {_CODE} SELECT concat(path, ':0') AS chunk_id, CAST(384 AS INTEGER) AS dimensions, CAST(CASE WHEN trim(replace(content, chr(10), ' ')) <> '' THEN 1 ELSE 0 END AS DOUBLE) AS norm FROM code WHERE content <> ''")
def vector_store_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of files with their embeddings' lengths."""
    v = embedding.vector_store(code(spark, sf_dir), splitting.transform_chunks)
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return v.select("chunk_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(square), 4).alias("norm"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a field of JSON texts."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@query(
    """SELECT user_id, (SELECT event_type FROM events x WHERE x.user_id = e.user_id AND x.event_id % 3 = 0 ORDER BY event_id DESC LIMIT 1) AS status,
      (SELECT value FROM events x WHERE x.user_id = e.user_id AND x.event_id % 5 = 0 ORDER BY event_id DESC LIMIT 1) AS score FROM (SELECT DISTINCT user_id FROM events) e"""
)
def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key the last value of each field that an event gave."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("number"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("status"), F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("score"))
    return store.latest_fields(e, "user_id", ["status", "score"]).select("user_id", "status", "score")


@query("SELECT layer, name FROM (SELECT p_brand AS layer, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS k FROM part) x WHERE k <= 10")
def report_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's components: ten of each layer."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("layer"), F.col("p_name").alias("name"))
    none = spark.createDataFrame([], "path string, method string, name string, score int")
    return store.report_tables(none, none, none, p)["components"].select("layer", "name")


@query(f"WITH {_CODE} SELECT sha256(content) AS content_hash, path, CAST(len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS loc FROM code")
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a store keeps them: with hash and lines."""
    return store.hashed(code(spark, sf_dir)).select("path", "content_hash", "loc")


@query(
    """SELECT c_custkey AS review, c_name AS project, n, first_key FROM customer JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey"""
)
def reviews_with_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each review with its project's validations, nested and in order, by one join in place of a query each."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("review")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("validations"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("review"), F.col("c_name").alias("project"))
    return c.join(o, "review").select("review", "project", F.size("validations").cast("long").alias("n"), F.element_at("validations", 1)["o_orderkey"].alias("first_key"))


def ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl_objects(code(spark, sf_dir).filter(F.col("path").endswith(".sql")))


_TABLES = "(SELECT p_partkey AS k, concat('t', p_partkey) AS t, concat('t', (p_partkey * 8 + 8) % 400) AS owner FROM part WHERE p_partkey % 8 = 3)"


@query(
    f"""SELECT t AS table_name, 1 AS ordinal, 'id' AS name, 'BIGSERIAL' AS type, CAST(NULL AS INTEGER) AS length, CAST(NULL AS INTEGER) AS scale, false AS nullable, true AS primary_key, true AS auto_increment FROM {_TABLES} x
    UNION ALL SELECT t, 2, 'name', 'VARCHAR', 100, NULL, false, false, false FROM {_TABLES} x UNION ALL SELECT t, 3, 'price', 'DECIMAL', 10, 2, true, false, false FROM {_TABLES} x
    UNION ALL SELECT t, 4, 'owner_id', 'INT', NULL, NULL, true, false, false FROM {_TABLES} x"""
)
def ddl_column_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of tables with their types, by the token parser of definitions."""
    return ddl(spark, sf_dir).filter("kind = 'column'").select("table_name", "ordinal", "name", F.upper("type").alias("type"), "length", "scale", "nullable", "primary_key", "auto_increment")


@query(f"SELECT t AS table_name, 'owner_id' AS columns, owner AS ref_table, 'id' AS ref_columns FROM {_TABLES} x")
def ddl_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys, inline ones too."""
    keys = ddl(spark, sf_dir).filter("ref_table is not null")
    return keys.select("table_name", F.array_join(F.coalesce("columns", F.array("name")), ",").alias("columns"), "ref_table", F.array_join("ref_columns", ",").alias("ref_columns"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT unnest(['table', 'column', 'column', 'column', 'column', 'index']) AS kind FROM {_TABLES} x) y GROUP BY kind")
def ddl_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of definitions by kind."""
    return ddl(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT t AS table_name, CAST(4 AS BIGINT) AS columns FROM {_TABLES} x")
def ddl_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each table."""
    return ddl(spark, sf_dir).filter("kind = 'column'").groupBy("table_name").agg(F.count("*").alias("columns"))


@query(f"""WITH {_CODE} SELECT path, 'function' AS kind, concat('create_', p_partkey) AS name FROM code JOIN part ON p_partkey = file_id WHERE path LIKE '%.py'""")
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of Python files, by their syntax trees."""
    files = code(spark, sf_dir).filter(F.col("path").endswith(".py"))
    return python_symbols(files).filter("kind = 'function'").select("path", "kind", "name")


@query(
    f"""WITH {_CODE}, f AS (SELECT CASE WHEN path LIKE '%.java' THEN 'Java' WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.sql' THEN 'SQL' ELSE 'other' END AS language, len(string_split(content, chr(10))) AS loc FROM code),
    p AS (SELECT language, count(*) AS n, sum(loc) AS loc FROM f GROUP BY language)
    SELECT CAST(sum(n) AS BIGINT) AS files, CAST(sum(loc) AS BIGINT) AS loc, concat('Files: ', sum(n), '; lines: ', sum(loc), '; languages: ', string_agg(concat(language, ' (', n, ')'), ', ' ORDER BY n DESC, language)) AS summary FROM p"""
)
def project_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's summary in a sentence."""
    p = F.col("path")
    language = F.when(p.endswith(".java"), "Java").when(p.endswith(".py"), "Python").when(p.endswith(".sql"), "SQL").otherwise("other")
    return summaries.project_summary(code(spark, sf_dir).select(language.alias("language"), F.size(F.split("content", "\n")).cast("long").alias("loc")))


@query(
    """SELECT n_nationkey AS id, concat('CONTEXT INFORMATION:', chr(10), 'Target stack: {"backend": "x"}', chr(10), 'Components: ', n_nationkey, chr(10), 'API endpoints: ', n_regionkey, chr(10), 'Database tables: 0',
      CASE WHEN n_nationkey % 2 = 1 THEN concat(chr(10), 'Related context:', chr(10), substr(repeat(n_name, 100), 1, 600)) ELSE '' END) AS context FROM nation"""
)
def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context lines of prompts."""
    related = F.when(F.col("n_nationkey") % 2 == 1, F.repeat("n_name", 100))
    context = summaries.prompt_context({"backend": "x"}, F.col("n_nationkey"), F.col("n_regionkey"), F.lit(None).cast("long"), related)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), context.alias("context"))


_CALLS = "SELECT p_partkey AS k, concat('f', p_partkey, '.py') AS path, concat('def g', p_partkey, '(x):', chr(10), '  return g', p_partkey + 1, '(x) + g', p_partkey + 1, ' (1) + print(x)') AS content FROM part"


@query("SELECT concat('f', a.p_partkey, '.py') AS src, concat('f', b.p_partkey, '.py') AS dst, concat('g', b.p_partkey) AS name, CAST(2 AS BIGINT) AS calls FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files call functions of which."""
    files = run_sql(spark, sf_dir, _CALLS)
    functions = files.select("path", F.concat(F.lit("g"), F.col("k").cast("string")).alias("name"), F.lit(0).alias("ordinal"))
    return summaries.call_edges(files.select("path", "content"), functions)


@query("SELECT concat('f', a.p_partkey) AS src, concat('f', b.p_partkey) AS dst, concat('C', b.p_partkey) AS name FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 WHERE a.p_partkey > 1")
def inheritance_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files' classes inherit from classes of which."""
    k = F.col("p_partkey")
    name = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    classes = table(spark, sf_dir, "part").select(name("f", k).alias("path"), name("C", k).alias("name"), F.when(k > 1, name("C", F.floor(k / 2))).alias("parent"), F.lit(0).alias("ordinal"))
    return summaries.inheritance_edges(classes)


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 50 AS dst FROM lineitem WHERE l_linenumber = 1 AND l_suppkey <> l_partkey % 50), n AS (SELECT src AS p FROM e UNION SELECT dst FROM e)
    SELECT p AS path, (SELECT count(*) FROM e WHERE src = p) AS n_out, (SELECT count(*) FROM e WHERE dst = p) AS n_in, (SELECT count(*) FROM e x JOIN e y ON x.dst = y.src AND x.src = y.dst WHERE x.src = p) AS mutual,
      CASE WHEN (SELECT count(*) FROM e WHERE src = p) >= 6 THEN 'High' WHEN (SELECT count(*) FROM e WHERE src = p) >= 3 THEN 'Medium' ELSE 'Low' END AS level FROM n"""
)
def file_dependency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each file: imports both ways, coupling, files that import each other."""
    edges = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"))
    return summaries.file_dependencies(edges)


@query("SELECT unnest(['React', 'Python', 'Spring Boot']) AS technology")
def fallback_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies by extension where none was sure."""
    none = spark.createDataFrame([], "technology string")
    java = spark.createDataFrame([("A.JAVA", "import org.Springframework")], "path string, content string")
    return summaries.stack_fallback(code(spark, sf_dir).filter(~F.col("path").endswith(".java")).select("path", "content").unionByName(java), none)


@query("SELECT p_name AS name, CASE WHEN lower(p_name) LIKE '%a%' THEN 'first' WHEN lower(p_name) LIKE '%e%' OR lower(p_name) LIKE '%o%' THEN 'second' ELSE 'general' END AS domain FROM part")
def entity_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each entity."""
    return summaries.grouped_entities(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), [("first", ("a",)), ("second", ("e", "o"))])


@query("SELECT n_nationkey, n_regionkey, CASE n_nationkey % 3 WHEN 0 THEN concat('new ', n_name) ELSE n_name END AS n_name FROM nation")
def overridden_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static results, where an override says more."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    k = F.col("n_nationkey") % 3
    given = n.filter("n_nationkey % 4 > 0 or n_nationkey % 3 = 0").select("n_nationkey", F.when(k == 0, F.concat(F.lit("new "), "n_name")).when(k == 1, "").alias("n_name"))
    return summaries.with_override(n, given, "n_nationkey", ["n_name"])


# Rows of a project each, by arithmetic on a key, so that every branch is met; nulls are absent measures.
_PROJECTS = """SELECT p_partkey AS id, (p_partkey % 10) / CAST(10 AS DOUBLE) AS overall_confidence, p_partkey % 3 = 0 AS low_graph, p_partkey % 3 AS n_weaknesses, p_partkey % 4 + 2 AS n_vulnerabilities, p_partkey % 5 % 3 AS n_high_risk,
  p_partkey % 2 AS n_security_patterns, CASE WHEN p_partkey % 7 > 1 THEN p_partkey % 4 END AS backend, p_partkey % 8 AS n_circular, p_partkey % 3 * 10 AS n_coupled_files, p_partkey % 3 * (p_partkey % 5) AS n_high_coupling,
  CASE WHEN p_partkey % 6 > 0 THEN (p_partkey % 11) / CAST(11 AS DOUBLE) END AS quality_score, CASE WHEN p_partkey % 9 > 2 THEN CAST(p_partkey % 30 AS DOUBLE) END AS average_complexity, p_partkey % 4 AS n_anti_patterns,
  p_partkey % 13 AS n_files, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 13 - p_partkey % 2 END AS n_parsed, p_partkey % 2 AS n_parsing_errors, CASE WHEN p_partkey % 17 = 1 THEN CAST(60 + p_partkey % 50 AS DOUBLE) END AS parse_success_rate,
  p_partkey % 12 AS n_processed, CASE WHEN p_partkey % 6 <> 2 THEN p_partkey % 12 - p_partkey % 3 END AS n_transformed, p_partkey % 3 AS n_failed, p_partkey % 2 AS n_test_scripts FROM part"""


@query(
    f"""WITH p AS ({_PROJECTS}), n AS (SELECT *,
      CASE WHEN backend = 0 THEN 1 ELSE 0 END + CASE WHEN n_circular >= 4 THEN 1 ELSE 0 END + CASE WHEN 10 * n_high_coupling > 3 * n_coupled_files THEN 1 ELSE 0 END AS arch,
      CASE WHEN quality_score < 0.5 THEN 1 ELSE 0 END + CASE WHEN average_complexity > 20 THEN 1 ELSE 0 END + CASE WHEN n_anti_patterns > 0 THEN 1 ELSE 0 END AS qual,
      CASE WHEN n_circular >= 6 THEN 1 ELSE 0 END + CASE WHEN 10 * n_high_coupling > 4 * n_coupled_files THEN 1 ELSE 0 END AS deps,
      CASE WHEN n_files = 0 THEN 0 WHEN parse_success_rate > 100 THEN 1 WHEN parse_success_rate IS NOT NULL THEN parse_success_rate / 100 WHEN n_parsed IS NULL THEN 1 ELSE n_parsed / n_files END AS cover,
      CASE WHEN n_processed = 0 THEN 0 WHEN n_transformed IS NULL THEN 1 ELSE n_transformed / n_processed END AS done FROM p),
    v AS (SELECT id, 'confidence_threshold' AS rule_type, overall_confidence AS score, 0.5 AS threshold, CASE WHEN low_graph THEN 1 ELSE 0 END + CASE WHEN n_weaknesses > 0 THEN 1 ELSE 0 END AS n_recommendations FROM n
      UNION ALL SELECT id, 'security_check', 1 - n_high_risk / n_vulnerabilities, 1, CASE WHEN n_high_risk > 0 THEN 1 ELSE 0 END + CASE WHEN n_security_patterns = 0 THEN 1 ELSE 0 END FROM n
      UNION ALL SELECT id, 'architecture_compliance', 1 - arch / 3, 0.5, arch FROM n UNION ALL SELECT id, 'quality_gate', 1 - qual / 3, 0.5, qual FROM n UNION ALL SELECT id, 'dependency_health', 1 - 0.4 * deps, 0.5, deps FROM n
      UNION ALL SELECT id, 'file_coverage', cover, 0.7, CASE WHEN n_files > 0 AND n_parsing_errors > 0 THEN 1 ELSE 0 END FROM n
      UNION ALL SELECT id, 'transformation_completeness', done, 0.7, CASE WHEN n_processed > 0 AND n_failed > 0 THEN 2 ELSE 0 END FROM n
      UNION ALL SELECT id, 'test_coverage_readiness', n_test_scripts, 0.5, 2 - 2 * n_test_scripts FROM n)
    SELECT id, rule_type, round(score::DOUBLE, 6) AS score, threshold::DOUBLE AS threshold, score >= threshold AS passed, CASE WHEN score >= threshold THEN 'approved' ELSE 'requires_review' END AS status, n_recommendations::INTEGER AS n_recommendations FROM v"""
)
def eight_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight validators' rows of every project."""
    p = run_sql(spark, sf_dir, _PROJECTS)
    layers = F.when(F.col("backend").isNotNull(), F.create_map(F.lit("backend"), F.col("backend")))
    got = validators.validations(p.withColumn("low_categories", F.when(F.col("low_graph"), F.array(F.lit("graph")))).withColumn("layer_files", layers), "id")
    return got.withColumn("score", F.round("score", 6)).withColumn("n_recommendations", F.size("recommendations")).drop("recommendations")
