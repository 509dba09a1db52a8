"""A synthetic corpus of source files, (file_id, path, content), made of the rows of part, and queries that analyse it."""

from __future__ import annotations

from .sql_plan import sql_query

_N = "chr(10)"


def _lines(*lines: str) -> str:
    """SQL that joins lines; $1 is the file's number and $2, $3 are numbers of others."""
    out = []
    for line in lines:
        parts = line.split("$")
        out.append("'" + parts[0].replace("'", "''") + "'")
        for p in parts[1:]:
            out.append({"1": "p_partkey", "2": "(p_partkey * 8 + 8) % 400", "3": "(p_partkey + 9) % 400"}[p[0]])
            out.append("'" + p[1:].replace("'", "''") + "'")
        out.append(_N)
    return "concat(" + ", ".join(out) + ")"


_JAVA = _lines("package com.shop.controller;", "import java.util.List;", "import com.shop.controller.Order$2Controller;", "@RestController", "public class Order$1Controller extends BaseController {", '  @GetMapping("/orders/$1/items")', "  public List list() {", "    if (x > 1 && y) { return repo.findAll(); }", '    String password = "secret$1";', "    validate(order);", "    throw new IllegalStateException();", "  }", "}")
_PY = _lines("import os", "import random", "from app.services.user_$3_service import Base", "", "@app.post('/users/$1')", "def create_$1(a, b):", "    for x in a:", "        if x and b:", "            os.system('ls ' + x)", "    try:", "        return eval(b) + random.random()", "    except ValueError:", "        raise", "", "class User$1Service(Base):", "    _instance = None", "# TODO validate input and authorize the user")
_TSX = _lines("import React from 'react';", "import { Widget$2 } from './Widget$2';", "export function Widget$1(props) {", "  const [s, set] = useState(0);", "  fetch('/users/$1');", "  return <div>{s}</div>;", "}")
_SQL = _lines("CREATE TABLE t$1 (", "  id BIGSERIAL PRIMARY KEY,", "  name VARCHAR(100) NOT NULL,", "  price DECIMAL(10,2),", "  owner_id INT REFERENCES t$2(id)", ");", "CREATE INDEX idx$1 ON t$1(name);")
_MD = _lines("# Order guide $1", "", "Log in with the customer account. See invoice and payment rules.")
_YML = _lines("spring:", "  datasource:", "    url: jdbc:postgresql://db/shop$1", "logging: debug")

CODE = f"""code AS (SELECT p_partkey AS file_id,
  CASE p_partkey % 8 WHEN 0 THEN concat('src/main/java/com/shop/controller/Order', p_partkey, 'Controller.java')
    WHEN 1 THEN concat('app/services/user_', p_partkey, '_service.py') WHEN 2 THEN concat('web/components/Widget', p_partkey, '.tsx')
    WHEN 3 THEN concat('db/migrations/V', p_partkey, '__init.sql') WHEN 4 THEN concat('node_modules/lib', p_partkey, '/index.js')
    WHEN 5 THEN concat('docs/Guide', p_partkey, '.md') WHEN 6 THEN concat('config/app', p_partkey, '.yml')
    ELSE concat('assets/img', p_partkey, '.png') END AS path,
  CASE p_partkey % 8 WHEN 0 THEN {_JAVA} WHEN 1 THEN {_PY} WHEN 2 THEN {_TSX} WHEN 3 THEN {_SQL} WHEN 5 THEN {_MD} WHEN 6 THEN {_YML} ELSE '' END AS content
  FROM part)"""
LINES = "src_lines AS (SELECT file_id, path, @explode(split(content, chr(10))) AS line FROM code)"


def code_query(name: str, body: str, *ctes: str) -> None:
    sql_query(name, "WITH " + ", ".join((CODE, *ctes)) + "\n" + body)


def values(name: str, columns: str, rows) -> str:
    """A rule table as a common table expression."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({columns}))"


_EXT = "CASE WHEN contains(path, '.') THEN concat('.', regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)) ELSE '' END"
# Languages by file extension.
LANGUAGES = [(".java", "Java"), (".py", "Python"), (".ts", "TypeScript"), (".tsx", "TypeScript"), (".js", "JavaScript"), (".jsx", "JavaScript"), (".sql", "SQL"), (".go", "Go"), (".cs", "C#"), (".cbl", "COBOL"), (".rb", "Ruby"), (".yml", "YAML"), (".yaml", "YAML"), (".md", "Markdown"), (".xml", "XML"), (".html", "HTML"), (".css", "CSS"), (".json", "JSON")]
_LANG = values("langs", "ext, language", LANGUAGES)
_FILES = f"files AS (SELECT file_id, path, content, {_EXT} AS ext, split_part(path, '/', 1) AS top FROM code)"

code_query(
    "file_inventory",
    """SELECT f.path, f.ext, coalesce(l.language, 'Other') AS language, CAST(length(f.content) AS BIGINT) AS size
FROM files f LEFT JOIN langs l ON f.ext = l.ext
WHERE f.ext NOT IN ('.png', '.jpg', '.gif', '.zip', '.class', '.jar') AND f.top NOT IN ('node_modules', 'target', '.git', 'build', 'dist') AND l.language IS NOT NULL""",
    _LANG,
    _FILES,
)
code_query("language_loc", """SELECT coalesce(language, 'Other') AS language, count(DISTINCT file_id) AS files, CAST(sum(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS loc, count(*) AS loc_split
FROM (SELECT s.*, l.language FROM src_lines s LEFT JOIN langs l ON concat('.', regexp_extract(s.path, '[.]([A-Za-z0-9]+)$', 1)) = l.ext) x GROUP BY 1""", LINES, _LANG)
code_query("path_functions", """SELECT path, lower(regexp_extract(path, '([^/]+?)([.][^./]*)?$', 1)) AS stem,
lower(regexp_replace(regexp_extract(path, '([^/]+?)([.][^./]*)?$', 1), '(Controller|_service|Service|_bean|Repository)$', '')) AS logical_name,
lower(translate(substr(path, 1, 40), '/. -', '____')) AS safe_name, length(path) - length(replace(path, '/', '')) AS depth FROM code""")
code_query("import_edges", """SELECT path, target, count(*) AS n FROM (
SELECT path, CASE WHEN path LIKE '%.java' THEN regexp_extract(line, '^import +([A-Za-z0-9_.]+);', 1) WHEN path LIKE '%.py' THEN regexp_extract(line, '^(import|from) +([A-Za-z0-9_.]+)', 2)
ELSE regexp_extract(line, '^import .* from .([A-Za-z0-9_./]+)', 1) END AS target FROM src_lines) x WHERE target <> '' GROUP BY path, target""", LINES)
code_query("symbol_extract", """SELECT path, kind, name, count(*) AS n FROM (
SELECT path, 'class' AS kind, regexp_extract(line, '(^| )class +([A-Za-z0-9_]+)', 2) AS name FROM src_lines
UNION ALL SELECT path, 'function' AS kind, regexp_extract(line, '(^| )(def|function) +([A-Za-z0-9_]+)', 3) AS name FROM src_lines
UNION ALL SELECT path, 'table' AS kind, regexp_extract(line, 'CREATE TABLE +([A-Za-z0-9_]+)', 1) AS name FROM src_lines
UNION ALL SELECT path, 'annotation' AS kind, regexp_extract(line, '^ *@([A-Za-z]+)', 1) AS name FROM src_lines) x WHERE name <> '' GROUP BY path, kind, name""", LINES)
_ENDPOINTS = """endpoints AS (SELECT file_id, path, verb, route FROM (SELECT file_id, path, upper(regexp_extract(lower(line), '(get|post|put|delete|patch)', 1)) AS verb, regexp_extract(line, '[(].(/[A-Za-z0-9_/{}]*)', 1) AS route FROM src_lines WHERE line LIKE '%@%Mapping(%' OR line LIKE '@app.%(%') x WHERE route <> '')"""
code_query("endpoint_extract", "SELECT path, CASE WHEN verb = '' THEN 'GET' ELSE verb END AS method, route FROM endpoints", LINES, _ENDPOINTS)
code_query("api_statistics", "SELECT count(*) AS endpoints, count(DISTINCT route) AS routes, count(DISTINCT verb) AS methods, round(avg(length(route) - length(replace(route, '/', ''))), 4) AS avg_segments FROM endpoints", LINES, _ENDPOINTS)
code_query("contract_extract", """SELECT path, kind, line, min(1) AS found FROM (
SELECT path, 'validation' AS kind, substr(trim(line), 1, 120) AS line FROM src_lines WHERE @like(lower(line), 'valid|assert|check|require')
UNION ALL SELECT path, 'error' AS kind, substr(trim(line), 1, 120) AS line FROM src_lines WHERE @like(lower(line), 'try|except|catch|throw|raise')
UNION ALL SELECT path, 'data' AS kind, substr(trim(line), 1, 120) AS line FROM src_lines WHERE @like(lower(line), 'findall|save[(]|insert |select |update |delete ')) x GROUP BY path, kind, line""", LINES)
# Indicators of frameworks, in order.
FRAMEWORKS = [(1, "Spring", "@RestController"), (1, "Spring", "springframework"), (2, "Flask", "@app.route"), (3, "FastAPI", "@app.post"), (3, "FastAPI", "@app.get"), (4, "React", "useState"), (4, "React", "from 'react'"), (5, "Django", "django."), (6, "Hibernate", "@Entity"), (7, "PostgreSQL", "jdbc:postgresql")]
_FW = values("rules", "ord, framework, indicator", FRAMEWORKS)
code_query("framework_detect", "SELECT c.path, r.framework, min(r.indicator) AS indicator FROM code c JOIN rules r ON contains(c.content, r.indicator) GROUP BY c.path, r.framework", _FW)
_LAYER_B = "CASE WHEN @like(lower(path), 'controller|component|view|page') THEN 'presentation' WHEN @like(lower(path), 'service|domain') THEN 'business' WHEN @like(lower(path), 'db/|migration|repositor|entity') THEN 'data' WHEN @like(lower(path), 'client|adapter|api/') THEN 'integration' ELSE 'infrastructure' END"
_LAYERS = f"layered AS (SELECT file_id, path, content, {_LAYER_B} AS layer FROM code)"
code_query("layer_rollup", "SELECT layer, count(*) AS file_count, count(DISTINCT split_part(path, '/', 1)) AS roots FROM layered GROUP BY layer", _LAYERS)
_SEGMENTS = values("segments", "ord, layer, segment", [(1, "frontend", "web"), (1, "frontend", "components"), (2, "backend", "controller"), (2, "backend", "services"), (3, "database", "db"), (3, "database", "migrations"), (4, "config", "config"), (5, "docs", "docs")])
code_query("layer_by_segment", """SELECT c.path, coalesce(min_by_layer, 'backend') AS layer FROM code c LEFT JOIN (SELECT file_id, substr(min(concat(s.ord, s.layer)), 2) AS min_by_layer FROM
(SELECT file_id, @explode(split(path, '/')) AS part FROM code) p JOIN segments s ON p.part = s.segment GROUP BY file_id) m ON c.file_id = m.file_id""", _SEGMENTS)
_CONCERNS = values("concerns", "concern, keyword", [("security", "password"), ("security", "authorize"), ("logging", "logging"), ("validation", "validate"), ("persistence", "datasource"), ("persistence", "create table"), ("error handling", "except"), ("error handling", "throw "), ("configuration", "spring:")])
code_query("concern_scan", "SELECT c.path, k.concern, count(*) AS evidence FROM code c JOIN concerns k ON contains(lower(c.content), k.keyword) GROUP BY c.path, k.concern", _CONCERNS)
_STACK = values("stack", "category, technology, ord, kind, indicator, points", [("backend", "Spring Boot", 1, "content", "@RestController", 12), ("backend", "Spring Boot", 1, "import", "import java.util", 20), ("backend", "Spring Boot", 1, "config", ".yml", 30), ("backend", "FastAPI", 2, "content", "@app.post", 12), ("backend", "FastAPI", 2, "import", "from app.", 20), ("backend", "Express", 3, "content", "app.listen", 12), ("frontend", "React", 1, "import", "from 'react'", 20), ("frontend", "React", 1, "content", "useState", 12), ("frontend", "Vue", 2, "content", "<template>", 12), ("database", "PostgreSQL", 1, "content", "BIGSERIAL", 12), ("database", "PostgreSQL", 1, "config", "jdbc:postgresql", 40), ("database", "MySQL", 2, "content", "AUTO_INCREMENT", 12)])
_SCORES = """scores AS (SELECT category, technology, ord, CAST(least(100, CASE WHEN points > 0 AND points < 70 THEN greatest(points, 70 + 5 * k) ELSE points END) AS BIGINT) AS score FROM (
SELECT category, technology, ord, sum(points) AS points, count(*) AS k FROM (SELECT DISTINCT s.category, s.technology, s.ord, s.indicator, s.points FROM stack s JOIN code c ON contains(c.content, s.indicator) OR (s.kind = 'config' AND contains(c.path, s.indicator))) h GROUP BY category, technology, ord) p)"""
code_query("stack_scores", "SELECT category, technology, score FROM scores", _STACK, _SCORES)
code_query("stack_top", "SELECT category, technology, score, place FROM (SELECT category, technology, score, row_number() OVER (PARTITION BY category ORDER BY score DESC, ord) AS place FROM scores WHERE score >= 70) x WHERE place <= 4", _STACK, _SCORES)
code_query("recommendations_lookup", """SELECT x.category, x.technology, x.score, coalesce(r.suggestion, concat(x.technology, ' (latest version)')) AS suggestion, CASE WHEN x.score > 80 THEN 'high' WHEN x.score >= 50 THEN 'medium' ELSE 'low' END AS priority
FROM scores x LEFT JOIN suggestions r ON x.technology = r.technology""", _STACK, _SCORES, values("suggestions", "technology, suggestion", [("Spring Boot", "Quarkus"), ("React", "Next.js")]))
_RISKS = values("risks", "rule, severity, confidence, pattern", [("command injection", "high", 0.9, "os[.]system|subprocess"), ("code execution", "high", 0.9, "eval[(]|exec[(]"), ("hard-coded secret", "medium", 0.7, "(password|secret|api_key) *= *."), ("weak random", "low", 0.6, "random[.]random")])
_FINDINGS = "findings AS (SELECT c.path, r.rule, r.severity, CAST(r.confidence AS @double) AS confidence FROM code c JOIN risks r ON @like(lower(c.content), r.pattern))"
code_query("security_findings", "SELECT path, rule, severity, confidence FROM findings", _RISKS, _FINDINGS)
code_query("risk_score", "SELECT path, count(*) AS findings, round(least(1.0, sum(CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END * confidence)), 4) AS risk FROM findings GROUP BY path", _RISKS, _FINDINGS)
code_query("design_patterns", """SELECT path, pattern, evidence FROM (
SELECT path, 'singleton' AS pattern, round(CASE WHEN contains(content, '_instance') THEN 0.4 ELSE 0.0 END + CASE WHEN @like(content, '_instance *= *None') THEN 0.3 ELSE 0.0 END, 2) AS evidence FROM code
UNION ALL SELECT path, 'controller' AS pattern, round(CASE WHEN contains(content, '@RestController') THEN 0.6 ELSE 0.0 END + CASE WHEN contains(path, 'Controller') THEN 0.3 ELSE 0.0 END, 2) AS evidence FROM code) x WHERE evidence > 0.5""")
code_query("coupling_levels", """SELECT path, coupling, CASE WHEN coupling < 0.3 THEN 'Low' WHEN coupling < 0.6 THEN 'Medium' ELSE 'High' END AS level FROM (
SELECT path, round(least(1.0, 0.1 * sum(CASE WHEN @like(line, '^(import|from) ') THEN 1 ELSE 0 END) + max(CASE WHEN @like(line, '(^| )class ') THEN 0.2 ELSE 0.0 END) + max(CASE WHEN contains(line, 'interface ') THEN 0.1 ELSE 0.0 END) + max(CASE WHEN @like(line, 'extends|implements') THEN 0.3 ELSE 0.0 END)), 4) AS coupling FROM src_lines GROUP BY path) x""", LINES)
code_query("business_rules_scan", "SELECT path, family, count(*) AS n FROM (SELECT path, CASE WHEN contains(lower(line), 'validate') THEN 'validation' WHEN contains(lower(line), 'authorize') THEN 'authorization' WHEN @like(line, '(^| )if ') THEN 'logic' ELSE '' END AS family FROM src_lines) x WHERE family <> '' GROUP BY path, family", LINES)
code_query("generic_cyclomatic", "SELECT path, CAST(1 + sum(" + " + ".join(f"CAST((length(line) - length(replace(line, '{k}', ''))) / {len(k)} AS BIGINT)" for k in ("if ", "elif ", "for ", "while ", "case ", "catch ", "&&", " and ")) + ") AS BIGINT) AS complexity FROM src_lines GROUP BY path", LINES)
_EDGES = """edges AS (SELECT DISTINCT s.path AS src, t.path AS dst FROM (
SELECT path, CASE WHEN path LIKE '%.java' THEN regexp_extract(line, '^import +[a-z.]*[.](Order[0-9]+Controller);', 1) WHEN path LIKE '%.py' THEN regexp_extract(line, '^from app.services.(user_[0-9]+_service) ', 1) ELSE regexp_extract(line, 'from .[.]/(Widget[0-9]+)', 1) END AS name FROM src_lines) s
JOIN (SELECT path, regexp_extract(path, '([^/]+?)([.][^./]*)?$', 1) AS name FROM code) t ON s.name = t.name WHERE s.name <> '' AND s.path <> t.path)"""
code_query("graph_edges", "SELECT src, dst, 'import' AS kind, CAST(0.5 AS @double) AS weight FROM edges", LINES, _EDGES)
code_query("graph_typed_counts", "SELECT 'file' AS kind, count(*) AS n FROM code UNION ALL SELECT 'import' AS kind, count(*) AS n FROM edges UNION ALL SELECT 'class' AS kind, count(*) AS n FROM src_lines WHERE @like(line, '(^| )class [A-Za-z]')", LINES, _EDGES)
code_query("dir_clusters", "SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS cluster, count(*) AS files FROM code GROUP BY 1")
code_query("degree_metrics", """SELECT c.path, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, round(CAST(2 * coalesce(i.n, 0) + coalesce(o.n, 0) AS @double) / 3, 4) AS hotspot FROM code c
LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON c.path = o.src LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON c.path = i.dst""", LINES, _EDGES)
code_query("graph_metrics", "SELECT v, e, round(CAST(e AS @double) / (v * (v - 1)), 8) AS density, round(CAST(e AS @double) / v, 6) AS avg_degree FROM (SELECT count(*) AS v FROM code) a CROSS JOIN (SELECT count(*) AS e FROM edges) b", LINES, _EDGES)
code_query("mutual_imports", "SELECT a.src AS one, a.dst AS other FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src AND a.src < a.dst", LINES, _EDGES)
_LEVEL = "CASE layer WHEN 'presentation' THEN 0 WHEN 'business' THEN 1 WHEN 'data' THEN 2 ELSE 3 END"
code_query(
    "layer_violations",
    f"""SELECT e.src, e.dst, s.lvl - t.lvl AS difference, CASE WHEN s.lvl - t.lvl > 2 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT a.path AS src, c.path AS dst FROM code a JOIN code c ON a.file_id + 2 = c.file_id) e
JOIN (SELECT path, {_LEVEL} AS lvl FROM layered) s ON e.src = s.path JOIN (SELECT path, {_LEVEL} AS lvl FROM layered) t ON e.dst = t.path WHERE s.lvl > t.lvl + 1""",
    _LAYERS,
)
_COMPONENT = "CASE WHEN path LIKE '%.tsx' THEN 'frontend' WHEN path LIKE '%.java' OR path LIKE '%.py' THEN 'backend' WHEN path LIKE '%.sql' THEN 'database' ELSE 'other' END"
code_query("transform_mappings", f"SELECT m.category, m.target, count(*) AS file_count, min(c.path) AS first_file FROM (SELECT path, {_COMPONENT} AS category FROM code) c JOIN targets m ON c.category = m.category GROUP BY m.category, m.target", values("targets", "category, target", [("frontend", "Next.js"), ("backend", "Quarkus")]))
code_query("catch_all_mapping", f"SELECT c.category, count(*) AS uncovered FROM (SELECT path, {_COMPONENT} AS category FROM code) c WHERE NOT EXISTS (SELECT 1 FROM targets m WHERE m.category = c.category) GROUP BY c.category", values("targets", "category, target", [("frontend", "Next.js"), ("backend", "Quarkus")]))
code_query("new_paths", "SELECT path, CASE WHEN path LIKE '%.tsx' THEN concat('src/components/', regexp_extract(path, '([^/]+)$', 1)) WHEN path LIKE '%.js' THEN concat('src/', regexp_extract(path, '([^/]+?)([.][^./]*)?$', 1), '.ts') ELSE path END AS new_path FROM code")
code_query("passthrough_transform", "SELECT path, length(concat(CASE WHEN path LIKE '%.py' OR path LIKE '%.yml' THEN '# unchanged' WHEN path LIKE '%.sql' THEN '-- unchanged' ELSE '// unchanged' END, chr(10), content)) AS length, @sha(content) AS digest FROM code")
code_query("transform_flags", "SELECT path, contains(lower(content), 'todo') AS has_todo, abs((length(content) - length(replace(content, '{', ''))) - (length(content) - length(replace(content, '}', '')))) > 5 AS unbalanced, length(content) < 50 AS stub FROM code")
code_query("ddl_columns", """SELECT path, name, lower(type) AS source_type, CASE WHEN lower(type) IN ('int', 'integer', 'bigint', 'bigserial', 'serial') THEN 'BIGINT' WHEN lower(type) IN ('varchar', 'char', 'text') THEN 'STRING' WHEN lower(type) IN ('decimal', 'numeric') THEN 'DECIMAL' ELSE 'STRING' END AS spark_type, not_null, primary_key, referenced FROM (
SELECT path, regexp_extract(line, '^  ([a-z_]+) ([A-Z]+)', 1) AS name, regexp_extract(line, '^  ([a-z_]+) ([A-Z]+)', 2) AS type, contains(line, 'NOT NULL') AS not_null, contains(line, 'PRIMARY KEY') AS primary_key, regexp_extract(line, 'REFERENCES ([a-z0-9_]+)', 1) AS referenced FROM src_lines WHERE path LIKE '%.sql') x WHERE name <> ''""", LINES)
code_query("ddl_fk_degrees", """SELECT t.name AS tbl, count(f.referenced) AS referenced_by FROM (SELECT regexp_extract(line, 'CREATE TABLE ([a-z0-9]+)', 1) AS name FROM src_lines WHERE line LIKE 'CREATE TABLE%') t
LEFT JOIN (SELECT regexp_extract(line, 'REFERENCES ([a-z0-9]+)', 1) AS referenced FROM src_lines WHERE line LIKE '%REFERENCES%') f ON t.name = f.referenced GROUP BY t.name""", LINES)
code_query("database_statistics", "SELECT tables, fks, indexes, round(CAST(0.4 * least(tables / 20.0, 1.0) + 0.4 * least(fks / 30.0, 1.0) + 0.2 * least(indexes / 50.0, 1.0) AS @double), 2) AS complexity FROM (SELECT CAST(sum(CASE WHEN line LIKE 'CREATE TABLE%' THEN 1 ELSE 0 END) AS BIGINT) AS tables, CAST(sum(CASE WHEN line LIKE '%REFERENCES%' THEN 1 ELSE 0 END) AS BIGINT) AS fks, CAST(sum(CASE WHEN line LIKE 'CREATE INDEX%' THEN 1 ELSE 0 END) AS BIGINT) AS indexes FROM src_lines) x", LINES)
code_query("dialect_detect", "SELECT path, CASE WHEN contains(upper(content), 'AUTO_INCREMENT') THEN 'mysql' WHEN contains(upper(content), 'SERIAL') THEN 'postgresql' WHEN contains(upper(content), 'VARCHAR2') THEN 'oracle' WHEN contains(upper(content), 'IDENTITY(') THEN 'sqlserver' ELSE 'unknown' END AS dialect FROM code WHERE path LIKE '%.sql'")
code_query("orm_codegen", "SELECT tbl, concat('class T', substr(tbl, 2), '(Base):', chr(10), '    __tablename__ = ', chr(39), tbl, chr(39)) AS model FROM (SELECT regexp_extract(content, 'CREATE TABLE ([a-z0-9]+)', 1) AS tbl FROM code WHERE path LIKE '%.sql') x")
code_query("curl_examples", "SELECT route, concat('curl -X ', verb, ' http://localhost', route) AS curl FROM endpoints", LINES, _ENDPOINTS)
code_query("openapi_paths", "SELECT route, count(*) AS operations, min(lower(verb)) AS first_method, concat('#/paths/', replace(route, '/', '~1')) AS pointer FROM endpoints GROUP BY route", LINES, _ENDPOINTS)
_AB = "a_eps AS (SELECT verb, route FROM endpoints WHERE file_id % 3 <> 0), b_eps AS (SELECT verb, route FROM endpoints WHERE file_id % 5 <> 0)"
code_query("endpoint_merge", "SELECT verb, route, 'converted' AS origin FROM b_eps UNION ALL SELECT a.verb, a.route, 'carried forward' AS origin FROM a_eps a WHERE NOT EXISTS (SELECT 1 FROM b_eps b WHERE b.verb = a.verb AND b.route = a.route)", LINES, _ENDPOINTS, _AB)
code_query("api_contracts", "SELECT total, matched, round(CAST(matched AS @double) / total, 4) AS rate, CAST(matched AS @double) / total >= 0.9 AS passed FROM (SELECT count(*) AS total, CAST(sum(CASE WHEN b.route IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS matched FROM a_eps a LEFT JOIN b_eps b ON a.verb = b.verb AND a.route = b.route) x", LINES, _ENDPOINTS, _AB)
code_query("preservation_static", """SELECT path, preserved, total, round(CAST(preserved AS @double) / total, 3) AS score, CASE WHEN CAST(preserved AS @double) / total >= 0.8 THEN 'preserved' WHEN CAST(preserved AS @double) / total >= 0.5 THEN 'partial' ELSE 'lost' END AS verdict FROM (
SELECT path, count(*) AS total, CAST(sum(CASE WHEN file_id % 4 = 1 OR kind = 'f' THEN 1 ELSE 0 END) AS BIGINT) AS preserved FROM (SELECT file_id, path, CASE WHEN @like(line, '(^| )(def|function) ') THEN 'f' ELSE 'c' END AS kind FROM src_lines WHERE @like(line, '(^| )(def|function|class) ')) x GROUP BY path) y""", LINES)
code_query("api_file_selector", "SELECT path FROM code WHERE contains(content, '@RestController') OR contains(content, '@app.') OR contains(lower(path), 'controller') OR contains(lower(path), '/api/')")
code_query("database_file_selector", "SELECT path FROM code WHERE path LIKE '%.sql' OR contains(lower(path), 'migration') OR contains(lower(content), 'create table')")
code_query("rest_naming_check", "SELECT route, @like(route, '^/[a-z0-9/{}_-]+$') AS conforms FROM endpoints", LINES, _ENDPOINTS)
