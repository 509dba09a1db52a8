"""Queries over projects of source files; what they must give is written out by hand, or by brute force over the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udtfs
from ..operators import api_docs, imports, lexing, paths, preservation, stack_rules, symbols
from ..operators.graphs import _cut
from ..sources import tree
from ..sources.tables import shared_dir
from .project_corpus import FILES, PROJECT_SQL, _literal, project_files
from .registry import query

_KIND = {path: k for k, (path, _) in enumerate(FILES)}
JAVA, SERVICE, REPOSITORY = (f"src/main/java/com/shop/Order{x}.java" for x in ("Controller", "Service", "Repository"))
USERS, USER_SERVICE, MODELS, FLASK, URLS, VIEWS = "api/app/routers/users.py", "api/app/services/user_service.py", "api/app/models.py", "legacy/app.py", "legacy/shop/urls.py", "legacy/shop/views.py"
EXPRESS, CARD, FORMAT, SHARP, GO, SCHEMA, COBOL = "web/server.js", "web/src/components/Card.tsx", "web/src/format.ts", "server/ItemsController.cs", "worker/main.go", "db/schema.sql", "mainframe/PAY.cbl"


def by_hand(name: str, columns: str, rows: dict[str, list[tuple]]) -> str:
    """Expected rows of each file as a table with the file's kind; in texts a ~ becomes the project's number."""
    values = [f"({_KIND[path]}, " + ", ".join(_literal(v) if isinstance(v, str) else str(v) for v in row) + ")" for path, each in rows.items() for row in each]
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(values)}) v(kind, {columns}))"


def _shown(*texts: str) -> str:
    return ", ".join(f"replace({t}, '~', CAST(project AS VARCHAR)) AS {t}" for t in texts)


#: (kind of symbol, name, first line, last line).
SYMBOLS: dict[str, list[tuple]] = {
    JAVA: [
        ("class", "OrderController", 7, 25),
        ("method", "find", 12, 16),
        ("method", "create", 18, 21),
        ("method", "all", 23, 24),
        ("import", "com.shop.OrderService", 3, 3),
        ("import", "org.springframework.web.bind.annotation.*", 4, 4),
        ("annotation", "RestController", 7, 25),
        ("annotation", "RequestMapping", 7, 25),
        ("annotation", "GetMapping", 12, 16),
        ("annotation", "PathVariable", 12, 16),
        ("annotation", "PostMapping", 18, 21),
        ("annotation", "RequestBody", 18, 21),
        ("annotation", "RequestMapping", 23, 24),
        ("rest_endpoint", "/{id}", 12, 16),
        ("request_mapping", "/api/orders~", 7, 25),
        ("request_mapping", "/all", 23, 24),
    ],
    SERVICE: [
        ("class", "OrderService", 5, 71),
        ("method", "find", 8, 10),
        ("method", "total", 12, 70),
        ("import", "com.shop.OrderRepository", 3, 3),
        ("annotation", "Stateless", 5, 71),
        ("ejb", "Stateless", 5, 71),
        ("sql_query", "select o from Order~ o where o.id = :id", 9, 9),
    ],
    REPOSITORY: [
        ("interface", "OrderRepository", 5, 6),
        ("class", "Order", 8, 13),
        ("import", "com.shop.Order", 3, 3),
        ("annotation", "Entity", 8, 13),
        ("annotation", "Table", 8, 13),
        ("entity", "Order", 8, 13),
        ("table", "orders_~", 8, 13),
        ("jpa_repository", "Order", 5, 6),
    ],
    USERS: [
        ("import", "os", 2, 2),
        ("import", "api.app.services.user_service", 3, 3),
        ("function", "create_user", 6, 9),
        ("function", "get_user", 12, 15),
        ("decorator", "app", 6, 9),
        ("decorator", "app", 12, 15),
        ("fastapi_route", "/users~", 6, 9),
        ("fastapi_route", "/users~/{user_id}", 12, 15),
        ("sql_query", "select * from users_~ where id = 1", 14, 14),
    ],
    USER_SERVICE: [("import", "api.app.models", 1, 1), ("import", "api.app.routers.users", 2, 2), ("class", "UserService", 5, 15), ("sqlalchemy_model", "UserService", 5, 15), ("function", "create", 11, 15)],
    MODELS: [("import", "sqlalchemy.orm", 1, 1), ("class", "User~", 6, 8), ("sqlalchemy_model", "User~", 6, 8)],
    FLASK: [
        ("import", "flask", 1, 1),
        ("function", "items", 6, 9),
        ("function", "ping", 12, 14),
        ("decorator", "app", 6, 9),
        ("decorator", "login_required", 6, 9),
        ("decorator", "app", 12, 14),
        ("flask_route", "/items~", 6, 9),
        ("flask_route", "/ping", 12, 14),
    ],
    URLS: [("import", "django.urls", 1, 1), ("import", "legacy.shop.views", 2, 2), ("django_url", "items~/", 4, 8), ("django_url", "about/", 4, 8)],
    VIEWS: [("import", "django.shortcuts", 1, 1), ("import", "legacy.shop.urls", 2, 2), ("function", "items", 5, 6)],
    EXPRESS: [("require", "express", 1, 1), ("express_route", "/shop~/:id", 4, 7), ("express_route", "/shop~", 8, 8), ("function", "save", 11, 13)],
    CARD: [("import", "react", 1, 1), ("import", "../format", 2, 2), ("arrow_function", "Card~", 4, 7), ("react_component", "Card~", 4, 7), ("class", "CardStore", 9, 11)],
    FORMAT: [("function", "money", 1, 3)],
    SHARP: [
        ("import", "System", 1, 1),
        ("import", "Microsoft.AspNetCore.Mvc", 2, 2),
        ("class", "ItemsController", 4, 16),
        ("class", "Item", 18, 19),
        ("method", "Get", 8, 9),
        ("method", "Remove", 11, 15),
        ("attribute", "ApiController", 4, 16),
        ("attribute", "Route", 4, 16),
        ("attribute", "HttpGet", 8, 9),
        ("attribute", "HttpDelete", 11, 15),
        ("attribute", "Table", 18, 19),
        ("api_route", "api/items~", 4, 16),
        ("api_route", "{id}", 8, 9),
        ("entity", "items_~", 18, 19),
    ],
    GO: [("import", "fmt", 3, 6), ("import", "net/http", 3, 6), ("struct", "Job~", 8, 10), ("interface", "Runner", 12, 14), ("function", "Run", 16, 19), ("function", "main", 21, 23)],
    SCHEMA: [
        ("create_table", "customers_~", 2, 7),
        ("create_table", "regions_~", 8, 8),
        ("create_index", "idx_name_~", 9, 9),
        ("create_view", "rich_~", 10, 10),
        ("alter_table", "customers_~", 11, 11),
        ("foreign_key", "region_id", 2, 7),
        ("column_def", "id", 2, 7),
        ("column_def", "name", 2, 7),
        ("column_def", "region_id", 2, 7),
        ("column_def", "id", 8, 8),
        ("column_def", "label", 8, 8),
    ],
    COBOL: [("program_id", "PAY~", 2, 2), ("section", "WORKING-STORAGE", 5, 5), ("copy", "PAYREC", 6, 6), ("paragraph", "MAIN-PARA", 7, 7), ("call", "TAX~", 8, 8), ("sql_exec", "SELECT X FROM PAYROLL_~", 9, 11)],
}


@query(f"WITH {PROJECT_SQL}, {by_hand('want', 'symbol, name, a, b', SYMBOLS)} SELECT path, symbol AS kind, {_shown('name')}, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line FROM project_files JOIN want USING (kind)")
def code_symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in nine languages' files, with the lines of what they name."""
    units = lexing.code_units(project_files(spark, sf_dir))
    return symbols.code_symbols(units).select("path", "kind", "name", "start_line", "end_line")


#: (framework, method, route, function, line).
ENDPOINTS: dict[str, list[tuple]] = {
    JAVA: [("Spring", "GET", "/api/orders~/{id}", "find", 12), ("Spring", "POST", "/api/orders~", "create", 18), ("Spring", "GET", "/api/orders~/all", "all", 23)],
    USERS: [("FastAPI", "POST", "/users~", "create_user", 6), ("FastAPI", "GET", "/users~/{user_id}", "get_user", 12)],
    FLASK: [("Flask", "GET", "/items~", "items", 6), ("Flask", "POST", "/items~", "items", 6), ("Flask", "GET", "/ping", "ping", 12)],
    URLS: [("Django", "GET", "items~/", "views", 4), ("Django", "GET", "about/", "about_view", 4)],
    EXPRESS: [("Express", "GET", "/shop~/:id", "get__shop~_id", 4), ("Express", "POST", "/shop~", "post__shop~", 8)],
    SHARP: [("ASP.NET", "GET", "{id}", "Get", 8), ("ASP.NET", "DELETE", "", "Remove", 11)],
}


@query(f"WITH {PROJECT_SQL}, {by_hand('want', 'framework, method, route, name, line', ENDPOINTS)} SELECT path, framework, method, {_shown('route')}, replace(name, '~', CAST(project AS VARCHAR)) AS function, CAST(line AS INTEGER) AS line FROM project_files JOIN want USING (kind)")
def endpoint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web endpoints of six frameworks, class prefixes joined to routes."""
    return symbols.endpoints(lexing.code_units(project_files(spark, sf_dir))).drop("parameters")


@query(f"WITH {PROJECT_SQL}, {by_hand('want', 'pattern, detail, line', {SERVICE: [('long method', 'total', 12)], USER_SERVICE: [('global variable', 'counter', 12)]})} SELECT path, pattern, detail, CAST(line AS INTEGER) AS line FROM project_files JOIN want USING (kind)")
def anti_pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of over fifty lines, and global variables."""
    return symbols.anti_patterns(lexing.code_units(project_files(spark, sf_dir)))


_WANT = by_hand("want", "symbol, name, a, b", SYMBOLS)
#: An import's run of segments by hand where it is relative, else its name with slashes; the first file whose path holds it.
_IMPORTED = """imported AS (SELECT project, path AS src, name AS import, CASE WHEN name = '../format' THEN 'p' || project || '/web/src/format' WHEN contains(name, '/') THEN name ELSE replace(regexp_replace(name, '[.][*]$', ''), '.', '/') END AS run
  FROM project_files JOIN want USING (kind) WHERE symbol IN ('import', 'require')),
import_edges AS (SELECT project, src, dst, import FROM (SELECT i.*, f.path AS dst, row_number() OVER (PARTITION BY i.project, src, import ORDER BY f.file_no) AS n
  FROM imported i JOIN project_files f ON i.project = f.project AND contains('/' || regexp_replace(f.path, '[.][^./]*$', '') || '/', '/' || run || '/')) x WHERE n = 1 AND src <> dst)"""


@query(f"WITH {PROJECT_SQL}, {_WANT}, {_IMPORTED} SELECT project, src, dst, import FROM import_edges")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file each import of a project names: the first whose path holds it."""
    files = project_files(spark, sf_dir)
    found = symbols.code_symbols(lexing.code_units(files), "import", "require")
    return imports.resolved(files, found.join(files.select("project", "path"), "path"))


_PARENTS = by_hand("parents", "class, parent", {JAVA: [("OrderController", "BaseController")], USER_SERVICE: [("UserService", "Base")], MODELS: [("User~", "Base")], SHARP: [("ItemsController", "ControllerBase")]})
_GRAPH = f"""{PROJECT_SQL}, {_WANT}, {_IMPORTED}, {_PARENTS},
parts AS (SELECT project, path, CASE symbol WHEN 'class' THEN 'class' ELSE 'function' END AS type, replace(name, '~', CAST(project AS VARCHAR)) AS name FROM project_files JOIN want USING (kind) WHERE symbol IN ('class', 'function', 'method')),
graph_edges AS (SELECT DISTINCT project, path AS src, type || ':' || path || ':' || name AS dst, 'contains' AS kind, CAST(1.0 AS DOUBLE) AS weight FROM parts
  UNION ALL SELECT DISTINCT project, src, dst, 'import', CAST(0.5 AS DOUBLE) FROM import_edges
  UNION ALL SELECT DISTINCT project, 'class:' || path || ':' || replace(class, '~', CAST(project AS VARCHAR)), 'class:' || project || ':' || parent, 'inheritance', CAST(2.0 AS DOUBLE) FROM project_files JOIN parents USING (kind))"""


@query(f"WITH {_GRAPH} SELECT project, src, dst, kind, weight FROM graph_edges")
def project_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the typed graph: what files hold, what they import, what classes inherit from."""
    files = project_files(spark, sf_dir)
    units = _cut(lexing.code_units(files))
    return imports.typed_graph(files, units, _cut(symbols.code_symbols(units)))[1]


@query(
    f"""WITH RECURSIVE {_GRAPH},
    starts AS (SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY project ORDER BY file_no) AS n FROM project_files WHERE path NOT IN (SELECT dst FROM graph_edges)) x WHERE n <= 5),
    r(start, path, cur) AS (SELECT path, [path], path FROM starts UNION ALL SELECT start, list_append(r.path, dst), dst FROM r JOIN graph_edges e ON r.cur = e.src WHERE NOT list_contains(r.path, dst))
    SELECT start, CAST(len(path) AS BIGINT) AS length, array_to_string(path, ' > ') AS path,
      CAST(len(path) + list_sum(list_transform(path, lambda x: CASE WHEN x LIKE 'class:%' THEN 2.0 WHEN x LIKE 'function:%' THEN 0.5 ELSE 1.0 END)) AS DOUBLE) AS impact
    FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path) DESC, path) AS n FROM r) x WHERE n = 1 AND len(path) > 2"""
)
def graph_critical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest path from each of a project's first five entry points, if it has over two nodes, and its impact."""
    files = project_files(spark, sf_dir)
    units = _cut(lexing.code_units(files))
    nodes, edges = map(_cut, imports.typed_graph(files, units, _cut(symbols.code_symbols(units))))
    starts = paths.entry_points(files.select(F.col("project").alias("graph"), F.col("file_no").alias("place"), F.col("path").alias("node")), edges)
    found = paths.critical_paths(nodes.withColumnRenamed("id", "node"), edges, starts)
    return found.withColumn("path", F.array_join("path", " > "))


_CHANNEL = {"import": "import", "require": "import", "annotation": "annotation", "decorator": "annotation", "attribute": "annotation", "ejb": "pattern", "jpa_repository": "pattern"}
_RULE_ROWS = ", ".join(f"({_literal(c)}, {_literal(t)}, {k}, {_literal(kind)}, {_literal(term)}, {'NULL' if points is None else points})" for c, t, k, kind, term, points in stack_rules.starter_rules())
_BONUS_ROWS = ", ".join(f"({_literal(c)}, {_literal(w)}, {points})" for c, (points, words) in stack_rules.BONUS.items() for w in words)
#: Every rule against every text.
_STACK = f"""{PROJECT_SQL}, {_WANT},
rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) v(category, technology, place, rule, term, points)),
bonuses AS (SELECT * FROM (VALUES {_BONUS_ROWS}) v(category, word, points)),
texts AS (SELECT project, 'content' AS channel, lower(content) AS text FROM project_files
  UNION ALL SELECT project, 'manifest', lower(content) FROM project_files WHERE regexp_extract(path, '[^/]*$') IN ({", ".join(map(_literal, stack_rules.MANIFESTS))})
  UNION ALL SELECT project, CASE WHEN symbol IN ('import', 'require') THEN 'import' WHEN symbol IN ('ejb', 'jpa_repository') THEN 'pattern' ELSE 'annotation' END, lower(CASE WHEN symbol IN ('ejb', 'jpa_repository') THEN symbol || ' ' || name ELSE name END)
    FROM project_files JOIN want USING (kind) WHERE symbol IN ({", ".join(map(_literal, _CHANNEL))})),
found AS (SELECT DISTINCT project, category, technology, place, term, channel FROM rules JOIN texts ON rule = 'indicator' AND contains(text, term)),
points AS (SELECT project, category, technology, place, CASE channel WHEN 'import' THEN 20 WHEN 'annotation' THEN 15 WHEN 'pattern' THEN 18 WHEN 'manifest' THEN 15 ELSE 12 END AS points, CASE WHEN channel IN ('content', 'manifest') THEN term END AS sure, term, channel FROM found
  UNION ALL SELECT DISTINCT project, category, technology, place, points, NULL, term, rule FROM rules JOIN texts ON rule = 'dependency' AND channel = 'manifest' AND contains(text, term)
  UNION ALL SELECT DISTINCT project, category, technology, place, points, NULL, term, rule FROM rules JOIN project_files ON rule = 'config' AND regexp_extract(path, '[^/]*$') = term
  UNION ALL SELECT project, category, technology, place, points * least(count(*), 5), NULL, term, rule FROM rules JOIN project_files ON rule = 'extension' AND lower(regexp_extract(path, '[.][^./]*$')) = term GROUP BY project, category, technology, place, points, term, rule),
extra AS (SELECT project, category, sum(points) AS bonus FROM (SELECT DISTINCT project, category, word, points FROM bonuses JOIN texts ON channel = 'content' AND contains(text, word)) x GROUP BY project, category),
sums AS (SELECT project, category, technology, place, sum(points) AS points, count(DISTINCT sure) AS sure FROM points GROUP BY project, category, technology, place),
scores AS (SELECT s.project, s.category, technology, place, CAST(least(100, CASE WHEN points + coalesce(bonus, 0) < 70 AND sure > 0 THEN greatest(points + coalesce(bonus, 0), 70 + 5 * sure) ELSE points + coalesce(bonus, 0) END) AS BIGINT) AS score
  FROM sums s LEFT JOIN extra e ON s.project = e.project AND s.category = e.category)"""


def _project_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = project_files(spark, sf_dir)
    named = symbols.code_symbols(lexing.code_units(files)).join(files.select("project", "path"), "path")
    channel = F.lit(None).cast("string")
    for kind, c in _CHANNEL.items():
        channel = F.when(F.col("kind") == kind, F.lit(c)).otherwise(channel)
    marks = named.withColumn("channel", channel).filter("channel is not null").select("project", "channel", F.when(F.col("channel") == "pattern", F.concat_ws(" ", "kind", "name")).otherwise(F.col("name")).alias("text"))
    return stack_rules.stack_scores(files, stack_rules.rules_of(spark), marks)


@query(f"WITH {_STACK} SELECT CAST(project AS VARCHAR) AS project, category, technology, score FROM scores")
def stack_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every technology that a project shows signs of, by all channels of evidence."""
    return _project_stack(spark, sf_dir).select("project", "category", "technology", "score")


@query(
    f"""WITH {_STACK}, placed AS (SELECT *, row_number() OVER (PARTITION BY project, category ORDER BY score DESC, place) AS n FROM scores WHERE score >= 70)
    SELECT CAST(project AS VARCHAR) AS project, category, max(CASE WHEN n = 1 THEN technology END) AS detected, max(score) AS confidence, coalesce(string_agg(technology, ', ' ORDER BY n) FILTER (WHERE n BETWEEN 2 AND 4), '') AS alternatives FROM placed GROUP BY project, category"""
)
def stack_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The technology of each category of each project, and up to three others."""
    return stack_rules.detected(_project_stack(spark, sf_dir)).withColumn("alternatives", F.array_join("alternatives", ", "))


#: What else is written for each project: skipped, binary and other files that aren't read, and one that is empty.
_ODD = [("node_modules/lib/index.js", "x"), ("sub/.gradle/a.py", "x"), ("logo.png", "x"), ("LICENSE", "x"), ("api/__init__.py", ""), (".gitignore", "*.pyc\n\n  \n"), ("Dockerfile", "FROM x")]
_SEEN = {".java": "Java", ".py": "Python", ".js": "JavaScript", ".tsx": "TypeScript", ".ts": "TypeScript", ".cs": "C#", ".go": "Go", ".sql": "SQL", ".cbl": "COBOL", ".xml": "XML", ".yml": "YAML", ".json": "JSON", ".properties": "Properties", ".md": "Markdown", ".xhtml": "XHTML", ".txt": "Other"}


@query(
    f"""WITH {PROJECT_SQL}, languages AS (SELECT * FROM (VALUES {", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in _SEEN.items())}) v(extension, language)),
    odd AS (SELECT DISTINCT 'p' || project || '/' || v.path AS path, v.content, v.language, v.extension FROM project_files, (VALUES ('api/__init__.py', '', 'Python', '.py'), ('.gitignore', '*.pyc' || chr(10) || chr(10) || '  ' || chr(10), 'Other', ''), ('Dockerfile', 'FROM x', 'Dockerfile', '')) v(path, content, language, extension)),
    named AS (SELECT path, content, regexp_extract(path, '[.][^./]*$') AS extension FROM project_files),
    seen AS (SELECT path, content, language, extension FROM named JOIN languages USING (extension) UNION ALL SELECT path, content, language, extension FROM odd)
    SELECT path, regexp_extract(path, '[^/]*$') AS filename, extension, language, CAST(octet_length(encode(content)) AS BIGINT) AS size, CAST(len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS loc, sha256(content) AS digest FROM seen"""
)
def source_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects written as trees of files and read again: what is relevant, with language, size and lines."""
    files = project_files(spark, sf_dir)
    odd = spark.createDataFrame(_ODD, "name string, content string")
    folders = files.select(F.substring_index("path", "/", 1).alias("folder")).distinct()
    more = folders.join(odd).select(F.concat_ws("/", "folder", "name").alias("path"), "content")
    root = shared_dir(spark, "tree")
    tree.write_tree(files.select("path", "content").unionByName(more), root)
    return tree.scan(spark, root).select("path", "filename", "extension", "language", "size", "loc", F.sha2("content", 256).alias("digest"))


def _as_view(spark: SparkSession, sf_dir: str) -> None:
    udtfs.register(spark)
    project_files(spark, sf_dir).createOrReplaceTempView("project_files")


_BLOCKS: dict[str, list[tuple]] = {
    JAVA: [("public class OrderController extends BaseController", 0, 7, 25), ("public Order find(@PathVariable Long id)", 1, 12, 16), ("if (id == null)", 2, 14, 14), ("public Order create(@RequestBody Order order)", 1, 18, 21), ("public List<Order> all()", 1, 23, 24)],
    USER_SERVICE: [("class UserService(Base):", 0, 5, 15), ("def create(self, name):", 1, 11, 15), ("for c in name:", 2, 13, 14)],
    GO: [("type Job~ struct", 0, 8, 10), ("type Runner interface", 0, 12, 14), ("func (j *Job~) Run(x int) error", 0, 16, 19), ("func main()", 0, 21, 23)],
}


@query(f"WITH {PROJECT_SQL}, {by_hand('want', 'head, depth, a, b', _BLOCKS)} SELECT path, {_shown('head')}, CAST(depth AS INTEGER) AS depth, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line FROM project_files JOIN want USING (kind)")
def sql_code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of source files by a table function, without their annotations."""
    _as_view(spark, sf_dir)
    return spark.sql(r"""SELECT f.path, regexp_replace(u.head, '^(@[A-Za-z]+([(][^)]*[)])? )+', '') AS head, u.depth, u.start_line, u.end_line
      FROM project_files f, LATERAL code_units(f.path, f.content) u
      WHERE u.kind = 'block' AND (f.path LIKE '%OrderController.java' OR f.path LIKE '%user_service.py' OR f.path LIKE '%main.go')""")


_COLUMNS: dict[str, list[tuple]] = {SCHEMA: [("customers_~", "id", 0, 1), ("customers_~", "name", 1, 0), ("customers_~", "region_id", 1, 0), ("regions_~", "id", 1, 0), ("regions_~", "label", 1, 0)]}


@query(f"WITH {PROJECT_SQL}, {by_hand('want', 'table_name, name, nullable, key', _COLUMNS)} SELECT path, {_shown('table_name')}, name, key = 1 AS primary_key FROM project_files JOIN want USING (kind)")
def sql_ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of DDL by a table function."""
    _as_view(spark, sf_dir)
    return spark.sql("SELECT f.path, d.table_name, d.name, coalesce(d.primary_key, false) AS primary_key FROM project_files f, LATERAL ddl_columns(f.content) d WHERE f.path LIKE '%.sql'")


@query(
    f"""WITH {PROJECT_SQL}, l AS (SELECT path, string_split(content, chr(10)) AS lines FROM project_files), w AS (SELECT path, lines, unnest(range(0, len(lines), 20)) AS s FROM l)
    SELECT path, CAST(s // 20 AS INTEGER) AS chunk, CAST(s AS BIGINT) AS first, CAST(least(s + 20, len(lines)) - 1 AS BIGINT) AS last, sha256(array_to_string(lines[s + 1:s + 20], chr(10))) AS digest
    FROM w WHERE trim(translate(array_to_string(lines[s + 1:s + 20], chr(10)), chr(10) || chr(9), '  ')) <> ''"""
)
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of twenty lines by a table function over the lines of each file."""
    _as_view(spark, sf_dir)
    spark.sql(r"SELECT path, cast(n AS bigint) AS n, line FROM project_files LATERAL VIEW posexplode(split(content, '\n')) x AS n, line").createOrReplaceTempView("project_lines")
    return spark.sql("SELECT path, chunk, first, last, sha2(body, 256) AS digest FROM chunks(TABLE(project_lines) PARTITION BY path ORDER BY n, size => 20)")


def _api(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = project_files(spark, sf_dir)
    units, own = lexing.code_units(files), files.select("project", "path")
    found = _cut(symbols.endpoints(units).join(own, "path"))  # read more than once
    return found, api_docs.parameters_of(found), api_docs.models_of(units).join(own, "path")


#: (method, route, function, parameters, body, query).
OPERATIONS: dict[str, list[tuple]] = {
    JAVA: [("GET", "/api/orders~/{id}", "find", "id path true integer", "", ""), ("POST", "/api/orders~", "create", "", "Order", ""), ("GET", "/api/orders~/all", "all", "", "", "")],
    USERS: [("POST", "/users~", "create_user", "name query true string, mail query false string", "", "?name={value}&mail={value}"), ("GET", "/users~/{user_id}", "get_user", "user_id path true integer", "", "")],
    FLASK: [("GET", "/items~", "items", "", "", ""), ("POST", "/items~", "items", "", "", ""), ("GET", "/ping", "ping", "", "", "")],
    URLS: [("GET", "/items~/", "views", "", "", ""), ("GET", "/about/", "about_view", "", "", "")],
    EXPRESS: [("GET", "/shop~/{id}", "get__shop~_id", "id path true string", "", ""), ("POST", "/shop~", "post__shop~", "", "", "")],
    SHARP: [("GET", "/{id}", "Get", "id path true integer", "", ""), ("DELETE", "/", "Remove", "id query true integer", "", "?id={value}")],
}
_OPERATIONS = by_hand("want", "method, route, name, given, body, asked", OPERATIONS)


@query(
    f"""WITH {PROJECT_SQL}, {_OPERATIONS} SELECT project, {_shown('route')}, lower(method) AS method, 'Endpoint: ' || replace(name, '~', CAST(project AS VARCHAR)) AS description, given AS parameters,
    CASE WHEN body = '' THEN '' WHEN EXISTS (SELECT 1 FROM project_files o WHERE o.project = f.project AND o.path LIKE '%OrderRepository.java') THEN '$ref #/components/schemas/' || body ELSE 'type object' END AS body FROM project_files f JOIN want USING (kind)"""
)
def openapi_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of each project's OpenAPI document, read back from its JSON."""
    documents = api_docs.openapi(*_api(spark, sf_dir))
    read = documents.select("project", F.from_json("document", api_docs.DOCUMENT).alias("d")).filter("d.openapi = '3.0.0'")
    routes = read.select("project", F.explode("d.paths").alias("route", "operations"))
    each = routes.select("project", "route", F.explode("operations").alias("method", "o"))
    given = F.array_join(F.transform("o.parameters", lambda p: F.concat_ws(" ", p["name"], p["in"], p["required"].cast("string"), p["schema"]["type"])), ", ")
    body = F.coalesce(F.array_join(F.transform(F.map_entries(F.element_at("o.requestBody.content", "application/json")["schema"]), lambda e: F.concat_ws(" ", e["key"], e["value"])), ""), F.lit(""))
    return each.select("project", "route", "method", "o.description", given.alias("parameters"), body.alias("body"))


@query(
    f"""WITH {PROJECT_SQL}, {_OPERATIONS} SELECT project, method || ' ' || replace(route, '~', CAST(project AS VARCHAR)) AS name, '{{{{base_url}}}}' || replace(route, '~', CAST(project AS VARCHAR)) AS raw, body <> '' AND method = 'POST' AS has_body
    FROM project_files JOIN want USING (kind)"""
)
def postman_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each project's Postman collection, read back from its JSON."""
    found, given, _ = _api(spark, sf_dir)
    schema = "item array<struct<name string, request struct<url struct<raw string>, body struct<mode string>>>>"
    items = api_docs.postman(found, given).select("project", F.explode(F.from_json("document", schema)["item"]).alias("i"))
    return items.select("project", "i.name", "i.request.url.raw", F.col("i.request.body").isNotNull().alias("has_body"))


@query(
    f"""WITH {PROJECT_SQL}, {_OPERATIONS} SELECT project, method || ' ' || replace(route, '~', CAST(project AS VARCHAR)) AS endpoint,
    'curl -X ' || method || ' ''' || replace(route, '~', CAST(project AS VARCHAR)) || asked || '''' || CASE WHEN method = 'POST' THEN ' -H ''Content-Type: application/json'' -d ''{{}}''' ELSE '' END AS command FROM project_files JOIN want USING (kind)"""
)
def curl_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curl command for each endpoint."""
    found, given, _ = _api(spark, sf_dir)
    return api_docs.curl_commands(found, given)


@query(f"WITH {PROJECT_SQL}, {_WANT}, {_IMPORTED} SELECT DISTINCT a.project, a.src AS one, a.dst AS other FROM import_edges a JOIN import_edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def project_mutual_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files that import each other."""
    e = _cut(import_resolution(spark, sf_dir).select("project", "src", "dst").distinct())
    back = e.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["project", "src", "dst"]).filter("src < dst").select("project", F.col("src").alias("one"), F.col("dst").alias("other"))


def _transformed(files: DataFrame) -> DataFrame:
    """A third of the files is gone, a third as it was in another folder, and in a third two names are others."""
    kind = (F.col("file_no") - 1) % len(FILES) % 3
    text = F.when(kind == 2, F.replace(F.replace("content", F.lit("find("), F.lit("lookup(")), F.lit("items"), F.lit("things"))).otherwise(F.col("content"))
    return files.filter(kind > 0).select("project", F.concat(F.lit("new/"), "path").alias("path"), text.alias("content"))


#: By hand: names of classes and functions, less those that the transformation has renamed where it did.
_KEPT = f"""{PROJECT_SQL}, {_WANT}, {by_hand("routes", "framework, method, route, name, line", ENDPOINTS)},
code AS (SELECT project, kind, path FROM project_files WHERE regexp_matches(path, '[.](java|py|js|ts|tsx|cs|go)$')),
names AS (SELECT DISTINCT project, kind, path, name FROM code JOIN want USING (kind) WHERE symbol IN ('class', 'function', 'method')),
rows_ AS (SELECT c.project, c.path, c.kind, count(n.name) AS total, count(n.name) FILTER (WHERE c.kind % 3 = 1 OR c.kind % 3 = 2 AND n.name NOT IN ('find', 'items')) AS kept FROM code c LEFT JOIN names n ON c.path = n.path GROUP BY ALL),
scored AS (SELECT *, CASE WHEN kind % 3 = 0 THEN 0.0::DOUBLE WHEN total = 0 THEN 1.0::DOUBLE ELSE round(CAST(kept AS DOUBLE) / total, 3) END AS score FROM rows_)"""


@query(f"WITH {_KEPT} SELECT project, path, total, kept, score, CASE WHEN score >= 0.8 THEN 'preserved' WHEN score >= 0.5 THEN 'partial' ELSE 'lost' END AS verdict FROM scored")
def preserved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which classes and functions of each file its transformed counterpart still has."""
    return _preserved(spark, sf_dir)[0].select("project", "path", "total", "kept", "score", "verdict")


def _preserved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = project_files(spark, sf_dir)
    new = _transformed(files)
    units, new_units = _cut(lexing.code_units(files)), _cut(lexing.code_units(new))
    named = lambda u: symbols.code_symbols(u).filter(F.col("kind").isin("class", "function", "method"))
    routes = lambda u, f: symbols.endpoints(u).join(f.select("project", "path"), "path")
    return preservation.file_preservation(files, new, named(units), named(new_units)), preservation.route_preservation(routes(units, files), routes(new_units, new))


@query(
    f"""WITH {_KEPT}, r AS (SELECT project, round(CAST(count(*) FILTER (WHERE kept) AS DOUBLE) / count(*), 3) AS route_share FROM (
      SELECT DISTINCT project, method, route, kind % 3 = 1 OR kind % 3 = 2 AND route NOT LIKE '%items%' AS kept FROM project_files JOIN routes USING (kind)) x GROUP BY project),
    s AS (SELECT project, count(*) AS files_checked, count(*) FILTER (WHERE score >= 0.8) AS files_passed, round(avg(score), 3) AS score FROM scored GROUP BY project)
    SELECT s.project, files_checked, files_passed, score, coalesce(route_share, 1) AS route_share, score >= 0.75 AND coalesce(route_share, 1) >= 0.9 AS passed FROM s LEFT JOIN r USING (project)"""
)
def preservation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each project has kept enough of its names and routes."""
    return preservation.preservation_report(*_preserved(spark, sf_dir))
