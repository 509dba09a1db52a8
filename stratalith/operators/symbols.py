"""Names, routes and long methods of units of source code, by built-in expressions over their heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_TYPED = r"[\w<>\[\], .?]+"
_VERBS = "Get|Post|Put|Delete|Patch"
_CALLS = "get|post|put|delete|patch"
_SCRIPT = (
    ("class", r"\bclass (\w+)"),
    ("function", r"\bfunction (\w+)"),
    ("arrow_function", r"\b(?:const|let|var) (\w+) ?= ?(?:async )?\("),
    ("import", r'^import .*from "(\d+)"'),
    ("require", r'\brequire ?\("(\d+)"'),
    ("express_route", rf'\b(?:app|router)\.(?:{_CALLS}) ?\("(\d+)"'),
    ("react_component", r"\b(?:function|const) (\w+).*(?:React|JSX|tsx)"),
)
#: For each language what a head may hold, and the group that names it; a number in quotes stands for a string.
PATTERNS: dict[str, tuple[tuple[str, str], ...]] = {
    "Java": (
        ("class", r"\bclass (\w+)"),
        ("interface", r"(?<!@)\binterface (\w+)"),
        ("method", rf"\b(?:public|private|protected) {_TYPED} (\w+) ?\("),
        ("import", r"^import (?:static )?([\w.]+(?:\.\*)?)$"),
        ("annotation", r"@(?!interface)(\w+)"),
        ("rest_endpoint", rf'@(?:{_VERBS})Mapping ?\( ?(?:(?:value|path) ?= ?)?\{{? ?"(\d+)"'),
        ("request_mapping", r'@RequestMapping ?\( ?(?:(?:value|path) ?= ?)?\{? ?"(\d+)"'),
        ("ejb", r"@(Stateless|Stateful|Singleton|MessageDriven)\b"),
        ("entity", r"@Entity\b.*\bclass (\w+)"),
        ("table", r'@Table ?\( ?name ?= ?"(\d+)"'),
        ("sql_query", r'(?:createQuery|createNativeQuery|@NamedQuery) ?\( ?"(\d+)"'),
        ("jpa_repository", r"extends (?:JpaRepository|CrudRepository|PagingAndSortingRepository) ?< ?(\w+)"),
    ),
    "Python": (
        ("class", r"^(?:@.* )?class (\w+)"),
        ("function", r"^(?:@.* )?(?:async )?def (\w+) ?\("),
        ("import", r"^(?:from|import) ([\w.]+)"),
        ("decorator", r"^@(\w+)|(?<=[ )])@(\w+)"),
        ("flask_route", r'@\w+\.route ?\("(\d+)"'),
        ("fastapi_route", rf'@\w+\.(?:{_CALLS}) ?\("(\d+)"'),
        ("django_url", r'\bpath ?\("(\d+)"'),
        ("sql_query", r'\bexecute ?\("(\d+)"'),
        ("sqlalchemy_model", r"class (\w+)\(.*(?:Base|Model).*\)"),
    ),
    "JavaScript": _SCRIPT,
    "TypeScript": _SCRIPT,
    "C#": (
        ("class", r"\bclass (\w+)"),
        ("method", rf"\b(?:public|private|protected|internal) {_TYPED} (\w+) ?\("),
        ("import", r"^using ([\w.]+)$"),
        ("attribute", r"(?:^|\] ?)\[(\w+)"),
        ("api_route", rf'\[(?:Http(?:{_VERBS})|Route) ?\("(\d+)"'),
        ("entity", r'\[Table ?\("(\d+)"\)'),
    ),
    "SQL": (
        ("create_table", r"(?i)^create table (?:if not exists )?(?:\w+\.)?(\w+)"),
        ("create_view", r"(?i)^create (?:or replace )?view (?:\w+\.)?(\w+)"),
        ("create_procedure", r"(?i)^create (?:or replace )?procedure (?:\w+\.)?(\w+)"),
        ("create_function", r"(?i)^create (?:or replace )?function (?:\w+\.)?(\w+)"),
        ("create_index", r"(?i)^create (?:unique )?index (?:\w+\.)?(\w+) on"),
        ("alter_table", r"(?i)^alter table (?:\w+\.)?(\w+)"),
        ("foreign_key", r"(?i)\bforeign key ?\( ?(\w+) ?\) ?references\b"),
        ("column_def", r"(?i)[(,] ?(\w+) (?:varchar|int|integer|bigint|decimal|numeric|date|timestamp|boolean|text|clob|blob|char|float|double)\b"),
    ),
    "Go": (
        ("function", r"^func (?:\([^)]*\) ?)?(\w+) ?\("),
        ("struct", r"\btype (\w+) struct\b"),
        ("interface", r"\btype (\w+) interface\b"),
        ("import", r'^import\b|"(\d+)"'),
    ),
    "COBOL": (
        ("program_id", r"(?i)program-id\. (\w+)"),
        ("section", r"(?i)(\w[\w-]*) section\."),
        ("paragraph", r"^(\w[\w-]*)\.$"),
        ("copy", r"(?i)\bcopy (\w+)"),
        ("call", r'(?i)\bcall "(\d+)"'),
        ("sql_exec", r"(?i)exec sql (.*?) end-exec"),
    ),
}


def quoted(number: Column) -> Column:
    """The string of a unit that a number in its head stands for."""
    return F.get("strings", number.cast("int"))


_NAMES = "array<struct<kind:string,quoted:boolean,names:array<string>>>"


def found(language: str, kind: str, pattern: str) -> Column:
    """A kind and its names in a unit's head, as an array; quoted: they are numbers of strings."""
    if kind == "decorator":
        names = F.regexp_extract_all("head", F.lit(r"(?:^|[ )])@(\w+)"), F.lit(1))
    elif language == "Go" and kind == "import":
        names = F.when(F.col("head").startswith("import"), F.regexp_extract_all("head", F.lit(r'"(\d+)"'), F.lit(1)))
    elif language == "COBOL" and kind == "paragraph":
        names = F.when(F.col("depth") == 0, F.regexp_extract_all("head", F.lit(pattern), F.lit(1)))
    else:
        names = F.regexp_extract_all("head", F.lit(pattern), F.lit(1))
    return F.struct(F.lit(kind).alias("kind"), F.lit(r'"(\d+)"' in pattern).alias("quoted"), names.alias("names"))


def code_symbols(units: DataFrame, *kinds: str) -> DataFrame:
    """(path, language, kind, name, start_line, end_line, unit): what the patterns find in the heads of units, those of these kinds alone if any are named."""
    each = F.lit(None).cast(_NAMES)
    for language, patterns in PATTERNS.items():
        if asked := [found(language, *p) for p in patterns if not kinds or p[0] in kinds]:
            each = F.when(F.col("language") == language, F.array(*asked)).otherwise(each)
    # strings are looked up once for all kinds, below, not in an expression of each
    each = F.filter(each, lambda x: F.size(x["names"]) > 0)
    held = ["path", "language", "start_line", "end_line", "unit"]
    rows = units.select(*held, "strings", F.explode(each).alias("x")).select(*held, "strings", "x.kind", "x.quoted", F.explode("x.names").alias("name"))
    name = F.when(F.col("quoted"), quoted(F.col("name"))).otherwise(F.col("name"))
    return rows.select("path", "language", "kind", name.alias("name"), "start_line", "end_line", "unit").filter(F.col("name") != "")


def _method() -> tuple[Column, Column, Column]:
    """Whether a unit is a block of a language with methods, the name of its method or function, empty if it is none, and its lines."""
    java, named = rf"\b(?:public|private|protected) {_TYPED} (\w+) ?\(", r"\b(?:def|function|func(?: \([^)]*\))?|const) (\w+)"
    name = F.when(F.col("language").isin("Java", "C#"), F.regexp_extract("head", java, 1)).otherwise(F.regexp_extract("head", named, 1))
    return (F.col("kind") == "block") & F.col("language").isin("Java", "C#", "Python", "JavaScript", "TypeScript", "Go"), name, F.col("end_line") - F.col("start_line") + 1


def methods(units: DataFrame) -> DataFrame:
    """(path, name, lines, start_line): methods and functions that have a body, decorators and annotations counted in."""
    block, name, lines = _method()
    return units.filter(block).select("path", name.alias("name"), lines.alias("lines"), "start_line").filter("name <> ''")


def anti_patterns(units: DataFrame, most: int = 50) -> DataFrame:
    """(path, pattern, detail, line): global variables of Python, and methods of over `most` lines."""
    block, name, lines = _method()
    row = lambda condition, pattern, detail: F.when(condition, F.struct(F.lit(pattern).alias("pattern"), detail.alias("detail")))
    one = row((F.col("language") == "Python") & F.col("head").startswith("global "), "global variable", F.substring_index("head", " ", -1))
    # a name is looked for in long blocks alone
    long = row(block & (lines > most), "long method", name)
    # both in one pass: units cost a scan
    found = units.select("path", F.col("start_line").alias("line"), F.explode(F.array_compact(F.array(one, long))).alias("x"))
    return found.filter("x.pattern <> 'long method' or x.detail <> ''").select("path", "x.pattern", "x.detail", "line")


def endpoints(units: DataFrame) -> DataFrame:
    """(path, framework, method, route, function, line, parameters) of web endpoints; parameters: what stands between the function's brackets.

    A Spring route starts with its class's; Flask gives a row for each of a route's
    methods; Express routes have no function, so one is named by verb and route;
    Django routes count in files called urls.py alone, all as GET.
    """
    one = lambda rx, k=1: F.regexp_extract("head", rx, k)
    string = lambda rx, k=1: F.coalesce(quoted(F.nullif(one(rx, k), F.lit(""))), F.lit(""))
    # what follows the function's own name, up to the last bracket
    after = lambda name: F.regexp_extract(F.element_at(F.split("head", F.concat(F.lit(r"\b"), name, F.lit(r" ?\("))), -1), r"^(.*)\)", 1)
    # scope: the unit of the class whose route it starts with; a class's own route is a row without a framework
    row = lambda framework, method, route, function, given=F.lit(""), scope=F.lit(None): F.struct(F.lit(framework).cast("string").alias("framework"), F.upper(method).alias("method"), route.alias("route"), function.alias("function"), given.alias("parameters"), scope.cast("int").alias("scope"))
    where = lambda condition, x: F.when(condition, F.array(x))
    has = lambda rx: F.col("head").rlike(rx)
    java_name = one(rf"\b(?:public|private|protected) {_TYPED} (\w+) ?\(")
    none = F.lit(None).cast("string")

    mapping = rf"@({_VERBS}|Request)Mapping\b ?(?:\(([^)]*)\))?"
    prefix = where(has(r"@RequestMapping.*\bclass \w"), row(None, none, string(r'@RequestMapping ?\([^)"]*"(\d+)"'), none, none, F.col("unit")))
    own = F.coalesce(quoted(F.nullif(F.regexp_extract(one(mapping, 2), r'"(\d+)"', 1), F.lit(""))), F.lit(""))
    verb = F.when(one(mapping) == "Request", F.lit("GET")).otherwise(one(mapping))
    spring = where(has(mapping) & (java_name != ""), row("Spring", verb, own, java_name, after(java_name), F.col("parent")))

    def_name = one(r"\bdef (\w+) ?\(")
    given = F.transform(F.regexp_extract_all(one(r"methods ?= ?[\[(]([^\])]*)"), F.lit(r'"(\d+)"'), F.lit(1)), quoted)
    verbs = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit("GET")))
    flask = F.when((def_name != "") & has(r'@\w+\.route ?\("'), F.transform(verbs, lambda v: row("Flask", v, string(r'@\w+\.route ?\("(\d+)"'), def_name, after(def_name))))
    fast = rf'@(?:app|router)\.({_CALLS}) ?\("(\d+)"'
    fastapi = where((def_name != "") & has(fast), row("FastAPI", one(fast), string(fast, 2), def_name, after(def_name)))
    pairs = F.arrays_zip(*[F.regexp_extract_all("head", F.lit(r'\bpath ?\("(\d+)"\W+(\w+)'), F.lit(k)).alias(f"g{k}") for k in (1, 2)])
    django = F.when(F.col("path").contains("urls.py"), F.transform(pairs, lambda x: row("Django", F.lit("GET"), quoted(x["g1"]), x["g2"])))

    express = rf'\b(?:app|router)\.({_CALLS}) ?\("(\d+)"'
    name = F.concat(one(express), F.lit("_"), F.translate(string(express, 2), "/:", "_"))
    routes = where(has(express), row("Express", one(express), string(express, 2), name))

    http = rf'\[Http({_VERBS})(?: ?\("(\d+)")?'
    sharp = where(has(http) & (java_name != ""), row("ASP.NET", one(http), string(http, 2), java_name, after(java_name)))

    language = F.col("language")
    each = F.when(language == "Java", F.array(prefix, spring)).when(language == "Python", F.array(flask, fastapi, django)).when(language.isin("JavaScript", "TypeScript"), F.array(routes)).when(language == "C#", F.array(sharp))
    # all in one pass: units cost a scan
    found = units.select("path", F.col("start_line").alias("line"), F.explode(F.flatten(F.array_compact(each))).alias("x")).select("path", "line", "x.*")
    start = F.max(F.when(F.col("framework").isNull(), F.col("route"))).over(W.partitionBy("path", "scope"))
    route = F.when(F.col("framework") == "Spring", F.replace(F.concat(F.coalesce("start", F.lit("")), "route"), F.lit("//"), F.lit("/"))).otherwise(F.col("route"))
    return found.withColumn("start", start).filter("framework is not null").select("path", "framework", "method", route.alias("route"), "function", "line", "parameters")
