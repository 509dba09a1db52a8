"""What must stay so that queries over projects grow with their input: tasks, and scans of a file."""

import pytest

from stratalith.functions import udtfs
from stratalith.operators import api_docs, imports, lexing, symbols
from stratalith.plans import code_analysis
from stratalith.plans.project_corpus import project_files
from stratalith.sources.tables import dealt

DATA = "/root/testdata/sf0.001"


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_files_are_dealt_over_tasks(spark):
    assert project_files(spark, DATA).rdd.getNumPartitions() == 4
    assert dealt(spark.range(10), 45, "id", each=5).rdd.getNumPartitions() == 9


def test_a_file_is_scanned_once(spark):
    units = lexing.code_units(spark.createDataFrame([("a.py", "x")], "path string, content string"))
    assert scans(symbols.endpoints(units)) == scans(api_docs.models_of(units)) == 1


@pytest.mark.parametrize("name", ["project_graph", "preservation_reports", "postman_collections", "curl_by_project", "project_mutual_imports", "graph_critical_paths"])
def test_shared_steps_are_stored(spark, name):
    assert scans(getattr(code_analysis, name)(spark, DATA)) <= 1


def test_units_of_many_files_in_one_task(spark):
    rows = [(f"{k}.py", f"def f{k}():\n    return {k}\n") for k in range(6000)] + [("b.py", ""), ("c.py", None)]
    units = lexing.code_units(spark.createDataFrame(rows, "path string, content string").coalesce(1)).collect()
    assert sorted((u.path, u.head) for u in units) == sorted(x for k in range(6000) for x in [(f"{k}.py", f"def f{k}():"), (f"{k}.py", f"return {k}")])


def test_routes_and_models_of_nested_classes(spark):
    text = """@RequestMapping("/a")
class A {
  @GetMapping("/x")
  public int x() { return 1; }
  private String one;
  @RequestMapping("/b")
  class B {
    @PostMapping
    public int y(int n) { return 1; }
    private long two;
  }
}
@GetMapping("/z")
public int z() { return 1; }
private int three;
"""
    units = lexing.code_units(spark.createDataFrame([("A.java", text), ("B.java", text.replace("/", "//"))], "path string, content string"))
    routes = {(r.path, r.method, r.route, r.function) for r in symbols.endpoints(units).collect()}
    assert routes == {(p, *x) for p in ("A.java", "B.java") for x in [("GET", "/a/x", "x"), ("POST", "/b", "y"), ("GET", "/z", "z")]}
    assert {(r.path, r.model, r.name, r.type) for r in api_docs.models_of(units).collect()} == {(p, *x) for p in ("A.java", "B.java") for x in [("A", "one", "String"), ("B", "two", "long")]}


def test_imports_are_resolved_by_hashes_of_numbers(spark):
    plan = code_analysis.import_resolution(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "api_route" not in plan and "express_route" not in plan


def test_first_file_of_equal_and_missing_numbers(spark):
    files = spark.createDataFrame([(1, 5, "b/x.py"), (1, 5, "a/x.py"), (1, None, "A/x.py"), (1, 6, "m.py"), (2, None, "x.py")], "project long, file_no long, path string")
    asked = spark.createDataFrame([(1, "m.py", "x"), (2, "n.py", "x")], "project long, path string, name string")
    assert [tuple(r) for r in imports.resolved(files, asked).collect()] == [(1, "m.py", "a/x.py", "x")]


def test_symbols_of_some_kinds(spark):
    units = lexing.code_units(spark.createDataFrame([("a.py", "import os\nclass A:\n    pass\n"), ("b.cbl", "       PROGRAM-ID. B.\n")], "path string, content string"))
    assert [(r.path, r.kind, r.name) for r in symbols.code_symbols(units, "import").collect()] == [("a.py", "import", "os")]
    assert symbols.code_symbols(units, "none").collect() == []


def test_anti_patterns_are_found_in_one_scan(spark):
    text = "def f():\n    global a, b\n    return 1\nif x:\n    pass\n    pass\nglobal c\n"
    units = lexing.code_units(spark.createDataFrame([("a.py", text)], "path string, content string"))
    found = symbols.anti_patterns(units, most=2)
    assert scans(found) == 1
    assert sorted(map(tuple, found.collect())) == [("a.py", "global variable", "b", 2), ("a.py", "global variable", "c", 7), ("a.py", "long method", "f", 1)]


@pytest.mark.parametrize("call", ["code_units(f.path, f.content)", "ddl_columns(f.content)"])
def test_table_functions_read_the_files_that_are_asked_for(spark, call):
    udtfs.register(spark)
    spark.range(9).selectExpr("concat(id, '.sql') AS path", "string(id) AS content").createOrReplaceTempView("asked_files")
    plan = spark.sql(f"SELECT f.path, u.* FROM asked_files f, LATERAL {call} u WHERE f.path LIKE '%7.sql'")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("PythonUDTF") < plan.find("Filter")


def test_names_of_all_kinds_take_one_lambda(spark):
    text = "@app.route('/a')\n@b\ndef f():\n    execute('select 1')\n    execute(x)\n    execute('')\n"
    units = lexing.code_units(spark.createDataFrame([("a.py", text), ("b.cbl", "       CALL 'X'.\n")], "path string, content string"))
    found = symbols.code_symbols(units)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(") == 1
    want = [("decorator", "app"), ("decorator", "b"), ("flask_route", "/a"), ("function", "f"), ("sql_query", "select 1"), ("call", "X")]
    assert sorted((r.kind, r.name) for r in found.collect()) == sorted(want)


def test_words_of_python_are_one_token():
    tokens = [m[0] for m in lexing._INDENTED.finditer("for buffer in fub'r' + rb'u' + x:\n")]
    assert tokens == ["for buffer in f", "ub'r'", " + ", "rb'u'", " + x:", "\n"]
