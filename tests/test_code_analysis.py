"""The scan of source files, import resolution and longest paths, on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from stratalith.operators import imports, lexing, paths, symbols


def longest(edges, start):
    """(length, path) by all simple paths."""
    after = {}
    for a, b in edges:
        if a != b:
            after.setdefault(a, set()).add(b)
    best, todo = (1, [start]), [[start]]
    while todo:
        p = todo.pop()
        if len(p) > best[0] or len(p) == best[0] and p < best[1]:
            best = (len(p), p)
        todo += [[*p, b] for b in after.get(p[-1], ()) if b not in p]
    return best


@pytest.mark.parametrize("seed, n, m", [(2, 9, 22), (3, 16, 20)])
def test_longest_paths_of_random_graphs(spark, seed, n, m):
    r = random.Random(seed)
    name = lambda: f"n{r.randrange(n):02d}"
    edges = [(name(), name()) for _ in range(m)]
    df = spark.createDataFrame([*edges, edges[0], (None, "n00"), ("n00", None)], "src string, dst string")
    starts = [f"n{i:02d}" for i in range(n)] + ["alone"]
    got = {x["start"]: (x["length"], x["path"]) for x in paths.longest_from(df, spark.createDataFrame([(s,) for s in starts], "node string")).collect()}
    assert got == {s: longest(edges, s) for s in starts}


def test_longest_path_over_many_layers_and_without_edges(spark):
    chain = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(12)]
    df = spark.createDataFrame(chain, "src string, dst string")
    start = spark.createDataFrame([("a000",)], "node string")
    assert paths.longest_from(df, start).first()["length"] == 13
    assert paths.longest_from(df.limit(0), start).first()["path"] == ["a000"]


def test_entry_points_and_impact(spark):
    edges = spark.createDataFrame([("f", "c"), ("c", "m"), ("g", "h")], "src string, dst string")
    nodes = spark.createDataFrame([("x", 1, "f", "file"), ("x", 2, "g", "file"), ("x", 3, "h", "file"), ("x", 4, "c", "class"), ("x", 5, "m", "function")], "graph string, place int, node string, type string")
    starts = paths.entry_points(nodes, edges)
    assert {x["node"] for x in starts.collect()} == {"f", "g"}
    assert {x["node"] for x in paths.entry_points(nodes, edges, 1).collect()} == {"f"}
    got = paths.critical_paths(nodes, edges, starts).collect()
    assert [(x["start"], x["length"], x["path"], x["impact"]) for x in got] == [("f", 3, ["f", "c", "m"], 6.5)]


def scanned(path, text):
    return [(x[5], x[8], x[6], x[7], x[3]) for x in lexing.units_of(path, lexing.EXTENSIONS[path.rsplit(".", 1)[1]], text)]


def test_units_of_awkward_texts():
    assert scanned("A.java", 'class A { String s = "{"; // {\n/* { */ void f() { } }') == [("block", "class A", 1, 2, None), ("statement", 'String s = "0"', 1, 1, 0), ("block", "void f()", 2, 2, 0)]
    # never closed, closed too often, nothing at all
    assert scanned("A.java", "class A { void f() {") == [("block", "class A", 1, 1, None), ("block", "void f()", 1, 1, 0)]
    assert scanned("A.java", "} } class A { }")[0][:2] == ("block", "class A")
    assert [scanned(f"a.{x}", t) for x in lexing.EXTENSIONS for t in ("", "\n\n", "   ")] == [[]] * 3 * len(lexing.EXTENSIONS)
    assert scanned("a.py", "x = '''a\nb'''\ny = (1,\n 2)\nif x:\n\tif y:\n\t\tz()\nw()") == [
        ("statement", 'x = "0"', 1, 2, None),
        ("statement", "y = (1, 2)", 3, 4, None),
        ("block", "if x:", 5, 7, None),
        ("block", "if y:", 6, 7, 2),
        ("statement", "z()", 7, 7, 3),
        ("statement", "w()", 8, 8, None),
    ]
    assert scanned("a.sql", "SELECT ';' -- ;\n; select 2") == [("statement", 'SELECT "0"', 1, 2, None), ("statement", "select 2", 2, 2, None)]
    assert scanned("a.js", "const a = `x ${y} {`\nfoo(function () {\n  bar()\n})")[:2] == [("statement", 'const a = "0"', 1, 1, None), ("block", "foo(function ()", 2, 4, None)]


def test_units_of_null_and_unknown_files(spark):
    files = spark.createDataFrame([("a.py", None), ("b.txt", "class A"), (None, "class B"), ("c.PY", "class C:\r\n  pass\r\n")], "path string, content string")
    got = symbols.code_symbols(lexing.code_units(files)).collect()
    assert [(x["path"], x["kind"], x["name"], x["end_line"]) for x in got] == [("c.PY", "class", "C", 2)]
    assert lexing.code_units(files.limit(0)).count() == 0


def test_imports_take_the_first_whole_segments(spark):
    paths_ = ["x/com/shop/Orders.java", "x/com/shop/Order.java", "y/com/shop/Order.java", "x/lib/com/shop/Order.java", "x/telecom/shop/Bill.java", "x/web/a/b.ts", "x/web/c.ts"]
    files = spark.createDataFrame([("x", i, p) for i, p in enumerate(paths_)], "project string, file_no int, path string")
    asked = [("com.shop.Order", paths_[0]), ("com.shop.Order", paths_[1]), ("com.shop.*", paths_[5]), ("shop.Bill", paths_[0]), ("../c", paths_[5]), ("./a/b", paths_[6]), ("../../../../c", paths_[5]), ("nothing", paths_[0])]
    rows = spark.createDataFrame([("x", p, n) for n, p in asked], "project string, path string, name string")
    got = {(r["src"], r["import"]): r["dst"] for r in imports.resolved(files, rows).collect()}
    assert got == {(paths_[0], "com.shop.Order"): paths_[1], (paths_[5], "com.shop.*"): paths_[0], (paths_[0], "shop.Bill"): paths_[4], (paths_[5], "../c"): paths_[6], (paths_[6], "./a/b"): paths_[5]}


def test_endpoint_of_a_class_without_a_route(spark):
    text = '@RequestMapping\npublic class A {\n  @RequestMapping(path = "/x")\n  public int f() { }\n  @DeleteMapping\n  public void g() { }\n}'
    files = spark.createDataFrame([("A.java", text)], "path string, content string")
    got = symbols.endpoints(lexing.code_units(files)).orderBy("line").collect()
    assert [(r["method"], r["route"], r["function"]) for r in got] == [("GET", "/x", "f"), ("DELETE", "", "g")]
    assert symbols.methods(lexing.code_units(files)).filter(F.col("lines") > 1).count() == 2
