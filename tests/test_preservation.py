"""What transformed files keep, on a small project."""

from stratalith.operators import preservation as P


def test_report(spark):
    files = lambda *rows: spark.createDataFrame(rows, "project string, path string, content string")
    names = lambda *rows: spark.createDataFrame(rows, "path string, name string")
    originals = files(("p", "a/Shop.java", "x"), ("p", "b/util.py", "x"), ("p", "gone.js", "x"), ("p", "empty.py", None), ("p", "notes.md", "x"), ("q", "one.go", "x"))
    new = files(("p", "z/shop.KT", "x"), ("p", "a/shop.kt", "x"), ("p", "util.ts", ""), ("q", "ONE.go", "x"))
    old_names = names(("a/Shop.java", "Shop"), ("a/Shop.java", "buy"), ("a/Shop.java", "sell"), ("a/Shop.java", "sell"), ("gone.js", "f"), ("b/util.py", "u"))
    new_names = names(("z/shop.KT", "Shop"), ("z/shop.KT", "buy"), ("a/shop.kt", "sell"))
    rows = P.file_preservation(originals, new, old_names, new_names)
    got = {r["path"]: (r["counterpart"], r["total"], r["kept"], r["missing"], r["score"], r["verdict"]) for r in rows.collect()}
    assert got == {
        "a/Shop.java": ("z/shop.KT", 3, 2, ["sell"], 0.667, "partial"),
        "b/util.py": ("util.ts", 1, 0, ["u"], 0.0, "lost"),
        "gone.js": (None, 1, 0, ["f"], 0.0, "lost"),
        "one.go": ("ONE.go", 0, 0, [], 1.0, "preserved"),
    }
    routes = lambda *rows: spark.createDataFrame(rows, "project string, method string, route string")
    kept = P.route_preservation(routes(("p", "GET", "/a"), ("p", "GET", "/a"), ("p", "PUT", "/a")), routes(("p", "GET", "/a"), ("q", "GET", "/z")))
    report = {r["project"]: (r["files_checked"], r["files_passed"], r["score"], r["route_share"], r["passed"]) for r in P.preservation_report(rows, kept).collect()}
    assert report == {"p": (3, 0, 0.222, 0.5, False), "q": (1, 1, 1.0, 1.0, True)}
    assert P.file_preservation(originals.limit(0), new, old_names, new_names).count() == 0
