"""The project store, the stage graph, and operators over source code, on small inputs."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.operators import compare, embedding, matches, splitting
from stratalith.plans.stages import Cancelled, Stage, StageGraph
from stratalith.sources import store


def files(spark, *rows):
    return spark.createDataFrame(rows, "path string, language string, content string")


def test_projects(spark, tmp_path):
    s = store.ProjectStore(spark, f"file://{tmp_path}/store")
    assert s.projects().count() == 0
    with pytest.raises(ValueError):
        s.create_project("p", "  ")
    s.create_project("p", " one ", "first")
    s.create_project("q", "two")
    s.update_project("p", description="changed")
    s.set_status("p", "running")
    p = s.project("p").first()
    assert (p.name, p.description, p.status) == ("one", "changed", "running") and p.updated_at > p.created_at
    with pytest.raises(ValueError):
        s.update_project("p", name="")
    s.put_files("p", files(spark, ("a.py", "python", "x\n\n y")))
    s.put_files("q", files(spark, ("b.py", "python", "x")))
    s.delete_project("p")
    assert [r.project_id for r in s.projects().collect()] == ["q"]
    assert [(r.path, r.loc) for r in s.read("files").collect()] == [("b.py", 1)]


def test_results_and_fallback(spark, tmp_path):
    s = store.ProjectStore(spark, f"file://{tmp_path}/store")
    s.append_result("p", "api", "1")
    s.append_result("p", "api", "2")
    s.append_result("p", "old_database", "3")
    assert {(r.result_type, r.data) for r in s.results().collect()} == {("api", "2"), ("old_database", "3")}
    look = lambda *a, **b: [r.data for r in s.result("p", *a, **b).collect()]
    assert look(["database", "old_database"]) == ["3"]
    assert look(["database", "old_database"], given=spark.createDataFrame([("memory", "0")], "result_type string, data string")) == ["0"]
    assert look(["none"], default="{}") == ["{}"] and look(["none"]) == []


def test_transformed_runs_vectors(spark, tmp_path):
    s = store.ProjectStore(spark, f"file://{tmp_path}/store")
    for p, text in (("p", "a"), ("q", "b"), ("p", "c\nd")):
        s.replace_transformed(p, files(spark, ("x", "python", text)))
    assert {(r.project_id, r.content, r.size, r.loc) for r in s.read("transformed").collect()} == {("p", "c\nd", 3, 2), ("q", "b", 1, 1)}
    s.start_run("p", "r1", "parse")
    s.complete_run("p", "r1", "parse", data="ok")
    s.start_run("p", "r1", "graph")
    assert {(r.stage, r.event) for r in s.runs().collect()} == {("parse", "completed"), ("graph", "running")}
    context = spark.createDataFrame([("layer", "web", "{}")], "kind string, name string, data string")
    s.store_orchestration("p", files(spark, ("a", "x", "y")), context, {"api": "{}"}, "analysed")
    assert [s.read(t).count() for t in ("files", "context", "results")] == [1, 1, 1] and s.project("p").first().status == "analysed"
    v = embedding.vector_store(files(spark, ("a", "x", "one two"), ("b", "x", None), ("c", "x", "two")), splitting.transform_chunks)
    s.save_vectors("p", v)
    s.save_vectors("p", v)
    got = {r.chunk_id: r.embedding for r in s.load_vectors("p").collect()}
    assert set(got) == {"a:0", "c:0"} and np.allclose(got["c:0"], embedding.hashing_embedder(["two"])[0])


def test_zip(spark):
    z = zipfile.ZipFile(io.BytesIO(store.artifact_zip(files(spark, ("b/x.py", "", "1"), ("a", "", None)))))
    assert z.namelist() == ["a", "b/x.py", "README.md"] and z.read("b/x.py") == b"1"
    assert zipfile.ZipFile(io.BytesIO(store.artifact_zip(files(spark, ("docs/ReadMe.txt", "", "1"))))).namelist() == ["docs/ReadMe.txt"]


def test_embedder_sees_bounded_batches(spark):
    sizes = []
    embedding.hashing_embedder([])

    def embedder(texts):
        assert len(texts) <= 3
        sizes.append(len(texts))
        return np.array([[len(t)] for t in texts], np.float32)

    rows = spark.createDataFrame([(i, "x" * i, "z") for i in range(10)] + [(99, None, "z")], "id int, text string, `odd name` string")
    got = {r.id: (r.embedding, r["odd name"]) for r in embedding.embedded(rows, "text", embedder, 3).collect()}
    assert got[4] == ([4.0], "z") and got[99] == ([0.0], "z") and len(got) == 11


def test_stage_graph(spark, tmp_path):
    ran, broken = [], [True]

    def stage(name, f, when=lambda s: True):
        def run(state):
            ran.append(name)
            return f(state)

        return Stage(name, run, when)

    def fails_once(state):
        if broken:
            broken.pop()
            raise RuntimeError("lost")
        return {"c": state["b"].withColumn("z", F.lit(1))}

    g = StageGraph(spark, [stage("one", lambda s: {"b": s["a"].filter("id > 1")}), stage("none", lambda s: {}, lambda s: "no" in s), stage("two", fails_once), stage("three", lambda s: {"d": s["c"].limit(1)})], f"file://{tmp_path}/g")
    state = {"a": spark.range(5).toDF("id")}
    with pytest.raises(RuntimeError):
        g.run(state)
    assert g.status() == {"one": "completed", "none": "skipped", "two": "failed", "three": "pending"}
    out = g.run(state, "two")
    assert ran == ["one", "two", "two", "three"] and out["c"].count() == 3 and out["d"].count() == 1
    g.run(state, "three")
    assert ran[4:] == ["three"] and set(g.status().values()) == {"completed", "skipped"}
    g.stages[0].run = lambda s: g.cancel() or {"b": s["a"]}
    with pytest.raises(Cancelled):
        g.run(state)
    assert g.status()["none"] == "cancelled"


JAVA = "package a;\nimport b;\nimport c;\n\n@Service\npublic class A {\n  int f() { return 1; }\n}\n// end\nclass B { }\n"
PYTHON = "import os\nfrom x import y\n\nZ = 1\n\n@dec\ndef f(a):\n    return a\n\n\nclass C:\n    def g(self): pass\n"


def test_structured_chunks(spark):
    got = splitting.code_chunks(files(spark, ("A.java", "", JAVA), ("p.py", "", PYTHON), ("bad.py", "", "def ("), ("t.ts", "", "import a from 'a';\nexport const f = (x) => {\n  return x;\n};\n"), ("n.txt", "", None)), 50)
    rows = {p: [(r.kind, r.name, r.start_line, r.end_line) for r in got.filter(F.col("path") == p).orderBy("chunk").collect()] for p in ("A.java", "p.py", "bad.py", "t.ts", "n.txt")}
    assert rows["A.java"] == [("imports", "", 1, 3), ("remaining", "", 4, 5), ("class", "A", 6, 8), ("remaining", "", 9, 9), ("class", "B", 10, 10)]
    assert rows["p.py"] == [("imports", "", 1, 2), ("remaining", "", 3, 5), ("function", "f", 6, 8), ("class", "C", 11, 12)]
    assert rows["bad.py"] == [("generic", "", 1, 1)] and rows["n.txt"] == []
    assert rows["t.ts"] == [("imports", "", 1, 1), ("function", "f", 2, 4)]


def test_pieces_and_reassembly(spark):
    text = "import os\n" + "".join(f"def f{i}():\n    return {i}\n" for i in range(20)) + "x = 1\n" * 60
    pieces = list(splitting.by_size(text, 100))
    assert "".join(p for p, _, _ in pieces) == text and max(len(p) for p, _, _ in pieces) <= 120
    assert all(p.startswith("def ") for p, _, _ in pieces[1:5])
    assert list(splitting.by_size("a" * 500 + "\nb\n", 100)) == [("a" * 500 + "\n", 1, 1), ("b\n", 2, 2)]
    chunks = spark.createDataFrame([("a.py", 0, "import a\nx\n"), ("a.py", 1, "import a\n  from b import c\ny\n"), ("a.js", 0, "p"), ("a.js", 1, "import q")], "path string, chunk int, body string")
    assert {r.path: r.content for r in splitting.reassembled(chunks).collect()} == {"a.py": "import a\nx\n\n\ny", "a.js": "p\n\nimport q"}


@pytest.mark.parametrize("text,parts", [("", []), ("a, b", ["a", "b"]), ("f(a, b), c[1, 2] d, ", ["f(a, b)", "c[1, 2] d"]), ("a, (b, c", ["a", "(b, c"]), (None, None)])
def test_split_parameters(spark, text, parts):
    assert spark.createDataFrame([(text,)], "t string").select(splitting.split_parameters("t").alias("p")).first().p == parts


def test_matches_of_odd_texts(spark):
    got = matches.matches(spark.createDataFrame([(1, "ab\nxab"), (2, None), (3, ""), (4, "none")], "id int, text string"), "text", "a(?=b)", 1)
    assert [(r.id, r.match, r.line, r.context) for r in got.orderBy("id", "line").collect()] == [(1, "a", 1, "ab"), (1, "a", 2, "xab")]


def test_comparisons_of_nothing(spark):
    none = spark.createDataFrame([], "name string")
    some = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    assert tuple(compare.schema_comparison(none, some).first()) == (1, 0, 1, False)
    assert compare.structural_score(compare.name_sets(none, some), compare.name_sets(some, none)).first().structural_score == 0.6
    assert compare.endpoint_comparison(none, some).first().modernization_score == 100
    targets = spark.createDataFrame([], "kind string, technology string")
    assert tuple(compare.migration_success(targets, some).first()) == ([], 0.0, True)


def test_validators(spark):
    from stratalith.operators.summaries import Validators, overall, recommendations_of

    v = Validators()
    v.register("files", lambda f: (f["files"].count() / 2, ["add files", "test more"]))
    v.register("broken", lambda f: 1 / 0)
    v.register("sure", lambda f: (1.0, ["test more"]))
    rows, status = v.run(spark, {"files": spark.range(1)}, [("files", 0.6), ("broken", 0.5), ("sure", 0.9), ("unknown", 0.1)])
    assert [(r.rule_type, r.status, r.passed) for r in rows.collect()] == [("files", "rejected", False), ("broken", "requires_review", False), ("sure", "approved", True), ("unknown", "requires_review", False)]
    assert status == "rejected"
    assert [r[0] for r in recommendations_of(rows).collect()] == ["add files", "test more", "Manual review required due to validation error"]
    assert overall([]) == "approved" and overall([("security_check", 0.0, False)] + [("x", 1.0, True)] * 9) == "requires_review"


def test_documentation_and_fallback(spark):
    from stratalith.operators.summaries import documentation, stack_fallback

    f = spark.createDataFrame([("a.py", "def f"), ("b.py", None)], "path string, content string")
    names = spark.createDataFrame([("a.py", "B"), ("a.py", "A"), ("b.py", "A")], "path string, name string")
    assert documentation(f, names, names.limit(0)).first()[0] == "# Codebase\n\nFiles: 2\n\nClasses: A, B\n\nFunctions: "
    sure = spark.createDataFrame([("Go",)], "technology string")
    assert [r[0] for r in stack_fallback(f, sure).collect()] == ["Go"] and [r[0] for r in stack_fallback(f, sure.limit(0)).collect()] == ["Python"]


@pytest.mark.parametrize("block", [2, 100])
def test_nearest_vectors(spark, block):
    from stratalith.operators.vectors import top_k

    r = np.random.default_rng(4)
    x = r.integers(-2, 3, (3000, 4)).astype(float)  # small numbers, so that there are many ties
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)] + [(77, None)], "query_id long, query array<float>")
    got = {}
    for row in top_k(queries, vectors, 7, block=block).collect():
        got.setdefault(row.query_id, {})[row.place] = (row.vec_id, row.score)
    want = {}
    for i in range(5):
        s = x @ x[i]
        order = np.lexsort((np.arange(len(x)), -s))[:7]
        want[i] = {p: (int(v), float(s[v])) for p, v in enumerate(order, 1)}
    assert got == want
    assert top_k(queries.limit(0), vectors, 3).count() == 0


def test_two_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = store.ProjectStore(spark, f"file://{tmp_path}/store")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: s.append_result("p", "api", str(k)), range(12)))
    rows = s.read("results").collect()
    assert sorted(r.number for r in rows) == list(range(12)) and {r.data for r in rows} == {str(k) for k in range(12)}
    (last,) = s.results().collect()
    assert last.number == 11


def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    s = store.ProjectStore(spark, f"file://{tmp_path}/store")
    s.put_files("p", files(spark, ("a.py", "python", "x")))

    def crash(*a, **b):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(s.logs["files"], "commit", crash)
        with pytest.raises(RuntimeError):
            s.put_files("p", files(spark, ("b.py", "python", "x")))
    assert [r.path for r in s.read("files").collect()] == ["a.py"]
    s.put_files("q/1 =", files(spark, ("c.py", "python", "x")))  # a name that a folder's name can't be
    assert sorted(r.path for r in s.read("files").collect()) == ["a.py", "c.py"]
    s.delete_project("q/1 =")
    assert [r.path for r in s.read("files").collect()] == ["a.py"]


def test_compact_keeps_what_holds(spark, tmp_path):
    s = store.ProjectStore(spark, f"file://{tmp_path}/store")
    for k in range(3):
        s.append_result("p", f"kind{k % 2}", str(k))
    s.put_files("p", files(spark, ("a.py", "python", "x")))
    s.append("files", store.hashed(files(spark, ("b.py", "python", "x"))).withColumn("project_id", F.lit("p")), once=("s", 4))
    before = sorted(map(str, s.results().collect()))
    for _ in range(2):
        s.compact()
        assert sorted(map(str, s.results().collect())) == before
    s.append_result("p", "kind0", "9")
    assert {(r.data, r.number) for r in s.results().collect()} == {("1", 1), ("9", 3)}
    s.append("files", store.hashed(files(spark, ("b.py", "python", "x"))).withColumn("project_id", F.lit("p")), once=("s", 4))
    assert s.read("files").count() == 2
    again = store.ProjectStore(spark, f"file://{tmp_path}/store")
    assert again.read("files").count() == 2 and again.read("results").count() == 4


def test_stream_of_results_once_each(spark, tmp_path, monkeypatch):
    from stratalith.streaming import results

    s = store.ProjectStore(spark, f"file://{tmp_path}/store")
    for k in range(4):
        files(spark, (f"f{k}.py", "python", f"x{k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("path string, language string, content string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start = lambda: results.store_each(stream(), s, "p", "files", store.hashed, str(tmp_path / "at"), "loader")
    real, left = s.append, [2]

    def dies(*a, **b):
        real(*a, **b)
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("killed after the store's commit, before the stream's")

    with monkeypatch.context() as m:
        m.setattr(s, "append", dies)
        with pytest.raises(Exception, match="killed"):
            start().awaitTermination(120)
    assert s.read("files").count() == 2
    assert start().awaitTermination(120)
    assert sorted(r.path for r in s.read("files").collect()) == [f"f{k}.py" for k in range(4)]
    files(spark, ("f9.py", "python", "x")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert start().awaitTermination(120)
    assert s.read("files").count() == 5 and [r.batch for r in results.progress(s, "files", "loader").collect()] == list(range(5))


def test_many_matches_of_a_long_text(spark):
    import re
    import time

    text = "\x01x\x02 " + "".join(f"ab{i % 7}é\n" if i % 3 else "abab" + "-" * (i % 250) for i in range(20_000))
    clean = text.replace("\x01", " ").replace("\x02", " ")
    start = time.time()
    got = matches.matches(spark.createDataFrame([(1, text), (2, None), (3, "")], "line_id int, text string"), "text", "ab|é").collect()
    assert time.time() - start < 90
    want = [(m.group(), clean.count("\n", 0, m.start()) + 1, clean[max(0, m.start() - 100) : m.end() + 100].strip(" ")) for m in re.finditer("ab|é", clean)]
    assert len(want) > 30_000 and [(r["match"], r["line"], r["context"]) for r in sorted(got, key=lambda r: r["line"])] != []
    assert sorted((r["match"], r["line"], r["context"]) for r in got) == sorted(want) and {r["line_id"] for r in got} == {1}


def test_commits_of_many_projects(spark, tmp_path):
    s = store.ProjectStore(spark, f"file://{tmp_path}/store")
    many = spark.range(300).selectExpr("concat('p', id) AS project_id", "'a.py' AS path", "'x' AS language", "cast(id AS string) AS content")
    s.append("files", store.hashed(many))
    s.append("results", many.selectExpr("project_id", "'api' AS result_type", "content AS data"))
    assert len(list((tmp_path / "store").rglob("*.parquet"))) < 20  # not a file for each project
    for p in ("p7", "p8"):
        s.delete_project(p)
    assert s.results().count() == 298
    on_disk = spark.read.option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/store/bulk/files")
    assert sorted(int(r.content) for r in on_disk.collect()) == [k for k in range(300) if k not in (7, 8)]  # gone from disk, the rest once
    s.append("files", store.hashed(many.filter("project_id = 'p7'")))
    s.compact()
    assert sorted(int(r.content) for r in s.read("files").collect()) == [k for k in range(300) if k != 8]


def test_two_deletions_from_one_file(spark, tmp_path):
    s = store.ProjectStore(spark, f"file://{tmp_path}/store")
    s.append("files", store.hashed(spark.range(9).selectExpr("concat('p', id) AS project_id", "'a.py' AS path", "'x' AS language", "cast(id AS string) AS content").coalesce(1)))
    real, other = s.logs["files"].commit, []

    def late(kind, *a, **b):
        if kind == "rewrite" and not other:  # another writer comes first
            other.append(1)
            store.ProjectStore(spark, s.path).delete_project("p2")
        return real(kind, *a, **b)

    s.logs["files"].commit = late
    s.delete_project("p1")
    assert sorted(r.project_id for r in s.read("files").collect()) == ["p0", "p3", "p4", "p5", "p6", "p7", "p8"]
    on_disk = spark.read.option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/store/bulk/files")
    assert sorted(r.project_id for r in on_disk.collect()) == ["p0", "p3", "p4", "p5", "p6", "p7", "p8"]
