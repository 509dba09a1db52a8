"""Source trees, DDL, Python symbols and the review stream on small inputs."""

import pytest

from stratalith.operators.ddl import ddl_objects
from stratalith.operators.python_code import python_symbols
from stratalith.sources import tree
from stratalith.sources.tree import scan
from stratalith.streaming.reviews import progress_counts, review_states

DDL = """-- use comma, (here
CREATE TABLE IF NOT EXISTS shop.orders (
  id BIGSERIAL PRIMARY KEY,
  total DECIMAL(10,2) NOT NULL CHECK (total IN (1, 2)),
  note VARCHAR(20) DEFAULT 'a, (b', /* , */
  buyer INT REFERENCES shop.people(id) ON DELETE SET NULL,
  UNIQUE (note, buyer),
  CONSTRAINT fk FOREIGN KEY (buyer, id) REFERENCES pairs (a, b)
);
CREATE UNIQUE INDEX by_note ON shop.orders (note, total);
CREATE VIEW v AS SELECT 1;
CREATE TABLE broken (a INT"""


def test_ddl(spark):
    rows = ddl_objects(spark.createDataFrame([("x.sql", DDL), ("n.sql", None), ("e.sql", "")], "path string, content string")).collect()
    of = lambda k, t="orders": [r for r in rows if r.kind == k and r.table_name == t]
    cols = {r.name: r for r in of("column")}
    assert list(cols) == ["id", "total", "note", "buyer"]
    assert (cols["total"].length, cols["total"].scale, cols["total"].nullable) == (10, 2, False)
    assert cols["id"].primary_key and cols["id"].auto_increment and cols["note"].length == 20
    assert (cols["buyer"].ref_table, cols["buyer"].ref_columns, cols["buyer"].on_delete) == ("people", ["id"], "SET NULL")
    (fk,) = of("foreign key")
    assert (fk.name, fk.columns, fk.ref_table, fk.ref_columns, fk.on_delete) == ("fk", ["buyer", "id"], "pairs", ["a", "b"], "RESTRICT")
    assert [(r.name, r.columns, r.is_unique) for r in of("index")] == [(None, ["note", "buyer"], True), ("by_note", ["note", "total"], True)]
    assert [r.name for r in rows if r.kind == "view"] == ["v"]
    assert [r.name for r in of("column", "broken")] == ["a"]


def test_python_symbols(spark):
    src = "import os\nfrom a import b\n@d\nclass A(B):\n    def m(self, x):\n        if x and 1 or 2:\n            pass\ndef f(y):\n    for i in y:\n        pass\n"
    rows = python_symbols(spark.createDataFrame([("x.py", src), ("bad.py", "def ("), ("n.py", None)], "path string, content string")).collect()
    got = {(r.path, r.kind, r.name, r.parent, r.complexity) for r in rows}
    assert got == {("x.py", "module", None, None, 5), ("x.py", "import", "os", None, None), ("x.py", "import", "b", "a", None), ("x.py", "class", "A", None, 4), ("x.py", "method", "m", "A", 4), ("x.py", "function", "f", None, 2), ("bad.py", "error", "SyntaxError", None, None), ("n.py", "module", None, None, 1)}


TREE = {"a.py": b"x\n\n y\r\n", "__init__.py": b"", ".gitignore": b"*.pyc", "target/x.py": b"x", "img.png": b"x", "Dockerfile": b"FROM x", "src/Main.JAVA": b"a\xffb\xef\xbf\xbd", "notes": b"x", "sub/target/deep.sql": b"x", "go.sum": b"x"}


def test_scan(spark, tmp_path):
    for name, body in TREE.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(body)
    want = {("a.py", "Python", 7, 2, "x\n\n y\r\n"), ("__init__.py", "Python", 0, 0, ""), (".gitignore", "Other", 5, 1, "*.pyc"), ("Dockerfile", "Dockerfile", 6, 1, "FROM x"), ("src/Main.JAVA", "Java", 6, 1, "ab\ufffd"), ("go.sum", "Other", 1, 1, "x")}
    rows = lambda df: {(r.path, r.language, r["size"], r.loc, r.content) for r in df.collect()}
    assert rows(scan(spark, str(tmp_path))) == rows(scan(spark, f"file://{tmp_path}")) == want
    each = scan(spark, str(tmp_path), partition_bytes=1)
    assert rows(each) == want and each.rdd.getNumPartitions() >= 5
    assert ("target/x.py", "Python", 1, 1, "x") in rows(scan(spark, str(tmp_path), skipped=(".git",)))
    (tmp_path / "empty").mkdir()
    assert scan(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="no folder at"):
        scan(spark, str(tmp_path / "none")).collect()


def test_skipped_folders_are_not_listed():
    class Listing:
        def get_file_info(self, selector):
            asked.append(selector.base_dir)
            assert "node_modules" not in selector.base_dir
            return real.get_file_info(selector)

    import pyarrow.fs as pafs

    real = pafs._MockFileSystem()
    real.create_dir("root/node_modules/deep")
    real.create_dir("root/src")
    for name in ("root/node_modules/deep/a.js", "root/src/b.js", "root/c.js"):
        with real.open_output_stream(name) as f:
            f.write(b"x")
    asked: list[str] = []
    assert [p for p, _ in tree.walk(Listing(), "root", frozenset(tree.SKIP_DIRS))] == ["c.js", "src/b.js"]
    assert asked == ["root", "root/src"]


def test_write_tree(spark, tmp_path):
    rows = [("a/b.py", "x"), ("c.md", None), ("a/d/é.sql", "ü")]
    files = spark.createDataFrame(rows, "path string, content string")
    for _ in range(2):  # a second time replaces
        tree.write_tree(files, f"file://{tmp_path}/out")
    assert {(r.path, r.content) for r in scan(spark, f"{tmp_path}/out").collect()} == {("a/b.py", "x"), ("c.md", ""), ("a/d/é.sql", "ü")}
    for bad in ("../x", "/x", None):
        with pytest.raises(Exception, match="not a path below"):
            tree.write_tree(spark.createDataFrame([(bad, "x")], "path string, content string"), str(tmp_path / "out"))


def run(spark, tmp_path, name, build, schema, *batches):
    src = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).selectExpr(*[f"CAST(ts AS timestamp) AS {c}" if c == "ts" else c for c in [x.split()[0] for x in schema.split(", ")]]).coalesce(1).write.mode("append").parquet(str(src))
        typed = spark.read.parquet(str(src)).schema
        stream = spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = build(stream).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_review_stream(spark, tmp_path):
    day = "2024-01-01 "
    first = [(1, day + "10:00:00", "create", None), (1, day + "10:30:00", "approve", "ann"), (2, day + "10:00:00", "create", None), (3, day + "10:00:00", "reject", "bob"), (4, day + "10:00:00", "create", None), (4, day + "11:30:00", "approve", "bob")]
    later = [(9, day + "15:00:00", "create", None)]
    out = run(spark, tmp_path, "r", review_states, "review_id long, ts string, action string, reviewer string", first, later)
    got = {(r.review_id, r.status, r.reviewer, str(r.at)[11:16]) for r in out.collect()}
    assert got >= {(1, "pending", None, "10:00"), (1, "approved", "ann", "10:30"), (2, "pending", None, "10:00"), (2, "timeout", None, "11:00"), (4, "pending", None, "10:00"), (4, "timeout", None, "11:00"), (9, "pending", None, "15:00")}
    assert {r[0] for r in got} == {1, 2, 4, 9}


def test_progress_stream(spark, tmp_path):
    out = run(spark, tmp_path, "p", progress_counts, "ts string, event_type string", [("2024-01-01 10:10:00", "a"), ("2024-01-01 10:50:00", "a")], [("2024-01-01 15:00:00", "b")])
    assert [(str(r.start)[11:16], r.event_type, r.n) for r in out.collect()] == [("10:00", "a", 2)]


def test_eight_validators(spark):
    from stratalith.operators import validators

    names = [f.split()[0] for f in validators.MEASURES.split(", ")]
    bad = dict(id=1, overall_confidence=0.4, low_categories=["graph", "tools"], n_weaknesses=1, n_vulnerabilities=4, n_high_risk=1, n_security_patterns=0, layer_files={"backend": 0}, n_circular=6, n_coupled_files=10, n_high_coupling=5, quality_score=0.2, average_complexity=25.0, n_anti_patterns=2, n_files=10, n_parsed=5, n_parsing_errors=5, n_processed=4, n_transformed=2, n_failed=2, n_test_scripts=0)
    absent = dict(id=2)
    rows = spark.createDataFrame([tuple(r.get(c) for c in ["id", *names]) for r in (bad, absent)], f"id long, {validators.MEASURES}")
    got = {(r.id, r.rule_type): r for r in validators.validations(rows, "id").collect()}
    assert len(got) == 16
    scores = {k: (round(r.score, 3), r.passed, len(r.recommendations)) for k, r in got.items()}
    expected = {"confidence_threshold": (0.4, False, 2), "security_check": (0.75, False, 2), "architecture_compliance": (0.0, False, 3), "quality_gate": (0.0, False, 3), "dependency_health": (0.2, False, 2), "file_coverage": (0.5, False, 1), "transformation_completeness": (0.5, False, 2), "test_coverage_readiness": (0.0, False, 2)}
    assert {k: scores[1, k] for k in expected} == expected
    expected = {"confidence_threshold": (0.0, False, 0), "security_check": (1.0, True, 1), "architecture_compliance": (1.0, True, 0), "quality_gate": (1.0, True, 0), "dependency_health": (1.0, True, 0), "file_coverage": (0.0, False, 0), "transformation_completeness": (0.0, False, 0), "test_coverage_readiness": (0.0, False, 2)}
    assert {k: scores[2, k] for k in expected} == expected
    assert got[1, "confidence_threshold"].recommendations[0].endswith("graph, tools") and got[1, "architecture_compliance"].recommendations[0].endswith("backend")
