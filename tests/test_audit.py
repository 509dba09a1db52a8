"""The audit of a project of which all is known, and of one of which nothing is."""

import json

from stratalith.operators import audit
from stratalith.sources import store

FILES = "project_id string, path string, content string, loc long, classes int, functions int, errors int"


def test_checks_of_a_full_and_an_empty_project(spark, tmp_path):
    s = store.ProjectStore(spark, f"file://{tmp_path}/store")
    results = {
        "ingestion": {"total_files": 2},
        "parsing": {"total_functions": 4, "total_classes": 2, "frameworks_detected": ["Spring Boot"]},
        "agentic_analysis": {"api_analysis": {"endpoints": [{"path": "/a", "method": "GET", "file": "a.py"}]}},
        "transformation_results": {"total_files_processed": 2, "successful_transformations": 1},
        "selected_stack": {"names": ["Weblogic 12", "Java 17"]},
        "test_scripts": {"scripts": [{"content": None}]},
    }
    s.append_result("full", "ingestion", json.dumps({"total_files": 7}))
    s.append("results", spark.createDataFrame([("full", k, json.dumps(v)) for k, v in results.items()], "project_id string, result_type string, data string"))
    s.append_result("full", "broken", "not json")
    files = spark.createDataFrame([("full", "a.py", "if x and y:\n    pass # TODO", 2, 6, 1, 7), ("full", "b.py.old", "", 501, 0, 0, None), ("full", "c.py", None, None, 0, 0, 0)], FILES)
    components = spark.createDataFrame([("full", "web", "A", "high"), ("full", "data", "B", "low")], "project_id string, layer string, name string, complexity string")
    validations = spark.createDataFrame([("full", "code_quality", 39.0, None, None), ("full", "dependency_health", 10.0, True, ""), ("full", "file_coverage", None, False, None)], "project_id string, validation_type string, score double, passed boolean, evidence string")
    projects = spark.createDataFrame([("full",), ("none",)], "project_id string")
    measures = audit.audit_measures(projects, s.results(), files, components, validations)
    row = {r["project_id"]: r for r in measures.collect()}
    full, none = row["full"], row["none"]
    assert (full["parsed_files"], full["total_files"], full["total_functions"], full["large_files"], full["god_files"], full["unfinished_files"], full["backup_files"]) == (3, 2, 4, 1, 1, 1, 1)
    assert full["avg_complexity"] == full["max_complexity"] == 101.0 and full["rules_total"] == 6 and full["rules_mapped"] == 3 and full["approval_rate"] == 33.3
    assert (none["parsed_files"], none["total_files"], none["rules_total"], none["avg_complexity"]) == (0, 0, 0, None)
    checked = audit.audit_checks(measures)
    got = {(r["project_id"], r["check"]): r["state"] for r in checked.collect()}
    assert len(audit.CHECKS) == 24 and len(got) == 48
    want = {"complexity": "fail", "linting": "fail", "smells": "warn", "overall gate": "fail", "circular dependencies": "pass", "layer isolation": "pass", "complex components": "warn", "frameworks": "pass", "coupling": "pass", "end of life": "warn", "modern versions": "pass", "known vulnerabilities": "skip", "scripts": "pass", "mockable endpoints": "pass", "validation suite": "warn", "empty stubs": "warn", "completeness": "skip", "entry points": "pass", "rules parity": "warn", "unfinished work": "warn", "inventory": "fail", "orphaned logic": "pass", "folders": "pass", "backups": "fail"}
    assert {c: v for (p, c), v in got.items() if p == "full"} == want
    said = {c: v for (p, c), v in got.items() if p == "none"}
    assert {c for c, v in said.items() if v != "skip"} == {"smells", "overall gate", "scripts", "validation suite", "backups"} and said["scripts"] == "fail"
    sections = {(r["project_id"], r["section"]): (r["passed"], r["warned"], r["failed"], r["skipped"]) for r in audit.audit_sections(checked).collect()}
    assert sections["full", "6 files"] == (2, 0, 2, 0) and sum(sections["none", s][3] for _, s in sections if _ == "none") == 19
