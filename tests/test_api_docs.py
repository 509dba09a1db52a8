"""API documents of a small project, equal to ones built by hand."""

import json

from pyspark.sql import functions as F

from stratalith.operators import api_docs, lexing, symbols

FILES = [
    ("a.py", '@app.put("/x/{k}")\ndef put_x(k: int, body: Request, q: List<int> = None):\n    pass\n\n\nclass Point:\n    x: float\n    y: int = 0\n'),
    ("b.java", 'class Point {\n  private Map<String, Long> m;\n  public void f() { }\n}\npublic class C {\n  @PostMapping("/p")\n  public void g(@RequestBody Point p, @RequestHeader("h") String h, int none) { }\n}'),
    ("z.java", 'public class D {\n  @PostMapping("/p")\n  public void later() { }\n}'),
    ("f.py", "@app.route('/i/<int:n>/<s>')\ndef i(n, s):\n    pass\n"),
]


def case(spark, files):
    df = spark.createDataFrame(files, "path string, content string")
    units = lexing.code_units(df)
    found = symbols.endpoints(units)
    named = lambda x: x.withColumn("project", F.lit("p"))
    return named(found), api_docs.parameters_of(found), named(api_docs.models_of(units))


def operation(summary, function, parameters=(), body=None):
    out = {"summary": summary, "description": f"Endpoint: {function}", "parameters": [{"name": n, "in": i, "required": r, "schema": {"type": t}} for n, i, r, t in parameters], "responses": {"200": {"description": "Success"}}}
    return out | ({"requestBody": {"content": {"application/json": {"schema": body}}}} if body else {})


def test_openapi(spark):
    (row,) = api_docs.openapi(*case(spark, FILES[:2] + FILES[3:])).collect()
    got = json.loads(row["document"])
    assert got["openapi"] == "3.0.0"
    assert got["paths"] == {
        "/x/{k}": {"put": operation("PUT /x/{k}", "put_x", [("k", "path", True, "integer"), ("q", "query", False, "array")], {"type": "object"})},
        "/p": {"post": operation("POST /p", "g", [("h", "header", True, "string")], {"$ref": "#/components/schemas/Point"})},
        "/i/{n}/{s}": {"get": operation("GET /i/{n}/{s}", "i", [("n", "path", True, "integer"), ("s", "path", True, "string")])},
    }
    assert got["components"]["schemas"].keys() == {"Point"}


def test_the_last_of_equal_endpoints_counts(spark):
    (row,) = api_docs.openapi(*case(spark, FILES[1:3])).collect()
    got = json.loads(row["document"])
    assert got["paths"] == {"/p": {"post": operation("POST /p", "later")}}
    assert got["components"] == {"schemas": {"Point": {"type": "object", "properties": {"m": {"type": "object"}}}}}


def test_postman_and_nothing(spark):
    found, given, models = case(spark, FILES[:1])
    (row,) = api_docs.postman(found, given).collect()
    (item,) = json.loads(row["document"])["item"]
    assert item["request"]["url"] == {"raw": "{{base_url}}/x/{k}", "host": ["{{base_url}}"], "path": ["x", "{k}"], "query": [{"key": "q", "value": "{{q}}"}]}
    assert item["request"]["body"] == {"mode": "raw", "raw": "{}"}
    none = found.limit(0)
    assert api_docs.openapi(none, given, models).count() == api_docs.postman(none, given).count() == api_docs.curl_commands(none, given).count() == 0
