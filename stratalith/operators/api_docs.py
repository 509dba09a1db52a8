"""Documents of web endpoints: OpenAPI 3.0, Postman 2.1, and curl commands, put together by aggregation.

An endpoint of a project is a route and a method; of several the last one counts, by file and line.
Routes are written as OpenAPI has them: with a slash before, and with parameters in braces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .splitting import split_parameters

# Types of documents by types of languages; others are strings.
TYPES = {
    "String": "string", "Integer": "integer", "Long": "integer", "Boolean": "boolean", "Double": "number", "Float": "number", "Date": "string", "LocalDateTime": "string",
    "str": "string", "int": "integer", "float": "number", "bool": "boolean", "datetime": "string", "list": "array", "dict": "object",
    "string": "string", "long": "integer", "double": "number", "decimal": "number", "DateTime": "string", "number": "number", "boolean": "boolean", "object": "object", "array": "array",
}
#: Where a parameter comes from, by its annotation.
PLACES = {"RequestParam": "query", "PathVariable": "path", "RequestBody": "body", "RequestHeader": "header", "FromQuery": "query", "FromRoute": "path", "FromBody": "body"}
_OPERATION = "struct<summary string, description string, parameters array<struct<name string, `in` string, required boolean, schema struct<type string>>>, requestBody struct<content map<string, struct<schema map<string, string>>>>, responses map<string, struct<description string>>>"
DOCUMENT = f"openapi string, info struct<title string, version string, description string>, paths map<string, map<string, {_OPERATION}>>, components struct<schemas map<string, struct<type string, properties map<string, struct<type string>>>>>"


def document_type(type_: Column) -> Column:
    base = F.lower(F.substring_index(type_, "<", 1))
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    generic = F.when(base.isin("list", "array"), "array").when(base.isin("map", "dict", "object"), "object").otherwise("string")
    return F.when(type_.contains("<"), generic).otherwise(F.coalesce(names[type_], F.lit("string")))


def open_route(route: Column) -> Column:
    """<int:id>, <id> and :id as {id}; a slash before."""
    braces = F.regexp_replace(F.regexp_replace(route, r"<(?:\w+:)?(\w+)>", "{$1}"), r":(\w+)", "{$1}")
    return F.when(braces.startswith("/"), braces).otherwise(F.concat(F.lit("/"), braces))


def parameters_of(endpoints: DataFrame) -> DataFrame:
    """(path, method, route, ordinal, name, type, location, required) of endpoints' parameters.

    Spring's count if they are annotated; ASP.NET's are where an attribute says; else those
    and FastAPI's are in the path if the route names them, and in the query if not;
    FastAPI's with a default aren't required; those of Flask, Express and Django are in the route."""
    key = ["path", "framework", "method", "route", "line"]
    each = endpoints.filter(F.col("framework").isin("Spring", "ASP.NET", "FastAPI")).select(*key, F.posexplode(split_parameters("parameters")).alias("ordinal", "text"))
    mark = F.regexp_extract("text", rf"[@\[]({'|'.join(PLACES)})\b", 1)
    place = F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv])[F.nullif(mark, F.lit(""))]
    typed = r"([\w.]+(?:<[^>]*>)?(?:\[\])?\??) (\w+)(?: ?=.*)?$"
    python = r"^(\w+) ?: ?([^=]+?)(?: ?= ?(.+))?$"
    fast = F.col("framework") == "FastAPI"
    body = F.regexp_extract("text", python, 2).rlike(r"Body\(|Request")
    name = F.when(fast, F.regexp_extract("text", python, 1)).otherwise(F.regexp_extract("text", typed, 2))
    in_path = F.col("route").contains(F.concat(F.lit("{"), name, F.lit("}")))
    elsewhere = F.when(in_path, "path").otherwise("query")
    location = F.when(fast, F.when(body, "body").otherwise(elsewhere)).when(F.col("framework") == "ASP.NET", F.coalesce(place, elsewhere)).otherwise(place)
    type_ = F.when(fast, F.regexp_extract("text", python, 2)).otherwise(F.regexp_extract("text", typed, 1))
    required = ~fast | (F.regexp_extract("text", python, 3) == "")
    signed = each.select("path", "method", "route", "ordinal", name.alias("name"), type_.alias("type"), location.alias("location"), required.alias("required"))
    inside = F.regexp_extract_all("route", F.lit(r"(<(?:\w+:)?\w+>|\{\w+\}|(?<=/):\w+)"), F.lit(1))
    routed = endpoints.filter(F.col("framework").isin("Flask", "Express", "Django")).select("path", "method", "route", F.posexplode(inside).alias("ordinal", "text"))
    bare = F.regexp_extract("text", r"(\w+)>?\}?$", 1)
    kind = F.when(F.col("text").contains(":") & F.col("text").startswith("<"), F.regexp_extract("text", r"<(\w+):", 1)).otherwise("string")
    routed = routed.select("path", "method", "route", "ordinal", bare.alias("name"), kind.alias("type"), F.lit("path").alias("location"), F.lit(True).alias("required"))
    return signed.unionByName(routed).filter("name <> '' and location is not null")


def models_of(units: DataFrame) -> DataFrame:
    """(path, model, ordinal, name, type): fields of classes that aren't controllers, services or repositories."""
    class_name = F.regexp_extract("head", r"\bclass (\w+)", 1)
    java, other = r"^(?:@\w+(?:\([^)]*\))? )*(?:private|public|protected) (?:final |static )?([\w.]+(?:<.*?>)?(?:\[\])?\??) (\w+)(?: ?=.*)?$", r"^(\w+)\?? ?: ?([\w\[\]<>.|, ]+?)(?: ?=.*)?$"
    braced = F.col("language").isin("Java", "C#")
    name = F.when(braced, F.regexp_extract("head", java, 2)).otherwise(F.regexp_extract("head", other, 1))
    kind = F.when(braced, F.regexp_extract("head", java, 1)).otherwise(F.regexp_extract("head", other, 2))
    # classes and fields in one pass, since units cost a scan; scope: the class's unit
    none = F.lit(None).cast("string")
    row = lambda scope, model, name, type_: F.struct(F.col(scope).alias("scope"), model.alias("model"), name.alias("name"), type_.alias("type"))
    model = F.when((class_name != "") & ~F.lower(class_name).rlike("controller|service|repository"), row("unit", class_name, none, none))
    field = F.when(F.col("parent").isNotNull() & ((F.col("kind") == "statement") | braced) & (name != ""), row("parent", none, name, kind))
    each = units.select("path", F.col("unit").alias("ordinal"), F.explode(F.array_compact(F.array(model, field))).alias("x")).select("path", "ordinal", "x.*")
    own = each.withColumn("model", F.max("model").over(W.partitionBy("path", "scope")))
    return own.filter("name is not null and model is not null").select("path", "model", "ordinal", "name", "type")


def _with_parameters(endpoints: DataFrame, parameters: DataFrame) -> DataFrame:
    """The last endpoint of each project, open route and method, with its parameters in order."""
    own = F.array_sort(F.collect_list(F.struct("ordinal", "name", "type", "location", "required")))
    each = parameters.groupBy("path", "method", "route").agg(own.alias("given"))
    rows = endpoints.select("project", "path", "method", "route", "function", "line", open_route(F.col("route")).alias("open"))
    last = W.partitionBy("project", "open", "method").orderBy(F.desc("path"), F.desc("line"))
    none = F.array().cast("array<struct<ordinal int, name string, type string, location string, required boolean>>")
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").join(each, ["path", "method", "route"], "left").withColumn("given", F.coalesce("given", none))


def _map_of(key: Column, value: Column) -> Column:
    """An aggregate: a map in order of its keys (maps themselves have no order to sort by)."""
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))), by_key))


def openapi(endpoints: DataFrame, parameters: DataFrame, models: DataFrame) -> DataFrame:
    """(project, document): an OpenAPI 3.0 document (DOCUMENT) as JSON for each project of endpoints (with a project); models: with a project.

    A body is a reference to its model if the project has one of that name."""
    fields = models.groupBy("project", "model").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", document_type(F.col("type")).alias("t")))), lambda f: F.struct(f["name"], F.struct(f["t"].alias("type"))))).alias("properties"))
    schemas = fields.groupBy("project").agg(_map_of(F.col("model"), F.struct(F.lit("object").alias("type"), "properties")).alias("schemas"), F.collect_set("model").alias("known"))
    each = _with_parameters(endpoints, parameters).join(schemas, "project", "left")
    plain = F.transform(F.filter("given", lambda p: p["location"] != "body"), lambda p: F.struct(p["name"].alias("name"), p["location"].alias("in"), p["required"].alias("required"), F.struct(document_type(p["type"]).alias("type")).alias("schema")))
    body = F.get(F.filter("given", lambda p: p["location"] == "body"), F.lit(0))
    refers = F.coalesce(F.array_contains("known", body["type"]), F.lit(False))
    schema = F.when(refers, F.create_map(F.lit("$ref"), F.concat(F.lit("#/components/schemas/"), body["type"]))).otherwise(F.create_map(F.lit("type"), F.lit("object")))
    request = F.when(body.isNotNull(), F.struct(F.create_map(F.lit("application/json"), F.struct(schema.alias("schema"))).alias("content")))
    operation = F.struct(
        F.concat_ws(" ", "method", "open").alias("summary"),
        F.concat(F.lit("Endpoint: "), F.col("function")).alias("description"),
        plain.alias("parameters"),
        request.alias("requestBody"),
        F.create_map(F.lit("200"), F.struct(F.lit("Success").alias("description"))).alias("responses"),
    )
    routes = each.groupBy("project", "open").agg(_map_of(F.lower("method"), operation).alias("operations"), F.first("schemas").alias("schemas"))
    projects = routes.groupBy("project").agg(_map_of(F.col("open"), F.col("operations")).alias("paths"), F.first("schemas").alias("schemas"))
    none = F.from_json(F.lit("{}"), "map<string, struct<type string, properties map<string, struct<type string>>>>")
    info = F.struct(F.lit("Generated API Documentation").alias("title"), F.lit("1.0.0").alias("version"), F.lit("API documentation generated from code").alias("description"))
    return projects.select("project", F.to_json(F.struct(F.lit("3.0.0").alias("openapi"), info.alias("info"), "paths", F.struct(F.coalesce("schemas", none).alias("schemas")).alias("components"))).alias("document"))


def postman(endpoints: DataFrame, parameters: DataFrame) -> DataFrame:
    """(project, document): a Postman 2.1 collection as JSON for each project, items by route and method."""
    each = _with_parameters(endpoints, parameters)
    query = F.transform(F.filter("given", lambda p: p["location"] == "query"), lambda p: F.struct(p["name"].alias("key"), F.concat(F.lit("{{"), p["name"], F.lit("}}")).alias("value")))
    parts = F.filter(F.split("open", "/"), lambda s: s != "")
    url = F.struct(F.concat(F.lit("{{base_url}}"), F.col("open")).alias("raw"), F.array(F.lit("{{base_url}}")).alias("host"), parts.alias("path"), F.when(F.size(query) > 0, query).alias("query"))
    body = F.when(F.col("method").isin("POST", "PUT", "PATCH") & F.exists("given", lambda p: p["location"] == "body"), F.struct(F.lit("raw").alias("mode"), F.lit("{}").alias("raw")))
    item = F.struct(F.concat_ws(" ", "method", "open").alias("name"), F.struct("method", F.array().cast("array<string>").alias("header"), url.alias("url"), body.alias("body")).alias("request"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("open", "method", item.alias("item"))), lambda a, b: F.when(F.struct(a["open"], a["method"]) < F.struct(b["open"], b["method"]), -1).when(F.struct(a["open"], a["method"]) > F.struct(b["open"], b["method"]), 1).otherwise(0)), lambda x: x["item"])
    info = F.struct(F.lit("Generated API Collection").alias("name"), F.lit("https://schema.getpostman.com/json/collection/v2.1.0/collection.json").alias("schema"))
    return each.groupBy("project").agg(items.alias("item")).select("project", F.to_json(F.struct(info.alias("info"), "item")).alias("document"))


def curl_commands(endpoints: DataFrame, parameters: DataFrame) -> DataFrame:
    """(project, endpoint, command) for each route and method."""
    query = F.array_join(F.transform(F.filter("given", lambda p: p["location"] == "query"), lambda p: F.concat(p["name"], F.lit("={value}"))), "&")
    url = F.concat(F.col("open"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    body = F.when(F.col("method").isin("POST", "PUT", "PATCH"), " -H 'Content-Type: application/json' -d '{}'").otherwise("")
    return _with_parameters(endpoints, parameters).select("project", F.concat_ws(" ", "method", "open").alias("endpoint"), F.concat(F.lit("curl -X "), F.col("method"), F.lit(" '"), url, F.lit("'"), body).alias("command"))
