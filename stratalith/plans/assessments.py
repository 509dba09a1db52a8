"""Queries that assess: coverage, merges of chunks, findings on schemas, confidences, routing and summaries."""

from __future__ import annotations

from .code_corpus import _CONCERNS, _EDGES, _ENDPOINTS, _FILES, _LAYERS, LINES, code_query, values
from .sql_plan import sql_query

# What a canonical type is called elsewhere.
_TYPES = values("names", "canonical, openapi, java, csharp, orm", [("BIGINT", "integer", "Long", "long", "BigInteger"), ("STRING", "string", "String", "string", "String"), ("DECIMAL", "number", "BigDecimal", "decimal", "Numeric"), ("DOUBLE", "number", "Double", "double", "Float"), ("BOOLEAN", "boolean", "Boolean", "bool", "Boolean")])
_CANONICAL = "CASE WHEN t IN ('int', 'integer', 'bigint', 'bigserial', 'serial') THEN 'BIGINT' WHEN t IN ('varchar', 'char', 'text') THEN 'STRING' WHEN t IN ('decimal', 'numeric') THEN 'DECIMAL' ELSE upper(t) END"
code_query("type_mapping", f"""SELECT c.path, c.name, n.openapi, n.java, n.csharp, n.orm FROM (SELECT path, name, {_CANONICAL} AS canonical FROM (
SELECT path, regexp_extract(line, '^  ([a-z_]+) ([A-Z]+)', 1) AS name, lower(regexp_extract(line, '^  ([a-z_]+) ([A-Z]+)', 2)) AS t FROM src_lines WHERE path LIKE '%.sql') x WHERE name <> '') c JOIN names n ON c.canonical = n.canonical""", LINES, _TYPES)
code_query("class_import_pairs", """SELECT a.path, a.name AS class_name, b.target FROM (SELECT DISTINCT path, regexp_extract(line, '(^| )class +([A-Za-z0-9_]+)', 2) AS name FROM src_lines) a
JOIN (SELECT DISTINCT path, regexp_extract(line, '^(import|from) +([A-Za-z0-9_.]+)', 2) AS target FROM src_lines) b ON a.path = b.path WHERE a.name <> '' AND b.target <> ''""", LINES)
code_query("endpoint_dedup", "SELECT verb, route, path FROM (SELECT verb, route, path, row_number() OVER (PARTITION BY verb, route ORDER BY file_id) AS place FROM endpoints) x WHERE place = 1", LINES, _ENDPOINTS)
code_query("component_frameworks", "SELECT l.layer, count(*) AS components, count(DISTINCT r.framework) AS frameworks, coalesce(min(r.framework), 'none') AS first_framework FROM layered l LEFT JOIN fw r ON contains(l.content, r.indicator) GROUP BY l.layer", _LAYERS, values("fw", "framework, indicator", [("Spring", "@RestController"), ("FastAPI", "@app.post"), ("React", "from 'react'")]))
code_query("business_entities", """SELECT name, count(*) AS files FROM (SELECT path, regexp_extract(line, '(^| )class +([A-Za-z0-9_]+)', 2) AS name FROM src_lines UNION ALL SELECT path, regexp_extract(line, 'CREATE TABLE +([A-Za-z0-9_]+)', 1) AS name FROM src_lines) x
WHERE @like(name, '(Entity|Model|Dto|DTO|Service)$') OR @like(lower(name), '^(order|user|customer|product|invoice|account)') GROUP BY name""", LINES)
code_query("file_hotspots", """SELECT path, loc, classes, loc > 10 AS large, classes > 5 AS god_class, @like(path, '[.](bak|old|orig|tmp)$') AS backup FROM (
SELECT path, count(*) AS loc, CAST(sum(CASE WHEN @like(line, '(^| )class ') THEN 1 ELSE 0 END) AS BIGINT) AS classes FROM src_lines WHERE trim(line) <> '' GROUP BY path) x""", LINES)
code_query("test_stubs", "SELECT path, length(content) AS n, length(trim(content)) < 50 AS stub FROM code")
code_query("anti_patterns", "SELECT path, CAST(sum(CASE WHEN @like(line, '(^| )global ') THEN 1 ELSE 0 END) AS BIGINT) AS globals, CAST(sum(CASE WHEN @like(line, 'except *:|catch *[(]Exception') THEN 1 ELSE 0 END) AS BIGINT) AS broad_handlers FROM src_lines GROUP BY path", LINES)
code_query("architecture_patterns", """SELECT models, views, controllers, round(CAST(models + views + controllers AS @double) / 3, 4) AS mvc, CAST(models + views + controllers AS @double) / 3 > 0.6 AS is_mvc FROM (
SELECT max(CASE WHEN @like(lower(path), 'model|entity|migration') THEN 1 ELSE 0 END) AS models, max(CASE WHEN @like(lower(path), 'view|component|page') THEN 1 ELSE 0 END) AS views, max(CASE WHEN contains(lower(path), 'controller') THEN 1 ELSE 0 END) AS controllers FROM code) x""")
code_query("content_quality", """SELECT count(*) AS files, round(least(CAST(1 AS @double), avg(CAST(CASE WHEN @like(content, 'class |def |function |CREATE ') THEN 1.0 ELSE 0.0 END AS @double) + CAST(CASE WHEN length(content) > 50 AND length(content) < 50000 THEN 0.5 ELSE 0.0 END AS @double) + 0.3)), 6) AS quality FROM code""")
code_query("message_queues", "SELECT c.path, m.broker, CASE WHEN @like(c.content, 'Listener|Consumer|consume') THEN 'consumer' ELSE 'producer' END AS role FROM code c JOIN mq m ON contains(lower(c.content), m.indicator)", values("mq", "broker, indicator", [("kafka", "kafka"), ("rabbitmq", "rabbit"), ("activemq", "activemq"), ("jms", "jms")]))
code_query("ddl_recommendations", """SELECT path, 'no index' AS finding FROM code WHERE contains(upper(content), 'CREATE TABLE') AND NOT contains(upper(content), 'CREATE INDEX')
UNION ALL SELECT path, 'no primary key' AS finding FROM code WHERE contains(upper(content), 'CREATE TABLE') AND NOT contains(upper(content), 'PRIMARY KEY')
UNION ALL SELECT path, concat('no foreign key: ', name) AS finding FROM (SELECT path, line, regexp_extract(line, '^  ([a-z_]+_id) ', 1) AS name FROM src_lines) x WHERE name <> '' AND NOT contains(line, 'REFERENCES')""", LINES)
code_query("schema_names", """SELECT path, CASE WHEN used <> '' THEN used WHEN made <> '' THEN made ELSE regexp_extract(path, '([^/]+?)([.][^./]*)?$', 1) END AS schema_name FROM (
SELECT path, regexp_extract(lower(content), '(^|;)[ ]*use +([a-z0-9_]+) *;', 2) AS used, regexp_extract(lower(content), 'create (schema|database) +([a-z0-9_]+)', 2) AS made FROM code WHERE path LIKE '%.sql') x""")
code_query("isolated_files", "SELECT c.path FROM code c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = c.path) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = c.path)", LINES, _EDGES)
code_query("stem_pairs", f"""SELECT a.stem, a.path AS original, b.path AS converted FROM (SELECT file_id, path, regexp_extract(path, '([^/]+?)([.][^./]*)?$', 1) AS stem FROM code) a JOIN (
SELECT stem, path FROM (SELECT stem, path, row_number() OVER (PARTITION BY stem ORDER BY file_id DESC) AS place FROM (SELECT file_id, path, regexp_extract(path, '([^/]+?)([.][^./]*)?$', 1) AS stem FROM code) y) x WHERE place = 1) b ON a.stem = b.stem""")
code_query("context_recommendations", """SELECT finding FROM (SELECT 'no presentation files' AS finding, count(*) = 0 AS applies FROM layered WHERE layer = 'presentation'
UNION ALL SELECT 'fewer than three logging files' AS finding, count(*) < 3 AS applies FROM (SELECT DISTINCT c.path FROM code c JOIN concerns k ON contains(lower(c.content), k.keyword) WHERE k.concern = 'logging') l
UNION ALL SELECT 'no security files' AS finding, count(*) = 0 AS applies FROM (SELECT DISTINCT c.path FROM code c JOIN concerns k ON contains(lower(c.content), k.keyword) WHERE k.concern = 'security') s) x WHERE applies""", _LAYERS, _CONCERNS)
code_query("parsing_confidence", """SELECT round(CAST(0.4 * ok + 0.3 * known + 0.2 * least(1.0, size / 10000) AS @double) + 0.1 * ok, 6) AS confidence FROM (
SELECT avg(CAST(CASE WHEN content <> '' THEN 1 ELSE 0 END AS @double)) AS ok, avg(CAST(CASE WHEN ext IN ('.java', '.py', '.tsx', '.sql') THEN 1 ELSE 0 END AS @double)) AS known, avg(CAST(length(content) AS @double)) AS size FROM files) x""", _FILES)

sql_query("ordered_dedup", "SELECT user_id, event_type, place FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_seen, event_type) AS place FROM (SELECT user_id, event_type, min(event_id) AS first_seen FROM events GROUP BY user_id, event_type) y) x WHERE place <= 40")
sql_query("review_durations", "SELECT l_returnflag, count(*) AS reviews, round(avg(CAST(micros AS @double) / 60000000), 4) AS avg_minutes FROM (SELECT l.l_returnflag, @micros(o.o_orderdate, l.l_shipdate) AS micros FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate >= o.o_orderdate) x GROUP BY l_returnflag")
sql_query("pattern_bands", "SELECT event_type, CASE WHEN value > 80 THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(value), 4) AS avg_value, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
sql_query("audit_approval_rate", "SELECT o_orderpriority, round(CAST(100 AS DOUBLE) * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / nullif(count(*), 0), 1) AS rate FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority")
sql_query("stage_elapsed", "SELECT event_id, user_id, event_type AS stage, place, CAST(micros AS @double) / 1000000 AS seconds FROM (SELECT event_id, user_id, event_type, CAST(row_number() OVER w AS BIGINT) AS place, @micros(lag(ts) OVER w, ts) AS micros FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x")
sql_query("business_complexity", "SELECT source, rules, CASE WHEN rules > 20 THEN 'high' WHEN rules > 10 THEN 'medium' ELSE 'low' END AS complexity FROM (SELECT source, CAST(sum(CASE WHEN contains(lower(text), ' must ') OR contains(lower(text), ' if ') THEN 1 ELSE 0 END) AS BIGINT) AS rules FROM documents GROUP BY source) x")
_PARTS = "g AS (SELECT n_nationkey, CAST((n_nationkey * 31) % 100 AS DOUBLE) / 100 AS overall, CAST((n_nationkey * 17) % 100 AS DOUBLE) / 100 AS security, n_nationkey % 9 = 0 AS failed FROM nation)"
sql_query("review_routing", f"WITH {_PARTS} SELECT n_nationkey, overall < 0.7 OR security < 0.5 OR failed AS to_human, concat(CASE WHEN overall < 0.7 THEN 'low confidence;' ELSE '' END, CASE WHEN security < 0.5 THEN 'security;' ELSE '' END, CASE WHEN failed THEN 'errors;' ELSE '' END) AS reason FROM g")
sql_query("pattern_confidence", "SELECT user_id, round(0.4 * least(CAST(1 AS DOUBLE), CAST(count(*) AS DOUBLE) / 5) + 0.4 * least(CAST(1 AS DOUBLE), avg(abs(value)) / 100) + 0.2 * least(CAST(1 AS DOUBLE), CAST(count(DISTINCT event_type) AS DOUBLE) / 3), 6) AS confidence FROM events GROUP BY user_id")
sql_query("small_chunk_merge", """SELECT doc_id, min(part) AS first_part, count(*) AS parts, CAST(sum(size) AS BIGINT) AS size FROM (SELECT doc_id, part, size, part - CASE WHEN size < 500 AND run % 2 = 0 AND run > 0 THEN 1 ELSE 0 END AS home FROM (
SELECT doc_id, part, size, CASE WHEN size < 500 THEN row_number() OVER (PARTITION BY doc_id, brk ORDER BY part) ELSE 0 END AS run FROM (
SELECT doc_id, part, size, sum(CASE WHEN size < 500 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 2 + CASE WHEN size < 500 THEN 0 ELSE 1 END AS brk FROM (
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS part, CAST(l_quantity * 20 AS BIGINT) AS size FROM lineitem) a) b) c) d GROUP BY doc_id, home""", {"lineitem": "l_orderkey"})
