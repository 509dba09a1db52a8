"""Queries over records: latest results, reviews, scores, comparisons and rankings."""

from __future__ import annotations

from .code_corpus import values
from .sql_plan import sql_query

sql_query("corpus_totals", "SELECT count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT lang) AS languages, count(DISTINCT source) AS sources FROM documents")
sql_query("content_hash_dups", "SELECT digest, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, @sha(text) AS digest FROM documents) x GROUP BY digest HAVING count(*) > 1")
_DOMAINS = values("domains", "domain, keyword", [("commerce", "order"), ("commerce", "invoice"), ("finance", "account"), ("education", "student"), ("licensing", "license"), ("identity", "token"), ("identity", "@")])
sql_query("domain_scores", f"WITH {_DOMAINS} SELECT d.domain, CAST(sum((length(lower(t.text)) - length(replace(lower(t.text), d.keyword, ''))) / length(d.keyword)) AS BIGINT) AS hits, count(DISTINCT t.doc_id) AS files, CAST(least(100, 10 * sum((length(lower(t.text)) - length(replace(lower(t.text), d.keyword, ''))) / length(d.keyword))) AS BIGINT) AS confidence FROM documents t JOIN domains d ON contains(lower(t.text), d.keyword) GROUP BY d.domain")
_DEC = " + ".join(f"(length(t) - length(replace(t, ' {k} ', ''))) / {len(k) + 2}" for k in ("if", "for", "while", "and", "or"))
sql_query("complexity_metrics", f"SELECT page_id, loc, round(1 + 100.0 * d / loc, 2) AS complexity, round(greatest(0.0, least(100.0, 100 - 50.0 * d / loc - CAST(n AS DOUBLE) / loc / 10)), 2) AS maintainability FROM (SELECT page_id, CAST({_DEC} AS DOUBLE) AS d, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS DOUBLE) AS loc, length(t) AS n FROM (SELECT page_id, lower(html) AS t FROM pages) a) b")
sql_query("page_links", "SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, split_part(part, chr(34), 1) AS target FROM (SELECT page_id, @explode(split(replace(html, concat('href=', chr(34)), chr(1)), chr(1))) AS part FROM pages) a WHERE part NOT LIKE '<%') b GROUP BY target")
sql_query("latest_result", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) x WHERE place = 1")
sql_query("stage_progress", f"WITH {values('stages', 'event_type0, idx', [('click', 0), ('view', 1), ('cart', 2), ('purchase', 3), ('refund', 4)])} SELECT e.event_type, coalesce(s.idx, -1) AS stage, round(100.0 * coalesce(s.idx, 0) / 4, 1) AS pct, count(*) AS n FROM events e LEFT JOIN stages s ON e.event_type = s.event_type0 GROUP BY e.event_type, s.idx".replace("100.0 *", "CAST(100 AS DOUBLE) *"))
sql_query("uncovered_islands", "SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS island FROM (SELECT DISTINCT user_id, extract(DAY FROM ts) AS d FROM events) a) b GROUP BY user_id, island")
sql_query("event_transitions", "SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) x WHERE b IS NOT NULL GROUP BY a, b")
sql_query("mutual_edges", "WITH moves AS (SELECT DISTINCT a, b FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) x WHERE b IS NOT NULL) SELECT p.a AS one, p.b AS other FROM moves p JOIN moves q ON p.a = q.b AND p.b = q.a AND p.a < p.b")
_RANK = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END"
sql_query("review_queue", f"SELECT o_orderkey, priority, created, place FROM (SELECT o_orderkey, {_RANK} AS priority, o_orderdate AS created, row_number() OVER (ORDER BY {_RANK}, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P') x WHERE place <= 100")
sql_query("review_timeouts", "SELECT o_orderpriority, count(*) AS expired, min(o_orderkey) AS first_key FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY o_orderpriority")
sql_query("validation_metrics", "SELECT o_orderpriority AS rule_type, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS approved, round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END), 0), 4) AS approval_rate FROM orders GROUP BY o_orderpriority")
sql_query("reviewer_stats", "SELECT c_mktsegment AS reviewer, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS approved, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS rejected FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql_query("priority_distribution", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 2) AS pct FROM orders GROUP BY o_orderpriority, o_orderstatus")
_WEIGHTS = values("weights", "category, weight", [("parsing", 0.15), ("analysis", 0.20), ("pattern", 0.15), ("architecture", 0.15), ("security", 0.10), ("dependencies", 0.15), ("recommendations", 0.10)])
_GRADES = "grades AS (SELECT n_nationkey, category, CAST(((n_nationkey * 7 + length(category) * 13) % 100) AS DOUBLE) / 100 AS score FROM nation CROSS JOIN weights)"
_BASE = "base AS (SELECT g.n_nationkey, sum(g.score * w.weight) / sum(w.weight) AS avg_score, stddev_samp(g.score) AS spread, CAST(sum(CASE WHEN g.score < 0.3 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS low, CAST(sum(CASE WHEN g.score > 0.8 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS high FROM grades g JOIN weights w ON g.category = w.category GROUP BY g.n_nationkey)"
_FACTOR = "CASE WHEN spread < 0.1 THEN 1.1 WHEN spread > 0.3 THEN 0.9 ELSE 1.0 END * CASE WHEN low > 0.5 THEN 0.8 ELSE 1.0 END * CASE WHEN high > 0.7 THEN 1.1 ELSE 1.0 END"
sql_query("weighted_confidence", f"WITH {_WEIGHTS}, {_GRADES}, {_BASE} SELECT n_nationkey, round(CAST(avg_score AS DOUBLE), 6) AS base, round(CAST(avg_score * {_FACTOR} AS DOUBLE), 6) AS overall, round(CAST(least(1.0, avg_score * {_FACTOR}) AS DOUBLE), 6) AS clamped FROM base")
sql_query("strengths_weaknesses", f"WITH {_WEIGHTS}, {_GRADES} SELECT n_nationkey, category, CASE WHEN score > 0.7 THEN 'strength' ELSE 'weakness' END AS kind FROM grades WHERE score > 0.7 OR score < 0.4")
sql_query("validators_union", f"WITH {_WEIGHTS}, {_GRADES} SELECT n_nationkey, 'confidence' AS rule_type, round(avg(score), 6) AS score, 0.5 <= avg(score) AS passed FROM grades GROUP BY n_nationkey UNION ALL SELECT n_nationkey, 'security' AS rule_type, round(min(score), 6) AS score, min(score) >= 0.3 AS passed FROM grades WHERE category IN ('security', 'dependencies') GROUP BY n_nationkey UNION ALL SELECT n_nationkey, 'coverage' AS rule_type, round(CAST(count(*) AS DOUBLE) / 7, 6) AS score, count(*) >= 5 AS passed FROM grades WHERE score > 0.2 GROUP BY n_nationkey")
sql_query("overall_status", f"WITH {_WEIGHTS}, {_GRADES} SELECT n_nationkey, CASE WHEN ok >= 0.7 THEN 'approved' WHEN ok >= 0.4 THEN 'review' ELSE 'rejected' END AS status, CASE WHEN worst < 0.05 THEN 'critical' WHEN security < 0.5 THEN 'high' ELSE 'medium' END AS priority, ok < 0.7 OR security < 0.5 AS needs_review FROM (SELECT n_nationkey, CAST(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS ok, min(score) AS worst, max(CASE WHEN category = 'security' THEN score ELSE 0 END) AS security FROM grades GROUP BY n_nationkey) x")
_AB = "a AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE extract(YEAR FROM l_shipdate) = 1997), b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE extract(YEAR FROM l_shipdate) = 1998)"
sql_query("edge_set_diff", f"WITH {_AB} SELECT 'preserved' AS kind, count(*) AS n FROM a JOIN b ON a.p = b.p AND a.s = b.s UNION ALL SELECT 'removed' AS kind, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.p = b.p AND a.s = b.s) UNION ALL SELECT 'added' AS kind, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.p = b.p AND a.s = b.s)")
sql_query("graph_diff", f"WITH {_AB}, c AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a JOIN b ON a.p = b.p AND a.s = b.s) AS both_n, (SELECT count(*) FROM (SELECT DISTINCT p FROM a) x JOIN (SELECT DISTINCT p FROM b) y ON x.p = y.p) AS nodes, (SELECT count(DISTINCT p) FROM a) AS pa) SELECT na, nb, both_n, round(CAST(100 AS DOUBLE) * nodes / pa, 2) AS structure, round(CAST(100 AS DOUBLE) * both_n / na, 2) AS edge_score, round(0.6 * CAST(100 AS DOUBLE) * nodes / pa + 0.4 * CAST(100 AS DOUBLE) * both_n / na, 2) AS combined FROM c")
sql_query("part_supplier_degrees", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_suppkey")
sql_query("highly_connected_parts", "SELECT l_partkey, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 5")
sql_query("project_search", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '7') AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
sql_query("project_counters", "SELECT count(*) AS projects, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE') THEN 1 ELSE 0 END) AS BIGINT) AS running, count(DISTINCT c_nationkey) AS owners FROM customer")
sql_query("mode_by_group", "SELECT n_regionkey, segment FROM (SELECT n_regionkey, c_mktsegment AS segment, row_number() OVER (PARTITION BY n_regionkey ORDER BY count(*) DESC, c_mktsegment) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, c_mktsegment) x WHERE place = 1")
sql_query("logical_name_match", "SELECT coalesce(a.k, b.k) AS name, a.k IS NOT NULL AS in_original, b.k IS NOT NULL AS in_converted FROM (SELECT DISTINCT lower(n_name) AS k FROM nation WHERE n_nationkey % 3 <> 0) a FULL OUTER JOIN (SELECT DISTINCT lower(n_name) AS k FROM nation WHERE n_nationkey % 4 <> 0) b ON a.k = b.k")
sql_query("audit_checks", "SELECT section, checked, CASE WHEN value >= 0.9 THEN 'pass' WHEN value >= 0.6 THEN 'warn' ELSE 'fail' END AS verdict FROM (SELECT 'orders' AS section, 'finished share' AS checked, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS value FROM orders UNION ALL SELECT 'customers' AS section, 'positive balance' AS checked, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS value FROM customer UNION ALL SELECT 'documents' AS section, 'distinct texts' AS checked, CAST(count(DISTINCT text) AS DOUBLE) / count(*) AS value FROM documents) x")
sql_query("audit_report", "SELECT 'documents' AS section, count(*) AS n FROM documents UNION ALL SELECT 'pages' AS section, count(*) AS n FROM pages UNION ALL SELECT 'events' AS section, count(*) AS n FROM events UNION ALL SELECT 'orders' AS section, count(*) AS n FROM orders")
