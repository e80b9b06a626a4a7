"""Passes over code graphs of the synthetic snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.operators import passes
from skylark.plans.catalog import query

_EXTENDS = "x AS (SELECT service_id AS child, service_id // 2 AS parent FROM syn_service WHERE service_id > 0 UNION SELECT service_id, service_id // 3 FROM syn_service WHERE service_id > 2)"


def _extends(v):
    s = v.syn_service
    return s.where("service_id > 0").selectExpr("service_id AS child", "service_id div 2 AS parent").union(s.where("service_id > 2").selectExpr("service_id", "service_id div 3")).distinct()


@query("y13_constant_maps", """
WITH p AS (SELECT service_id AS map, endpoint_id % 5 AS key, uri AS value, endpoint_id % 29 <> 0 AS literal FROM syn_endpoint), c AS (SELECT map FROM p GROUP BY map HAVING bool_and(literal)),
v AS (SELECT DISTINCT map, key, value FROM p WHERE map IN (SELECT map FROM c)), g AS (SELECT endpoint_id AS get_id, service_id AS map, endpoint_id % 7 AS key FROM syn_endpoint)
SELECT get_id, value FROM g LEFT JOIN v USING (map, key)""")
def _(v):
    n = F.col("endpoint_id")
    puts = v.syn_endpoint.select(F.col("service_id").alias("map"), (n % 5).alias("key"), F.col("uri").alias("value"), (n % 29 != 0).alias("literal"))
    return passes.constant_gets(puts, v.syn_endpoint.select(n.alias("get_id"), F.col("service_id").alias("map"), (n % 7).alias("key")))


@query("y20_origin_classes", """
SELECT endpoint_id, CASE WHEN endpoint_id % 10 = 0 OR count(operation) = 0 THEN 'other' WHEN count(DISTINCT operation) > 1 THEN 'mixed' ELSE min(operation) END AS origin FROM syn_access GROUP BY endpoint_id""")
def _(v):
    atoms = v.syn_access.groupBy("endpoint_id").agg(F.collect_set("operation").alias("a"))
    return atoms.select("endpoint_id", passes.origin_class(F.col("a"), F.col("endpoint_id") % 10 == 0).alias("origin"))


@query("y24_nearest_declarations", f"""
WITH RECURSIVE {_EXTENDS}, a(root, node, level) AS (SELECT service_id, service_id, 0 FROM syn_service UNION SELECT a.root, x.parent, a.level + 1 FROM a JOIN x ON x.child = a.node),
c AS (SELECT root, node, min(level) AS level FROM a GROUP BY ALL), d AS (SELECT DISTINCT service_id AS type, concat(http_method, size) AS method FROM syn_endpoint),
m AS (SELECT root, method, node, level, min(level) OVER (PARTITION BY root, method) AS least FROM c JOIN d ON d.type = c.node)
SELECT root AS type, method, node AS declarer, CAST(level AS INTEGER) AS distance FROM m WHERE level = least""")
def _(v):
    return passes.nearest_declarations(_extends(v), v.syn_endpoint.select(F.col("service_id").alias("type"), F.concat("http_method", F.col("size").cast("string")).alias("method")).distinct())


@query("y25_ancestors", f"""
WITH RECURSIVE {_EXTENDS}, a(root, node, level) AS (SELECT service_id, service_id, 0 FROM syn_service UNION SELECT a.root, x.parent, a.level + 1 FROM a JOIN x ON x.child = a.node)
SELECT root AS type, node AS ancestor, CAST(min(level) AS INTEGER) AS distance FROM a GROUP BY ALL""")
def _(v):
    return passes.ancestors(_extends(v))


@query("y29_response_types", """
SELECT service_id, coalesce(max(CASE WHEN endpoint_id % 17 = 0 THEN entity END), CASE WHEN count(ret) = count(*) AND min(ret) = max(ret) THEN min(ret) END) AS type
FROM (SELECT *, CASE WHEN service_id % 4 = 0 THEN 'Same' WHEN service_id % 4 = 1 AND endpoint_id % 3 = 0 THEN NULL ELSE http_method END AS ret FROM syn_endpoint) GROUP BY service_id""")
def _(v):
    four, n = F.col("service_id") % 4, F.col("endpoint_id")
    ret = F.when(four == 0, "Same").when(~((four == 1) & (n % 3 == 0)), F.col("http_method"))
    return passes.agreed(v.syn_endpoint.select("service_id", F.when(n % 17 == 0, F.col("entity")).alias("declared"), ret.alias("found")), ["service_id"], "declared", "found")


@query("y42_enclosing_statements", """
WITH RECURSIVE n AS (SELECT endpoint_id AS node, endpoint_id // 2 AS parent, endpoint_id % 7 = 3 AS is_statement FROM syn_endpoint),
w(node, cur, hit) AS (SELECT node, node, is_statement FROM n UNION ALL SELECT w.node, n.parent, (SELECT is_statement FROM n p WHERE p.node = n.parent) FROM w JOIN n ON n.node = w.cur WHERE NOT w.hit AND n.parent <> n.node)
SELECT n.node, w.cur AS statement FROM n LEFT JOIN w ON w.node = n.node AND w.hit""")
def _(v):
    n = v.syn_endpoint.selectExpr("endpoint_id AS node", "endpoint_id div 2 AS parent", "endpoint_id % 7 = 3 AS is_statement")
    return passes.enclosing_statements(n)


@query("y18_reaching_definitions", """
WITH RECURSIVE d AS (SELECT endpoint_id, node_id FROM syn_node WHERE kind = 'call'), u AS (SELECT endpoint_id, node_id FROM syn_node WHERE kind = 'branch'),
w(endpoint_id, node_id, cur, hit) AS (SELECT endpoint_id, node_id, node_id, FALSE FROM u
  UNION SELECT w.endpoint_id, w.node_id, e.source, EXISTS (SELECT 1 FROM d WHERE d.endpoint_id = e.endpoint_id AND d.node_id = e.source) FROM w JOIN syn_edge e ON e.endpoint_id = w.endpoint_id AND e.target = w.cur WHERE NOT w.hit)
SELECT DISTINCT endpoint_id, node_id, cur AS def_node, FALSE AS exhausted FROM w WHERE hit""")
def _(v):
    of = lambda kind: v.syn_node.where(F.col("kind") == kind).select("endpoint_id", "node_id")
    return passes.reaching(of("branch"), of("call"), v.syn_edge, 20)


@query("y49_primary_calls", """
SELECT service_id AS statement, arg_min(endpoint_id, (CASE WHEN endpoint_id % 50 = 0 THEN 0 WHEN endpoint_id % 5 = 0 THEN 1 ELSE 2 END, size, endpoint_id)) AS call_id FROM syn_endpoint GROUP BY service_id""")
def _(v):
    n = F.col("endpoint_id")
    return passes.primary_calls(v.syn_endpoint.select(F.col("service_id").alias("statement"), n.alias("call_id"), F.col("size").alias("ord"), (n % 50 == 0).alias("is_sink"), (n % 5 == 0).alias("is_internal")))


@query("x33_unreachable_sinks", """
WITH RECURSIVE r(node) AS (SELECT root FROM syn_root UNION SELECT g.dst FROM r JOIN syn_call_graph g ON g.src = r.node)
SELECT endpoint_id * 10 + node_id AS node FROM syn_node n WHERE kind = 'call' AND NOT EXISTS (SELECT 1 FROM r WHERE r.node = n.endpoint_id * 10 + n.node_id)""")
def _(v):
    sinks = v.syn_node.where("kind = 'call'").select((F.col("endpoint_id") * 10 + F.col("node_id")).alias("node"))
    return passes.unreachable(sinks, v.syn_call_graph, v.syn_root)


@query("y02_concatenated_candidates", """
WITH o AS (SELECT DISTINCT service_id AS expr, endpoint_id % 3 AS ord, http_method AS value FROM syn_endpoint)
SELECT DISTINCT a.expr, concat(a.value, coalesce(b.value, ''), coalesce(c.value, '')) AS candidate FROM
  (SELECT x.expr, o.value FROM (SELECT DISTINCT expr FROM o) x LEFT JOIN o ON o.expr = x.expr AND o.ord = 0) a LEFT JOIN o b ON b.expr = a.expr AND b.ord = 1 LEFT JOIN o c ON c.expr = a.expr AND c.ord = 2""")
def _(v):
    return passes.concatenated(v.syn_endpoint.select(F.col("service_id").alias("expr"), (F.col("endpoint_id") % 3).alias("ord"), F.col("http_method").alias("value")).distinct())
