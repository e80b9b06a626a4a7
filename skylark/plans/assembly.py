"""Flow of endpoints over methods of the synthetic snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.operators import assembly
from skylark.plans.catalog import query
from skylark.plans.synthetic import VIEWS

# a method for each flow graph; calls stay within blocks of eight methods, one in eleven calls its own method
VIEWS.update({
    "syn_method": "SELECT DISTINCT endpoint_id AS method FROM {syn_node} UNION ALL SELECT -1 - endpoint_id FROM {syn_node} WHERE node_id = 1 AND endpoint_id % 16 = 0",
    "syn_statement_node": """
        SELECT s.endpoint_id AS method, s.endpoint_id * 10 + s.node_id AS node,
          CASE WHEN kind <> 'statement' THEN kind WHEN part_id % 9 = 0 THEN 'loop' WHEN part_id % 10 = 1 THEN 'return' ELSE 'statement' END AS kind,
          CASE WHEN kind = 'branch' THEN CASE WHEN part_id % 3 = 0 THEN 'switch' ELSE 'if' END WHEN kind = 'statement' AND part_id % 9 = 0 THEN CASE WHEN part_id % 2 = 0 THEN 'while' ELSE 'for' END END AS construct,
          CASE WHEN kind = 'statement' AND part_id % 9 = 0 THEN CASE part_id % 4 WHEN 0 THEN ' true ' WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE 'i < n' END END AS condition,
          line, CASE WHEN kind = 'call' THEN CASE WHEN part_id % 11 = 0 THEN s.endpoint_id WHEN part_id % 7 = 0 THEN -1 - s.endpoint_id ELSE 8 * CAST(floor(s.endpoint_id / 8) AS BIGINT) + part_id % 8 END END AS callee,
          part_id % 13 <> 0 AS resolved, kind = 'call' AND part_id % 5 = 0 AS signal
        FROM {syn_node} s""",
    "syn_statement_flow": """
        SELECT e.endpoint_id AS method, e.endpoint_id * 10 + e.source AS source, e.endpoint_id * 10 + e.target AS target,
          CASE s.kind WHEN 'branch' THEN CASE WHEN s.construct = 'if' THEN e.kind WHEN e.kind = 'true' THEN 'case' ELSE 'default' END WHEN 'loop' THEN CASE WHEN s.node % 4 = 1 THEN 'flow' ELSE 'true' END
            ELSE CASE WHEN s.node % 17 = 2 THEN 'exception' ELSE 'flow' END END AS label, FALSE AS back
        FROM {syn_edge} e JOIN {syn_statement_node} s ON s.node = e.endpoint_id * 10 + e.source WHERE NOT (s.kind = 'branch' AND s.node % 5 = 0 AND e.kind = 'false')
        UNION ALL SELECT method, node + 1, node, 'flow', TRUE FROM {syn_statement_node} WHERE kind = 'loop' AND node % 3 <> 0
        UNION ALL SELECT method, node, -node, 'flow', FALSE FROM {syn_statement_node} WHERE node % 19 = 0""",
    "syn_flow_endpoint": "SELECT endpoint_id, CASE WHEN endpoint_id % 40 = 0 THEN -endpoint_id - 1000000000 ELSE endpoint_id END AS method FROM {syn_node} WHERE node_id = 1 AND endpoint_id % 5 = 0",
})

_LOCAL = """
x AS (SELECT f.*, a.node IS NOT NULL AS has_source, b.node IS NOT NULL AS has_target FROM syn_statement_flow f LEFT JOIN syn_statement_node a ON a.method = f.method AND a.node = f.source LEFT JOIN syn_statement_node b ON b.method = f.method AND b.node = f.target),
o AS (SELECT method, source AS node, count(*) AS n_out, bool_or(label = 'flow') AS l_flow, bool_or(label = 'true') AS l_true, bool_or(label = 'false') AS l_false, bool_or(label = 'default') AS l_default, bool_or(label IN ('case', 'default')) AS l_switch, bool_and(label = 'exception') AS l_only
  FROM x WHERE has_source AND has_target GROUP BY ALL),
s AS (SELECT s.*, n_out, l_flow, l_true, l_false, l_default, l_switch, l_only, o.node IS NOT NULL AS has_out FROM syn_statement_node s LEFT JOIN o ON o.method = s.method AND o.node = s.node),
v AS (SELECT method, node, unnest(CASE WHEN NOT has_out OR l_flow THEN [] WHEN kind = 'branch' AND construct = 'switch' THEN CASE WHEN l_default THEN [] ELSE ['default'] END
    WHEN kind = 'branch' THEN list_filter([CASE WHEN NOT l_true THEN 'true' END, CASE WHEN NOT l_false THEN 'false' END], lambda y: y IS NOT NULL)
    WHEN kind = 'loop' THEN CASE WHEN l_false OR (construct = 'for' AND trim(condition) = '') OR (construct = 'while' AND trim(condition) = 'true') THEN [] ELSE ['false'] END WHEN l_only THEN ['flow'] ELSE [] END) AS label FROM s)"""
_CLOSED = """
k AS (SELECT DISTINCT c.method AS src, c.callee AS dst FROM syn_statement_node c JOIN syn_method m ON m.method = c.callee WHERE resolved),
c(endpoint_id, method) AS (SELECT e.endpoint_id, e.method FROM syn_flow_endpoint e JOIN syn_method m ON m.method = e.method UNION SELECT c.endpoint_id, k.dst FROM c JOIN k ON k.src = c.method)"""
_JOINED = f"""
WITH RECURSIVE {_LOCAL},
g AS (
  SELECT method, concat('m', method, ':n', source) AS source, concat('m', method, ':n', target) AS target, label AS kind, back FROM x WHERE has_source AND has_target
  UNION ALL SELECT method, concat('m', method, ':entry'), concat('m', method, ':n', node), 'flow', FALSE FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE has_source AND x.method = s.method AND x.target = s.node)
  UNION ALL SELECT method, concat('m', method, ':n', node), concat('m', method, ':exit'), label, FALSE FROM (
    SELECT method, node, 'flow' AS label FROM s WHERE kind = 'return' OR NOT EXISTS (SELECT 1 FROM x WHERE has_target AND x.method = s.method AND x.source = s.node) UNION SELECT method, node, label FROM v)
  UNION ALL SELECT method, concat('m', method, ':entry'), concat('m', method, ':exit'), 'flow', FALSE FROM syn_method WHERE method NOT IN (SELECT method FROM s)
  UNION ALL SELECT c.method, concat('m', c.method, ':n', node), concat('m', callee, ':entry'), 'call', FALSE FROM s c JOIN syn_method m ON m.method = callee WHERE resolved
  UNION ALL SELECT c.method, concat('m', callee, ':exit'), concat('m', c.method, ':n', node), 'return', FALSE FROM s c JOIN syn_method m ON m.method = callee WHERE resolved),
{_CLOSED}"""


def _assembled(v):
    return assembly.assembled(v.syn_flow_endpoint, v.syn_method, v.syn_statement_node, v.syn_statement_flow)


@query("g05_assembled_flow", f"{_JOINED} SELECT endpoint_id, source, target, kind, back FROM c JOIN g USING (method)")
def _(v):
    return _assembled(v)[1]


@query("g05_assembled_nodes", f"""
WITH RECURSIVE {_CLOSED}, n AS (SELECT method, concat('m', method, ':n', node) AS id, kind, node FROM syn_statement_node UNION ALL SELECT method, concat('m', method, ':', kind), kind, NULL FROM syn_method, (VALUES ('entry'), ('exit')) t(kind))
SELECT endpoint_id, id, kind, method, node FROM c JOIN n USING (method)""")
def _(v):
    return _assembled(v)[0]


@query("g06_flow_anomalies", f"""
WITH {_LOCAL},
e AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY entered, line, node) AS first, count(*) OVER (PARTITION BY method) AS n FROM (
  SELECT s.*, EXISTS (SELECT 1 FROM x WHERE has_source AND has_target AND x.method = s.method AND x.target = s.node) AS entered FROM s))
SELECT 'dangling-edge' AS code, method, CAST(NULL AS BIGINT) AS node FROM x WHERE NOT (has_source AND has_target)
UNION ALL SELECT 'disconnected-node', method, node FROM e WHERE n >= 2 AND first > 1 AND NOT entered
UNION ALL SELECT 'branch-arity', method, node FROM s WHERE kind IN ('branch', 'loop') AND (NOT has_out OR (construct = 'switch' AND NOT l_switch))
UNION ALL SELECT 'unlabeled-arm', method, node FROM s WHERE kind IN ('branch', 'loop') AND construct <> 'switch' AND l_flow AND n_out > 1
UNION ALL SELECT 'loop-no-back-edge', method, node FROM s WHERE kind = 'loop' AND l_true AND NOT EXISTS (SELECT 1 FROM x WHERE back AND has_source AND has_target AND x.method = s.method AND (x.source = s.node OR x.target = s.node))
UNION ALL SELECT 'exit-unreachable', method, NULL FROM (SELECT DISTINCT method FROM s WHERE method NOT IN (SELECT method FROM s WHERE kind = 'return' OR NOT has_out UNION SELECT method FROM v))""")
def _(v):
    return assembly.anomalies(v.syn_statement_node, v.syn_statement_flow)


_RUNS = """
io AS (SELECT s.method, s.node, (SELECT count(*) FROM x WHERE has_source AND has_target AND x.method = s.method AND x.source = s.node) AS n_out, (SELECT count(*) FROM x WHERE has_source AND has_target AND x.method = s.method AND x.target = s.node) AS n_in FROM s),
p AS (SELECT method, node FROM s JOIN io USING (method, node) WHERE kind IN ('statement', 'call', 'return') AND construct IS NULL AND condition IS NULL AND NOT signal AND io.n_out <= 1 AND n_in <= 1),
st AS (SELECT x.method, x.source, x.target FROM x JOIN p a ON a.method = x.method AND a.node = x.source JOIN p b ON b.method = x.method AND b.node = x.target WHERE label = 'flow' AND NOT back),
rn(method, node, head, place) AS (SELECT method, node, node, 0 FROM p WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.method = p.method AND st.target = p.node) UNION ALL SELECT rn.method, st.target, rn.head, rn.place + 1 FROM rn JOIN st ON st.method = rn.method AND st.source = rn.node),
r AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY method, head) AS n FROM rn) WHERE n >= 2)"""


@query("w07_runs_along_flow", f"WITH RECURSIVE {_LOCAL}, {_RUNS} SELECT method, node, head, CAST(place AS INTEGER) AS place, n FROM r")
def _(v):
    return assembly.runs(v.syn_statement_node, v.syn_statement_flow)


_REMOTE = "(SELECT method, node, concat('c', node) AS remote_call_id FROM syn_statement_node WHERE signal)"
_TARGETS = "(SELECT concat('c', node) AS remote_call_id, CASE WHEN node % 3 = 0 THEN concat('svc-', node % 4) WHEN node % 3 = 1 THEN 'api.example.com' END AS target FROM syn_statement_node WHERE signal)"
_DRAWN = f"""{_JOINED}, {_RUNS},
d AS (SELECT c.endpoint_id, s.method, s.node, concat('m', s.method, ':n', s.node) AS id, c.method % 2 = 0 AS open,
  CASE WHEN c.method % 2 <> 0 THEN concat('method:', s.method) WHEN r.node IS NOT NULL AND r.head % 3 <> 0 THEN concat('run:m', s.method, ':n', r.head) ELSE concat('stmt:m', s.method, ':n', s.node) END AS drawn
  FROM c JOIN s USING (method) LEFT JOIN r ON r.method = s.method AND r.node = s.node),
gh AS (SELECT DISTINCT d.endpoint_id, d.drawn AS source, concat('ghost:', coalesce(t.target, m.remote_call_id)) AS target FROM d JOIN {_REMOTE} m USING (method, node) LEFT JOIN {_TARGETS} t USING (remote_call_id))"""


def _canvas(v):
    n, s = F.col("node"), v.syn_statement_node
    nodes, edges = _assembled(v)
    call = F.concat(F.lit("c"), n.cast("string"))
    remote = s.where("signal").select("method", "node", call.alias("remote_call_id"))
    targets = s.where("signal").select(call.alias("remote_call_id"), F.when(n % 3 == 0, F.concat(F.lit("svc-"), (n % 4).cast("string"))).when(n % 3 == 1, "api.example.com").alias("target"))
    expanded = nodes.where("method % 2 = 0").select("endpoint_id", "method").distinct()
    opened = s.where(n % 3 == 0).select("method", n.alias("head"))
    return assembly.canvas(nodes, edges, s, v.syn_statement_flow, expanded, opened, remote, targets)


@query("g14_canvas_nodes", f"""{_DRAWN}
SELECT endpoint_id, drawn AS id, CASE WHEN starts_with(drawn, 'method:') THEN 'method' WHEN starts_with(drawn, 'run:') THEN 'condensed' ELSE 'statement' END AS type, count(*) AS n FROM d GROUP BY ALL
UNION ALL SELECT endpoint_id, concat('method:', method), 'method', 0 FROM c WHERE method % 2 <> 0 AND method NOT IN (SELECT method FROM s) UNION ALL SELECT endpoint_id, target, 'ghost', count(*) FROM gh GROUP BY ALL""")
def _(v):
    return _canvas(v)[0]


@query("g14_canvas_edges", f"""{_DRAWN},
b AS (SELECT d.endpoint_id, d.method, arg_min(drawn, (line, d.node)) AS begin FROM d JOIN s USING (method, node) WHERE d.open GROUP BY ALL)
SELECT a.endpoint_id, a.drawn AS source, z.drawn AS target, x.label AS kind, x.back FROM x JOIN d a ON a.method = x.method AND a.node = x.source JOIN d z ON z.endpoint_id = a.endpoint_id AND z.method = x.method AND z.node = x.target WHERE has_source AND has_target AND a.open AND a.drawn <> z.drawn
UNION ALL (SELECT DISTINCT d.endpoint_id, d.drawn, coalesce(b.begin, concat('method:', callee)), 'call', FALSE FROM d JOIN s USING (method, node) JOIN syn_method m ON m.method = s.callee LEFT JOIN b ON b.endpoint_id = d.endpoint_id AND b.method = s.callee WHERE s.resolved AND d.drawn <> coalesce(b.begin, concat('method:', callee)))
UNION ALL SELECT endpoint_id, source, target, 'remote', FALSE FROM gh""")
def _(v):
    return _canvas(v)[1]


@query("g20_downstream_endpoints", f"""
WITH RECURSIVE {_CLOSED} SELECT DISTINCT c.endpoint_id, concat('c', s.node) AS remote_call_id, e.endpoint_id AS target_endpoint_id
FROM c JOIN syn_statement_node s USING (method) JOIN syn_endpoint e ON e.endpoint_id = s.node % 997 OR e.endpoint_id = s.node % 991 WHERE s.signal AND s.node % 2 = 0""")
def _(v):
    n = F.col("node")
    calls = v.syn_statement_node.where("signal").select("method", "node", F.concat(F.lit("c"), n.cast("string")).alias("remote_call_id"))
    wanted = calls.select("remote_call_id", F.explode(F.when(n % 2 == 0, F.array(n % 997, n % 991)).otherwise(F.array(F.lit(None).cast("long")))).alias("endpoint_id"))
    stitched = wanted.join(v.syn_endpoint.select("endpoint_id", F.col("endpoint_id").alias("target_endpoint_id")), "endpoint_id", "left")
    return assembly.downstream(_assembled(v)[0], calls, stitched)
