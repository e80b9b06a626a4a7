"""Queries over the synthetic snapshot, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.functions import text as X
from skylark.operators import access, coverage, graph, measure, reads, rules, stitch
from skylark.plans import assembly, deployment, evidence, flows, generics, reading, reconcile, rule_evidence, scalars, sinks, slicing, statements, stitching, syntax  # noqa: F401
from skylark.plans.catalog import ORACLES, QUERIES, Views, query  # noqa: F401
from skylark.sources import tables
from skylark.streaming import queue

big = lambda c: F.col(c).cast("long").alias(c)

# ---- scalar functions

_SEGMENTS = """'/' || array_to_string(list_transform(list_filter(string_split(p, '/'), lambda s: s <> ''),
  lambda s: CASE WHEN regexp_matches(s, '^\\{[^/{}]*(:[^{}]*)?\\}$') OR regexp_matches(s, '^:[A-Za-z_][A-Za-z0-9_]*$') THEN '{?}' ELSE s END), '/')"""

@query("f01_simplify_uri", rf"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT endpoint_id + 1000000, concat(uri, '/:id?x=', endpoint_id) FROM syn_endpoint UNION ALL SELECT endpoint_id + 2000000, concat('http://h/', uri, '/{{id:[0-9]+}}#f') FROM syn_endpoint),
c AS (SELECT *, CASE WHEN contains(trim(url), '://') THEN regexp_extract(trim(url), '://[^/?#]*([^?#]*)', 1) ELSE regexp_replace(regexp_replace(trim(url), '(^|[^{{])\?.*$', '\1'), '#.*$', '') END AS p FROM u)
SELECT page_id, url, {_SEGMENTS} AS simplified, TRUE AS stable FROM c""")
def _(v):
    e = v.syn_endpoint
    u = v.pages.select("page_id", "url").union(e.select(F.col("endpoint_id") + 1000000, F.concat("uri", F.lit("/:id?x="), F.col("endpoint_id").cast("string")))).union(e.select(F.col("endpoint_id") + 2000000, F.concat(F.lit("http://h/"), "uri", F.lit("/{id:[0-9]+}#f"))))
    s = X.simplify_uri(F.col("url"))
    return u.select("page_id", "url", s.alias("simplified"), (X.simplify_uri(s) == s).alias("stable"))


_PARTS = "(?i)^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]+)(?::([0-9]+))?(/.*)?$"


@query("f05_url_parts", f"""
WITH u AS (SELECT call_id, trim(url) AS u FROM syn_remote WHERE url IS NOT NULL), m AS (SELECT *, regexp_extract(u, '{_PARTS}', 1) AS h FROM u),
k AS (SELECT *, u <> '' AND NOT starts_with(u, '/') AND h <> '' AND NOT contains(h, '{{') AND NOT contains(h, '$') AS known FROM m)
SELECT call_id, CASE WHEN known THEN h END AS host, CASE WHEN known THEN TRY_CAST(nullif(regexp_extract(u, '{_PARTS}', 2), '') AS INTEGER) END AS port,
  CASE WHEN known THEN coalesce(nullif(regexp_extract(u, '{_PARTS}', 3), ''), '/') END AS path FROM k""")
def _(v):
    return v.syn_remote.where("url IS NOT NULL").select("call_id", X.url_parts(F.col("url")).alias("p")).select("call_id", "p.host", "p.port", "p.path")


@query("f08_external_hosts", """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM pages UNION ALL SELECT page_id + 1000000, concat('10.', page_id % 300, '.0.', page_id % 7) FROM pages)
SELECT page_id, host, contains(host, '.') AS dotted, regexp_matches(host, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$') AS ip FROM h WHERE host <> ''""")
def _(v):
    p = v.pages
    host = F.concat(F.lit("10."), (F.col("page_id") % 300).cast("string"), F.lit(".0."), (F.col("page_id") % 7).cast("string"))
    h = p.select("page_id", X.url_host(F.col("url")).alias("host")).union(p.select(F.col("page_id") + 1000000, host)).where("host IS NOT NULL")
    return h.select("page_id", "host", X.is_external(F.col("host")).alias("dotted"), X.is_ip(F.col("host")).alias("ip"))


@query("f03_content_ids", """
SELECT endpoint_id, 'ep_' || substr(sha256(concat_ws(chr(31), 'endpoint', CAST(service_id AS VARCHAR), http_method, uri)), 1, 16) AS id FROM syn_endpoint""")
def _(v):
    return v.syn_endpoint.select("endpoint_id", X.content_id("ep_", "endpoint", F.col("service_id"), F.col("http_method"), F.col("uri")).alias("id"))


@query("f07_env_keys", "SELECT service_id, upper(translate(app_name || '.' || name, '.-', '__')) AS env_key FROM syn_service")
def _(v):
    return v.syn_service.select("service_id", X.env_key(F.concat_ws(".", "app_name", "name")).alias("env_key"))


@query("f10_weakest_confidence", """
WITH t AS (SELECT call_id, CASE WHEN http_verb IS NULL THEN 'heuristic' ELSE 'exact' END AS a, CASE WHEN url IS NULL THEN 'none' WHEN contains(url, 'legacy') THEN 'high' ELSE 'exact' END AS b FROM syn_call)
SELECT call_id, ['exact', 'high', 'heuristic', 'none'][greatest(list_position(['exact', 'high', 'heuristic', 'none'], a), list_position(['exact', 'high', 'heuristic', 'none'], b))] AS confidence FROM t""")
def _(v):
    a = F.when(F.col("http_verb").isNull(), "heuristic").otherwise("exact")
    b = F.when(F.col("url").isNull(), "none").when(F.contains("url", F.lit("legacy")), "high").otherwise("exact")
    return v.syn_call.select("call_id", X.weakest(a, b).alias("confidence"))


@query("f18_millisecond_times", "SELECT event_id, epoch_ms(date_trunc('milliseconds', ts)) AS ms FROM events")
def _(v):
    return v.events.select("event_id", F.unix_millis(F.date_trunc("millisecond", "ts").cast("timestamp")).alias("ms"))


@query("f20_role_names", "SELECT endpoint_id, regexp_replace(role, '^ROLE_', '') AS role FROM syn_auth WHERE role IS NOT NULL")
def _(v):
    return v.syn_auth.where("role IS NOT NULL").select("endpoint_id", X.role_name(F.col("role")).alias("role"))


@query("x_strip_markup", r"""
SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<script[^>]*>.*?</script>', ' ', 'g'),
  '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_sha FROM pages""")
def _(v):
    return v.pages.select("page_id", F.sha2(X.strip_markup(F.col("html")), 256).alias("text_sha"))


# ---- stitching

_STITCH = stitching.EDGES
KINDS = ("endpoint", "external", "placeholder", "undetermined")


def _edges(v: Views) -> stitch.Edges:
    return stitching.stored(v.spark, v.sf_dir)


@query("j05_phone_book", """
WITH book AS (SELECT lower(trim(name)) AS host, service_id, 1 AS prio FROM syn_service UNION ALL SELECT lower(trim(app_name)), service_id, 2 FROM syn_service),
h AS (SELECT DISTINCT CASE WHEN service_id % 3 = 0 THEN name WHEN service_id % 3 = 1 THEN app_name ELSE 'nobody-' || service_id END AS host FROM syn_service),
r AS (SELECT h.host, service_id, prio, rank() OVER (PARTITION BY h.host ORDER BY prio) AS k FROM h LEFT JOIN book ON book.host = h.host)
SELECT host, service_id, prio, CASE WHEN service_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY host) END AS n_claims FROM r WHERE k = 1""")
def _(v):
    s = v.syn_service
    hosts = s.select(F.when(F.col("service_id") % 3 == 0, F.col("name")).when(F.col("service_id") % 3 == 1, F.col("app_name")).otherwise(F.concat(F.lit("nobody-"), F.col("service_id").cast("string"))).alias("host"))
    return stitch.resolve_hosts(hosts, stitch.phone_book(s))


@query("j07_port_owner", """
WITH o AS (SELECT port, count(*) AS n, min(service_id) AS owner FROM syn_service GROUP BY port)
SELECT e.endpoint_id, o.owner FROM (SELECT endpoint_id, 8000 + endpoint_id % 70 AS port FROM syn_endpoint) e LEFT JOIN o ON o.port = e.port AND o.n = 1""")
def _(v):
    return stitch.resolve_ports(v.syn_endpoint.select("endpoint_id", (F.lit(8000) + F.col("endpoint_id") % 70).alias("port")), v.syn_service).select("endpoint_id", "owner")


@query("j08_gateway_route", """
WITH r AS (SELECT DISTINCT '/' || lower(p_type) AS prefix FROM part UNION SELECT DISTINCT '/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '-')) FROM part WHERE p_size % 2 = 0),
m AS (SELECT endpoint_id, uri, prefix, row_number() OVER (PARTITION BY endpoint_id ORDER BY len(string_split(prefix, '/')) DESC, prefix) AS k FROM syn_endpoint JOIN r ON uri = prefix OR starts_with(uri, prefix || '/'))
SELECT endpoint_id, uri AS path, prefix AS route_id, prefix FROM m WHERE k = 1""")
def _(v):
    p = v.part
    one, two = F.concat(F.lit("/"), F.lower("p_type")), F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
    r = p.select(one.alias("prefix")).union(p.where("p_size % 2 = 0").select(two)).distinct().select(F.col("prefix").alias("route_id"), "prefix", F.col("prefix").alias("ord"))
    return stitch.longest_prefix(v.syn_endpoint.select("endpoint_id", F.col("uri").alias("path")), r, ["endpoint_id"])


@query("j13_stitch", _STITCH + "SELECT * FROM edges")
def _(v):
    return _edges(v).full()


@query("a18_totals_by_kind", _STITCH + "SELECT k.target_kind, k.ord, count(e.call_id) AS n FROM (VALUES ('endpoint', 0), ('external', 1), ('placeholder', 2), ('undetermined', 3)) k(target_kind, ord) LEFT JOIN edges e USING (target_kind) GROUP BY ALL")
def _(v):
    return stitch.totals(_edges(v), "target_kind", KINDS)


@query("a18_totals_by_confidence", _STITCH + "SELECT k.confidence, k.ord, count(e.call_id) AS n FROM (VALUES ('exact', 0), ('high', 1), ('heuristic', 2), ('none', 3)) k(confidence, ord) LEFT JOIN edges e USING (confidence) GROUP BY ALL")
def _(v):
    return stitch.totals(_edges(v), "confidence", X.CONFIDENCE)


_HOSTS = "SELECT external_host, count(*) AS n_calls, array_to_string(list_sort(list_distinct(list(service_id))), ',') AS callers FROM edges WHERE target_kind = '%s' GROUP BY external_host"


@query("a19_placeholders", _STITCH + _HOSTS % "placeholder")
def _(v):
    return stitch.host_rollup(_edges(v), "placeholder")


@query("a20_external_hosts", _STITCH + _HOSTS % "external")
def _(v):
    return stitch.host_rollup(_edges(v), "external")


@query("a30_system_map", _STITCH + """
SELECT service_id AS src, target_service_id AS dst, count(DISTINCT call_id) AS n_calls,
  arg_min(confidence, CASE confidence WHEN 'exact' THEN 0 WHEN 'high' THEN 1 WHEN 'heuristic' THEN 2 ELSE 3 END) AS confidence
FROM edges WHERE target_kind = 'endpoint' GROUP BY ALL""")
def _(v):
    return stitch.system_map(_edges(v))


@query("j01_edge_rows", _STITCH + """
SELECT call_id, s.name AS caller, target_kind, CASE WHEN target_kind = 'endpoint' THEN concat_ws(' ', t.name, p.http_method || ' ' || p.uri) WHEN target_kind IN ('external', 'placeholder') THEN external_host END AS target, confidence
FROM edges e LEFT JOIN syn_service s ON s.service_id = e.service_id LEFT JOIN syn_service t ON t.service_id = e.target_service_id LEFT JOIN syn_endpoint p ON p.endpoint_id = e.target_endpoint_id""")
def _(v):
    return reads.edge_rows(_edges(v), v.syn_service, v.syn_endpoint)


@query("j02_edges_both_ways", _STITCH + """
SELECT service_id, count(*) AS n, 'outbound' AS direction FROM edges GROUP BY service_id
UNION ALL SELECT target_service_id, count(*), 'inbound' FROM edges WHERE target_service_id IS NOT NULL GROUP BY target_service_id""")
def _(v):
    return reads.both_ways(_edges(v))


@query("j19_dependencies", _STITCH + """
SELECT service_id, label, min(call_id) AS call_id FROM (SELECT service_id, call_id, coalesce('endpoint:' || target_endpoint_id, 'host:' || external_host) AS label FROM edges) WHERE label IS NOT NULL GROUP BY ALL""")
def _(v):
    return reads.dependencies(_edges(v))


@query("a44_stitch_summary", _STITCH + """
SELECT (SELECT count(*) FROM own) AS n_calls, count(DISTINCT call_id) AS n_with_edge, count(*) AS n_edges, count(DISTINCT CASE WHEN target_kind = 'undetermined' THEN call_id END) AS n_undetermined FROM edges""")
def _(v):
    e = stitch.summary(_edges(v))
    return stitch.stitchable(v.syn_remote).agg(F.count("*").alias("n_calls")).join(F.broadcast(e), F.lit(True)).select("n_calls", "n_with_edge", "n_edges", "n_undetermined")


# ---- coverage

@query("a10_method_coverage", """
WITH s AS (SELECT * FROM syn_service WHERE kind = 'service'),
r AS (SELECT service_id, sum(reachable_methods) AS reached, sum(production_methods) AS methods FROM s GROUP BY service_id
  UNION ALL SELECT NULL, sum(reachable_methods), sum(production_methods) FROM s WHERE production_methods IS NOT NULL)
SELECT service_id, CAST(reached AS BIGINT) AS reached, CAST(methods AS BIGINT) AS methods, round(reached * 100.0 / nullif(methods, 0), 1) AS percent FROM r""")
def _(v):
    return coverage.method_coverage(v.syn_service).select("service_id", big("reached"), big("methods"), F.col("percent").cast("double").alias("percent"))


_STATE = "CASE WHEN denied THEN 'denied' WHEN authenticated IS NULL AND unread THEN 'withheld' WHEN authenticated IS NULL THEN 'unknown' WHEN authenticated THEN 'protected' ELSE 'open' END"


@query("a13_auth_states", f"""
WITH t AS (SELECT service_id, {_STATE} AS s FROM syn_auth)
SELECT service_id, count(*) AS n, count(*) FILTER (s = 'denied') AS n_denied, count(*) FILTER (s = 'protected') AS n_protected, count(*) FILTER (s = 'open') AS n_open,
  count(*) FILTER (s = 'withheld') AS n_withheld, count(*) FILTER (s = 'unknown') AS n_unknown FROM t GROUP BY service_id""")
def _(v):
    return coverage.auth_states(v.syn_auth)


@query("f27_endpoint_auth", f"SELECT endpoint_id, {_STATE} AS state FROM syn_auth")
def _(v):
    return v.syn_auth.select("endpoint_id", coverage.auth_state().alias("state"))


@query("a12_unread_by_kind", """
SELECT k.evidence, coalesce(count(*) FILTER (unread), 0) AS n_unread, count(a.endpoint_id) = 0 AS unexercised
FROM (VALUES ('filter-chain'), ('annotation'), ('in-handler'), ('aspect')) k(evidence) LEFT JOIN syn_auth a USING (evidence) GROUP BY k.evidence""")
def _(v):
    return coverage.unread_by_kind(v.syn_auth, ("filter-chain", "annotation", "in-handler", "aspect"))


@query("a33_role_legend", "SELECT role, n, CAST(row_number() OVER (ORDER BY n DESC, role) AS INTEGER) AS place FROM (SELECT role, count(*) AS n FROM syn_auth WHERE role IS NOT NULL GROUP BY role)")
def _(v):
    return coverage.role_legend(v.syn_auth)


@query("a24_endpoint_collisions", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY service_id, http_method, uri ORDER BY handler, endpoint_id) AS rn FROM syn_endpoint)
SELECT service_id, http_method, uri, arg_min(endpoint_id, rn) AS kept, array_to_string(list_sort(list(endpoint_id) FILTER (rn > 1)), ',') AS dropped, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 1""")
def _(v):
    return coverage.collisions(v.syn_endpoint)


@query("a21_anomaly_samples", """
WITH n AS (SELECT http_method AS code, count(*) AS n FROM syn_endpoint GROUP BY ALL),
f AS (SELECT http_method AS code, endpoint_id, row_number() OVER (PARTITION BY http_method ORDER BY endpoint_id) AS k FROM syn_endpoint)
SELECT code, n, array_to_string(list_sort(list(endpoint_id)), ',') AS samples FROM n JOIN f USING (code) WHERE k <= 5 GROUP BY ALL""")
def _(v):
    return coverage.anomaly_samples(v.syn_endpoint.select(F.col("http_method").alias("code"), "endpoint_id"), "code", "endpoint_id")


@query("a14_folded_facts", """
SELECT entity, operation, count(*) AS n, min(site) AS sample FROM syn_access GROUP BY ALL""")
def _(v):
    facts = v.syn_access.select("entity", "operation", "site", F.lit(1).cast("long").alias("one"))
    return coverage.folded(facts, ["entity", "operation"], "one", "site", "site")


# ---- entity access

_OPS = "(VALUES ('create', 0), ('create-or-update', 1), ('read', 2), ('update', 3), ('delete', 4), ('unknown', 5)) o(operation, ord)"


@query("a06_entity_summaries", f"""
WITH d AS (SELECT DISTINCT endpoint_id, entity, operation FROM syn_access),
l AS (SELECT d.endpoint_id, d.entity, string_agg(d.operation, ',' ORDER BY o.ord) AS operations FROM d JOIN {_OPS} USING (operation) GROUP BY ALL),
n AS (SELECT endpoint_id, entity, count(DISTINCT site) AS n_sites, count(DISTINCT site) FILTER (operation = 'create') AS n_create, count(DISTINCT site) FILTER (operation = 'read') AS n_read,
  count(DISTINCT site) FILTER (operation = 'update') AS n_update, count(DISTINCT site) FILTER (operation = 'delete') AS n_delete, count(DISTINCT site) FILTER (operation = 'unknown') AS n_unknown FROM syn_access GROUP BY ALL)
SELECT n.endpoint_id, n.entity, operations, n_sites, n_create, n_read, n_update, n_delete, n_unknown FROM n JOIN l ON l.endpoint_id = n.endpoint_id AND l.entity IS NOT DISTINCT FROM n.entity""")
def _(v):
    return access.summaries(v.syn_access)


@query("a07_entity_usage", f"""
WITH a AS (SELECT coalesce(entity, '(undetermined)') AS entity, operation, endpoint_id, site FROM syn_access),
n AS (SELECT entity, operation, count(DISTINCT endpoint_id) AS e, count(DISTINCT site) AS s FROM a GROUP BY ALL)
SELECT x.entity, o.operation, o.ord, coalesce(e, 0) AS n_endpoints, coalesce(s, 0) AS n_sites FROM (SELECT DISTINCT entity FROM a) x CROSS JOIN {_OPS} LEFT JOIN n ON n.entity = x.entity AND n.operation = o.operation""")
def _(v):
    return access.usage(v.syn_access)


@query("a31_entity_matrix", "SELECT entity, " + ", ".join(f"count(DISTINCT endpoint_id) FILTER (operation = '{o}') AS {o.replace('-', '_')}" for o in access.OPERATIONS) + " FROM syn_access WHERE entity IS NOT NULL GROUP BY entity")
def _(v):
    return access.matrix(v.syn_access)


@query("a32_known_service_sites", """
SELECT s.service_id, CASE WHEN production_methods IS NOT NULL THEN coalesce(n, 0) END AS n_sites FROM syn_service s LEFT JOIN (SELECT service_id, count(DISTINCT site) AS n FROM syn_access GROUP BY ALL) a USING (service_id)""")
def _(v):
    return access.service_counts(v.syn_access, v.syn_service)


@query("a22_access_accounting", """
SELECT service_id, count(*) AS n, count(entity) AS n_bound, count(*) - count(entity) AS n_undetermined, count(*) FILTER (operation <> 'unknown') AS n_operation,
  count(*) FILTER (operation = 'unknown') AS n_unknown, count(*) FILTER (operation <> 'unknown' AND entity IS NOT NULL) AS n_full FROM syn_access GROUP BY service_id""")
def _(v):
    return access.accounting(v.syn_access)


# ---- rules

_GOVERN = """
WITH m AS (
  SELECT e.endpoint_id, r.* EXCLUDE (service_id) FROM syn_endpoint e JOIN syn_rule r ON r.service_id = e.service_id
  WHERE pattern = '/**' OR (ends_with(pattern, '/**') AND (uri = replace(pattern, '/**', '') OR starts_with(uri, replace(pattern, '**', ''))))
    OR (NOT ends_with(pattern, '/**') AND starts_with(uri, replace(pattern, '*', '')) AND NOT contains(substr(uri, length(pattern)), '/'))),
s AS (SELECT *, min(CASE WHEN is_read THEN ord END) OVER (PARTITION BY endpoint_id) AS stop FROM m),
g AS (SELECT endpoint_id, rule_id, access, is_read, 'exact' AS precision FROM s WHERE stop IS NULL OR ord <= stop)
"""


@query("j28_governing_rules", _GOVERN + "SELECT * FROM g")
def _(v):
    return rules.governing(v.syn_endpoint, v.syn_rule)


@query("f26_rule_verdicts", _GOVERN + """,
h AS (SELECT endpoint_id, max(CASE WHEN is_read THEN access END) AS access, count(*) FILTER (NOT is_read) AS n_unread FROM g GROUP BY ALL)
SELECT e.endpoint_id, CASE WHEN access = 'deny' THEN 'denied' WHEN access = 'authenticated' THEN 'protected' WHEN access = 'permit' AND n_unread > 0 THEN 'withheld' WHEN access = 'permit' THEN 'open'
  WHEN n_unread > 0 THEN 'withheld' ELSE 'unknown' END AS state, coalesce(n_unread, 0) AS n_unread FROM syn_endpoint e LEFT JOIN h USING (endpoint_id)""")
def _(v):
    return rules.verdict(rules.governing(v.syn_endpoint, v.syn_rule), v.syn_endpoint)


# ---- graph

_CLOSURE = """
WITH RECURSIVE r(root, node, level) AS (
  SELECT root, root, 0 FROM syn_root UNION SELECT r.root, g.dst, r.level + 1 FROM r JOIN syn_call_graph g ON g.src = r.node WHERE r.level < 10),
c AS (SELECT root, node, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY ALL)
"""


@query("g01_closure", _CLOSURE + "SELECT * FROM c")
def _(v):
    return graph.closure(v.syn_call_graph, v.syn_root)


@query("g03_closure_leaves", _CLOSURE + "SELECT node, root, level FROM c WHERE NOT EXISTS (SELECT 1 FROM syn_call_graph g WHERE g.src = c.node)")
def _(v):
    return graph.leaves(v.syn_call_graph, graph.closure(v.syn_call_graph, v.syn_root))


@query("g08_call_tree", """
WITH RECURSIVE t(root, path, trail, node, depth, cycle) AS (
  SELECT root, CAST(root AS VARCHAR), [root], root, 0, FALSE FROM syn_root
  UNION ALL SELECT t.root, t.path || '>' || g.dst, list_append(t.trail, g.dst), g.dst, t.depth + 1, list_contains(t.trail, g.dst) FROM t JOIN syn_call_graph g ON g.src = t.node WHERE NOT t.cycle)
SELECT root, path, node, depth, cycle FROM t""")
def _(v):
    return graph.call_tree(v.syn_call_graph, v.syn_root)


@query("g12_witness_paths", _CLOSURE + """,
p AS (SELECT c.root, c.node, c.level, min(g.src) AS src FROM c JOIN syn_call_graph g ON g.dst = c.node JOIN c x ON x.root = c.root AND x.node = g.src AND x.level = c.level - 1 GROUP BY ALL),
w AS (SELECT root, root AS node, 0 AS level, CAST(root AS VARCHAR) AS path FROM syn_root
  UNION ALL SELECT p.root, p.node, p.level, w.path || '>' || p.node FROM w JOIN p ON p.root = w.root AND p.src = w.node AND p.level = w.level + 1)
SELECT root, node, level, path FROM w""")
def _(v):
    return graph.witness_paths(v.syn_call_graph, v.syn_root)


@query("g06_flow_invariants", """
WITH o AS (SELECT endpoint_id, source AS node_id, count(*) AS n_out, count(*) FILTER (kind = 'true') AS t, count(*) FILTER (kind = 'false') AS f FROM syn_edge GROUP BY ALL),
i AS (SELECT endpoint_id, target AS node_id, count(*) AS n_in FROM syn_edge GROUP BY ALL),
a AS (SELECT n.endpoint_id, n.node_id, n.kind, coalesce(n_out, 0) AS n_out, coalesce(t, 0) AS t, coalesce(f, 0) AS f, coalesce(n_in, 0) AS n_in FROM syn_node n LEFT JOIN o USING (endpoint_id, node_id) LEFT JOIN i USING (endpoint_id, node_id))
SELECT 'disconnected' AS code, endpoint_id, node_id FROM a WHERE n_in = 0 AND n_out = 0
UNION ALL SELECT 'branch-without-true', endpoint_id, node_id FROM a WHERE kind = 'branch' AND t = 0
UNION ALL SELECT 'branch-without-false', endpoint_id, node_id FROM a WHERE kind = 'branch' AND t > 0 AND f = 0
UNION ALL SELECT 'fork-without-branch', endpoint_id, node_id FROM a WHERE kind <> 'branch' AND n_out > 1""")
def _(v):
    return graph.invariants(v.syn_node, v.syn_edge)


@query("w04_entry_nodes", """
WITH r AS (SELECT n.endpoint_id, n.node_id, n.line, row_number() OVER (PARTITION BY n.endpoint_id ORDER BY e.target IS NOT NULL, n.line, n.node_id) AS k
  FROM syn_node n LEFT JOIN (SELECT DISTINCT endpoint_id, target FROM syn_edge) e ON e.endpoint_id = n.endpoint_id AND e.target = n.node_id)
SELECT endpoint_id, node_id, line FROM r WHERE k = 1""")
def _(v):
    return graph.entry_nodes(v.syn_node, v.syn_edge)


_SPANS = "SELECT DISTINCT conv_id, 2 * turn AS lo, 2 * turn + length(text) % 3 AS hi FROM conversations"


@query("w05_merged_intervals", f"""
WITH s AS ({_SPANS}),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY conv_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT conv_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY conv_id, island""")
def _(v):
    n = F.length("text")
    spans = v.conversations.select("conv_id", (2 * F.col("turn")).alias("lo"), (2 * F.col("turn") + n % 3).alias("hi")).distinct()
    return graph.merged_intervals(spans, ["conv_id"])


@query("w07_condensed_runs", """
WITH p AS (SELECT *, node_id - row_number() OVER (PARTITION BY endpoint_id ORDER BY node_id) AS k FROM syn_node WHERE kind = 'statement')
SELECT endpoint_id, count(*) AS n, min(node_id) AS first, max(node_id) AS last FROM p GROUP BY endpoint_id, k HAVING count(*) >= 2""")
def _(v):
    return graph.condensed_runs(v.syn_node)


@query("a25_method_rollup", """
SELECT endpoint_id, method_id, count(*) AS n_nodes, count(*) FILTER (kind = 'branch') AS n_branch, count(*) FILTER (kind = 'call') AS n_call, count(*) FILTER (kind = 'statement') AS n_statement, min(node_id) AS first_node
FROM syn_node GROUP BY ALL""")
def _(v):
    return graph.rollup_by_method(v.syn_node)


# ---- reads, windows and sets

@query("j20_services_with_counts", "SELECT s.service_id, name, kind, coalesce(n, 0) AS n_endpoints FROM syn_service s LEFT JOIN (SELECT service_id, count(*) AS n FROM syn_endpoint GROUP BY ALL) e USING (service_id)")
def _(v):
    return reads.services_with_counts(v.syn_service, v.syn_endpoint)


@query("p04_endpoint_list", "SELECT endpoint_id, http_method, uri FROM syn_endpoint WHERE service_id = 7")
def _(v):
    return reads.endpoint_list(v.syn_endpoint, 7)


@query("p21_search", "SELECT endpoint_id, 'handler' AS field FROM syn_endpoint WHERE contains(lower(handler), 'widget') UNION ALL SELECT endpoint_id, 'uri' FROM syn_endpoint WHERE contains(lower(uri), 'widget')")
def _(v):
    return reads.search(v.syn_endpoint, ["handler", "uri"], "Widget", "endpoint_id")


@query("w09_newest_succeeded", """
SELECT job_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY status <> 'succeeded', ts DESC, event_id) AS k FROM syn_job) WHERE k = 1""")
def _(v):
    return reads.first_of(v.syn_job, ["job_id"], [F.col("status") != "succeeded", F.desc("ts"), "event_id"]).select("job_id", "event_id", "status")


@query("w13_disambiguated_names", """
SELECT service_id, CASE WHEN count(*) OVER (PARTITION BY snapshot_id, app_name) > 1 THEN name ELSE app_name END AS shown FROM syn_service""")
def _(v):
    return reads.disambiguated(v.syn_service, "app_name", ["snapshot_id"], "name").select("service_id", "shown")


@query("l07_capped_candidates", """
WITH r AS (SELECT service_id, endpoint_id, row_number() OVER (PARTITION BY service_id ORDER BY uri, endpoint_id) AS rn, count(*) OVER (PARTITION BY service_id) AS n FROM syn_endpoint)
SELECT service_id, endpoint_id, CAST(rn AS INTEGER) AS rn, n > 8 AS truncated FROM r WHERE rn <= 8""")
def _(v):
    return reads.capped(v.syn_endpoint, ["service_id"], ["uri", "endpoint_id"], 8).select("service_id", "endpoint_id", "rn", "truncated")


@query("l10_seeded_sample", """
WITH r AS (SELECT endpoint_id, row_number() OVER (ORDER BY md5('20261115:' || endpoint_id)) AS k FROM syn_endpoint)
SELECT endpoint_id, 'b' || lpad(CAST(k AS VARCHAR), 3, '0') AS sample_id FROM r WHERE k <= 40""")
def _(v):
    return reads.sampled(v.syn_endpoint.select("endpoint_id"), "endpoint_id", 20261115, 40)


@query("u03_name_conflicts", """
WITH book AS (SELECT lower(trim(name)) AS host, service_id, 1 AS prio FROM syn_service UNION ALL SELECT lower(trim(app_name)), service_id, 2 FROM syn_service)
SELECT prio, host, count(DISTINCT service_id) AS n, array_to_string(list_sort(list_distinct(list(service_id))), ',') AS services FROM book GROUP BY ALL HAVING count(DISTINCT service_id) > 1""")
def _(v):
    return reads.conflicts(stitch.phone_book(v.syn_service))


@query("u05_oracle_difference", """
WITH a AS (SELECT DISTINCT service_id, entity FROM syn_access WHERE operation = 'read' AND entity IS NOT NULL), b AS (SELECT DISTINCT service_id, entity FROM syn_access WHERE operation = 'delete' AND entity IS NOT NULL)
SELECT coalesce(a.service_id, b.service_id) AS service_id, coalesce(a.entity, b.entity) AS entity, CASE WHEN b.service_id IS NULL THEN 'left-only' WHEN a.service_id IS NULL THEN 'right-only' ELSE 'agree' END AS side
FROM a FULL JOIN b ON a.service_id = b.service_id AND a.entity = b.entity""")
def _(v):
    a = v.syn_access.where("entity IS NOT NULL")
    return reads.difference(a.where("operation = 'read'"), a.where("operation = 'delete'"), ["service_id", "entity"])


# ---- measurement

@query("j35_paired_sites", """
WITH a AS (SELECT service_id, entity, site, row_number() OVER (PARTITION BY service_id, entity ORDER BY site) AS rn FROM syn_access WHERE operation = 'read' AND entity IS NOT NULL),
b AS (SELECT service_id, entity, site, row_number() OVER (PARTITION BY service_id, entity ORDER BY site) AS rn FROM syn_access WHERE operation = 'update' AND entity IS NOT NULL)
SELECT coalesce(a.service_id, b.service_id) AS service_id, coalesce(a.entity, b.entity) AS entity, CAST(coalesce(a.rn, b.rn) AS INTEGER) AS rn, a.site AS oracle_id, b.site AS found_id
FROM a FULL JOIN b ON a.service_id = b.service_id AND a.entity = b.entity AND a.rn = b.rn""")
def _(v):
    a = v.syn_access.where("entity IS NOT NULL")
    return measure.paired(a.where("operation = 'read'"), a.where("operation = 'update'"), ["service_id", "entity"], "site")


_VERDICT = "CASE (doc_id * 7 + quality * 3 + toxic) % 4 WHEN 0 THEN 'wrong' WHEN 1 THEN 'missed' WHEN 2 THEN 'extra' ELSE 'agree' END"


@query("a39_strata", f"""
WITH t AS (SELECT quality, {_VERDICT} AS verdict FROM labels)
SELECT quality, count(*) AS n, count(*) FILTER (verdict = 'wrong') AS n_wrong, count(*) FILTER (verdict = 'missed') AS n_missed, count(*) FILTER (verdict = 'extra') AS n_extra, count(*) FILTER (verdict = 'agree') AS n_agree FROM t GROUP BY quality""")
def _(v):
    return measure.strata(v.labels.select("quality", F.expr(_VERDICT).alias("verdict")), "quality", "verdict")


@query("a40_worst_verdicts", f"""
WITH t AS (SELECT doc_id // 10 AS pair, CASE {_VERDICT} WHEN 'wrong' THEN 1 WHEN 'missed' THEN 2 WHEN 'extra' THEN 3 ELSE 4 END AS o FROM labels)
SELECT pair, ['wrong', 'missed', 'extra', 'agree'][min(o)] AS verdict FROM t GROUP BY pair""")
def _(v):
    return measure.worst_verdict(v.labels.select(F.expr("doc_id div 10").alias("pair"), F.expr(_VERDICT).alias("verdict")), ["pair"], "verdict")


@query("f16_error_bounds", """
WITH RECURSIVE n AS (SELECT quality, count(*) AS n, count(*) FILTER (doc_id % 50 = 0) AS errors FROM labels GROUP BY quality),
b AS (
  SELECT quality, n, errors, errors / n::DOUBLE AS lo, 1::DOUBLE AS hi, 0 AS k FROM n
  UNION ALL SELECT quality, n, errors, CASE WHEN tail > 0.05 THEN p ELSE lo END, CASE WHEN tail > 0.05 THEN hi ELSE p END, k + 1
  FROM (SELECT *, (lo + hi) / 2 AS p, list_sum(list_transform(range(0, errors + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) AS tail FROM b WHERE k < 45))
SELECT quality, n, errors, round(hi, 6) AS bound FROM b WHERE k = 45""")
def _(v):
    n = v.labels.groupBy("quality").agg(F.count("*").alias("n"), F.count_if((F.col("doc_id") % 50) == 0).alias("errors"))
    return measure.with_bounds(n, "errors", "n").withColumn("bound", F.round("bound", 6))


# ---- jobs and exports

@query("a02_job_status", "SELECT status, count(*) AS n FROM syn_job GROUP BY status")
def _(v):
    return v.syn_job.groupBy("status").agg(F.count("*").alias("n"))


@query("t06_snapshot_states", """
SELECT snapshot AS snapshot_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'succeeded') THEN 'done' ELSE 'running' END AS state, count(*) AS n_jobs FROM (SELECT *, job_id * 1000 + event_id % 3 AS snapshot FROM syn_job) GROUP BY snapshot""")
def _(v):
    return queue.snapshot_states(v.syn_job.withColumn("snapshot_id", F.col("job_id") * 1000 + F.col("event_id") % 3))


@query("t01_claimable", """
WITH r AS (SELECT snapshot_id, job_id, event_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY ts, event_id) AS k FROM syn_job
  WHERE (status = 'pending' OR (status = 'running' AND epoch(ts) // 1 + 600 < 1710000000)) AND event_id % 5 < 3)
SELECT snapshot_id, event_id AS job_id FROM r WHERE k = 1""")
def _(v):
    jobs = v.syn_job.select("snapshot_id", F.col("event_id").alias("job_id"), "status", (F.unix_seconds(F.col("ts").cast("timestamp")) + 600).alias("lease_until"), F.col("ts").alias("created_at"), (F.col("event_id") % 5).alias("attempts"))
    return queue.claimable(jobs, 1710000000).select("snapshot_id", "job_id")


@query("t02_queue_replay", """
WITH RECURSIVE e AS (
  SELECT user_id AS job_id, epoch(ts)::BIGINT AS tm, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END AS action,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS rn FROM events),
s AS (
  SELECT job_id, 0::BIGINT AS rn, 'none' AS status, 0 AS attempts, 0::BIGINT AS until FROM (SELECT DISTINCT job_id FROM e)
  UNION ALL
  SELECT job_id, rn, CASE WHEN action = 'enqueue' AND st IN ('none', 'succeeded', 'failed') THEN 'pending' WHEN action = 'claim' AND st = 'pending' THEN 'running' WHEN action = 'complete' AND st = 'running' THEN 'succeeded'
      WHEN action = 'fail' AND st = 'running' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE st END,
    CASE WHEN action = 'enqueue' AND st IN ('none', 'succeeded', 'failed') THEN 0 WHEN action = 'claim' AND st = 'pending' THEN attempts + 1 ELSE attempts END,
    CASE WHEN action = 'enqueue' AND st IN ('none', 'succeeded', 'failed') THEN 0 WHEN action = 'claim' AND st = 'pending' OR action = 'heartbeat' AND st = 'running' THEN tm + 600
      WHEN action IN ('complete', 'fail') AND st = 'running' THEN 0 ELSE until END
  FROM (SELECT s.job_id, e.rn, e.tm, e.action, s.attempts, s.until, CASE WHEN s.status = 'running' AND e.tm > s.until THEN CASE WHEN s.attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE s.status END AS st
    FROM s JOIN e ON e.job_id = s.job_id AND e.rn = s.rn + 1))
SELECT s.job_id, s.status, s.attempts FROM s JOIN (SELECT job_id, max(rn) AS rn FROM e GROUP BY job_id) m ON m.job_id = s.job_id AND m.rn = s.rn""")
def _(v):
    action = F.element_at(F.create_map(*[F.lit(x) for kv in queue.ACTIONS.items() for x in kv]), F.col("event_type"))
    return queue.replay(v.events.select(F.col("user_id").alias("job_id"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), action.alias("action")))


@query("k12_manifest_check", """
WITH d AS (SELECT 'endpoint' AS kind, (SELECT count(*) FROM syn_endpoint) AS declared, (SELECT count(*) FROM syn_endpoint WHERE endpoint_id % 3 <> 0) AS received
  UNION ALL SELECT 'service', (SELECT count(*) FROM syn_service), (SELECT count(*) FROM syn_service))
SELECT kind, declared, received FROM d WHERE declared IS DISTINCT FROM received""")
def _(v):
    rows = tables.bundle({"service": v.syn_service, "endpoint": v.syn_endpoint})
    lost = (F.col("kind") == "endpoint") & (F.get_json_object("artifact", "$.endpoint_id").cast("long") % 3 == 0)
    return tables.manifest_errors(rows.where(~lost))


@query("k11_export_counts", "SELECT 'endpoint' AS kind, count(*) AS n FROM syn_endpoint UNION ALL SELECT 'service', count(*) FROM syn_service UNION ALL SELECT 'manifest', 2")
def _(v):
    return tables.bundle({"service": v.syn_service, "endpoint": v.syn_endpoint}).groupBy("kind").agg(F.count("*").alias("n"))
