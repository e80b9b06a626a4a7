"""Read views, joins, sequence and graph queries over the synthetic snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.functions import text as X
from skylark.operators import coverage, graph, reads, stitch
from skylark.plans import stitching
from skylark.plans.catalog import query

_EDGES = stitching.EDGES


def _edges(v):
    return stitching.stored(v.spark, v.sf_dir)


@query("p01_boundaries", "SELECT name, service_id, kind, port FROM syn_service WHERE snapshot_id = 1")
def _(v):
    return reads.listed(v.syn_service, ["name"], ["name", "service_id", "kind", "port"], snapshot_id=1)


@query("p02_boundary", "SELECT service_id, name, port FROM syn_service WHERE service_id = 7")
def _(v):
    return reads.point(v.syn_service, ["service_id", "name", "port"], service_id=7)


@query("p05_all_endpoints", "SELECT service_id, uri, http_method, endpoint_id FROM syn_endpoint")
def _(v):
    return reads.listed(v.syn_endpoint, ["service_id", "uri", "http_method", "endpoint_id"], ["service_id", "uri", "http_method", "endpoint_id"])


@query("p06_access_rows", "SELECT endpoint_id, service_id, entity, operation, site FROM syn_access")
def _(v):
    return v.syn_access.select("endpoint_id", "service_id", "entity", "operation", "site")


@query("p08_endpoint", "SELECT endpoint_id, service_id, http_method, uri, handler FROM syn_endpoint WHERE endpoint_id = 11")
def _(v):
    return reads.point(v.syn_endpoint, ["endpoint_id", "service_id", "http_method", "uri", "handler"], endpoint_id=11)


@query("p10_remote_calls", "SELECT call_id, http_verb, url FROM syn_remote WHERE service_id = 3")
def _(v):
    return reads.listed(v.syn_remote, ["call_id"], ["call_id", "http_verb", "url"], service_id=3)


@query("p13_edges_by_direction", _EDGES + "SELECT 'outbound' AS direction, call_id, target_kind FROM edges WHERE service_id = 5 UNION ALL SELECT 'inbound', call_id, target_kind FROM edges WHERE target_service_id = 5")
def _(v):
    e = _edges(v)
    both = [reads.edges_of(e, 5, d).select(F.lit(d).alias("direction"), "call_id", "target_kind") for d in ("outbound", "inbound")]
    return both[0].union(both[1])


@query("p14_edges_of_calls", _EDGES + "SELECT call_id, target_kind, target_endpoint_id FROM edges WHERE call_id IN (SELECT call_id FROM syn_remote WHERE http_verb = 'PUT')")
def _(v):
    return reads.edges_of_calls(_edges(v), v.syn_remote.where("http_verb = 'PUT'")).select("call_id", "target_kind", "target_endpoint_id")


@query("p15_report_exists", "SELECT TRUE AS found")
def _(v):
    return reads.exists(v.syn_service)


@query("p16_snapshots_newest_first", "SELECT ts, event_id, status FROM syn_job WHERE job_id = 4")
def _(v):
    return reads.listed(v.syn_job, [F.desc("ts"), F.desc("event_id")], ["ts", "event_id", "status"], job_id=4)


@query("p20_unread_evidence", "SELECT endpoint_id, evidence FROM syn_auth WHERE unread AND authenticated IS NULL")
def _(v):
    return v.syn_auth.where("unread AND authenticated IS NULL").select("endpoint_id", "evidence")


@query("p22_filtered_auth", "SELECT endpoint_id, role FROM syn_auth WHERE contains(lower(role), 'brand_1') AND NOT denied AND authenticated")
def _(v):
    return v.syn_auth.where((coverage.auth_state() == "protected") & F.contains(F.lower("role"), F.lit("brand_1"))).select("endpoint_id", "role")


@query("p24_source_window", r"""
WITH d AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, len(lines) AS n, sha256(unnest(lines)) AS h, generate_subscripts(lines, 1) AS i FROM d)
SELECT doc_id, CAST(i AS INTEGER) AS line, h AS line_sha, n > 6 AS truncated FROM l WHERE i BETWEEN 3 AND 6""")
def _(v):
    lines = v.documents.select(F.col("doc_id").alias("path"), F.posexplode(X.source_lines(F.col("text"))).alias("i", "t")).select("path", (F.col("i") + 1).alias("line"), F.sha2("t", 256).alias("line_sha"))
    return reads.windowed_lines(lines, 3, 4).withColumnRenamed("path", "doc_id")


@query("p25_edges_of_a_method", """
WITH m AS (SELECT endpoint_id, node_id FROM syn_node WHERE method_id = 3)
SELECT e.endpoint_id, e.source, e.target, e.kind FROM syn_edge e WHERE EXISTS (SELECT 1 FROM m WHERE m.endpoint_id = e.endpoint_id AND m.node_id IN (e.source, e.target))""")
def _(v):
    m = v.syn_node.where("method_id = 3").select("endpoint_id", "node_id")
    ends = [v.syn_edge.join(m.withColumnRenamed("node_id", c), ["endpoint_id", c], "left_semi") for c in ("source", "target")]
    return ends[0].unionByName(ends[1]).distinct().select("endpoint_id", "source", "target", "kind")


_ENTITIES = "SELECT DISTINCT concat('com.acme.', lower(p_brand), '.', p_type) AS entity FROM part"


@query("p26_selected_entities", f"""
WITH n AS (SELECT entity, regexp_extract(entity, '([^.]*)$', 1) AS simple FROM ({_ENTITIES})), w AS (SELECT entity AS wanted FROM n UNION SELECT simple FROM n UNION SELECT 'nothing' UNION SELECT concat('Own', p_partkey) FROM part),
s AS (SELECT simple, count(*) AS k, min(entity) AS only FROM n GROUP BY simple)
SELECT w.wanted, coalesce(n.entity, CASE WHEN s.k = 1 THEN s.only END) AS entity, CASE WHEN n.entity IS NOT NULL THEN 1 ELSE coalesce(s.k, 0) END AS n_candidates FROM w LEFT JOIN n ON n.entity = w.wanted LEFT JOIN s ON s.simple = w.wanted""")
def _(v):
    rows = v.part.select(F.concat(F.lit("com.acme."), F.lower("p_brand"), F.lit("."), "p_type").alias("entity")).distinct()
    own = v.part.select(F.concat(F.lit("Own"), F.col("p_partkey").cast("string")))
    wanted = rows.select(F.col("entity").alias("wanted")).union(rows.select(F.substring_index("entity", ".", -1))).union(v.spark.createDataFrame([("nothing",)], "wanted string")).union(own).distinct()
    return reads.selected_entity(rows, wanted)


_FLOW_CALLS = "SELECT DISTINCT l_partkey AS endpoint_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS call_id FROM {lineitem}"


@query("j17_endpoint_outbound", _EDGES + f", f AS ({_FLOW_CALLS.replace('{lineitem}', 'lineitem')}) SELECT f.endpoint_id, count(e.call_id) AS n_edges, TRUE AS stitched FROM f LEFT JOIN edges e USING (call_id) GROUP BY f.endpoint_id")
def _(v):
    flow = v.spark.sql(_FLOW_CALLS, lineitem=v.lineitem)
    return reads.outbound(flow, _edges(v), v.syn_service)


@query("j21_system_graph", _EDGES + """
SELECT coalesce(s.name, CAST(e.service_id AS VARCHAR)) AS caller, coalesce(t.name, e.external_host) AS target, target_kind AS kind, count(*) AS n
FROM edges e LEFT JOIN syn_service s ON s.service_id = e.service_id LEFT JOIN syn_service t ON t.service_id = e.target_service_id GROUP BY ALL""")
def _(v):
    return reads.system_graph(_edges(v), v.syn_service)


@query("j22_auth_with_names", "SELECT a.endpoint_id, coalesce(s.name, CAST(a.service_id AS VARCHAR)) AS service, a.role FROM syn_auth a LEFT JOIN (SELECT * FROM syn_service WHERE kind = 'service') s USING (service_id)")
def _(v):
    names = v.syn_service.where("kind = 'service'").select("service_id", "name")
    return v.syn_auth.join(names, "service_id", "left").select("endpoint_id", F.coalesce("name", F.col("service_id").cast("string")).alias("service"), "role")


@query("j26_binding_entries", """
WITH c AS (SELECT endpoint_id AS ord, replace(substr(uri, 2), '/', '.') AS key FROM syn_endpoint), r AS (SELECT DISTINCT service_id AS rule_id, lower(p_type) AS prefix FROM syn_service JOIN part ON p_partkey = service_id)
SELECT rule_id, arg_min(key, ord) AS key FROM r JOIN c ON key = prefix OR starts_with(key, prefix || '.') GROUP BY rule_id""")
def _(v):
    config = v.syn_endpoint.select(F.col("endpoint_id").alias("ord"), F.replace(F.substring("uri", 2, 1000), F.lit("/"), F.lit(".")).alias("key"))
    rules = v.syn_service.join(v.part, F.col("p_partkey") == F.col("service_id")).select(F.col("service_id").alias("rule_id"), F.lower("p_type").alias("prefix")).distinct()
    return reads.binding_entries(rules, config)


@query("j32_module_owners", "SELECT service_id AS module, app_name AS artifact, owner FROM syn_service JOIN (SELECT app_name, min(service_id) AS owner FROM syn_service GROUP BY app_name) USING (app_name)")
def _(v):
    s = v.syn_service
    return reads.first_owner(s.select(F.col("service_id").alias("module"), F.col("app_name").alias("artifact")), s.select(F.col("app_name").alias("artifact"), F.col("service_id").alias("owner")))


@query("j33_unique_names", "SELECT app_name, CASE WHEN count(DISTINCT service_id) = 1 THEN min(service_id) END AS service_id FROM syn_service GROUP BY app_name")
def _(v):
    return reads.unique_names(v.syn_service, "app_name", "service_id")


@query("j34_tables_to_entities", """
WITH e AS (SELECT DISTINCT p_type AS entity, p_type AS tab, CASE WHEN p_type = 'SMALL' THEN 'pub' END AS sch FROM part),
u AS (SELECT endpoint_id AS use_id, CASE WHEN endpoint_id % 2 = 0 THEN lower(entity) ELSE entity END AS name, endpoint_id % 3 = 0 AS quoted, CASE WHEN endpoint_id % 5 = 0 THEN 'other' END AS sch FROM syn_endpoint)
SELECT u.use_id, CASE WHEN count(DISTINCT e.entity) = 1 THEN min(e.entity) END AS entity
FROM u LEFT JOIN e ON lower(u.name) = lower(e.tab) AND (NOT u.quoted OR u.name = e.tab) AND (u.sch IS NULL OR e.sch IS NULL OR u.sch = e.sch) GROUP BY u.use_id""")
def _(v):
    entities = v.part.select(F.col("p_type").alias("entity"), F.col("p_type").alias("table"), F.when(F.col("p_type") == "SMALL", "PUB").alias("schema")).distinct()
    n = F.col("endpoint_id")
    uses = v.syn_endpoint.select(n.alias("use_id"), F.when(n % 2 == 0, F.lower("entity")).otherwise(F.col("entity")).alias("name"), (n % 3 == 0).alias("quoted"), F.when(n % 5 == 0, "other").alias("schema"))
    return reads.tables_to_entities(uses, entities)


@query("j36_sites_in_methods", """
WITH s AS (SELECT endpoint_id AS site_id, concat('repo/src/F', endpoint_id % 50, '.java') AS file, size AS line FROM syn_endpoint), m AS (SELECT concat('src/F', service_id % 60, '.java') AS file, port % 40 AS lo, port % 40 + 5 AS hi FROM syn_service)
SELECT site_id, file, line FROM s WHERE EXISTS (SELECT 1 FROM m WHERE s.file = 'repo/' || m.file AND line BETWEEN lo AND hi)""")
def _(v):
    sites = v.syn_endpoint.select(F.col("endpoint_id").alias("site_id"), F.concat(F.lit("repo/src/F"), (F.col("endpoint_id") % 50).cast("string"), F.lit(".java")).alias("file"), F.col("size").alias("line"))
    spans = v.syn_service.select(F.concat(F.lit("src/F"), (F.col("service_id") % 60).cast("string"), F.lit(".java")).alias("file"), (F.col("port") % 40).alias("lo"), (F.col("port") % 40 + 5).alias("hi"))
    return reads.inside_any(sites, spans)


@query("a03_unfinished_jobs", "SELECT snapshot_id, count(*) FILTER (status IN ('pending', 'running')) AS n FROM syn_job GROUP BY snapshot_id")
def _(v):
    return v.syn_job.groupBy("snapshot_id").agg(F.count_if(F.col("status").isin("pending", "running")).alias("n"))


@query("a04_flow_call_sets", "SELECT endpoint_id, array_to_string(list_sort(list_distinct(list(part_id))), ',') AS parts, count(DISTINCT part_id) AS n FROM (SELECT endpoint_id, part_id FROM syn_node WHERE kind = 'call' UNION ALL SELECT endpoint_id, part_id FROM syn_node WHERE kind = 'branch') GROUP BY endpoint_id")
def _(v):
    both = v.syn_node.where("kind = 'call'").select("endpoint_id", "part_id").union(v.syn_node.where("kind = 'branch'").select("endpoint_id", "part_id"))
    parts = F.array_sort(F.collect_set("part_id"))
    return both.groupBy("endpoint_id").agg(F.array_join(parts, ",").alias("parts"), F.size(parts).cast("long").alias("n"))


@query("a09_unmodelled_mechanisms", "SELECT url_confidence AS mechanism, count(*) AS n, array_to_string(list_sort(list_distinct(list(service_id))), ',') AS services FROM syn_remote WHERE suspected GROUP BY url_confidence")
def _(v):
    return v.syn_remote.where("suspected").groupBy(F.col("url_confidence").alias("mechanism")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("service_id")), ",").alias("services"))


@query("a16_entity_coverage", """
SELECT sum(n) AS n, sum(bound) AS bound, sum(unknown) AS unknown, count(*) AS reporting FROM (SELECT service_id, count(*) AS n, count(entity) AS bound, count(*) FILTER (operation = 'unknown') AS unknown FROM syn_access GROUP BY service_id)
WHERE service_id IN (SELECT service_id FROM syn_service WHERE production_methods IS NOT NULL)""")
def _(v):
    per = v.syn_access.groupBy("service_id").agg(F.count("*").alias("n"), F.count("entity").alias("bound"), F.count_if(F.col("operation") == "unknown").alias("unknown"))
    known = v.syn_service.where("production_methods IS NOT NULL").select("service_id")
    return per.join(known, "service_id", "left_semi").agg(F.sum("n").alias("n"), F.sum("bound").alias("bound"), F.sum("unknown").alias("unknown"), F.count("*").alias("reporting"))


@query("a17_gated_verbs", "SELECT operation, bool_or(production_methods IS NULL OR is_gateway) AS held FROM syn_access JOIN syn_service USING (service_id) GROUP BY operation")
def _(v):
    flags = v.syn_service.select("service_id", (F.col("production_methods").isNull() | F.col("is_gateway")).alias("held"))
    return v.syn_access.join(flags, "service_id").groupBy("operation").agg(F.bool_or("held").alias("held"))


@query("a28_touched_methods", "SELECT endpoint_id, method_id, count(*) AS n FROM syn_node WHERE EXISTS (SELECT 1 FROM syn_edge e WHERE e.endpoint_id = syn_node.endpoint_id AND e.source = syn_node.node_id) GROUP BY ALL")
def _(v):
    out = v.syn_edge.select("endpoint_id", F.col("source").alias("node_id")).distinct()
    return v.syn_node.join(out, ["endpoint_id", "node_id"], "left_semi").groupBy("endpoint_id", "method_id").agg(F.count("*").alias("n"))


@query("a29_unresolved_by_reason", _EDGES + "SELECT reason, count(*) AS n, count(DISTINCT service_id) AS n_services FROM edges WHERE reason IS NOT NULL GROUP BY reason")
def _(v):
    return reads.unresolved(_edges(v)).orderBy(F.desc("n"), "reason")


@query("a34_distinct_targets", _EDGES + "SELECT DISTINCT service_id, coalesce('endpoint:' || target_endpoint_id, 'host:' || external_host, 'undetermined') AS label FROM edges")
def _(v):
    return reads.distinct_targets(_edges(v))


@query("f04_target_keys", _EDGES + "SELECT DISTINCT CASE target_kind WHEN 'endpoint' THEN CAST(target_endpoint_id AS VARCHAR) WHEN 'external' THEN 'external:' || external_host WHEN 'placeholder' THEN 'placeholder:' || external_host ELSE 'undetermined' END AS key FROM edges")
def _(v):
    return reads.target_keys(_edges(v))


_OPERATIONS = [("save", "create-or-update"), ("find", "read"), ("get", "read"), ("delete", "delete"), ("update", "update")]


@query("w02_prefix_rules", """
WITH n AS (SELECT endpoint_id, CASE endpoint_id % 7 WHEN 0 THEN 'findAll' WHEN 1 THEN 'save' WHEN 2 THEN 'getter' WHEN 3 THEN 'deleteById' WHEN 4 THEN 'saved' WHEN 5 THEN 'updateX' ELSE 'run' END AS name FROM syn_endpoint)
SELECT endpoint_id, name, CASE endpoint_id % 7 WHEN 0 THEN 'read' WHEN 1 THEN 'create-or-update' WHEN 3 THEN 'delete' WHEN 5 THEN 'update' ELSE 'unknown' END AS rule FROM n""")
def _(v):
    names = F.array(*[F.lit(x) for x in ("findAll", "save", "getter", "deleteById", "saved", "updateX", "run")])
    rows = v.syn_endpoint.select("endpoint_id", F.get(names, (F.col("endpoint_id") % 7).cast("int")).alias("name"))
    return reads.first_rule(rows, "name", _OPERATIONS, "unknown")


@query("w10_superseding_jobs", "SELECT snapshot_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_jobs FROM syn_job GROUP BY snapshot_id")
def _(v):
    return reads.superseding(v.syn_job, ["snapshot_id"])


@query("w14_folded_copies", """
WITH s AS (SELECT service_id % 4 AS export, entity AS file, size AS line, http_method AS method, endpoint_id AS site_id FROM syn_endpoint),
n AS (SELECT *, row_number() OVER (PARTITION BY export, file, line, method ORDER BY site_id) AS nth FROM s)
SELECT file, line, method, CAST(nth AS INTEGER) AS nth, arg_min(site_id, (export, site_id)) AS site_id, min(export) AS owner, count(*) AS n_copies FROM n GROUP BY file, line, method, nth""")
def _(v):
    return reads.folded_copies(v.syn_endpoint.select((F.col("service_id") % 4).alias("export"), F.col("entity").alias("file"), F.col("size").alias("line"), F.col("http_method").alias("method"), F.col("endpoint_id").alias("site_id")))


@query("l02_sorted_nulls_last", "SELECT entity, count(*) AS n, CAST(row_number() OVER (ORDER BY entity NULLS LAST) AS INTEGER) AS place FROM syn_access GROUP BY entity")
def _(v):
    from pyspark.sql import Window

    n = v.syn_access.groupBy("entity").agg(F.count("*").alias("n"))  # as many rows as there are entities
    return n.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("entity").asc_nulls_last())))


@query("l09_worst_services", "SELECT app_name, arg_min(service_id, (-port, service_id)) AS worst FROM syn_service GROUP BY app_name")
def _(v):
    return v.syn_service.groupBy("app_name").agg(F.min_by("service_id", F.struct(-F.col("port"), "service_id")).alias("worst"))


@query("u02_identity_conflicts", """
WITH b AS (SELECT lower(trim(name)) AS host, service_id, 1 AS prio FROM syn_service UNION ALL SELECT CASE WHEN service_id % 3 = 0 THEN lower(trim(name)) ELSE concat(substr(lower(trim(name)), 1, length(trim(name)) - 1), (service_id + 1) % 10) END, service_id, 2 FROM syn_service),
g AS (SELECT host, list_sort(list_distinct(coalesce(list(service_id) FILTER (prio = 1), []))) AS a, list_sort(list_distinct(coalesce(list(service_id) FILTER (prio = 2), []))) AS c FROM b GROUP BY host)
SELECT host, array_to_string(a, ',') AS by_host, array_to_string(c, ',') AS by_name FROM g WHERE len(a) > 0 AND len(c) > 0 AND a <> c""")
def _(v):
    s = v.syn_service
    other = s.withColumn("app_name", F.when(F.col("service_id") % 3 == 0, F.col("name")).otherwise(F.concat(F.expr("substr(name, 1, length(name) - 1)"), ((F.col("service_id") + 1) % 10).cast("string"))))
    return reads.identity_conflicts(stitch.phone_book(other))


@query("u06_operation_sets", """
WITH o AS (SELECT endpoint_id, list_sort(list_distinct(list(operation))) AS ops FROM syn_access GROUP BY endpoint_id)
SELECT endpoint_id, array_to_string(ops, ',') AS operations, array_to_string(list_sort(list_filter(['create', 'delete', 'read', 'unknown', 'update'], lambda x: NOT list_contains(ops, x))), ',') AS unexercised FROM o""")
def _(v):
    o = v.syn_access.groupBy("endpoint_id").agg(F.array_sort(F.collect_set("operation")).alias("ops"))
    every = F.array(*[F.lit(x) for x in ("create", "delete", "read", "unknown", "update")])
    return o.select("endpoint_id", F.array_join("ops", ",").alias("operations"), F.array_join(F.array_sort(F.array_except(every, "ops")), ",").alias("unexercised"))


_TREE = """
WITH RECURSIVE t(root, path, trail, node, depth, cycle) AS (
  SELECT root, CAST(root AS VARCHAR), [root], root, 0, FALSE FROM syn_root
  UNION ALL SELECT t.root, t.path || '>' || g.dst, list_append(t.trail, g.dst), g.dst, t.depth + 1, list_contains(t.trail, g.dst) FROM t JOIN syn_call_graph g ON g.src = t.node WHERE NOT t.cycle)"""


@query("g09_subtree_sizes", _TREE + ", a AS (SELECT root, unnest(list_transform(range(1, len(trail) + 1), lambda n: array_to_string(list_slice(trail, 1, n), '>'))) AS path FROM t) SELECT root, path, count(*) AS size FROM a GROUP BY ALL")
def _(v):
    return graph.subtree_sizes(graph.call_tree(v.syn_call_graph, v.syn_root))


@query("g11_first_paths", _TREE + "SELECT root, node, arg_min(path, (depth, trail)) AS path FROM t GROUP BY ALL")
def _(v):
    return graph.first_paths(graph.call_tree(v.syn_call_graph, v.syn_root))


@query("g07_leaving_arms", """
SELECT e.endpoint_id, e.source, e.target, e.kind FROM syn_edge e WHERE e.kind IN ('true', 'false') AND NOT EXISTS (SELECT 1 FROM syn_edge o WHERE o.endpoint_id = e.endpoint_id AND o.source = e.target)""")
def _(v):
    return graph.leaving_arms(v.syn_edge, v.syn_node)


@query("g13_governing_conditions", """
WITH RECURSIVE w(endpoint_id, node_id, cur, decision, kind, distance) AS (
  SELECT endpoint_id, node_id, node_id, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), 0 FROM syn_node
  UNION SELECT w.endpoint_id, w.node_id, e.source, CASE WHEN e.kind <> 'flow' THEN e.source END, CASE WHEN e.kind <> 'flow' THEN e.kind END, w.distance + 1
  FROM w JOIN syn_edge e ON e.endpoint_id = w.endpoint_id AND e.target = w.cur WHERE w.decision IS NULL AND w.distance < 20),
f AS (SELECT DISTINCT endpoint_id, node_id, decision, kind, distance FROM w WHERE decision IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY endpoint_id, node_id ORDER BY distance, decision, kind) AS rn FROM f)
SELECT endpoint_id, node_id, decision, kind, distance FROM r WHERE rn <= 2""")
def _(v):
    return graph.governing_conditions(v.syn_node, v.syn_edge)
