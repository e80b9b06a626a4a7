"""A synthetic snapshot: architecture tables as arithmetic over the plain tables, the same text in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylark.sources.shared import modified, written

_STORED: dict[tuple, DataFrame] = {}
VIEWS = {
    "syn_service": """
        SELECT s_suppkey AS service_id, n_regionkey AS snapshot_id, lower(replace(s_name, '#', '-')) AS name,
          concat('app-', CAST(s_suppkey % 40 AS STRING)) AS app_name, 8000 + s_suppkey % 60 AS port,
          CASE WHEN s_suppkey % 10 = 9 THEN 'library' ELSE 'service' END AS kind,
          CASE WHEN s_acctbal < 0 THEN NULL ELSE 100 + s_suppkey END AS production_methods,
          CASE WHEN s_acctbal < 0 THEN NULL ELSE (100 + s_suppkey) * 7 % 100 END AS reachable_methods,
          s_suppkey % 25 = 0 AS is_gateway
        FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    "syn_endpoint": """
        SELECT p_partkey AS endpoint_id, p_partkey % (SELECT count(*) FROM {supplier}) AS service_id,
          CASE p_size % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS http_method,
          concat('/', lower(p_type), '/', lower(replace(p_brand, '#', '-')), CASE WHEN p_partkey % 3 = 0 THEN '/{{?}}' ELSE '' END) AS uri,
          concat('com.acme.', replace(p_name, ' ', '_')) AS handler, p_size AS size, p_type AS entity
        FROM {part}""",
    "syn_call": """
        SELECT DISTINCT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS call_id,
          l_suppkey AS service_id, l_partkey AS part_id,
          CASE WHEN l_linestatus = 'O' THEN NULL ELSE e.http_method END AS http_verb,
          CASE WHEN l_quantity < 3 THEN NULL
            WHEN l_returnflag = 'R' THEN concat('https://api-', CAST(l_partkey % 7 AS STRING), '.example.com/x')
            WHEN l_returnflag = 'A' THEN concat('http://legacy-', CAST(l_partkey % 5 AS STRING), '/y')
            ELSE concat('http://', s.name, replace(e.uri, '{{?}}', CAST(l_linenumber AS STRING))) END AS url,
          l_quantity > 5 AS reachable, l_linenumber = 7 AS suspected
        FROM {lineitem} JOIN {syn_endpoint} e ON e.endpoint_id = l_partkey JOIN {syn_service} s ON s.service_id = e.service_id""",
    "syn_env": """
        SELECT s.service_id, 'svc.target' AS key, concat('http://', t.name) AS value
        FROM (SELECT service_id, (service_id + 1) % n AS next FROM {syn_service} JOIN (SELECT count(*) AS n FROM {supplier}) c ON n > 0) s JOIN {syn_service} t ON t.service_id = s.next
        UNION ALL SELECT service_id, 'SVC_BACKUP', concat('$', '{{svc.target}}') FROM {syn_service}
        UNION ALL SELECT service_id, 'server.servlet.context-path', '/ctx/' FROM {syn_service} WHERE service_id % 7 = 3""",
    "syn_route": """
        SELECT s.service_id, 0 AS ord, '/small/**' AS prefix, concat('lb://', t.name) AS target_uri, 0 AS strip
        FROM {syn_service} s JOIN {syn_service} t ON t.service_id = s.service_id + 1 WHERE s.is_gateway
        UNION ALL SELECT s.service_id, 1, '/large', concat('lb://', t.app_name), 0 FROM {syn_service} s JOIN {syn_service} t ON t.service_id = s.service_id + 2 WHERE s.is_gateway
        UNION ALL SELECT s.service_id, 2, '/medium/*', concat('http://', t.name, ':8080'), 0
        FROM (SELECT service_id, (service_id + 25) % n AS next FROM {syn_service} JOIN (SELECT count(*) AS n FROM {supplier}) c ON n > 0 WHERE is_gateway) s JOIN {syn_service} t ON t.service_id = s.next
        UNION ALL SELECT service_id, 3, '/medium/brand-1', 'http://nowhere-svc/x', 1 FROM {syn_service} WHERE is_gateway
        UNION ALL SELECT service_id, 4, '/promo', '??bad', 1 FROM {syn_service} WHERE is_gateway""",
    "syn_locator": "SELECT service_id FROM {syn_service} WHERE service_id % 50 = 0",
    "syn_remote": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS call_id,
          l_suppkey AS service_id, CASE WHEN l_linestatus = 'O' THEN NULL ELSE e.http_method END AS http_verb,
          CASE WHEN l_partkey % 16 IN (6, 7) THEN 'high' WHEN l_partkey % 16 = 9 THEN 'heuristic' ELSE 'exact' END AS url_confidence,
          CASE WHEN l_quantity < 2 THEN 'slice [unsupported-idiom:reflection] here' WHEN l_quantity < 3 THEN 'lombok-generated interior of a getter'
            WHEN l_partkey % 16 = 10 AND l_linenumber = 1 THEN 'base-undetermined' END AS evidence,
          CASE WHEN l_quantity < 4 THEN NULL ELSE CASE l_partkey % 16
            WHEN 0 THEN concat('$', '{{svc.target}}', u.path) WHEN 1 THEN concat('$', '{{no.such:http://legacy-1}}', '/y') WHEN 2 THEN concat('$', '{{no.such}}', '/y')
            WHEN 3 THEN concat('http://', '{{svc}}', '/x') WHEN 4 THEN concat('HTTPS://API-', CAST(l_partkey % 7 AS STRING), '.Example.com:8443/x')
            WHEN 5 THEN concat('http://', s.name, '.default.svc.cluster.local', u.path) WHEN 6 THEN concat('http://', s.name, '.prod', u.path)
            WHEN 7 THEN concat('http://localhost:', CAST(8000 + l_partkey % 70 AS STRING), u.path) WHEN 8 THEN concat('http://10.0.0.', CAST(l_linenumber AS STRING), '/x')
            WHEN 9 THEN concat('http://', s.app_name, u.path) WHEN 10 THEN u.path WHEN 11 THEN concat('$', '{{svc.backup}}', u.path)
            WHEN 12 THEN concat('http://', g.name, u.path) WHEN 13 THEN concat('http://', g.name, '/', s.app_name, u.path)
            WHEN 14 THEN concat('http://', s.name, ':', CAST(s.port + l_linenumber % 2 AS STRING), '/ctx', u.path) ELSE concat(s.name, u.path) END END AS url,
          l_quantity > 2 OR l_linenumber < 3 AS reachable, l_linenumber = 7 AS suspected
        FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_suppkey, l_partkey) i
        JOIN {syn_endpoint} e ON e.endpoint_id = l_partkey JOIN {syn_service} s ON s.service_id = e.service_id
        JOIN {syn_service} g ON g.service_id = s.service_id - s.service_id % 25
        JOIN (SELECT x.endpoint_id, n.line, CASE WHEN n.line = 5 THEN concat('/', lower(x.entity), '/{{x}}') WHEN n.line = 6 THEN concat(replace(x.uri, '{{?}}', ':id'), '?a=/b')
            ELSE replace(x.uri, '{{?}}', CAST(n.line AS STRING)) END AS path
          FROM {syn_endpoint} x JOIN (SELECT DISTINCT l_linenumber AS line FROM {lineitem}) n ON n.line > 0) u ON u.endpoint_id = l_partkey AND u.line = l_linenumber""",
    "syn_call_graph": """
        SELECT DISTINCT a.endpoint_id * 10 + a.node_id AS src, b.endpoint_id * 10 + b.node_id AS dst
        FROM {syn_node} a JOIN {syn_node} b ON a.endpoint_id = b.endpoint_id
          AND (b.node_id = a.node_id + 1 OR (a.kind = 'branch' AND b.node_id = a.node_id + 2) OR (a.kind = 'call' AND b.node_id = a.node_id - 3))""",
    "syn_root": "SELECT endpoint_id * 10 + min(node_id) AS root FROM {syn_node} GROUP BY endpoint_id",
    "syn_access": """
        SELECT DISTINCT o_custkey AS endpoint_id, o_custkey % (SELECT count(*) FROM {supplier}) AS service_id,
          CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_type END AS entity,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'create' WHEN '2' THEN 'read' WHEN '3' THEN 'update' WHEN '4' THEN 'unknown' ELSE 'delete' END AS operation,
          concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS site
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey""",
    "syn_auth": """
        SELECT p_partkey AS endpoint_id, p_partkey % (SELECT count(*) FROM {supplier}) AS service_id,
          CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS authenticated,
          p_partkey % 17 = 0 AS denied, p_partkey % 4 = 0 AS unread,
          CASE WHEN p_partkey % 5 >= 2 THEN concat('ROLE_', upper(replace(p_brand, '#', '_'))) END AS role,
          CASE p_partkey % 3 WHEN 0 THEN 'filter-chain' WHEN 1 THEN 'annotation' ELSE 'in-handler' END AS evidence
        FROM {part}""",
    "syn_rule": """
        SELECT p_partkey AS rule_id, p_partkey % (SELECT count(*) FROM {supplier}) AS service_id, p_partkey AS ord,
          CASE p_size % 3 WHEN 0 THEN '/**' WHEN 1 THEN concat('/', lower(p_type), '/**') ELSE concat('/', lower(p_type), '/', lower(replace(p_brand, '#', '-')), '/*') END AS pattern,
          CASE p_size % 5 WHEN 0 THEN 'permit' WHEN 1 THEN 'deny' ELSE 'authenticated' END AS access, p_size % 4 <> 0 AS is_read
        FROM {part}""",
    "syn_node": """
        SELECT l_orderkey AS endpoint_id, l_linenumber AS node_id,
          min(CASE l_returnflag WHEN 'R' THEN 'branch' WHEN 'A' THEN 'call' ELSE 'statement' END) AS kind,
          min(l_suppkey) AS method_id, min(CAST(l_quantity AS INT)) AS line, min(l_partkey) AS part_id
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "syn_edge": """
        SELECT a.endpoint_id, a.node_id AS source, b.node_id AS target,
          CASE WHEN a.kind = 'branch' THEN CASE WHEN b.node_id = a.node_id + 1 THEN 'true' ELSE 'false' END ELSE 'flow' END AS kind
        FROM {syn_node} a JOIN {syn_node} b ON a.endpoint_id = b.endpoint_id
          AND (b.node_id = a.node_id + 1 OR (a.kind = 'branch' AND b.node_id = a.node_id + 2))""",
    "syn_job": """
        SELECT user_id AS job_id, event_id, ts, event_type,
          CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'pending' ELSE 'succeeded' END AS status,
          user_id % 10 AS snapshot_id
        FROM {events}""",
}


def _remote(of) -> DataFrame:
    """syn_remote with what its text joins to a call told once for each endpoint; calls are dealt out once, by their endpoint.

    A path is a function of the endpoint and the line, and each line of a call is among all lines.
    """
    shown, _, rest = VIEWS["syn_remote"].partition("FROM (SELECT")
    path = re.search(r"n\.line, (CASE .*? END) AS path", rest, re.S)[1].replace("n.line", "l_linenumber")
    endpoints = """
        SELECT e.endpoint_id, struct(e.http_method) AS e, struct(s.name, s.app_name, s.port) AS s, struct(g.name) AS g, struct(x.uri, x.entity) AS x
        FROM {syn_endpoint} e JOIN {syn_service} s ON s.service_id = e.service_id JOIN {syn_service} g ON g.service_id = s.service_id - s.service_id % 25 JOIN {syn_endpoint} x ON x.endpoint_id = e.endpoint_id"""
    calls = of("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_linestatus", "l_quantity").where("l_linenumber > 0").repartition("l_partkey")
    # of the least status it counts only whether it is O, which flags tell without sorting texts
    status, keys = F.col("l_linestatus"), ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    calls = calls.groupBy(*keys).agg(F.max(status == "O").alias("_is"), F.max(status < "O").alias("_less"), F.min("l_quantity").alias("l_quantity"))
    calls = calls.select(*keys, "l_quantity", F.when(F.col("_is") & ~F.col("_less"), "O").alias("l_linestatus"))
    spark = calls.sparkSession
    known = spark.sql(endpoints, **{n: of(n) for n in _names(endpoints)})
    return spark.sql(f"{shown} FROM (SELECT *, struct({path} AS path) AS u FROM {{calls}} JOIN {{known}} ON endpoint_id = l_partkey)", calls=calls, known=known)


def _edge(of) -> DataFrame:
    """syn_edge by what follows each node among its endpoint's nodes, which are one row each, so that the nodes do not meet themselves."""
    w = Window.partitionBy("endpoint_id").orderBy("node_id")
    node, ahead = F.col("node_id"), lambda n: F.lead("node_id", n).over(w)
    n = of("syn_node").where("endpoint_id IS NOT NULL AND node_id IS NOT NULL").select("endpoint_id", "node_id", "kind", ahead(1).alias("_1"), ahead(2).alias("_2"))
    branch = F.coalesce(F.col("kind") == "branch", F.lit(False))
    one = F.when(F.col("_1") == node + 1, F.struct((node + 1).alias("target"), F.when(branch, "true").otherwise("flow").alias("kind")))
    two = F.when(branch & ((F.col("_1") == node + 2) | F.coalesce(F.col("_2") == node + 2, F.lit(False))), F.struct((node + 2).alias("target"), F.lit("false").alias("kind")))
    return n.select("endpoint_id", node.alias("source"), F.inline(F.array_compact(F.array(one, two))))


#: Views that Spark makes by a plan of its own; their texts tell the same rows.
PLANS = {"syn_remote": _remote, "syn_edge": _edge}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def version(spark: SparkSession, sf_dir: str) -> tuple[str, str, tuple[int, ...]]:
    """What tells one state of a folder in a session: the session, the folder and when each of its tables was changed."""
    return spark.sparkContext.applicationId, sf_dir, tuple(modified(spark, f"{sf_dir}/{t}.parquet") for t in TABLES)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A plain table, or a synthetic one, which is written once for each state of a folder and session as a snapshot's tables are."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = (*version(spark, sf_dir), name)
    if key not in _STORED:
        text = VIEWS[name]
        of = lambda n: view(spark, sf_dir, n)
        _STORED[key] = written(PLANS[name](of) if name in PLANS else spark.sql(text, **{n: of(n) for n in _names(text)}), name)
    return _STORED[key]


def with_views(sql: str) -> str:
    """DuckDB SQL with the synthetic views that it names put before it."""
    found: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in found:
            for n in _names(VIEWS[name]):
                add(n)
            found.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    sql = sql.strip()
    if not found:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].format(**{x: x for x in _names(VIEWS[n])})})" for n in found)
    own = re.match(r"WITH( RECURSIVE)?\s+", sql)
    return f"WITH RECURSIVE {ctes}" + (",\n" + sql[own.end() :] if own else "\n" + sql)
