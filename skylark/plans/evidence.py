"""Claims about protection and settings of services over the synthetic snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.operators import claims
from skylark.plans.catalog import query
from skylark.sources import config

_KIND = "CASE p_partkey % 7 WHEN 0 THEN 'filter-chain' WHEN 1 THEN 'annotation' WHEN 2 THEN 'config' WHEN 3 THEN 'in-handler' WHEN 4 THEN 'chain-bypass' WHEN 5 THEN 'authority-model' ELSE 'aspect' END"
_EVIDENCE = f"""
SELECT l_partkey AS endpoint_id, {_KIND.replace('p_partkey', '(l_orderkey + l_linenumber)')} AS kind, CASE l_suppkey % 5 WHEN 0 THEN 'permit' WHEN 1 THEN 'deny' ELSE 'authenticated' END AS effect,
  l_orderkey % 11 <> 0 AS active, CASE WHEN l_orderkey % 13 = 0 THEN 'opaque' ELSE 'exact' END AS resolution, l_suppkey % 10 <> 0 AS covers_route, concat('R', CAST(l_suppkey % 4 AS STRING)) AS role
FROM {{t}} WHERE l_linenumber = 1 AND l_quantity > 35"""


@query("f27_merged_claims", f"""
WITH e AS ({_EVIDENCE.format(t='lineitem')}),
g AS (SELECT *, active AND kind NOT IN ('config', 'authority-model') AS gating FROM e),
f AS (SELECT endpoint_id, count(*) AS n_evidence, bool_or(gating) AS has, bool_or(gating AND resolution <> 'opaque' AND effect <> 'permit') AS requires, bool_or(gating AND kind = 'chain-bypass') AS bypassed, bool_or(gating AND resolution = 'opaque') AS unread,
  bool_or(gating AND resolution = 'opaque' AND (kind = 'chain-bypass' OR effect = 'permit')) AS removes, bool_or(gating AND effect = 'permit' AND NOT covers_route) AS partly, bool_or(gating AND resolution <> 'opaque' AND effect = 'deny') AS denies,
  coalesce(string_agg(DISTINCT CASE WHEN gating AND resolution <> 'opaque' AND effect <> 'permit' THEN role END, ',' ORDER BY CASE WHEN gating AND resolution <> 'opaque' AND effect <> 'permit' THEN role END), '') AS roles FROM g GROUP BY endpoint_id),
c AS (SELECT *, CASE WHEN has AND NOT (NOT requires AND partly) AND NOT removes AND NOT (unread AND NOT (requires AND NOT bypassed)) THEN requires AND NOT bypassed END AS claim FROM f)
SELECT endpoint_id, claim AS authenticated, coalesce(claim AND denies, FALSE) AS denied, CASE WHEN claim IS NOT NULL THEN roles END AS roles, n_evidence FROM c""")
def _(v):
    return claims.merged(v.spark.sql(_EVIDENCE.format(t="{t}"), t=v.lineitem).withColumn("roles", F.array("role")))


@query("f28_annotation_activity", """
SELECT endpoint_id, CASE WHEN endpoint_id % 3 <> 2 OR endpoint_id % 4 = 3 THEN TRUE WHEN endpoint_id % 4 = 0 THEN endpoint_id % 5 = 0 WHEN endpoint_id % 4 = 1 THEN endpoint_id % 7 = 0 ELSE FALSE END AS active,
  CASE WHEN endpoint_id % 3 = 1 AND endpoint_id % 4 <> 3 THEN 'opaque' ELSE 'exact' END AS resolution FROM syn_auth""")
def _(v):
    n = F.col("endpoint_id")
    payload = F.when(n % 4 == 0, "@PreAuthorize('x')").when(n % 4 == 1, "@Secured('x')").when(n % 4 == 2, "@RolesAllowed('x')").otherwise("@Other")
    present = F.when(n % 3 == 1, False).when(n % 3 == 2, True)
    state = claims.annotation_activity(payload, present, {"pre_post": n % 5 == 0, "secured": n % 7 == 0, "jsr250": F.lit(False)}, F.lit("exact"))
    return v.syn_auth.select("endpoint_id", state.alias("s")).select("endpoint_id", "s.active", "s.resolution")


@query("f30_published_verbs", """
SELECT endpoint_id AS site, entity AS basis, CASE WHEN endpoint_id % 2 = 0 THEN 'create' ELSE 'update' END AS operation,
  CASE WHEN entity IN ('SMALL', 'LARGE') AND endpoint_id % 2 = 0 THEN 'create' ELSE 'create-or-update' END AS published FROM syn_endpoint""")
def _(v):
    sites = v.syn_endpoint.select(F.col("endpoint_id").alias("site"), F.col("entity").alias("basis"), F.when(F.col("endpoint_id") % 2 == 0, "create").otherwise("update").alias("operation"))
    flags = v.spark.createDataFrame([("SMALL", "create", True, "r2"), ("LARGE", "create", True, "r2"), ("LARGE", "update", False, "r2"), ("SMALL", "update", True, "r1")], "basis string, operation string, enabled boolean, scored_version string")
    return claims.published(sites, flags, "r2")


@query("f31_parameter_origins", """
SELECT endpoint_id, CASE endpoint_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'loaded' ELSE 'parameter' END AS origin FROM syn_endpoint""")
def _(v):
    n = F.col("endpoint_id") % 4
    callers = F.when(n == 1, F.array(F.lit("loaded"), F.lit("loaded"))).when(n == 2, F.array(F.lit("new"), F.lit("loaded"))).otherwise(F.array().cast("array<string>"))
    return v.syn_endpoint.select("endpoint_id", claims.parameter_origin(F.when(n == 0, "new").otherwise("parameter"), callers).alias("origin"))


@query("j29_governing_chains", r"""
SELECT service_id, endpoint_id, service_id % 4 = 0 OR service_id % 4 = 1 AND (starts_with(uri, '/small/') OR uri = '/small' OR starts_with(uri, '/large/')) OR service_id % 4 = 2 AND regexp_matches(uri, '^/[^/]+/[^/]+$') AS covered
FROM syn_endpoint""")
def _(v):
    four = F.col("service_id") % 4
    scope = F.when(four == 0, "").when(four == 1, "/small/**, /large/**").when(four == 2, "/*/*").otherwise("/nothing/**")
    return v.syn_endpoint.select("service_id", "endpoint_id", claims.in_chain(scope, F.col("uri")).alias("covered"))


@query("j30_scoped_enforcements", r"""
SELECT endpoint_id, CASE WHEN endpoint_id % 2 = 0 THEN uri = '/small/brand-11' ELSE regexp_matches(uri, '^/small/(brand-11|\{\?\})$') END AS covered, CASE WHEN uri = '/small/brand-11' THEN 'exact' END AS literal FROM syn_endpoint""")
def _(v):
    kind = F.when(F.col("endpoint_id") % 2 == 0, "in-handler").otherwise("filter-chain")
    return v.syn_endpoint.select("endpoint_id", claims.in_scope(kind, F.lit("/small/brand-11"), F.col("uri")).alias("covered"), claims.governs(F.lit("/small/brand-11"), F.col("uri")).alias("literal"))


def _poms(v):
    n = F.col("service_id")
    body = F.concat(F.lit("<project><artifactId> "), "app_name", F.lit("</artifactId><dependencies><dependency><artifactId>"), "name", F.lit("</artifactId></dependency><dependency><artifactId>common</artifactId></dependency></dependencies>"))
    parent = F.when(n % 5 == 0, "<modules><module>x</module></modules></project>").otherwise("</project>")
    folder = F.when(n % 7 == 0, "target/").otherwise("")
    return v.syn_service.select(F.concat(F.lit("repo/"), folder, "name", F.lit("/pom.xml")).alias("path"), F.concat(body, parent).alias("content"))


@query("s03_leaf_modules", "SELECT concat('repo/', name, '/pom.xml') AS path, app_name AS artifact FROM syn_service WHERE service_id % 5 <> 0 AND service_id % 7 <> 0")
def _(v):
    return config.leaf_modules(_poms(v)).select("path", config.artifact(F.col("content")).alias("artifact"))


@query("s05_dependencies", """
WITH p AS (SELECT concat('repo/', CASE WHEN service_id % 7 = 0 THEN 'target/' ELSE '' END, name, '/pom.xml') AS path, name FROM syn_service) SELECT path, name AS artifact FROM p UNION ALL SELECT path, 'common' FROM p""")
def _(v):
    return config.dependencies(_poms(v))


@query("s08_env_files", """
SELECT name AS path, 'A' AS key, CAST(port AS VARCHAR) AS value FROM syn_service UNION ALL SELECT name, 'B_C', app_name || '=x' FROM syn_service UNION ALL SELECT name, 'D', '' FROM syn_service""")
def _(v):
    text = F.concat(F.lit("# c\nA="), F.col("port").cast("string"), F.lit("\r\n\nexport B_C=\""), "app_name", F.lit("=x\"\nnothing\nD=''\n"))
    return config.env_entries(v.syn_service.select(F.col("name").alias("path"), text.alias("content"))).select("path", "key", "value")


@query("s11_merged_settings", """
SELECT service_id, 'port' AS key, CASE WHEN service_id % 2 = 0 THEN '1' || port ELSE CAST(port AS VARCHAR) END AS value FROM syn_service UNION ALL SELECT service_id, 'name', app_name FROM syn_service
UNION ALL SELECT service_id, 'extra', 'prod' FROM syn_service WHERE service_id % 2 = 0""")
def _(v):
    s = v.syn_service
    names = F.explode(F.array(*[F.lit(x) for x in ("application.yml", "application-prod.yml", "application-test.yml", "logback.xml")]))
    files = config.profile_files(s.select("service_id", names.alias("name")), s.where("service_id % 2 = 0").select("service_id", F.lit(0).alias("ord"), F.lit("prod").alias("profile")))
    row = lambda name, key, value: s.select("service_id", F.lit(name).alias("name"), F.lit(key).alias("key"), value.cast("string").alias("value"), F.lit(0).alias("ord"))
    rows = row("application.yml", "port", F.col("port")).union(row("application.yml", "name", F.col("app_name"))).union(row("application-prod.yml", "port", F.concat(F.lit("1"), F.col("port").cast("string"))))
    rows = rows.union(row("application-prod.yml", "extra", F.lit("prod"))).union(row("application-test.yml", "port", F.lit("9")))
    return config.merged(files.join(rows, ["service_id", "name"]))


@query("s14_flattened_settings", """
SELECT name AS path, 'a.b' AS key, CAST(port AS VARCHAR) AS value FROM syn_service UNION ALL SELECT name, 'a.list', '1,x,true' FROM syn_service UNION ALL SELECT name, 'r[0].id', app_name FROM syn_service
UNION ALL SELECT name, 'r[1].id', '' FROM syn_service""")
def _(v):
    text = F.concat(F.lit('{"a": {"b": '), F.col("port").cast("string"), F.lit(', "list": [1, "x", true]}, "r": [{"id": "'), "app_name", F.lit('"}, {"id": null}]}'))
    return config.flattened(v.syn_service.select(F.col("name").alias("path"), text.alias("content"))).select("path", "key", "value")


@query("s15_properties", """
SELECT name AS path, 'server.port' AS key, CAST(port AS VARCHAR) AS value FROM syn_service UNION ALL SELECT name, 'a.b', 'one two' FROM syn_service UNION ALL SELECT name, 'c', app_name FROM syn_service""")
def _(v):
    text = F.concat(F.lit("! x\nserver.port = "), F.col("port").cast("string"), F.lit("\n# y=z\n  a.b: one \\\n   two\nc "), "app_name", F.lit("\n"))
    return config.property_entries(v.syn_service.select(F.col("name").alias("path"), text.alias("content"))).select("path", "key", "value")


@query("s10_allowed_settings", "SELECT service_id, key, key <> 'SVC_BACKUP' AS allowed FROM syn_env WHERE key <> 'svc.target' UNION ALL SELECT service_id, key, FALSE FROM syn_env WHERE key = 'svc.target'")
def _(v):
    return v.syn_env.select("service_id", "key", config.allowed(F.col("key"), ("server.", "spring."), ("port",)).alias("allowed"))
