"""Scalar functions over the synthetic snapshot and the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.functions import text as X
from skylark.operators import rules
from skylark.plans.catalog import query



def _joined(array):
    return F.array_join(array, ",")


@query("f02_repositories", r"""
WITH s AS (SELECT page_id, url AS src FROM pages UNION ALL SELECT page_id + 1000000, concat('git@Host', page_id % 3, '.Example.com:org/r', page_id % 5, '.git') FROM pages
  UNION ALL SELECT page_id + 2000000, concat('https://me@Host', page_id % 3, '.Example.com/org/r', page_id % 5, '/') FROM pages UNION ALL SELECT page_id + 3000000, concat('/srv/r', page_id % 4, '//') FROM pages)
SELECT page_id, CASE WHEN NOT contains(src, '://') AND regexp_matches(src, '^[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+:.+$')
    THEN lower(regexp_extract(src, '@([^:]*):', 1)) || '/' || regexp_replace(regexp_replace(regexp_extract(src, ':(.*)$', 1), '^/+|/+$', '', 'g'), '[.]git$', '')
  WHEN contains(src, '://') THEN lower(regexp_extract(src, '://(?:[^/?#@]*@)?([^/?#:]*)', 1)) || '/' || regexp_replace(regexp_replace(regexp_extract(src, '://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '[.]git$', '')
  ELSE coalesce(nullif(regexp_replace(src, '/+$', ''), ''), '/') END AS canonical FROM s""")
def _(v):
    p, n = v.pages, lambda k: (F.col("page_id") % k).cast("string")
    spell = lambda k, *parts: p.select(F.col("page_id") + k * 1000000, F.concat(*parts))
    s = p.select("page_id", F.col("url").alias("src")).union(spell(1, F.lit("git@Host"), n(3), F.lit(".Example.com:org/r"), n(5), F.lit(".git")))
    s = s.union(spell(2, F.lit("https://me@Host"), n(3), F.lit(".Example.com/org/r"), n(5), F.lit("/"))).union(spell(3, F.lit("/srv/r"), n(4), F.lit("//")))
    return s.select("page_id", X.repository(F.col("src")).alias("canonical"))


@query("f06_expanded_keys", r"""
WITH c AS (SELECT call_id, service_id, url, regexp_extract(url, '\$\{[^}:]+(:[^}]*)?\}', 0) AS tok, trim(regexp_extract(url, '\$\{([^}:]+)', 1)) AS key, regexp_extract(url, '\$\{[^}:]+(:[^}]*)\}', 1) AS d FROM syn_remote WHERE contains(url, '${'))
SELECT call_id, replace(url, tok, coalesce(a.value, b.value, CASE WHEN d <> '' THEN substr(d, 2) END, tok)) AS expanded, NOT contains(replace(url, tok, coalesce(a.value, b.value, CASE WHEN d <> '' THEN substr(d, 2) END, tok)), '${') AS resolved
FROM c LEFT JOIN syn_env a ON a.service_id = c.service_id AND a.key = c.key LEFT JOIN syn_env b ON b.service_id = c.service_id AND b.key = upper(translate(c.key, '.-', '__'))""")
def _(v):
    from skylark.operators.stitch import env_maps

    c = v.syn_remote.where(F.contains("url", F.lit("${"))).join(env_maps(v.syn_env), "service_id")
    return c.select("call_id", X.expand_keys(F.col("url"), F.col("env")).alias("expanded"), X.resolve_or_null(F.col("url"), F.col("env")).isNotNull().alias("resolved"))


@query("f09_markers", r"SELECT call_id, nullif(regexp_extract(evidence, '\[(unsupported-idiom:[^\]]*)\]', 1), '') AS code FROM syn_remote WHERE evidence IS NOT NULL")
def _(v):
    return v.syn_remote.where("evidence IS NOT NULL").select("call_id", X.marker(F.col("evidence")).alias("code"))


@query("f12_stripped_paths", """
SELECT endpoint_id, n, CASE WHEN n <= 0 THEN uri ELSE '/' || array_to_string(list_slice(list_filter(string_split(uri, '/'), lambda s: s <> ''), n + 1, 99), '/') END AS path
FROM (SELECT endpoint_id, uri, endpoint_id % 5 - 1 AS n FROM syn_endpoint)""")
def _(v):
    n = F.col("endpoint_id") % 5 - 1
    return v.syn_endpoint.select("endpoint_id", n.alias("n"), X.strip_segments(F.col("uri"), n.cast("int")).alias("path"))


@query("f13_context_paths", "SELECT s.service_id, coalesce(rtrim(e.value, '/'), '') AS context FROM syn_service s LEFT JOIN syn_env e ON e.service_id = s.service_id AND e.key = 'server.servlet.context-path'")
def _(v):
    from skylark.operators.stitch import env_maps

    return v.syn_service.join(env_maps(v.syn_env), "service_id", "left").select("service_id", F.coalesce(X.context_path(F.col("env")), F.lit("")).alias("context"))


_EXPRESSION = "CASE endpoint_id % 8 WHEN 0 THEN 'permitAll' WHEN 1 THEN 'denyAll()' WHEN 2 THEN concat('hasRole(''ROLE_R', endpoint_id % 7, ''')') WHEN 3 THEN concat('hasAnyRole(''A', endpoint_id % 3, ''', \"ROLE_B\") and hasAuthority(''x:', endpoint_id % 4, ''')') WHEN 4 THEN ' isAuthenticated() ' WHEN 5 THEN 'hasRole(Roles.ADMIN)' WHEN 6 THEN '@guard.check(#id)' ELSE concat('hasAuthority(\"a', endpoint_id % 5, '\")') END"


@query("f19_access_effects", f"""
WITH x AS (SELECT endpoint_id, {_EXPRESSION} AS e FROM syn_auth),
g AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(e, '(?:hasRole|hasAnyRole)\\s*\\(([^)]*)\\)', 1), ','), '["'']([^"'']+)["'']', 1), lambda r: regexp_replace(r, '^ROLE_', '')))) AS r,
  list_sort(list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(e, '(?:hasAuthority|hasAnyAuthority)\\s*\\(([^)]*)\\)', 1), ','), '["'']([^"'']+)["'']', 1))) AS a FROM x)
SELECT endpoint_id, CASE endpoint_id % 8 WHEN 0 THEN 'permit' WHEN 1 THEN 'deny' WHEN 4 THEN 'authenticated' WHEN 5 THEN 'opaque' WHEN 6 THEN 'opaque' ELSE 'role' END AS effect, array_to_string(r, ',') AS roles, array_to_string(a, ',') AS authorities, endpoint_id % 8 = 5 AS unresolved FROM g""")
def _(v):
    n, k = F.col("endpoint_id") % 8, lambda m: (F.col("endpoint_id") % m).cast("string")
    e = F.when(n == 0, "permitAll").when(n == 1, "denyAll()").when(n == 2, F.concat(F.lit("hasRole('ROLE_R"), k(7), F.lit("')")))
    e = e.when(n == 3, F.concat(F.lit("hasAnyRole('A"), k(3), F.lit("', \"ROLE_B\") and hasAuthority('x:"), k(4), F.lit("')")))
    e = e.when(n == 4, " isAuthenticated() ").when(n == 5, "hasRole(Roles.ADMIN)").when(n == 6, "@guard.check(#id)").otherwise(F.concat(F.lit('hasAuthority("a'), k(5), F.lit('")')))
    return v.syn_auth.select("endpoint_id", X.access_effect(e).alias("effect"), _joined(X.grants(e, "roles")).alias("roles"), _joined(X.grants(e, "authorities")).alias("authorities"), X.unresolved_arguments(e).alias("unresolved"))


@query("f22_config_access", """
SELECT service_id, CASE service_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'denyAll' WHEN 2 THEN 'permitAll' WHEN 3 THEN 'authenticated' ELSE concat('hasAnyRole(''', app_name, ''',''', name, ''')') END AS access FROM syn_service""")
def _(v):
    six = F.col("service_id") % 6
    names = F.when(six == 0, F.array(F.lit(" "))).when(six == 1, F.array("name", F.lit("Deny"))).when(six == 2, F.array(F.lit("permitAll"))).when(six == 3, F.array("name", F.lit("*"))).otherwise(F.array("app_name", F.concat(F.lit(" "), "name")))
    return v.syn_service.select("service_id", X.config_access(names, "hasAnyRole").alias("access"))


@query("f38_blanked_source", r"""
WITH s AS (SELECT conv_id, turn, concat('int a = 1; // ', replace(text, chr(10), ' '), chr(10), '/* x', chr(10), replace(text, '*', ''), '*/ call("', regexp_replace(text, '["\\\n]', ' ', 'g'), '", ''c'') / 2;') AS src FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, 'int a = 1;  ' || chr(10) || '  call( ,  ) / 2;' AS blanked FROM s""")
def _(v):
    t = F.col("text")
    src = F.concat(F.lit("int a = 1; // "), F.replace(t, F.lit("\n"), F.lit(" ")), F.lit("\n/* x\n"), F.replace(t, F.lit("*"), F.lit("")), F.lit('*/ call("'), F.regexp_replace(t, '["\\\\\\n]', " "), F.lit("\", 'c') / 2;"))
    return v.conversations.where("text IS NOT NULL").select("conv_id", "turn", X.blank_noise(src).alias("blanked"))


@query("f39_line_scan", r"""
WITH d AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS line, sha256(t) AS line_sha FROM (SELECT doc_id, unnest(lines) AS t, generate_subscripts(lines, 1) AS i FROM d)""")
def _(v):
    return v.documents.select("doc_id", F.posexplode(X.source_lines(F.col("text"))).alias("i", "t")).select("doc_id", (F.col("i") + 1).alias("line"), F.sha2("t", 256).alias("line_sha"))


@query("f39_matching_lines", r"""
WITH d AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS t, generate_subscripts(lines, 1) AS i FROM d)
SELECT doc_id, CAST(i AS INTEGER) AS line, len(regexp_extract_all(t, '[Tt]he')) AS n FROM l WHERE regexp_matches(t, '[Tt]he')""")
def _(v):
    hits = v.documents.select("doc_id", F.explode(X.matching_lines(F.col("text"), "[Tt]he")).alias("line"))
    return hits.groupBy("doc_id", "line").agg(F.count("*").alias("n"))


@query("f40_tags", """
SELECT endpoint_id, CASE WHEN endpoint_id % 4 = 0 THEN NULL ELSE concat('kind-', endpoint_id % 3) END AS namespace, CASE WHEN endpoint_id % 4 <> 0 THEN concat(handler, '=', endpoint_id) END AS value FROM syn_endpoint""")
def _(v):
    tag = F.when(F.col("endpoint_id") % 4 == 0, F.concat(F.lit("Bad="), "handler")).otherwise(F.concat(F.lit("kind-"), (F.col("endpoint_id") % 3).cast("string"), F.lit("="), "handler", F.lit("="), F.col("endpoint_id").cast("string")))
    return v.syn_endpoint.select("endpoint_id", X.tag_parts(tag).alias("t")).select("endpoint_id", "t.namespace", "t.value")


@query("f41_gateway_predicates", """
SELECT service_id, ord, concat(prefix, ',', '/x', ord) AS paths, CAST(strip AS INTEGER) AS strip FROM syn_route""")
def _(v):
    r = v.syn_route
    predicate = F.concat(F.lit("Path = "), "prefix", F.lit(" , /x"), F.col("ord").cast("string"), F.lit(","))
    return r.select("service_id", "ord", _joined(X.predicate_paths(predicate)).alias("paths"), X.stripped_segments(F.concat(F.lit("StripPrefix="), F.col("strip").cast("string"))).alias("strip"))


@query("f43_container_ports", "SELECT service_id, CASE WHEN service_id % 5 = 4 THEN NULL ELSE CAST(port AS INTEGER) END AS container FROM syn_service")
def _(v):
    port, five = F.col("port").cast("string"), F.col("service_id") % 5
    entry = F.when(five == 0, port).when(five == 1, F.concat(F.lit("9000:"), port)).when(five == 2, F.concat(F.lit("127.0.0.1:9000:"), port)).when(five == 3, F.concat(port, F.lit("/tcp"))).otherwise(F.concat(F.lit("9000:"), port, F.lit("-9"), port))
    return v.syn_service.select("service_id", X.container_port(entry).alias("container"))


@query("f44_short_signatures", "SELECT endpoint_id, 'Api' || endpoint_id || '.run' AS short FROM syn_endpoint")
def _(v):
    full = F.concat("handler", F.lit(".Api"), F.col("endpoint_id").cast("string"), F.lit(".run:void(java.lang.String)"))
    return v.syn_endpoint.select("endpoint_id", X.short_signature(full).alias("short"))


@query("f46_path_slugs", """
SELECT service_id, substr(regexp_replace(concat('git.example.com/org/', name), '[^a-z0-9]+', '-', 'g'), 1, 40) || '-' || substr(sha256(concat('git.example.com/org/', name)), 1, 8) AS slug FROM syn_service""")
def _(v):
    return v.syn_service.select("service_id", X.path_slug(F.concat(F.lit("https://Git.example.com/org/"), "name", F.lit(".git"))).alias("slug"))


@query("f47_newer_versions", """
WITH x AS (SELECT endpoint_id, [1, CAST(endpoint_id % 12 AS INTEGER), 3] AS a, [1, CAST(size % 12 AS INTEGER)] AS b FROM syn_endpoint) SELECT endpoint_id, a > b AS newer, endpoint_id % 9 = 0 AS unreadable FROM x""")
def _(v):
    a = F.concat(F.lit("v1."), (F.col("endpoint_id") % 12).cast("string"), F.lit(".3"))
    b = F.concat(F.lit("1."), (F.col("size") % 12).cast("string"))
    odd = F.when(F.col("endpoint_id") % 9 == 0, F.lit("1.x")).otherwise(F.lit("1.0"))
    return v.syn_endpoint.select("endpoint_id", (X.version_parts(a) > X.version_parts(b)).alias("newer"), X.version_parts(odd).isNull().alias("unreadable"))


@query("j06_kubernetes_names", """
SELECT service_id, CASE service_id % 4 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN name ELSE NULL END AS short, service_id % 4 = 2 AS inferred FROM syn_service""")
def _(v):
    four = F.col("service_id") % 4
    host = F.concat("name", F.when(four == 0, ".ns.svc.cluster.local").when(four == 1, ".ns.svc").when(four == 2, ".ns").otherwise(".a.b"))
    short = X.kubernetes_name(host)
    return v.syn_service.select("service_id", short.alias("short"), (short.isNotNull() & X.two_labels(host)).alias("inferred"))


@query("j27_ant_matches", r"""
WITH r AS (SELECT rule_id, service_id, pattern FROM syn_rule), e AS (SELECT endpoint_id, service_id, uri FROM syn_endpoint),
p AS (SELECT endpoint_id, rule_id, uri, pattern, CASE WHEN rule_id % 3 = 0 THEN 'deep' WHEN rule_id % 3 = 1 THEN 'mark' ELSE 'hole' END AS form FROM e JOIN r USING (service_id))
SELECT endpoint_id, rule_id, CASE form WHEN 'deep' THEN CASE WHEN regexp_matches(uri, '^/[^/]*/brand-1[^/]*$') OR regexp_matches(uri, '/brand-1[^/]*$') THEN 'exact' WHEN regexp_matches(uri, '/\{\?\}$') THEN 'speculative' END
  WHEN 'mark' THEN CASE WHEN regexp_matches(uri, '^/smal.(/|$)') THEN 'exact' END
  ELSE CASE WHEN regexp_matches(uri, '^/[^/]+/[^/]+/\{\?\}$') THEN 'speculative' END END AS precision FROM p""")
def _(v):
    three = F.col("rule_id") % 3
    form = F.when(three == 0, "/**/brand-1*").when(three == 1, "/smal?/**").otherwise("/*/*/item")
    p = v.syn_endpoint.select("endpoint_id", "service_id", "uri").join(v.syn_rule.select("rule_id", "service_id", form.alias("pattern")), "service_id")
    return rules.matched(p, "pattern", "uri").select("endpoint_id", "rule_id", "precision")


@query("a39_error_rates", """
SELECT quality, n, errors, round(100.0 * errors / nullif(n, 0), 1) AS rate FROM (SELECT quality, count(*) AS n, count(*) FILTER (toxic = 1) AS errors FROM labels GROUP BY quality)""")
def _(v):
    n = v.labels.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("errors"))
    return n.withColumn("rate", X.percent(F.col("errors"), F.col("n")).cast("double"))
