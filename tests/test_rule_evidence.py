"""Rules as written to evidence, and what it adds up to."""

from skylark.operators import claims
from skylark.operators import rule_evidence as E

RULES = "service_id long, rule_id long, chain_id int, chain_scope string, ord int, origin string, pattern string, http_method string, access string"


def _evidence(spark, rules, endpoints, settings=(), env=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return E.evidence(
        frame(endpoints, "endpoint_id long, service_id long, uri string, http_method string"), frame(rules, RULES), frame(settings, "service_id long, key string, ord int, pattern string, access string"), frame(env, "service_id long, key string, value string"),
    )


def test_chains_settings_and_placeholders(spark):
    rules = [
        (1, 1, 0, None, 0, "code", "/pub/**", None, "permitAll"), (1, 2, 0, None, 1, "code", "/a/*", "post", "hasRole('ADMIN')"), (1, 3, 0, None, 2, "unread", "?", None, "authenticated"), (1, 4, 0, None, 3, "code", "/**", None, "authenticated"), (1, 5, 0, None, 4, "code", "/**", None, "denyAll"),
        (2, 1, 0, None, 0, "config", "app.rules", None, "denyAll"), (2, 2, 0, None, 1, "config", "app.rules", None, "permitAll"), (2, 3, 0, None, 2, "code", "/**", None, "denyAll"), (3, 1, 0, None, 0, "config", "none", None, "permitAll"),
        (4, 1, 0, "/x/**", 0, "code", "${p:/x}/**", None, "permitAll"), (4, 2, 1, "/x/y/**", 0, "code", "${gone}/**", None, "denyAll"), (4, 3, 0, "/x/**", 1, "code", "/x/**", None, "${role}"), (5, 1, 0, None, 0, "code", "/u/me/x", None, "permitAll"), (5, 2, 0, None, 1, "code", "/**", None, "custom"),
    ]
    endpoints = [(10, 1, "/pub/x", "GET"), (11, 1, "/a/b", "POST"), (12, 1, "/a/b", "GET"), (20, 2, "/s/1", "GET"), (21, 2, "/other", "GET"), (30, 3, "/z", "GET"), (40, 4, "/x/1", "GET"), (41, 4, "/x/y/1", "GET"), (42, 4, "/else", "GET"), (50, 5, "/v/{?}", "GET")]
    settings = [(2, "app.rules", 0, "/s/**", "hasAuthority('a')"), (2, "app.rules", 1, "/t/**", "permitAll"), (9, "app.rules", 0, "/**", "denyAll")]
    rows = _evidence(spark, rules, endpoints, settings, [(4, "role", "hasRole('R')")])
    got = {}
    for r in rows.collect():
        got.setdefault(r.endpoint_id, set()).add((r.rule_id, r.effect, r.resolution, ",".join(r.roles + r.authorities), r.declared_in))
    assert got == {
        10: {(1, "permit", "exact", "", None)}, 11: {(2, "role", "exact", "ADMIN", None)}, 12: {(3, "authenticated", "opaque", "", None), (4, "authenticated", "exact", "", None)},
        20: {(1, "role", "exact", "a", "app.rules")}, 21: {(3, "deny", "exact", "", None)}, 30: {(1, "permit", "opaque", "", None)}, 40: {(1, "permit", "exact", "", None)},
        41: {(1, "permit", "opaque", "", None), (2, "deny", "opaque", "", None)}, 50: {(2, "authenticated", "opaque", "", None)},
    }
    told = {r.endpoint_id: (r.authenticated, r.denied) for r in claims.merged(rows).collect()}
    assert told[10] == (False, False) and told[11] == (True, False) and told[12] == (True, False) and told[21] == (True, True) and told[30] == (None, False) and told[41] == (None, False)


def test_bypass_counts_only_where_it_fits_exactly(spark):
    endpoints = spark.createDataFrame([(1, 1, "/static/a"), (2, 1, "/static/{id}"), (3, 1, "/x"), (4, 2, "/static/a")], "endpoint_id long, service_id long, uri string")
    ignored = spark.createDataFrame([(1, 7, "/static/a"), (1, 8, "/s*/b")], "service_id long, rule_id long, pattern string")
    assert [(r.endpoint_id, r.rule_id) for r in E.bypasses(endpoints, ignored).collect()] == [(1, 7)]
