"""Evidence about protection from the rules of the synthetic snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.operators import claims, rule_evidence
from skylark.plans.catalog import query
from skylark.plans.synthetic import VIEWS

# a tenth of the rules stand in a chain for /small alone; one rule of each service loops over two settings
VIEWS.update({
    "syn_chain_rule": """
        SELECT service_id, rule_id, rule_id % 10 = 0 AS narrow, ord, CASE WHEN rule_id % 7 = 3 THEN concat('$', '{{base:', pattern, '}}') ELSE pattern END AS pattern, CAST(NULL AS STRING) AS http_method,
          CASE WHEN NOT is_read THEN 'custom.check(x)' WHEN access = 'permit' THEN 'permitAll' WHEN access = 'deny' THEN 'denyAll()' ELSE concat('hasAnyRole(''ROLE_R', CAST(rule_id % 3 AS STRING), ''', ''X'')') END AS access, 'code' AS origin FROM {syn_rule}
        UNION ALL SELECT service_id, -1 - service_id, FALSE, -1, 'app.rules', CASE WHEN service_id % 2 = 0 THEN 'GET' END, 'denyAll', 'config' FROM {syn_service}""",
    "syn_setting": """
        SELECT service_id, 'app.rules' AS key, 0 AS ord, '/large/**' AS pattern, 'hasAuthority(''a'')' AS access FROM {syn_service} WHERE service_id % 3 > 0
        UNION ALL SELECT service_id, 'app.rules', 1, '/promo/**', 'permitAll' FROM {syn_service} WHERE service_id % 3 > 0""",
})

_EVIDENCE = """
WITH r0 AS (SELECT service_id, rule_id, narrow, ord, 0 AS entry, http_method, CASE WHEN origin = 'code' THEN regexp_replace(pattern, '^[$]\\{base:(.*)\\}$', '\\1') END AS pattern, access FROM syn_chain_rule c WHERE origin = 'code' OR NOT EXISTS (SELECT 1 FROM syn_setting s WHERE s.service_id = c.service_id)),
r AS (SELECT * FROM r0 UNION ALL SELECT c.service_id, c.rule_id, c.narrow, c.ord, s.ord, http_method, s.pattern, s.access FROM syn_chain_rule c JOIN syn_setting s ON s.service_id = c.service_id AND s.key = c.pattern WHERE origin = 'config'),
k AS (SELECT e.endpoint_id, e.uri, e.http_method AS method, c.service_id, c.narrow, count(*) OVER (PARTITION BY endpoint_id) AS n FROM (SELECT DISTINCT service_id, narrow FROM r) c JOIN syn_endpoint e ON e.service_id = c.service_id WHERE NOT narrow OR starts_with(uri, '/small/')),
m AS (SELECT k.endpoint_id, k.n, r.*, CASE WHEN access = 'permitAll' THEN 'permit' WHEN starts_with(access, 'denyAll') THEN 'deny' WHEN starts_with(access, 'has') THEN 'role' END AS effect FROM k JOIN r ON r.service_id = k.service_id AND r.narrow = k.narrow AND (r.http_method IS NULL OR r.http_method = k.method)
  WHERE pattern IS NULL OR pattern = '/**' OR (ends_with(pattern, '/**') AND starts_with(uri, replace(pattern, '**', ''))) OR (NOT ends_with(pattern, '/**') AND starts_with(uri, replace(pattern, '*', '')) AND NOT contains(substr(uri, length(pattern)), '/'))),
s AS (SELECT *, min(CASE WHEN pattern IS NOT NULL AND effect IS NOT NULL THEN ord * 10 + entry END) OVER (PARTITION BY endpoint_id, narrow) AS stop FROM m),
v AS (SELECT endpoint_id, rule_id, coalesce(effect, 'authenticated') AS effect, CASE WHEN pattern IS NULL OR effect IS NULL OR n > 1 THEN 'opaque' ELSE 'exact' END AS resolution,
  CASE WHEN contains(access, 'ROLE_R') THEN concat('R', rule_id % 3, ',X') ELSE '' END AS roles, pattern FROM s WHERE stop IS NULL OR ord * 10 + entry <= stop)"""


def _evidence(v):
    rules = v.syn_chain_rule.withColumn("chain_id", F.col("narrow").cast("int")).withColumn("chain_scope", F.when(F.col("narrow"), "/small/**"))
    env = v.syn_service.select("service_id", F.lit("unused").alias("key"), F.lit("x").alias("value"))
    return rule_evidence.evidence(v.syn_endpoint, rules, v.syn_setting, env)


@query("z12_rule_evidence", _EVIDENCE + " SELECT * FROM v")
def _(v):
    return _evidence(v).select("endpoint_id", "rule_id", "effect", "resolution", F.array_join(F.array_sort("roles"), ",").alias("roles"), "pattern")


@query("f27_claims_from_rules", _EVIDENCE + """,
f AS (SELECT endpoint_id, count(*) AS n_evidence, bool_or(resolution <> 'opaque' AND effect <> 'permit') AS requires, bool_or(resolution = 'opaque') AS unread, bool_or(resolution = 'opaque' AND effect = 'permit') AS removes, bool_or(resolution <> 'opaque' AND effect = 'deny') AS denies,
  coalesce(string_agg(DISTINCT CASE WHEN resolution <> 'opaque' AND effect <> 'permit' AND roles <> '' THEN roles END, ',' ORDER BY CASE WHEN resolution <> 'opaque' AND effect <> 'permit' AND roles <> '' THEN roles END), '') AS all_roles FROM v GROUP BY endpoint_id),
c AS (SELECT *, CASE WHEN NOT removes AND NOT (unread AND NOT requires) THEN requires END AS claim FROM f)
SELECT endpoint_id, claim AS authenticated, coalesce(claim AND denies, FALSE) AS denied, n_evidence FROM c""")
def _(v):
    return claims.merged(_evidence(v)).select("endpoint_id", "authenticated", "denied", "n_evidence")
