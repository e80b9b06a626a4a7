"""URL expressions of the synthetic snapshot: one sink for each endpoint, in eight forms."""

from __future__ import annotations

from skylark.operators import slicing
from skylark.plans.catalog import query
from skylark.plans.synthetic import VIEWS

# expressions of endpoint n are 100 n and up; f is the form
VIEWS.update({
    "syn_url": "SELECT endpoint_id AS n, endpoint_id * 100 AS b, endpoint_id % 8 AS f, CAST(endpoint_id AS STRING) AS s, size % 3 AS k, lower(entity) AS word FROM {syn_endpoint}",
    "syn_url_expr": """
        SELECT b AS expr, n AS method, CASE f WHEN 1 THEN 'local' WHEN 2 THEN 'call' WHEN 3 THEN 'ternary' WHEN 4 THEN 'format' WHEN 5 THEN 'builder' WHEN 6 THEN 'call' ELSE 'concat' END AS kind,
          CASE WHEN f = 1 THEN 'u' END AS text, CASE f WHEN 2 THEN n + 1000000000 WHEN 6 THEN n + 2000000000 END AS callee, CAST(NULL AS INT) AS place FROM {syn_url}
        UNION ALL SELECT b + 1, n, CASE WHEN f = 7 THEN 'local' ELSE 'literal' END, CASE f WHEN 4 THEN 'http://h-%s/p/%d' WHEN 7 THEN 'x' ELSE concat('http://', word, '-', s) END, NULL, NULL FROM {syn_url}
        UNION ALL SELECT b + 2, n, CASE f WHEN 1 THEN 'literal' WHEN 3 THEN 'config' WHEN 4 THEN 'literal' WHEN 5 THEN 'literal' WHEN 7 THEN 'local' ELSE 'literal' END, CASE f WHEN 1 THEN concat('http://other-', s) WHEN 3 THEN concat('key.', word) WHEN 4 THEN word WHEN 7 THEN 'y' ELSE '/a' END, NULL, NULL FROM {syn_url}
        UNION ALL SELECT b + 3, n, CASE WHEN f = 7 THEN 'local' WHEN f = 0 AND k = 0 THEN 'literal' ELSE 'other' END, CASE WHEN f = 7 THEN 'z' WHEN f = 0 THEN '/b' END, NULL, NULL FROM {syn_url}
        UNION ALL SELECT b + 4, n + 1000000000, 'concat', NULL, NULL, NULL FROM {syn_url} WHERE f = 2 UNION ALL SELECT b + 5, n + 1000000000, 'parameter', NULL, NULL, 1 FROM {syn_url} WHERE f = 2
        UNION ALL SELECT b + 6, n + 1000000000, 'literal', '/v', NULL, NULL FROM {syn_url} WHERE f = 2
        UNION ALL SELECT b + 4, n + 2000000000, 'call', NULL, n + 2000000000, NULL FROM {syn_url} WHERE f = 6
        UNION ALL SELECT b + 10 + t.i, n, 'literal', concat(CASE WHEN t.i < 3 THEN 'http://x' WHEN t.i < 6 THEN '/y' ELSE '/z' END, CAST(t.i % 3 AS STRING)), NULL, NULL FROM {syn_url} JOIN (SELECT DISTINCT CAST(n_nationkey AS INT) AS i FROM {nation} WHERE n_nationkey < 9) t ON f = 7""",
    "syn_url_child": """
        SELECT b AS expr, 1 AS ord, b + 1 AS child, CASE WHEN f = 5 THEN 'base' END AS role FROM {syn_url} WHERE f IN (0, 2, 3, 4, 5, 6, 7)
        UNION ALL SELECT b, 2, b + 2, CASE WHEN f = 5 THEN 'path' END FROM {syn_url} WHERE f IN (0, 3, 4, 5, 7) UNION ALL SELECT b, 3, b + 3, CASE WHEN f = 5 THEN CASE k WHEN 0 THEN 'segment' WHEN 1 THEN 'neutral' ELSE 'other' END END FROM {syn_url} WHERE f IN (0, 4, 5, 7)
        UNION ALL SELECT b + 4, 1, b + 5, NULL FROM {syn_url} WHERE f = 2 UNION ALL SELECT b + 4, 2, b + 6, NULL FROM {syn_url} WHERE f = 2""",
    "syn_url_assignment": """
        SELECT n AS method, 'u' AS name, 1 AS ord, b + 1 AS expr FROM {syn_url} WHERE f = 1 UNION ALL SELECT n, 'u', 2, b + 2 FROM {syn_url} WHERE f = 1 AND k > 0
        UNION ALL SELECT n, CASE WHEN t.i < 3 THEN 'x' WHEN t.i < 6 THEN 'y' ELSE 'z' END, t.i, b + 10 + t.i FROM {syn_url} JOIN (SELECT DISTINCT CAST(n_nationkey AS INT) AS i FROM {nation} WHERE n_nationkey < 9) t ON f = 7""",
    "syn_url_return": "SELECT n + 1000000000 AS method, 1 AS ord, b + 4 AS expr FROM {syn_url} WHERE f = 2 UNION ALL SELECT n + 2000000000, 1, b + 4 FROM {syn_url} WHERE f = 6 UNION ALL SELECT n + 2000000000, 2, b + 1 FROM {syn_url} WHERE f = 6 AND k = 0",
})


@query("x20_sliced_urls", """
WITH o AS (SELECT *, concat('http://', word, '-', s) AS lit FROM syn_url), r AS (
  SELECT b AS root, 0 AS ord, CASE WHEN k = 0 THEN concat(lit, '/a/b') ELSE concat(lit, '/a{?}') END AS url, CASE WHEN k = 0 THEN 'exact' ELSE 'heuristic' END AS confidence, FALSE AS truncated FROM o WHERE f = 0
  UNION ALL SELECT b, 0, lit, CASE WHEN k > 0 THEN 'heuristic' ELSE 'exact' END, FALSE FROM o WHERE f = 1 UNION ALL SELECT b, 1, concat('http://other-', s), 'heuristic', FALSE FROM o WHERE f = 1 AND k > 0
  UNION ALL SELECT b, 0, concat(lit, '/v'), 'high', FALSE FROM o WHERE f = 2
  UNION ALL SELECT b, 0, lit, 'heuristic', FALSE FROM o WHERE f = 3 UNION ALL SELECT b, 1, concat('${key.', word, '}'), 'heuristic', FALSE FROM o WHERE f = 3
  UNION ALL SELECT b, 0, concat('http://h-', word, '/p/{?}'), 'high', FALSE FROM o WHERE f = 4
  UNION ALL SELECT b, 0, concat(lit, '/a', CASE k WHEN 0 THEN '/{?}' WHEN 1 THEN '' ELSE '{?}' END), CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'exact' ELSE 'heuristic' END, FALSE FROM o WHERE f = 5
  UNION ALL SELECT b, 0, NULL, 'none', FALSE FROM o WHERE f = 6 UNION ALL SELECT b, 1, lit, 'heuristic', FALSE FROM o WHERE f = 6 AND k = 0
  UNION ALL SELECT b, CAST(i AS INTEGER), concat('http://x0/y', i // 3, '/z', i % 3), 'heuristic', TRUE FROM o, range(8) t(i) WHERE f = 7)
SELECT * FROM r""")
def _(v):
    return slicing.sliced(v.syn_url.selectExpr("b AS expr"), v.syn_url_expr, v.syn_url_child, v.syn_url_assignment, v.syn_url_return)
