"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP1 = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.d WHERE r.c < u.b),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.d = w.doc_id
"""


def _mix_sql() -> str:
    """op7: the three levels of the tree one after the other, then whole epochs and the seeded prefix."""
    names = ["domain", "language", "origin"]
    weight = {
        "domain": "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 WHEN 'd3' THEN 1 ELSE 1 END",
        "language": "CASE language WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END",
        "origin": "1",
    }
    sql = """
WITH t AS (
  SELECT doc_id, 'd' || CAST((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 4 AS VARCHAR) AS domain, lang AS language, source AS origin,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents WHERE doc_id IS NOT NULL),
rows_ AS (SELECT * FROM t WHERE tokens > 0),
b0 AS (SELECT CAST(floor(coalesce(sum(tokens), 0) * 500 / 1000) AS BIGINT) AS share FROM rows_)"""
    for i, name in enumerate(names):
        own, above = names[: i + 1], names[:i]
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        by = f"{part} ORDER BY CAST(cap AS DOUBLE) / weight NULLS LAST, {name} NULLS FIRST"
        on = " AND ".join(f"n.{x} IS NOT DISTINCT FROM p.{x}" for x in above) or "TRUE"
        sql += f""",
n{i} AS (SELECT {", ".join(own)}, sum(tokens)::HUGEINT * 2 AS cap, {weight[name]} AS weight FROM rows_ GROUP BY {", ".join(own)}),
j{i} AS (SELECT n.*, p.share AS budget FROM n{i} n JOIN b{i} p ON {on}),
f{i} AS (
  SELECT *, coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM j{i}),
g{i} AS (SELECT *, budget - filled > 0 AND cap * weights <= weight * (budget - filled) AS is_full FROM f{i}),
h{i} AS (
  SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS left_, sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}) AS open_
  FROM g{i}),
b{i + 1} AS (
  SELECT {", ".join(own)}, CAST(CASE WHEN is_full THEN cap ELSE greatest(0, least(cap, (weight::HUGEINT * left_::HUGEINT) // open_::HUGEINT)) END AS BIGINT) AS share
  FROM h{i})"""
    same = " AND ".join(f"r.{x} IS NOT DISTINCT FROM l.{x}" for x in names)
    sql += f""",
l AS (SELECT b.*, s.supply, b.share // s.supply AS whole, b.share % s.supply AS rest
  FROM b3 b JOIN (SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS supply FROM rows_ GROUP BY ALL) s
  ON b.domain IS NOT DISTINCT FROM s.domain AND b.language IS NOT DISTINCT FROM s.language AND b.origin IS NOT DISTINCT FROM s.origin),
x AS (SELECT r.*, l.whole, l.rest FROM rows_ r JOIN l ON {same}),
p AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY md5('17:' || whole || ':' || doc_id), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar
  FROM x WHERE rest > 0)
SELECT doc_id, domain, language, origin, CAST(e.range AS INTEGER) AS epoch, tokens, tokens AS taken FROM x, range(2) e WHERE e.range < whole
UNION ALL
SELECT doc_id, domain, language, origin, CAST(whole AS INTEGER), tokens, CAST(least(tokens, rest - sofar) AS BIGINT) FROM p WHERE sofar < rest
"""
    return sql


OP7 = _mix_sql()

OP13 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
    CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def _codes_sql() -> str:
    """op11: six rounds of assignment and floored means, then the final assignment."""
    near = """a{r} AS MATERIALIZED (
  SELECT vec_id, p, min(CAST(dist AS HUGEINT) * 16 + e) AS best
  FROM (SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM x JOIN b{r} b ON b.p = x.p)
  GROUP BY vec_id, p)"""
    move = """,
s{r} AS (SELECT x.p, CAST(a.best % 16 AS INTEGER) AS e, generate_subscripts(x.c, 1) AS i, unnest(x.c) AS v FROM x JOIN a{r} a ON a.vec_id = x.vec_id AND a.p = x.p),
m{r} AS (SELECT p, e, i, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM s{r} GROUP BY p, e, i),
n{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY p, e),
b{next} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN n{r} n ON n.p = b.p AND n.e = b.e)"""
    sql = """
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, CAST(t.range AS INTEGER) AS p, v[t.range * (len(v) // 8) + 1 : (t.range + 1) * (len(v) // 8)] AS c FROM k, range(8) t),
b0 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS e, c FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)),
"""
    for r in range(6):
        sql += near.format(r=r) + move.format(r=r, next=r + 1) + ",\n"
    return sql + near.format(r=6) + """,
r AS (
  SELECT a.vec_id, k.label, string_agg(lpad(to_hex(CAST(best % 16 AS BIGINT)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error
  FROM a6 a JOIN k ON k.vec_id = a.vec_id GROUP BY a.vec_id, k.label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h
"""


OP11 = _codes_sql()
