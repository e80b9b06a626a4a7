"""Annotated queries of the synthetic snapshot, put together from parts, and what the parts do."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.operators import statements
from skylark.plans.catalog import query
from skylark.plans.synthetic import VIEWS

VIEWS.update({
    "syn_entity": """
        SELECT endpoint_id, service_id, concat('com.acme.E', CAST(endpoint_id AS STRING)) AS entity,
          CASE WHEN endpoint_id % 3 = 0 THEN concat('N', CAST(endpoint_id AS STRING)) END AS jpql_name, CASE WHEN endpoint_id % 4 <> 0 THEN concat('T_', CAST(endpoint_id AS STRING)) END AS storage_name,
          CASE WHEN endpoint_id % 8 = 1 THEN 'Sch' END AS storage_schema, endpoint_id % 10 = 0 AS delete_rewritten
        FROM {syn_endpoint}""",
    "syn_entity_field": """
        SELECT e.service_id, e.entity AS owner, 'next' AS field, CASE WHEN endpoint_id % 2 = 0 THEN concat('com.acme.E', CAST(endpoint_id + c.n AS STRING)) ELSE 'java.util.List' END AS type_name,
          CASE WHEN endpoint_id % 2 = 0 THEN concat('E', CAST(endpoint_id + c.n AS STRING)) ELSE concat('List<E', CAST(endpoint_id + c.n AS STRING), '>') END AS declared_type
        FROM {syn_entity} e JOIN (SELECT count(*) AS n FROM {supplier}) c ON c.n > 0
        UNION ALL SELECT service_id, entity, 'tags', 'java.util.Map', 'Map<String, java.util.UUID>' FROM {syn_entity}""",
    "syn_statement": """
        SELECT query_id, service_id, native, FALSE AS mongo, repository_entity, simple AS repository_text, part, pick, clause, verb, other_id, storage_name, storage_schema, written,
          concat(CASE part % 3 WHEN 1 THEN '/* delete from Ghost */ ' WHEN 2 THEN concat('-- from Ghost, Ghost', chr(10)) ELSE '' END,
            CASE verb WHEN 'select' THEN concat('SELECT a FROM ', CASE WHEN native AND part % 7 = 0 THEN 'only ' ELSE '' END, written, ' a') WHEN 'update' THEN concat('update ', written, ' a set a.x = 1')
              WHEN 'delete' THEN concat('delete from ', written, ' a') ELSE concat('insert into ', written, ' (id) select b.id from ', CASE WHEN native THEN 'T_' ELSE 'com.acme.E' END, CAST(other_id AS STRING), ' b') END,
            CASE WHEN verb <> 'select' OR pick = 0 THEN '' WHEN pick = 3 THEN ', Ghost g' WHEN native AND pick = 1 THEN concat(' join T_', CAST(other_id AS STRING), ' b on b.id = a.id')
              WHEN native THEN ', generate_series(1, 3) g' WHEN pick = 1 THEN ' join a.next b' ELSE ' left join fetch a.tags' END,
            CASE WHEN verb = 'insert' OR clause = 0 THEN '' WHEN clause = 1 THEN concat(' where a.note = ', chr(39), 'it', chr(39), chr(39), 's, from Ghost', chr(39), ' order by a.id, a.x')
              ELSE concat(' where a.id in (select c.id from ', CASE WHEN native THEN 'T_' ELSE 'com.acme.E' END, CAST(other_id AS STRING), ' c where extract(year from c.d) = :from)') END,
            CASE WHEN verb = 'insert' AND native AND part % 13 = 0 THEN ' on conflict (id) do update set x = 1' ELSE '' END, CASE WHEN part % 11 = 0 THEN ' # and more' ELSE '' END) AS text
        FROM (
          SELECT o_orderkey AS query_id, e.service_id, o_orderkey % 2 = 0 AS native, e.entity AS repository_entity, concat('E', CAST(e.endpoint_id AS STRING)) AS simple, o_orderkey AS part, o_custkey % 4 AS pick, o_custkey % 3 AS clause,
            CASE (o_orderkey + o_custkey) % 5 WHEN 2 THEN 'update' WHEN 3 THEN 'delete' WHEN 4 THEN 'insert' ELSE 'select' END AS verb, e.endpoint_id + c.s AS other_id, e.storage_name, e.storage_schema,
            CASE WHEN o_orderkey % 2 = 0 THEN concat(CASE WHEN e.storage_schema IS NOT NULL AND o_orderkey % 3 = 0 THEN 'sCh.' ELSE '' END, coalesce(CASE WHEN o_custkey % 2 = 0 THEN lower(e.storage_name) ELSE e.storage_name END, concat('E', CAST(e.endpoint_id AS STRING))))
              WHEN o_orderkey % 7 = 0 THEN '#{{#entityName}}' WHEN o_orderkey % 5 = 0 THEN concat('e', CAST(e.endpoint_id AS STRING)) ELSE coalesce(e.jpql_name, concat('E', CAST(e.endpoint_id AS STRING))) END AS written
          FROM {orders} JOIN (SELECT (SELECT count(*) FROM {supplier}) AS s, (SELECT count(*) FROM {part}) AS p) c ON c.p > 0 JOIN {syn_entity} e ON e.endpoint_id = o_orderkey % c.p) x""",
})

#: What each part of a statement names, in order: the parts are chosen in syn_statement, their effect is stated here.
_MENTIONS = """
n AS (SELECT s.*, o.entity AS other, o.storage_name AS o_table, o.storage_schema AS o_schema, CASE WHEN native THEN concat('T_', other_id) ELSE concat('com.acme.E', other_id) END AS o_written
  FROM syn_statement s LEFT JOIN syn_entity o ON o.endpoint_id = s.other_id),
r AS (SELECT *, CASE WHEN native THEN CASE WHEN o_table IS NOT NULL AND o_schema IS NULL THEN other END ELSE other END AS o_entity,
  CASE WHEN native THEN CASE WHEN storage_name IS NOT NULL AND (storage_schema IS NULL OR part % 3 = 0) THEN repository_entity END WHEN part % 7 = 0 THEN repository_entity WHEN part % 5 = 0 THEN NULL ELSE repository_entity END AS t_entity,
  CASE verb WHEN 'select' THEN 'read' WHEN 'insert' THEN 'create' ELSE verb END AS op, NOT (part % 11 = 0 OR (verb = 'insert' AND native AND part % 13 = 0)) AS is_read FROM n),
m AS (
  SELECT query_id, 1 AS n, t_entity AS entity, op, written, native FROM r WHERE is_read
  UNION ALL SELECT query_id, 2, o_entity, 'read', o_written, native FROM r WHERE is_read AND verb = 'insert'
  UNION ALL SELECT query_id, 2, CASE WHEN native THEN o_entity WHEN t_entity IS NOT NULL THEN other END, 'read', CASE WHEN native THEN o_written ELSE 'a.next' END, native FROM r
    WHERE is_read AND verb = 'select' AND pick = 1 AND (native OR t_entity IS NULL OR other IS NOT NULL)
  UNION ALL SELECT query_id, 2, NULL, 'read', 'a.tags', native FROM r WHERE is_read AND verb = 'select' AND pick = 2 AND NOT native AND t_entity IS NULL
  UNION ALL SELECT query_id, 2, NULL, 'read', 'Ghost', native FROM r WHERE is_read AND verb = 'select' AND pick = 3
  UNION ALL SELECT query_id, 3, o_entity, 'read', o_written, native FROM r WHERE is_read AND verb <> 'insert' AND clause = 2)"""


@query("f35_query_accesses", f"""
WITH {_MENTIONS},
d AS (SELECT query_id, entity, op, native, min(n) AS n FROM m GROUP BY ALL),
g AS (SELECT d.query_id, n, d.entity, CASE WHEN op = 'delete' AND NOT native AND e.delete_rewritten THEN 'unknown' ELSE op END AS operation FROM d LEFT JOIN syn_entity e ON e.entity = d.entity),
f AS (SELECT query_id, written, min(n) AS n FROM m WHERE entity IS NULL GROUP BY ALL), u AS (SELECT query_id, string_agg(written, ', ' ORDER BY n, written) AS names FROM f GROUP BY query_id),
s AS (SELECT query_id, bool_or(entity IS NOT NULL) AS hit FROM m GROUP BY query_id)
SELECT g.query_id, CAST(row_number() OVER (PARTITION BY g.query_id ORDER BY n, operation) - 1 AS INTEGER) AS ord, entity, operation, TRUE AS is_read, CASE WHEN NOT hit THEN names END AS unresolved FROM g JOIN s USING (query_id) LEFT JOIN u USING (query_id)
UNION ALL SELECT query_id, 0, repository_entity, 'unknown', FALSE, NULL FROM r WHERE NOT is_read""")
def _(v):
    return statements.accesses(v.syn_statement, v.syn_entity, v.syn_entity_field)


@query("f34_statement_tokens", """
WITH t AS (SELECT query_id, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(text, '/[*].*?[*]/', ' ', 'g'), '--[^\n]*\n', ' ', 'g'), '''(?:[^'']|'''')*''|#[{][^}]*[}]|[?:][A-Za-z]+|[0-9]+|[A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)*|[^ ]'), '|') AS all_tokens FROM syn_statement)
SELECT query_id, len(string_split(all_tokens, '|')) AS n_tokens, sha256(all_tokens) AS tokens_sha FROM t""")
def _(v):
    rows = statements.tokens(v.syn_statement).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("t"))
    return rows.select("query_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("t", lambda x: x["t"]), "|"), 256).alias("tokens_sha"))


@query("f37_field_targets", """
WITH f AS (SELECT f.*, CASE WHEN field = 'next' THEN e.entity END AS target FROM syn_entity_field f LEFT JOIN syn_entity e ON e.entity = CASE WHEN starts_with(type_name, 'com.') THEN type_name ELSE concat('com.acme.', regexp_extract(declared_type, '<(.*)>', 1)) END)
SELECT service_id, owner, field, target, target IS NOT NULL AS is_entity FROM f""")
def _(v):
    return statements.field_targets(v.syn_entity, v.syn_entity_field)
