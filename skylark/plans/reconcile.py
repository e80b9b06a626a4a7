"""Readings against each other and lookups by position, over the synthetic snapshot and the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.operators import reconcile
from skylark.plans.catalog import query
from skylark.plans.synthetic import VIEWS

VIEWS.update({
    "syn_read_site": "SELECT l_orderkey * 10 + l_linenumber AS site, concat('src/', CAST(l_orderkey AS STRING), '/A', CAST(l_suppkey % 5 AS STRING), '.java') AS file, l_suppkey % 5 AS f, CAST(l_quantity AS INT) AS line, CAST(l_quantity AS INT) + l_partkey % 4 AS line_end, CASE WHEN l_returnflag = 'A' THEN 'save' ELSE 'find' END AS method FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x",
})


@query("j35_reconciled_sites", """
WITH o AS (SELECT site AS oracle_site, concat(f, '-', site // 10) AS k, method, line + site % 3 AS line FROM syn_read_site WHERE site % 7 <> 0), e AS (SELECT site, concat(f, '-', site // 10) AS k, method, line, line_end FROM syn_read_site WHERE site % 5 <> 0),
c AS (SELECT site, oracle_site, o.line - e.line AS rank FROM e JOIN o ON o.k = e.k AND o.method = e.method AND o.line BETWEEN e.line AND e.line_end),
x1 AS (SELECT e.k, e.method, e.line, e.site, row_number() OVER (PARTITION BY e.k, e.method, e.line ORDER BY e.site) AS rn FROM e), y1 AS (SELECT o.k, o.method, o.line, o.oracle_site, row_number() OVER (PARTITION BY o.k, o.method, o.line ORDER BY o.oracle_site) AS rn FROM o),
p1 AS (SELECT site, oracle_site FROM x1 JOIN y1 ON x1.k = y1.k AND x1.method = y1.method AND x1.line = y1.line AND x1.rn = y1.rn)
SELECT site, oracle_site FROM p1""")
def _(v):
    s = v.syn_read_site
    oracle = s.where("site % 7 <> 0").select(F.col("site").alias("oracle_site"), F.concat(F.lit("/repo/"), "file").alias("file"), (F.col("line") + F.col("site") % 3).alias("line"), "method")
    return reconcile.reconciled(oracle, s.where("site % 5 <> 0")).where("NOT by_span").select("site", "oracle_site")


@query("y54_declared_types", """
WITH d AS (SELECT file, method AS name, line AS offset_, concat('T', site % 9) AS type FROM syn_read_site WHERE site % 3 = 0), u AS (SELECT site AS use_id, file, method AS name, line AS offset_ FROM syn_read_site WHERE site % 3 <> 0)
SELECT u.use_id, coalesce((SELECT arg_max(type, (d.offset_, type)) FROM d WHERE d.file = u.file AND d.name = u.name AND d.offset_ <= u.offset_), (SELECT arg_min(type, (d.offset_, type)) FROM d WHERE d.file = u.file AND d.name = u.name AND d.offset_ > u.offset_)) AS type FROM u""")
def _(v):
    row = v.syn_read_site.select("site", "file", F.col("method").alias("name"), F.col("line").alias("offset"))
    declarations = row.where("site % 3 = 0").select("file", "name", "offset", F.concat(F.lit("T"), (F.col("site") % 9).cast("string")).alias("type"))
    return reconcile.declared_types(row.where("site % 3 <> 0").withColumnRenamed("site", "use_id"), declarations)


@query("y56_modules", """
WITH r AS (SELECT DISTINCT concat('src/', site // 10) AS root FROM syn_read_site WHERE (site // 10) % 3 = 0 UNION ALL SELECT 'src'), f AS (SELECT DISTINCT file, concat('src/', site // 10) AS folder FROM syn_read_site)
SELECT file, coalesce(r.root, 'src') AS root FROM f LEFT JOIN r ON r.root = f.folder""")
def _(v):
    order = F.expr("site div 10")
    roots = v.syn_read_site.where(order % 3 == 0).select(F.concat(F.lit("src/"), order.cast("string")).alias("root")).distinct()
    return reconcile.modules_of(v.syn_read_site.select("file").distinct(), roots.union(v.spark.range(1).select(F.lit("src"))))


_SOURCE = "concat('class C {{ /* .permitAll( */ SecurityFilterChain f() {{ http', CASE WHEN site % 2 = 0 THEN '.authorizeHttpRequests()' ELSE '' END, CASE WHEN site % 3 > 0 THEN '.hasRole(\"x.denyAll()\")' ELSE '' END, CASE WHEN site % 5 > 1 THEN concat(chr(10), '. access (y)') ELSE '' END, CASE WHEN site % 11 = 0 THEN 'anyExchange' ELSE '' END, '; }} }}')"
VIEWS.update({"syn_source": f"SELECT site, concat('S', CAST(site AS STRING), '.java') AS file, {_SOURCE} AS content FROM {{syn_read_site}} WHERE site % 13 < 5"})


@query("a38_unread_access", """
WITH s AS (SELECT *, CAST(site % 3 > 0 AS INTEGER) + CAST(site % 5 > 1 AS INTEGER) AS n FROM syn_source), r AS (SELECT file, site % 4 AS m FROM syn_source WHERE site % 4 > 0)
SELECT s.file, CAST(n AS BIGINT) AS n_named, coalesce(m, 0) AS n_emitted, greatest(0, n - coalesce(m, 0)) AS n_missing, coalesce(m, 0) = 0 AS unread, site % 11 = 0 AS reactive, CASE WHEN site % 3 > 0 THEN 1 ELSE 2 END AS first_line FROM s LEFT JOIN r ON r.file = s.file WHERE n > 0""")
def _(v):
    rules = v.syn_source.select("file", F.explode(F.sequence(F.lit(0), (F.col("site") % 4).cast("int"))).alias("call_id")).where("call_id > 0")
    return reconcile.unread_access(v.syn_source.select("file", "content"), rules)


@query("z65_innermost_blocks", """
SELECT site AS use_id, CASE WHEN site % 2 = 0 THEN CAST(strpos(content, '{') - 1 AS BIGINT) END AS start, CAST(site % 2 = 0 AS INTEGER) AS depth FROM (SELECT site, content FROM syn_source)""")
def _(v):
    uses = v.syn_source.select(F.col("site").alias("use_id"), "file", F.when(F.col("site") % 2 == 0, F.locate("/*", F.col("content")) - 1).otherwise(F.lit(3)).alias("offset"))
    return reconcile.innermost_blocks(v.syn_source.select("file", "content"), uses)
