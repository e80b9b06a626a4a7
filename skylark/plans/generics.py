"""Repository types of the synthetic snapshot with generic signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.operators import generics
from skylark.plans.catalog import query
from skylark.plans.synthetic import VIEWS

# type R<n> extends R<n / 2>; those divisible by 3 have no parameters; the references pass on, swap, fix, or leave out arguments
VIEWS.update({
    "syn_generic": """
        SELECT n, div2, concat('com.acme.R', CAST(n AS STRING)) AS type, n % 3 <> 0 AS has_params, div2 % 3 <> 0 AS up_params, how,
          concat(CASE WHEN n % 3 <> 0 THEN '<A:Ljava.lang.Object;B::LComparable<TB;>;>' ELSE '' END, 'Ljava.lang.Object;',
            CASE WHEN n < 2 THEN CASE WHEN n % 3 <> 0 THEN 'LCrudRepository<TA;LLong;>;' ELSE concat('LCrudRepository<LE', CAST(n AS STRING), ';LLong;>;') END
              WHEN how = 3 THEN concat('LR', CAST(div2 AS STRING), ';') WHEN how = 4 THEN concat('LR', CAST(div2 AS STRING), '<+LE', CAST(n AS STRING), ';*>;')
              WHEN n % 3 = 0 OR how = 2 THEN concat('LR', CAST(div2 AS STRING), '<Lcom.acme.E', CAST(n AS STRING), ';[LMap<LList<LF', CAST(n AS STRING), ';>;[I>;>;')
              WHEN how = 1 THEN concat('LR', CAST(div2 AS STRING), '<TB;LA;>;') ELSE concat('LR', CAST(div2 AS STRING), '<TA;TB;>;') END) AS signature
        FROM (SELECT p_partkey AS n, CAST(floor(p_partkey / 2) AS BIGINT) AS div2, p_size % 5 AS how FROM {part}) x""",
})


def _types(v):
    up = F.when(F.col("n") < 2, "org.data.CrudRepository").otherwise(F.concat(F.lit("com.acme.R"), F.col("div2").cast("string")))
    return v.syn_generic.select("type", "signature", F.array(F.lit("java.lang.Object"), up).alias("parents"))


@query("x23_generic_bindings", """
WITH RECURSIVE w(root, n, a, a_in, b, b_in) AS (
  SELECT n, n, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM syn_generic
  UNION ALL SELECT root, div2, CASE WHEN NOT up_params OR how IN (3, 4) THEN NULL WHEN NOT has_params OR how = 2 THEN concat('com.acme.E', g.n) WHEN how = 1 THEN b ELSE a END,
    CASE WHEN NOT up_params OR how IN (3, 4) THEN NULL WHEN NOT has_params OR how = 2 THEN g.n WHEN how = 1 THEN b_in ELSE a_in END,
    CASE WHEN NOT up_params OR how IN (3, 4) THEN NULL WHEN NOT has_params OR how = 2 THEN concat('Map<List<F', g.n, '>, int[]>[]') WHEN how = 1 THEN a ELSE b END,
    CASE WHEN NOT up_params OR how IN (3, 4) THEN NULL WHEN NOT has_params OR how = 2 THEN g.n WHEN how = 1 THEN a_in ELSE b_in END
  FROM w JOIN syn_generic g ON g.n = w.n WHERE w.n >= 2)
SELECT concat('com.acme.R', root) AS type, 'org.data.CrudRepository' AS marker, CASE WHEN w.n % 3 = 0 THEN concat('E', w.n) ELSE a END AS bound, concat('com.acme.R', CASE WHEN w.n % 3 = 0 THEN w.n ELSE a_in END) AS written_in
FROM w WHERE w.n < 2""")
def _(v):
    marker = v.spark.range(1).select(F.lit("org.data.CrudRepository").alias("marker"))
    return generics.bindings(_types(v), marker).withColumn("written_in", F.coalesce("written_in", F.lit("com.acme.R")))


@query("x36_declarations", r"""
SELECT type, CASE WHEN has_params THEN 'A,B' ELSE '' END AS params, regexp_extract(signature, ';L([^<;]+)(?:<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)?;$', 1) AS parent,
  CASE WHEN n < 2 THEN CASE WHEN has_params THEN 'A|Long' ELSE concat('E', n, '|Long') END WHEN how = 3 THEN '' WHEN how = 4 THEN concat('? extends E', n, '|?') WHEN NOT has_params OR how = 2 THEN concat('com.acme.E', n, '|Map<List<F', n, '>, int[]>[]') WHEN how = 1 THEN 'B|A' ELSE 'A|B' END AS args
FROM syn_generic""")
def _(v):
    d = _types(v).select("type", generics.declaration(F.col("signature")).alias("d"))
    last = F.element_at("d.supers", -1)
    return d.select("type", F.array_join("d.params", ",").alias("params"), last["name"].alias("parent"), F.array_join(F.transform(last["args"], lambda a: a["text"]), "|").alias("args"))
