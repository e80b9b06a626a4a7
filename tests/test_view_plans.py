"""Views with plans of their own: the rows of their texts, dealt out less often."""

import pytest
from pyspark.sql import functions as F

from skylark.plans import synthetic as V


@pytest.fixture
def few(spark):
    """The plain tables at sf0.001, some of them with repeated and missing keys."""
    d = "/root/testdata/sf0.001"
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "nation", "part", "lineitem")}
    tables["part"] = tables["part"].unionByName(tables["part"].where("p_partkey % 7 = 0").withColumn("p_type", F.lit("OTHER")))
    line = tables["lineitem"]
    odd = line.where("l_orderkey % 50 = 0")
    tables["lineitem"] = line.unionByName(odd).unionByName(odd.withColumn("l_partkey", F.lit(None).cast("long"))).unionByName(odd.withColumn("l_linenumber", F.lit(0))).unionByName(odd.withColumn("l_linenumber", F.lit(None).cast("int")))

    def of(name):
        return tables[name] if name in tables else spark.sql(V.VIEWS[name], **{n: of(n) for n in V._names(V.VIEWS[name])})

    return of


@pytest.mark.parametrize("name", list(V.PLANS))
def test_rows_of_the_text(few, name):
    text, plan = few(name), V.PLANS[name](few)
    assert plan.columns == text.columns and plan.dtypes == text.dtypes
    assert text.count() > 0 and text.exceptAll(plan).isEmpty() and plan.exceptAll(text).isEmpty()


def test_calls_are_dealt_out_once(spark, few):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = V.PLANS["syn_remote"](few)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum("Exchange hashpartitioning(l_" in x for x in plan.splitlines()) == 1 and "REPARTITION_BY_COL" in plan
