"""Which endpoints create, read, update or delete an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("create", "create-or-update", "read", "update", "delete", "unknown")


def summaries(access: DataFrame) -> DataFrame:
    """Per endpoint and entity (NULL is its own group) the operations in order and the distinct sites."""
    does = lambda o: F.col(f"does_{o.replace('-', '_')}")
    # a row for each site first, with what it does, so that no distinct count expands the rows
    sites = access.groupBy("endpoint_id", "entity", "site").agg(*[F.bool_or(F.col("operation") == o).alias(f"does_{o.replace('-', '_')}") for o in OPERATIONS])
    ops = F.filter(F.array(*[F.when(F.bool_or(does(o)), F.lit(o)) for o in OPERATIONS]), lambda o: o.isNotNull())
    counts = [F.count_if(does(o) & F.col("site").isNotNull()).alias(f"n_{o}") for o in ("create", "read", "update", "delete", "unknown")]
    return sites.groupBy("endpoint_id", "entity").agg(F.array_join(ops, ",").alias("operations"), F.count("site").alias("n_sites"), *counts)


def usage(access: DataFrame) -> DataFrame:
    """Per entity every operation, zeros included, with endpoints and sites; an unnamed entity is undetermined."""
    dim = access.sparkSession.createDataFrame([(o, i) for i, o in enumerate(OPERATIONS)], "operation string, ord int")
    named = access.withColumn("entity", F.coalesce("entity", F.lit("(undetermined)")))
    counts = named.groupBy("entity", "operation").agg(F.count_distinct("endpoint_id").alias("n_endpoints"), F.count_distinct("site").alias("n_sites"))
    every = named.select("entity").distinct().withColumn("operation", F.explode(F.array(*[F.lit(o) for o in OPERATIONS])))
    return every.join(F.broadcast(dim), "operation").join(counts, ["entity", "operation"], "left").select("entity", "operation", "ord", F.coalesce("n_endpoints", F.lit(0)).alias("n_endpoints"), F.coalesce("n_sites", F.lit(0)).alias("n_sites"))


def matrix(access: DataFrame) -> DataFrame:
    """Entity by operation, distinct endpoints in each cell."""
    does = lambda o: f"does_{o.replace('-', '_')}"
    # a row for each endpoint first, as in summaries
    rows = access.where("entity IS NOT NULL").groupBy("entity", "endpoint_id").agg(*[F.bool_or(F.col("operation") == o).alias(does(o)) for o in OPERATIONS])
    return rows.groupBy("entity").agg(*[F.count_if(F.col(does(o)) & F.col("endpoint_id").isNotNull()).alias(o.replace("-", "_")) for o in OPERATIONS])


def service_counts(access: DataFrame, services: DataFrame) -> DataFrame:
    """Sites per service over services that report; a service without production methods is unknown, not zero."""
    n = access.groupBy("service_id").agg(F.count_distinct("site").alias("n"))
    return services.join(n, "service_id", "left").select("service_id", F.when(F.col("production_methods").isNotNull(), F.coalesce("n", F.lit(0))).alias("n_sites"))


def accounting(access: DataFrame) -> DataFrame:
    """Two partitions of the same accesses, by entity known or not and by operation known or not."""
    c = lambda cond, name: F.count_if(cond).alias(name)
    e, o = F.col("entity").isNotNull(), F.col("operation") != "unknown"
    return access.groupBy("service_id").agg(F.count("*").alias("n"), c(e, "n_bound"), c(~e, "n_undetermined"), c(o, "n_operation"), c(~o, "n_unknown"), c(e & o, "n_full"))
