"""How much of a system an analysis could determine; unknown is never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylark.functions.text import percent


def method_coverage(services: DataFrame) -> DataFrame:
    """A10: reached methods per service and for all known services (service_id NULL), percent NULL of nothing."""
    known = services.where("kind = 'service'")
    rows = known.groupBy("service_id").agg(F.sum("reachable_methods").alias("reached"), F.sum("production_methods").alias("methods"))
    total = known.where("production_methods IS NOT NULL").agg(F.sum("reachable_methods").alias("reached"), F.sum("production_methods").alias("methods")).select(F.lit(None).cast("long").alias("service_id"), "reached", "methods")
    return rows.select("service_id", "reached", "methods").unionByName(total).withColumn("percent", percent(F.col("reached"), F.col("methods")))


def auth_states(auth: DataFrame) -> DataFrame:
    """Endpoints per service in five states that sum to the row count."""
    state = auth_state()
    c = lambda s: F.count_if(state == s).alias(f"n_{s}")
    return auth.groupBy("service_id").agg(F.count("*").alias("n"), *[c(s) for s in ("denied", "protected", "open", "withheld", "unknown")])


def auth_state():
    """one state of an endpoint from its tri-state claim."""
    return (
        F.when(F.col("denied"), "denied").when(F.col("authenticated").isNull() & F.col("unread"), "withheld").when(F.col("authenticated").isNull(), "unknown")
        .when(F.col("authenticated"), "protected").otherwise("open")
    )


def unread_by_kind(auth: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Unread evidence per kind over the whole vocabulary, and whether a kind is never exercised."""
    dim = auth.sparkSession.createDataFrame([(k,) for k in kinds], "evidence string")
    n = auth.groupBy("evidence").agg(F.count("*").alias("n"), F.count_if("unread").alias("n_unread"))
    return F.broadcast(dim).join(n, "evidence", "left").select("evidence", F.coalesce("n_unread", F.lit(0)).alias("n_unread"), (F.coalesce("n", F.lit(0)) == 0).alias("unexercised"))


def role_legend(auth: DataFrame) -> DataFrame:
    """Endpoints per role, the most common first."""
    return auth.where("role IS NOT NULL").groupBy("role").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "role")))


def collisions(endpoints: DataFrame) -> DataFrame:
    """Endpoints of a service under one method and uri: the lowest handler stays, the others are recorded."""
    w = Window.partitionBy("service_id", "http_method", "uri").orderBy("handler", "endpoint_id")
    ranked = endpoints.withColumn("rn", F.row_number().over(w))
    keys = ["service_id", "http_method", "uri"]
    return ranked.groupBy(*keys).agg(F.min_by("endpoint_id", "rn").alias("kept"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.col("endpoint_id")))), ",").alias("dropped"), F.count("*").alias("n")).where("n > 1")


def anomaly_samples(facts: DataFrame, code: str, site: str, most: int = 5) -> DataFrame:
    """Facts per code with the first few sites."""
    w = Window.partitionBy(code).orderBy(site)
    counted = facts.groupBy(code).agg(F.count("*").alias("n"))
    first = facts.select(code, site).distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return counted.join(first.groupBy(code).agg(F.array_join(F.array_sort(F.collect_list(site)), ",").alias("samples")), code)


def folded(facts: DataFrame, keys: list[str], count: str, sample: str, order: str) -> DataFrame:
    """Facts with equal keys (NULL equals NULL) as one row: counts summed, the first sample kept."""
    return facts.groupBy(*keys).agg(F.sum(count).alias("n"), F.min_by(sample, order).alias("sample"))
