"""From rules as they are written to evidence about endpoints: settings expanded, placeholders filled in, chains walked.

rules: service_id, rule_id, chain_id, chain_scope (patterns of the chain, NULL for all routes), ord, origin (code, config for a loop over
settings below a prefix, unread), pattern (the prefix where the origin is config), http_method (NULL for any), access.
settings: service_id, key, ord, pattern, access: entries of lists in settings. env: service_id, key, value. endpoints: endpoint_id, service_id,
uri, http_method.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylark.functions import text as X
from skylark.operators.claims import governs, in_chain
from skylark.operators.stitch import env_maps

_RULE = ["service_id", "rule_id", "chain_id", "chain_scope", "http_method"]


def expanded(rules: DataFrame, settings: DataFrame) -> DataFrame:
    """rules with those that loop over settings replaced by one row for each entry, in the entries' order, with ``declared_in``.

    Several sites that loop over one prefix in a chain are branches of one loop, so only the first is expanded. One whose
    prefix has no entries stays, unread.
    """
    first = F.row_number().over(Window.partitionBy("service_id", "chain_id", "pattern").orderBy("ord", "rule_id"))
    loops = rules.where("origin = 'config'").withColumn("_first", first).where("_first = 1").drop("_first")
    entries = settings.select("service_id", F.col("key").alias("pattern"), F.col("ord").alias("_eo"), F.col("pattern").alias("_pattern"), F.col("access").alias("_access"))
    met = loops.join(entries, ["service_id", "pattern"], "left")
    none = F.col("_eo").isNull()
    told = met.select(*_RULE, F.struct("ord", F.coalesce("_eo", F.lit(0)).alias("entry")).alias("ord"), F.when(~none, F.col("_pattern")).alias("pattern"), F.when(~none, F.col("_access")).otherwise(F.col("access")).alias("access"), F.when(~none, F.col("pattern")).alias("declared_in"))
    own = rules.where("origin <> 'config'").select(*_RULE, F.struct("ord", F.lit(0).alias("entry")).alias("ord"), F.when(F.col("origin") == "code", F.col("pattern")).alias("pattern"), "access", F.lit(None).cast("string").alias("declared_in"))
    return own.unionByName(told)


def filled_in(rules: DataFrame, env: DataFrame) -> DataFrame:
    """Expanded rules with the placeholders of patterns and access replaced by settings; what is left over makes its half unread."""
    maps = env_maps(env)
    full = rules.join(maps, "service_id", "left").withColumn("env", F.coalesce("env", F.create_map().cast("map<string,string>")))
    value = lambda c: F.when(F.contains(c, F.lit("${")), X.resolve_or_null(F.col(c), F.col("env"))).otherwise(F.col(c))
    return full.withColumn("pattern", value("pattern")).withColumn("access", value("access")).drop("env")


def evidence(endpoints: DataFrame, rules: DataFrame, settings: DataFrame, env: DataFrame) -> DataFrame:
    """(endpoint_id, rule_id, kind, effect, resolution, roles, authorities, covers_route, active, pattern, declared_in): what rules say of endpoints.

    In every chain that covers an endpoint rules are walked in order up to the first that is read whole and fits exactly; those
    before it that are not read, or fit some requests only, stay beside it. A rule whose pattern is not read may govern anything.
    Where several chains cover an endpoint nothing tells which runs, so all they say is opaque.
    """
    own = filled_in(expanded(rules, settings), env)
    effect = X.access_effect(F.col("access"))
    read = F.col("pattern").isNotNull() & F.col("access").isNotNull() & F.coalesce(effect != "opaque", F.lit(False))
    own = own.withColumn("_effect", effect).withColumn("_read", read)
    e = endpoints.select("endpoint_id", "service_id", "uri", F.col("http_method").alias("_method"))
    chains = own.select("service_id", "chain_id", "chain_scope").distinct().join(e, "service_id").where(F.col("chain_scope").isNull() | in_chain(F.col("chain_scope"), F.col("uri")))
    chains = chains.withColumn("_chains", F.count("*").over(Window.partitionBy("endpoint_id")))
    met = chains.drop("chain_scope").join(own.drop("chain_scope"), ["service_id", "chain_id"]).where(F.col("http_method").isNull() | (F.upper("http_method") == F.upper("_method")))
    fit = F.when(F.col("pattern").isNull(), "unknown").otherwise(governs(F.col("pattern"), F.col("uri")))
    met = met.withColumn("_fit", fit).where("_fit IS NOT NULL")
    stop = F.min(F.when(F.col("_read") & (F.col("_fit") == "exact"), F.col("ord"))).over(Window.partitionBy("endpoint_id", "chain_id"))
    kept = met.withColumn("_stop", stop).where("_stop IS NULL OR ord <= _stop")
    return kept.select(
        "endpoint_id", "rule_id", F.lit("filter-chain").alias("kind"), F.coalesce(F.when(F.col("_effect") == "opaque", "authenticated").otherwise(F.col("_effect")), F.lit("authenticated")).alias("effect"),
        F.when(F.col("_read") & (F.col("_chains") == 1), "exact").otherwise("opaque").alias("resolution"), X.grants(F.col("access"), "roles").alias("roles"), X.grants(F.col("access"), "authorities").alias("authorities"),
        (F.col("_fit") != "speculative").alias("covers_route"), F.lit(True).alias("active"), "pattern", "declared_in",
    )


def bypasses(endpoints: DataFrame, ignored: DataFrame) -> DataFrame:
    """Evidence of patterns (service_id, rule_id, pattern) that take requests around all chains; only an exact fit counts."""
    met = endpoints.join(ignored, "service_id").where(F.coalesce(governs(F.col("pattern"), F.col("uri")) == "exact", F.lit(False)))
    none = F.array().cast("array<string>")
    return met.select("endpoint_id", "rule_id", F.lit("chain-bypass").alias("kind"), F.lit("permit").alias("effect"), F.lit("exact").alias("resolution"), none.alias("roles"), none.alias("authorities"), F.lit(True).alias("covers_route"), F.lit(True).alias("active"), "pattern", F.lit(None).cast("string").alias("declared_in"))
