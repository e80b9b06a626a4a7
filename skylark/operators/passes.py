"""Passes over the node and edge tables of a code graph: what every path, caller, return or declaration agrees on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylark.operators.graph import closure
from skylark.sources.shared import written


def agreed(rows: DataFrame, by: list[str], declared: str, found: str) -> DataFrame:
    """The declared type of each group, else the one that all its rows agree on, else NULL; a row without one agrees with none."""
    one = (F.count(found) == F.count("*")) & (F.min(found) == F.max(found))
    return rows.groupBy(*by).agg(F.coalesce(F.max(declared), F.when(one, F.min(found))).alias("type"))


def constant_gets(puts: DataFrame, gets: DataFrame) -> DataFrame:
    """(get_id, value) of reads (get_id, map, key) of constant maps (map, key, value, literal).

    One put that is no literal poisons its whole map; of several puts of a key every value is a candidate.
    """
    clean = puts.groupBy("map").agg(F.bool_and("literal").alias("clean")).where("clean").select("map")
    values = puts.join(clean, "map", "left_semi").select("map", "key", "value").distinct()
    return gets.join(values, ["map", "key"], "left").select("get_id", "value")


def origin_class(atoms: Column, exhausted: Column) -> Column:
    """One class for a value's origins: cut short or none is other, several are mixed."""
    one = F.array_distinct(atoms)
    return F.when(exhausted | (F.size(one) == 0), "other").when(F.size(one) > 1, "mixed").otherwise(F.get(one, F.lit(0)))


def ancestors(extends: DataFrame) -> DataFrame:
    """(type, ancestor, distance) at the least distance, the type itself at 0; cycles end."""
    types = extends.select(F.col("child").alias("root")).union(extends.select("parent")).distinct()
    return closure(extends.select(F.col("child").alias("src"), F.col("parent").alias("dst")), types).select(F.col("root").alias("type"), F.col("node").alias("ancestor"), F.col("level").alias("distance"))


def nearest_declarations(extends: DataFrame, declares: DataFrame) -> DataFrame:
    """(type, method, declarer, distance): who declares a method nearest above each type; equal distances all count."""
    met = ancestors(extends).join(declares.select(F.col("type").alias("ancestor"), "method"), "ancestor")
    least = F.min("distance").over(Window.partitionBy("type", "method"))
    return met.withColumn("_least", least).where("distance = _least").select("type", "method", F.col("ancestor").alias("declarer"), "distance")


def enclosing_statements(nodes: DataFrame) -> DataFrame:
    """(node, statement): of nodes (node, parent, is_statement) the nearest statement at or above each, NULL for none."""
    up = nodes.where("NOT is_statement").select(F.col("node").alias("at"), "parent")
    ends = nodes.where("is_statement").select(F.col("node").alias("at"))
    live, found = nodes.select("node", F.col("node").alias("at")), None
    while True:
        live = written(live, "above")
        if live.isEmpty():
            return nodes.select("node").join(found, "node", "left")
        hit = live.join(ends, "at", "left_semi").select("node", F.col("at").alias("statement"))
        found = hit if found is None else found.unionByName(hit)
        live = live.join(up, "at").where("parent IS NOT NULL AND parent <> at").select("node", F.col("parent").alias("at"))


def reaching(uses: DataFrame, defs: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """(endpoint_id, node_id, def_node, exhausted): the definitions that reach each use against the flow.

    A walk ends at a definition and where it has been; walks that are still on after ``budget`` steps
    are told by a row of their own with no definition.
    """
    keys = ["endpoint_id", "node_id"]
    back = edges.select("endpoint_id", F.col("target").alias("at"), F.col("source").alias("up"))
    stop = defs.select("endpoint_id", F.col("node_id").alias("at"), F.lit(True).alias("hit"))
    live = seen = written(uses.select(*keys, F.col("node_id").alias("at")), "reach")
    found = live.limit(0).select(*keys, F.col("at").alias("def_node"), F.lit(False).alias("exhausted"))
    for _ in range(budget):
        step = live.join(back, ["endpoint_id", "at"]).select(*keys, F.col("up").alias("at")).distinct().join(seen, [*keys, "at"], "left_anti")
        step = written(step.join(stop, ["endpoint_id", "at"], "left"), "reach")
        hit = step.where("hit").select(*keys, F.col("at").alias("def_node"), F.lit(False).alias("exhausted"))
        found = found.unionByName(hit)
        live = step.where("hit IS NULL").select(*keys, "at")
        seen = seen.unionByName(step.select(*keys, "at"))
        if live.isEmpty():
            return found
    on = live.join(back, ["endpoint_id", "at"]).select(*keys, F.col("up").alias("at")).distinct().join(seen, [*keys, "at"], "left_anti")
    return found.unionByName(on.select(*keys).distinct().select(*keys, F.lit(None).cast("int").alias("def_node"), F.lit(True).alias("exhausted")))


def primary_calls(calls: DataFrame) -> DataFrame:
    """(statement, call_id): of calls (statement, call_id, ord, is_sink, is_internal) the sink, else one of the project's own, else the first."""
    rank = F.struct(F.when(F.col("is_sink"), 0).when(F.col("is_internal"), 1).otherwise(2), "ord", "call_id")
    return calls.groupBy("statement").agg(F.min_by("call_id", rank).alias("call_id"))


def unreachable(sinks: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The sinks (node) that no root reaches."""
    reached = closure(edges, roots).select("node").distinct()
    return sinks.join(reached, "node", "left_anti")


def concatenated(operands: DataFrame, most: int = 1000) -> DataFrame:
    """(expr, candidate): of operands (expr, ord, value) every text that one value of each gives, in order.

    Candidates multiply by nature; an expression that would have more than ``most`` fails, as ``slicing`` has the
    evaluation that keeps some and tells what it cut.
    """
    per = operands.groupBy("expr", "ord").agg(F.array_sort(F.collect_set("value")).alias("vs"))
    number = F.aggregate(F.collect_list(F.size("vs")), F.lit(1).cast("double"), lambda a, n: a * n)
    per = per.join(per.groupBy("expr").agg(number.alias("_n")), "expr").withColumn("vs", F.when(F.col("_n") > most, F.raise_error(F.lit("too many candidates")).cast("array<string>")).otherwise(F.col("vs")))
    listed = per.groupBy("expr").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "vs"))), lambda x: x["vs"]).alias("parts"))
    cross = lambda acc, vs: F.flatten(F.transform(acc, lambda a: F.transform(vs, lambda b: F.concat(a, b))))
    return listed.select("expr", F.explode(F.aggregate("parts", F.array(F.lit("")), cross)).alias("candidate")).distinct()
