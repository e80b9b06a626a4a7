"""Connected components of links by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node that it reaches.

    In each round every node hooks on to its smallest neighbour, hooks are followed for some steps,
    and links become links between roots, until none is left. Nothing is gathered by node, so a node
    may have any number of links. A link from a node to itself, or with a null end, is ignored.
    """
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    for _ in range(rounds):
        if edges.isEmpty():
            return maps
        hook = edges.select(F.col("b").alias("x"), F.col("a").alias("p")).groupBy("x").agg(F.min("p").alias("p"))
        hook = materialise(hook, "hooks")
        for _ in range(3):  # follow the hooks, as x -> p -> p's hook
            up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p"))
        hook = materialise(hook, "hooks")
        maps = materialise(maps.join(hook.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        a, b = hook.select(F.col("x").alias("a"), F.col("p").alias("pa")), hook.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        edges = materialise(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    raise RuntimeError(f"links are not contracted after {rounds} rounds")
