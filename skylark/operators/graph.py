"""Traversals of call and flow graphs: semi-naive loops over DataFrames, cut by checkpoints."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylark.sources.shared import written


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, level): all that each root reaches, at its least level.

    A round joins the newest level with the edges and keeps what is new, all roots at once; the
    loop ends when a level is empty.
    """
    e = written(edges.select("src", "dst").distinct(), "edges")
    seen = written(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("level")).distinct(), "closure")
    frontier = seen
    for level in count(1):
        step = frontier.join(e, frontier.node == e.src).select("root", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, ["root", "node"], "left_anti").withColumn("level", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def witness_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, level, path): one shortest path each, the smallest predecessor at every step."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    frontier = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("level"), F.col("root").cast("string").alias("path")).distinct(), "paths")
    seen = frontier
    for level in count(1):
        step = frontier.join(e, frontier.node == e.src).groupBy("root", F.col("dst").alias("node")).agg(F.min_by("path", "src").alias("path"))
        step = step.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(level).alias("level"), F.concat_ws(">", "path", F.col("node").cast("string")).alias("path"))
        frontier = written(step, "paths")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def call_tree(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, path, node, depth, cycle): the tree of calls; a node that is on its own path is a cycle leaf.

    Every path is followed to its end or cycle, or to max_depth where one is given.
    """
    e = written(edges.select("src", "dst").distinct(), "edges")
    level = roots.select("root", F.array("root").alias("trail"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("cycle")).distinct()
    out = level = written(level, "tree")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        open_ = level.where("NOT cycle")
        step = open_.join(e, open_.node == e.src).select("root", F.concat("trail", F.array("dst")).alias("trail"), F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.array_contains("trail", F.col("dst")).alias("cycle"))
        level = written(step, "tree")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("root", F.array_join("trail", ">").alias("path"), "node", "depth", "cycle")


def leaves(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """What is reached and has nothing below it.

    An anti join would be pushed into each level of ``reached``, and a task would hold the sorts of all levels at once.
    """
    goes_on = edges.select(F.col("src").alias("node")).distinct().withColumn("goes_on", F.lit(True))
    return reached.join(goes_on, "node", "left").where("goes_on IS NULL").drop("goes_on")


def invariants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, endpoint_id, node_id) of flow graphs that break a rule of structure."""
    keys = ["endpoint_id", "node_id"]
    out = edges.groupBy("endpoint_id", F.col("source").alias("node_id")).agg(F.count("*").alias("n_out"), F.count_if(F.col("kind") == "true").alias("n_true"), F.count_if(F.col("kind") == "false").alias("n_false"))
    into = edges.groupBy("endpoint_id", F.col("target").alias("node_id")).agg(F.count("*").alias("n_in"))
    all_ = nodes.join(out, keys, "left").join(into, keys, "left").fillna(0, ["n_out", "n_true", "n_false", "n_in"])
    codes = F.filter(
        F.array(
            F.when((F.col("n_in") == 0) & (F.col("n_out") == 0), "disconnected"),
            F.when((F.col("kind") == "branch") & (F.col("n_true") == 0), "branch-without-true"),
            F.when((F.col("kind") == "branch") & (F.col("n_true") > 0) & (F.col("n_false") == 0), "branch-without-false"),
            F.when((F.col("kind") != "branch") & (F.col("n_out") > 1), "fork-without-branch"),
        ),
        lambda c: c.isNotNull(),
    )
    return all_.select(F.explode(codes).alias("code"), *keys)


def entry_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each endpoint the lowest (line, id) among nodes without a way in, else among all."""
    has_in = edges.select("endpoint_id", F.col("target").alias("node_id")).distinct().withColumn("has_in", F.lit(1))
    w = Window.partitionBy("endpoint_id").orderBy(F.coalesce("has_in", F.lit(0)), "line", "node_id")
    return nodes.join(has_in, ["endpoint_id", "node_id"], "left").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("endpoint_id", "node_id", "line")


def merged_intervals(spans: DataFrame, by: list[str]) -> DataFrame:
    """Intervals (lo, hi) of each group that overlap or touch, merged."""
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1))
    return marked.withColumn("island", F.sum("new").over(order)).groupBy(*by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def condensed_runs(nodes: DataFrame) -> DataFrame:
    """Maximal runs, of two or more, of plain statements in node order."""
    w = Window.partitionBy("endpoint_id").orderBy("node_id")
    marked = nodes.withColumn("plain", F.col("kind") == "statement").withColumn("step", F.when(F.col("plain") & (F.lag("plain").over(w)) & (F.lag("node_id").over(w) == F.col("node_id") - 1), 0).otherwise(1))
    return marked.withColumn("run", F.sum("step").over(w)).where("plain").groupBy("endpoint_id", "run").agg(F.count("*").alias("n"), F.min("node_id").alias("first"), F.max("node_id").alias("last")).where("n >= 2").drop("run")


def rollup_by_method(nodes: DataFrame) -> DataFrame:
    """Node counts per method and kind, and the first node."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return nodes.groupBy("endpoint_id", "method_id").agg(F.count("*").alias("n_nodes"), kind("branch").alias("n_branch"), kind("call").alias("n_call"), kind("statement").alias("n_statement"), F.min("node_id").alias("first_node"))


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(root, path, size): how many nodes of the tree lie at or below each path."""
    parts = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ">"))
    return tree.select("root", F.explode(above).alias("path")).groupBy("root", "path").agg(F.count("*").alias("size"))


def first_paths(tree: DataFrame) -> DataFrame:
    """(root, node, path): of all paths to a node the first in the tree's order: the shortest, then the smallest."""
    trail = F.transform(F.split("path", ">"), lambda x: x.cast("long"))
    return tree.groupBy("root", "node").agg(F.min_by("path", F.struct("depth", trail)).alias("path"))


def leaving_arms(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Decision edges whose target has no way out, which so leave the method."""
    out = edges.select("endpoint_id", F.col("source").alias("target")).distinct().withColumn("goes_on", F.lit(True))
    known = nodes.select("endpoint_id", F.col("node_id").alias("target"))
    arms = edges.where("kind IN ('true', 'false')").join(known, ["endpoint_id", "target"])
    return arms.join(out, ["endpoint_id", "target"], "left").where("goes_on IS NULL").select("endpoint_id", "source", "target", "kind")


def governing_conditions(nodes: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """(endpoint_id, node_id, decision, kind, distance): the nearest decision edges backwards from every node, at most so many.

    A round walks one edge back from all nodes at once; a walk ends at a decision edge, which it
    reports, and where it has been before. Nearer decisions come first, of equal ones the smaller.
    """
    back = edges.select("endpoint_id", F.col("target").alias("at"), F.col("source").alias("up"), "kind")
    front = written(nodes.select("endpoint_id", "node_id", F.col("node_id").alias("at")), "walks")
    seen, found = front, None
    for distance in count(1):
        step = written(front.join(back, ["endpoint_id", "at"]), "walks")
        hit = step.where("kind IN ('true', 'false')").select("endpoint_id", "node_id", F.col("up").alias("decision"), "kind", F.lit(distance).alias("distance")).distinct()
        found = hit if found is None else found.unionByName(hit)
        on = step.where("kind NOT IN ('true', 'false')").select("endpoint_id", "node_id", F.col("up").alias("at")).distinct()
        front = written(on.join(seen, ["endpoint_id", "node_id", "at"], "left_anti"), "walks")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    w = Window.partitionBy("endpoint_id", "node_id").orderBy("distance", "decision", "kind")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")
