"""Mixing sources to target weights: hierarchical token budgets, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylark.llm.common import materialise

_BIG = "decimal(38,0)"
#: First hexadecimal digits of a document's place in its epoch, by which sums are taken before rows are ordered.
BUCKET_DIGITS = 3


def token_count(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def waterfill(nodes: DataFrame, parent: list[str], node: str) -> DataFrame:
    """nodes: parent columns, node, weight, cap, budget (of the parent) -> the same with ``share``.

    A parent's budget goes to its children by weight; a child takes its cap at most and what it
    lacks is shared among its siblings by weight. Children are ordered by cap / weight, so those
    that fill up are a prefix and one running sum finds it; a child with weight 0 gets nothing.
    """
    w = Window.partitionBy(*parent)
    order = [(F.col("cap").cast("double") / F.col("weight")).asc_nulls_last(), F.col(node).asc_nulls_first()]
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = w.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = lambda c: F.col(c).cast(_BIG)
    df = nodes.where("weight > 0").withColumn("_filled", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(_BIG)).withColumn("_weights", F.sum("weight").over(onward).cast(_BIG))
    room = big("budget") - big("_filled")
    df = df.withColumn("_full", (room > 0) & (big("cap") * big("_weights") <= big("weight") * room))
    left = big("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(w), F.lit(0)).cast(_BIG)
    weights = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(w)
    df = df.withColumn("_left", left.cast(_BIG)).withColumn("_open", weights.cast(_BIG))
    part = F.expr("cast((cast(weight as decimal(38,0)) * _left) div _open as bigint)")
    return df.withColumn("share", F.when(F.col("_full"), F.col("cap")).otherwise(F.greatest(F.lit(0), F.least(F.col("cap"), part)))).drop("_filled", "_weights", "_full", "_left", "_open")


def budgets(supply: DataFrame, weights: dict[str, dict[str, int]], levels: list[str], budget: int | None, permille: int, max_epochs: int) -> DataFrame:
    """Leaf budgets: the level columns, tokens (one epoch's), and share.

    supply: the level columns and tokens. weights: level -> value -> integer weight; other values
    weigh 1. Each level's nodes split their parent's budget, so a shortage stays with the siblings as
    long as they can make it up, and only what a whole subtree lacks is left to the level above it.
    """
    total = supply.agg(F.sum("tokens").alias("all"))
    top = F.floor(F.coalesce(F.col("all"), F.lit(0)) * permille / 1000).cast("long") if budget is None else F.lit(budget).cast("long")
    done = total.select(top.alias("share"))
    for i, level in enumerate(levels):
        parent = levels[:i]
        own = weights.get(level, {})
        weight = F.lit(1)
        for value, x in own.items():
            weight = F.when(F.col(level) == value, x).otherwise(weight)
        nodes = supply.groupBy(*levels[: i + 1]).agg((F.sum("tokens") * max_epochs).alias("cap")).withColumn("weight", weight.cast("long"))
        above = done.select(*[F.col(c).alias(f"_{c}") for c in parent], F.col("share").alias("budget"))
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parent]
        nodes = (nodes.join(above, on) if on else nodes.join(F.broadcast(above), F.lit(True))).drop(*[f"_{c}" for c in parent])
        done = waterfill(nodes, parent or [F.lit(1)], level).select(*levels[: i + 1], "share")
    return done


def mix(docs: DataFrame, *, levels: dict[str, Column], weights: dict[str, dict[str, int]], budget: int | None = None, permille: int = 500, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, the level columns, epoch, tokens, taken: which tokens of which documents the mixture takes.

    ``levels`` name a tree from its root down. The budget, or ``permille`` thousandths of all tokens,
    is split by weight; a leaf gives its tokens ``max_epochs`` times at most. A leaf's share is whole
    epochs of all its documents, then a prefix of one more, in which documents come in the order of
    md5(seed:epoch:doc_id); the last document gives the tokens that are still missing.

    Rows with a null id, and texts without words, have nothing to give and take no part. A null
    level value is a node of its own. Repeated rows count as often as they appear; ties of the order
    go by tokens. With ``row_col``, a unique number of each row, the result has it as ``row``; rows
    with a null id take part then, placed by it. An empty table gives no rows; columns with clashing names are ignored.
    """
    names = list(levels)
    key = [] if row_col is None else ["row"]
    row = [F.col(row_col).alias("row")] if key else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row, *[c.cast("string").alias(n) for n, c in levels.items()], token_count(F.col(text_col)).alias("tokens"))
    rows = materialise(rows.where("tokens > 0" if key else "doc_id IS NOT NULL AND tokens > 0"), "mix-tokens")
    supply = materialise(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "mix-supply")
    leaf = budgets(supply, weights, names, budget, permille, max_epochs)
    leaf = leaf.select(*[F.col(n).alias(f"_{n}") for n in names], "share")
    leaf = supply.withColumnRenamed("tokens", "supply").join(leaf, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]).drop(*[f"_{n}" for n in names])
    leaf = leaf.withColumn("whole", F.expr("share div supply")).withColumn("rest", F.col("share") % F.col("supply")).withColumn("leaf", F.md5(F.to_json(F.struct(*names))))
    leaf = materialise(leaf, "mix-leaves")
    tagged = rows.withColumn("leaf", F.md5(F.to_json(F.struct(*names)))).join(leaf.select("leaf", "whole", "rest"), "leaf")
    every = tagged.where("whole > 0").select("doc_id", *key, *names, F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("epoch"), "tokens", F.col("tokens").alias("taken"))
    # the last epoch: sums by bucket first, and only the bucket in which the share ends is ordered row by row
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row"), F.col("row").cast("string"))) if key else F.col("doc_id").cast("string")
    place = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("whole").cast("string"), own))
    last = tagged.where("rest > 0").withColumn("place", place).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    by_bucket = last.groupBy("leaf", "bucket").agg(F.sum("tokens").alias("held"))
    before = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
    placed = last.join(starts, ["leaf", "bucket"]).where("start < rest")
    in_full = placed.where("start + held <= rest").select("doc_id", *key, *names, F.col("whole").cast("int").alias("epoch"), "tokens", F.col("tokens").alias("taken"))
    inner = Window.partitionBy("leaf", "bucket").orderBy("place", "doc_id", "tokens", *key).rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("start + held > rest").withColumn("sofar", F.col("start") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).where("sofar < rest")
    partial = edge.select("doc_id", *key, *names, F.col("whole").cast("int").alias("epoch"), "tokens", F.least("tokens", F.col("rest") - F.col("sofar")).alias("taken"))
    return every.unionByName(in_full).unionByName(partial)
