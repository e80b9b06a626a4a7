"""Values of URL expressions: each sink's expression unrolled within a budget, then candidates combined from the leaves up.

exprs: expr, method, kind, text, callee, place. Kinds: literal (text), config (text is the key), concat, ternary, format
(first child the template), builder (base and steps), local (text is the name), member (text is the name, method its owner's id),
parameter (place is its index), call (callee a method), anything else is a hole.
children: expr, ord, child, role (of builders: base, path, segment, neutral or other). assignments: method, name, ord, expr.
returns: method, ord, expr.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylark.sources.shared import written

DEPTH, HOPS, MOST, VISITED = 8, 2, 8, 512
HOLE = "{?}"
#: A candidate: its text, whether it has a literal or a key in it, its holes, and by what ways it came about.
_CANDIDATE = "struct<text:string,lit:boolean,key:boolean,holes:int,field:boolean,hop:boolean,multi:boolean,cut:boolean>"
_FLAGS = ("field", "hop", "multi", "cut")
_FRAME = "struct<args:map<int,bigint>,depth:int,hops:int,seen:array<bigint>>"
_PARTS = r"%[^A-Za-z%]*[A-Za-z]"


def _candidate(text: Column, *, lit=False, key=False, holes=0, cut=False) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(text.alias("text"), as_column(lit).alias("lit"), as_column(key).alias("key"), as_column(holes).alias("holes"), *[as_column(x).alias(n) for n, x in zip(_FLAGS, (False, False, False, cut), strict=True)])


def _hole(cut: bool = False) -> Column:
    return _candidate(F.lit(HOLE), holes=1, cut=cut)


def _joined(a: Column, b: Column) -> Column:
    return F.struct(
        F.concat(a["text"], b["text"]).alias("text"), (a["lit"] | b["lit"]).alias("lit"), (a["key"] | b["key"]).alias("key"), (a["holes"] + b["holes"]).alias("holes"), *[(a[f] | b[f]).alias(f) for f in _FLAGS],
    )


def _flagged(c: Column, **flags: Column) -> Column:
    return F.struct(*[(c[n] | flags[n] if n in flags else c[n]).alias(n) for n in ("text", "lit", "key", "holes", *_FLAGS)])


def _capped(candidates: Column, most: int) -> Column:
    """At most so many candidates; where there were more, those that stay say so."""
    return F.when(F.size(candidates) <= most, candidates).otherwise(F.transform(F.slice(candidates, 1, most), lambda c: _flagged(c, cut=F.lit(True))))


def _product(a: Column, b: Column, most: int) -> Column:
    """Every text of one followed by every text of the other, the first's order first."""
    return _capped(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: _joined(x, y)))), most)


def unrolled(sinks: DataFrame, exprs: DataFrame, children: DataFrame, assignments: DataFrame, returns: DataFrame, depth: int, hops: int, visited: int) -> DataFrame:
    """(root, path, up, ord, role, kind, text, n): each sink's expression as a tree of what it may come from.

    A name leads to all its assignments, a call to all that its callee returns, with the call's arguments for its
    parameters; at most ``hops`` calls deep and never into a method that the walk is in. What is deeper than ``depth``, or beyond
    ``visited`` expressions of one sink, is cut: a leaf of kind cut, told by its candidates.
    """
    e = exprs.select("expr", "method", "kind", "text", "callee", "place")
    few = lambda df, by: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("expr" if "child" not in df.columns else "child").alias("to"), (F.col("role") if "role" in df.columns else F.lit(None).cast("string")).alias("role")))).alias("next"))
    below = few(children, ["expr"]).withColumnRenamed("next", "below")
    given = few(assignments.select("method", F.col("name").alias("text"), "ord", "expr"), ["method", "text"]).withColumnRenamed("next", "given")
    back = few(returns.select(F.col("method").alias("callee"), "ord", "expr"), ["callee"]).withColumnRenamed("next", "back")
    full = written(e.join(below, "expr", "left").join(given, ["method", "text"], "left").join(back, "callee", "left"), "exprs")
    front = sinks.select(F.col("expr").alias("root"), F.array().cast("array<int>").alias("path"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("role"), "expr", F.lit(depth).alias("depth"), F.lit(hops).alias("hops"), F.array().cast("array<bigint>").alias("seen"), F.array().cast(f"array<{_FRAME}>").alias("frames"), F.lit(False).alias("in_concat"))
    out = None
    while True:
        front = written(front, "front")
        if front.isEmpty():
            break
        # what is visited within the budget is among the first of its level too
        place = F.row_number().over(Window.partitionBy("root").orderBy("path"))
        here = front.join(full, "expr", "left").withColumn("_spent", place)
        frame = F.element_at("frames", -1)
        argument = F.try_element_at(frame["args"], F.col("place"))
        opens = (F.col("kind") == "call") & (F.col("hops") > 0) & F.col("back").isNotNull() & ~F.array_contains("seen", F.col("callee"))
        bound = (F.col("kind") == "parameter") & (F.size("frames") > 0) & F.coalesce(argument.isNotNull(), F.lit(False))
        cut = (F.col("depth") <= 0) | (F.col("_spent") > visited)
        kind = F.when(cut, "cut").when(F.col("kind").isin("concat", "ternary", "format", "builder") & F.col("below").isNull(), "hole").when(F.col("kind").isin("local", "member") & F.col("given").isNull(), "hole")
        kind = kind.when((F.col("kind") == "call") & ~F.coalesce(opens, F.lit(False)), "hole").when((F.col("kind") == "parameter") & ~F.when(F.size("frames") > 0, bound).otherwise(F.lit(False)), "hole").otherwise(F.coalesce("kind", F.lit("hole")))
        here = here.withColumn("kind", kind)
        nothing = F.array().cast("array<struct<ord:int,to:bigint,role:string>>")
        nxt = F.when(F.col("kind").isin("concat", "ternary", "format", "builder"), F.col("below")).when(F.col("kind").isin("local", "member"), F.col("given")).when(F.col("kind") == "call", F.col("back"))
        nxt = nxt.when(F.col("kind") == "parameter", F.array(F.struct(F.lit(0).alias("ord"), F.when(F.size("frames") > 0, argument).alias("to"), F.lit(None).cast("string").alias("role")))).otherwise(nothing)
        here = written(here.withColumn("next", nxt.cast("array<struct<ord:int,to:bigint,role:string>>")).withColumn("n", F.size("next")), "unrolled")
        told = here.select("root", "path", "ord", "role", "kind", "text", "n")
        out = told if out is None else out.unionByName(told)
        step = here.select("*", F.explode("next").alias("_n"))
        call, parameter = F.col("kind") == "call", F.col("kind") == "parameter"
        args = F.map_from_entries(F.transform(F.coalesce("below", nothing), lambda x: F.struct(x["ord"].alias("key"), x["to"].alias("value"))))
        deeper = F.when(parameter, F.element_at("frames", -1)["depth"]).otherwise(F.col("depth") - F.when((F.col("kind") == "concat") & F.col("in_concat"), 0).otherwise(1))
        pushed = F.concat("frames", F.array(F.struct(args.alias("args"), (F.col("depth") - 1).alias("depth"), F.col("hops"), F.col("seen"))))
        frames = F.when(call, pushed).when(parameter, F.slice("frames", F.lit(1), F.size("frames") - 1)).otherwise(F.col("frames"))
        front = step.select(
            "root", F.concat("path", F.array(F.col("_n.ord"))).alias("path"), F.col("_n.ord").alias("ord"), F.col("_n.role").alias("role"), F.col("_n.to").alias("expr"), deeper.cast("int").alias("depth"),
            F.when(parameter, F.element_at("frames", -1)["hops"]).otherwise(F.col("hops") - call.cast("int")).alias("hops"),
            F.when(call, F.concat("seen", F.array("callee"))).when(parameter, F.element_at("frames", -1)["seen"]).otherwise(F.col("seen")).alias("seen"), frames.alias("frames"), (F.col("kind") == "concat").alias("in_concat"),
        )
    # the walk goes depth first, so all that is behind the last one visited is cut
    late = F.row_number().over(Window.partitionBy("root").orderBy("path")) > visited
    return out.withColumn("_late", late).withColumn("kind", F.when(F.col("_late"), "cut").otherwise(F.col("kind"))).withColumn("n", F.when(F.col("_late"), 0).otherwise(F.col("n"))).drop("_late")


def _combined(most: int) -> Column:
    """The candidates of an inner node from its parts (ord, role, c), by its kind."""
    parts, empty = F.col("parts"), F.array(_candidate(F.lit("")))
    start = empty.cast(f"array<{_CANDIDATE}>")
    fold = lambda xs, step: F.aggregate(xs, start, step)
    joined = fold(parts, lambda acc, p: _product(acc, p["c"], most))
    every = F.flatten(F.transform(parts, lambda p: p["c"]))
    several = F.col("n") > 1
    union = lambda **flags: _capped(F.transform(every, lambda c: _flagged(c, **flags)), most)
    slash = F.array(_candidate(F.lit("/"), lit=True))
    hole = F.array(_hole())
    build = fold(parts, lambda acc, p: F.when(F.coalesce(p["role"], F.lit("base")).isin("base", "path"), _product(acc, p["c"], most)).when(p["role"] == "segment", _product(_product(acc, slash, most), p["c"], most)).when(p["role"] == "neutral", acc).otherwise(_product(acc, hole, most)))

    def filled(template: Column) -> Column:
        """A template's text with the arguments in the place of its specifiers; a hole where one is lacking."""
        pieces = F.split(template["text"], _PARTS)
        piece = lambda i: F.array(_flagged(_candidate(F.get(pieces, i), lit=F.get(pieces, i) != ""), **{f: template[f] for f in _FLAGS}))
        value = lambda i: F.coalesce(F.get(F.transform(F.slice(parts, 2, 1 << 20), lambda p: p["c"]), i - 1), hole.cast(f"array<{_CANDIDATE}>"))
        more = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: i > 0)
        return F.aggregate(more, piece(F.lit(0)).cast(f"array<{_CANDIDATE}>"), lambda acc, i: _product(_product(acc, value(i), most), piece(i).cast(f"array<{_CANDIDATE}>"), most))

    formed = _capped(F.flatten(F.transform(F.get(parts, F.lit(0))["c"], lambda t: F.when(t["holes"] > 0, F.array(t)).otherwise(filled(t)))), most)
    return (
        F.when(F.col("kind") == "concat", joined).when(F.col("kind") == "builder", build).when(F.col("kind") == "format", formed).when(F.col("kind") == "ternary", union(multi=F.lit(True)))
        .when(F.col("kind") == "local", union(multi=several)).when(F.col("kind") == "member", union(multi=several, field=F.lit(True))).when(F.col("kind") == "call", union(hop=F.lit(True), multi=several)).otherwise(every)
    )


def benign(text: Column) -> Column:
    """Whether each hole of a URL is one whole segment of its path; a hole in the authority never is."""
    at = F.instr(text, F.lit("://"))
    path = F.when(at > 0, F.regexp_extract(text, r"^.*?://[^/]*(/.*)?$", 1)).otherwise(text)
    authority = F.when(at > 0, F.regexp_extract(text, r"^(.*?://[^/]*)", 1)).otherwise(F.lit(""))
    whole = F.forall(F.split(path, "/"), lambda s: ~F.contains(s, F.lit(HOLE)) | (s == HOLE))
    return ~((at == 0) & F.startswith(text, F.lit(HOLE))) & ~F.contains(authority, F.lit(HOLE)) & whole


def sliced(sinks: DataFrame, exprs: DataFrame, children: DataFrame, assignments: DataFrame, returns: DataFrame, *, depth: int = DEPTH, hops: int = HOPS, most: int = MOST, visited: int = VISITED) -> DataFrame:
    """(root, ord, url, confidence, truncated): the URLs that each sink's expression may have.

    At most ``most`` candidates at every step, so no product grows; what was cut says so by ``truncated``. A URL without a
    literal or key is none, with NULL as its text; with holes that are no whole segments, one of several, or cut, it is
    heuristic; by way of a key, a field, a call or with whole holes high; else exact. Equal URLs count once, the first.
    """
    tree = written(unrolled(sinks, exprs, children, assignments, returns, depth, hops, visited), "trees")
    leaf = F.when(F.col("kind") == "literal", _candidate(F.coalesce("text", F.lit("")), lit=F.coalesce(F.col("text") != "", F.lit(False)))).when(F.col("kind") == "config", _candidate(F.concat(F.lit("${"), "text", F.lit("}")), key=True)).when(F.col("kind") == "cut", _hole(True)).otherwise(_hole())
    one = F.array(leaf).cast(f"array<{_CANDIDATE}>")
    longest = tree.agg(F.max(F.size("path"))).first()[0] or 0
    level = lambda i: tree.where(F.size("path") == i)
    done = None
    for i in range(longest, -1, -1):
        own = level(i)
        leaves = own.where("n = 0").select("root", "path", "ord", "role", one.alias("c"))
        if done is not None:
            parts = done.groupBy("root", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.array_sort(F.collect_list(F.struct("ord", "role", "c"))).alias("parts"))
            inner = own.where("n > 0").join(parts, ["root", "path"]).select("root", "path", "ord", "role", _combined(most).alias("c"))
            leaves = leaves.unionByName(inner)
        done = written(leaves, "combined")
    rows = done.select("root", F.posexplode("c").alias("ord", "c")).select("root", "ord", "c.*")
    none = ~F.col("lit") & ~F.col("key")
    weak = ((F.col("holes") > 0) & ~benign(F.col("text"))) | F.col("cut") | F.col("multi")
    confidence = F.when(none, "none").when(weak, "heuristic").when(F.col("key") | F.col("field") | F.col("hop") | (F.col("holes") > 0), "high").otherwise("exact")
    rows = rows.select("root", "ord", F.when(~none, F.col("text")).alias("url"), confidence.alias("confidence"), F.col("cut").alias("truncated"))
    first = rows.groupBy("root", "url").agg(F.min_by(F.struct("ord", "confidence", "truncated"), "ord").alias("f")).select("root", "url", "f.*")
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("root").orderBy("ord")) - 1).select("root", "ord", "url", "confidence", "truncated")
