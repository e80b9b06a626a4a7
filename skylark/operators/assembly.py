"""Flow of endpoints over methods: each method's flow with an entry and an exit, inlined along the closure of calls.

statements: method, node, kind (branch, loop, return, call, statement), construct, condition, line, callee (a
method or NULL), resolved, signal (it makes calls of its own that are told). flow: method, source, target, label, back.
Ids of the assembled graph are m<method>:n<node>, m<method>:entry and m<method>:exit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylark.operators.graph import closure
from skylark.sources.shared import written

SWITCHES = ("switch", "switch-arrow")
_NODE = ["method", "node"]


def node_id(method: Column, node: Column) -> Column:
    return F.concat(F.lit("m"), method.cast("string"), F.lit(":n"), node.cast("string"))


def _end(method: Column, which: str) -> Column:
    return F.concat(F.lit("m"), method.cast("string"), F.lit(f":{which}"))


def local_flow(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """flow with has_source and has_target: whether its ends are statements of the method."""
    own = lambda c: statements.select("method", F.col("node").alias(c), F.lit(True).alias(f"has_{c}"))
    out = flow.join(own("source"), ["method", "source"], "left").join(own("target"), ["method", "target"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_source", "has_target")})


def unconditional(construct: Column, condition: Column) -> Column:
    """Whether a loop has no test to leave it by: a for without a condition, a while or do of the word true."""
    text = F.trim(F.coalesce(condition, F.lit("")))
    return F.coalesce(F.when(construct == "for", text == "").when(construct.isin("while", "do-while"), text == "true"), F.lit(False))


def arms_leaving(statements: DataFrame, local: DataFrame) -> DataFrame:
    """(method, node, label): arms of which control leaves the method, as no statement follows them.

    A branch lacks true or false, a switch its default, a loop with a test its exit; where all that follows is
    handlers, normal flow leaves. A branch with an unlabelled successor lacks nothing that could be named.
    """
    labels = local.where("has_source AND has_target").groupBy("method", F.col("source").alias("node")).agg(F.collect_set("label").alias("labels"))
    has = lambda x: F.array_contains("labels", x)
    lacks = lambda *xs: F.filter(F.array(*[F.when(~has(x), F.lit(x)) for x in xs]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    is_switch = F.coalesce(F.col("construct").isin(*SWITCHES), F.lit(False))
    arms = (
        F.when(has("flow"), none).when(F.col("kind") == "branch", F.when(is_switch, lacks("default")).otherwise(lacks("true", "false")))
        .when(F.col("kind") == "loop", F.when(unconditional(F.col("construct"), F.col("condition")), none).otherwise(lacks("false")))
        .when((F.size("labels") == 1) & has("exception"), F.array(F.lit("flow"))).otherwise(none)
    )
    return statements.join(labels, _NODE).select(*_NODE, F.explode(arms).alias("label"))


def method_flow(methods: DataFrame, statements: DataFrame, flow: DataFrame) -> DataFrame:
    """(method, source, target, kind, back): each method's own flow between its nodes; a NULL source is its entry, a NULL target its exit.

    The entry leads to statements that nothing enters; what leads nowhere, a return and an arm that leaves lead to
    the exit. A method without statements goes from its entry to its exit.
    """
    local = written(local_flow(statements, flow), "local")
    null, plain = F.lit(None).cast(dict(statements.dtypes)["node"]), [F.lit("flow").alias("kind"), F.lit(False).alias("back")]
    inner = local.where("has_source AND has_target").select("method", "source", "target", F.col("label").alias("kind"), "back")
    entered = local.where("has_source").select("method", F.col("target").alias("node")).distinct()
    left = local.where("has_target").select("method", F.col("source").alias("node")).distinct()
    first = statements.select(*_NODE).join(entered, _NODE, "left_anti").select("method", null.alias("source"), F.col("node").alias("target"), *plain)
    ends = statements.select(*_NODE).join(left, _NODE, "left_anti").unionByName(statements.where("kind = 'return'").select(*_NODE)).withColumn("label", F.lit("flow"))
    out = ends.unionByName(arms_leaving(statements, local)).distinct().select("method", F.col("node").alias("source"), null.alias("target"), F.col("label").alias("kind"), F.lit(False).alias("back"))
    bare = methods.select("method").join(statements.select("method").distinct(), "method", "left_anti").select("method", null.alias("source"), null.alias("target"), *plain)
    return inner.unionByName(first).unionByName(out).unionByName(bare)


def inlined(endpoints: DataFrame, methods: DataFrame, statements: DataFrame) -> DataFrame:
    """(endpoint_id, method, level): the methods of each endpoint's flow: its handler and all that resolved calls reach.

    An endpoint whose handler is no known method has none. The closure runs once for each handler, not for each endpoint.
    """
    known = methods.select("method").distinct()
    handlers = written(endpoints.join(known, "method", "left_semi").select("endpoint_id", F.col("method").alias("root")), "handlers")
    calls = statements.where("resolved AND callee IS NOT NULL").select(F.col("method").alias("src"), F.col("callee").alias("dst")).distinct().join(known.withColumnRenamed("method", "dst"), "dst", "left_semi")
    return handlers.join(closure(calls, handlers.select("root").distinct()), "root").select("endpoint_id", F.col("node").alias("method"), "level")


def assembled(endpoints: DataFrame, methods: DataFrame, statements: DataFrame, flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (endpoint_id, id, kind, method, node) and edges (endpoint_id, source, target, kind, back) of every endpoint's flow.

    A method stands in an endpoint's graph once, however often it is called; each resolved call is matched by an
    edge into the callee's entry and one back from its exit, so recursion closes a cycle and ends there. Methods are
    put together once and joined to all endpoints that inline them.
    """
    inside = written(inlined(endpoints, methods, statements).select("endpoint_id", "method"), "inlined")
    m, none = F.col("method"), F.lit(None)
    # ids are texts, so they are made after the rows have met
    shown = inside.join(statements.select("method", "kind", "node"), "method").select("endpoint_id", node_id(m, F.col("node")).alias("id"), "kind", "method", "node")
    ends = inside.select("endpoint_id", "method", F.explode(F.array(F.lit("entry"), F.lit("exit"))).alias("kind"))
    ends = ends.select("endpoint_id", F.concat(F.lit("m"), m.cast("string"), F.lit(":"), "kind").alias("id"), "kind", "method", none.cast(dict(statements.dtypes)["node"]).alias("node"))
    calls = statements.where("resolved AND callee IS NOT NULL").join(methods.select(F.col("method").alias("callee")).distinct(), "callee", "left_semi")
    calls = calls.select("method", F.col("node").alias("source"), none.cast(dict(statements.dtypes)["node"]).alias("target"), F.lit("call").alias("kind"), F.lit(False).alias("back"), "callee")
    met = inside.join(method_flow(methods, statements, flow).withColumn("callee", none.cast(dict(statements.dtypes)["callee"])).unionByName(calls), "method")
    at, called = node_id(m, F.col("source")), F.col("callee")
    edge = lambda source, target, kind: F.struct(source.alias("source"), target.alias("target"), kind.alias("kind"), "back")
    own = edge(F.coalesce(at, _end(m, "entry")), F.coalesce(node_id(m, F.col("target")), _end(m, "exit")), F.col("kind"))
    pair = F.array(edge(at, _end(called, "entry"), F.lit("call")), edge(_end(called, "exit"), at, F.lit("return")))
    return shown.unionByName(ends), met.select("endpoint_id", F.inline(F.when(called.isNotNull(), pair).otherwise(F.array(own))))


def anomalies(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """(code, method, node) of flow that breaks a rule of structure, node NULL for what concerns a whole method.

    dangling-edge, disconnected-node (but for the entry: the first by line and id of those that nothing enters),
    branch-arity (no outcome named), unlabeled-arm (one of several unnamed), loop-no-back-edge, exit-unreachable.
    """
    local = written(local_flow(statements, flow), "local")
    null = F.lit(None).cast(dict(statements.dtypes)["node"])
    code = lambda df, name, node="node": df.select(F.lit(name).alias("code"), "method", (F.col(node) if node else null).alias("node"))
    inner = local.where("has_source AND has_target")
    entered = inner.select("method", F.col("target").alias("node")).distinct().withColumn("entered", F.lit(True))
    own = statements.join(entered, _NODE, "left")
    w = Window.partitionBy("method")
    first = F.row_number().over(w.orderBy(F.coalesce("entered", F.lit(False)), "line", "node"))
    alone = own.withColumn("_first", first).withColumn("_n", F.count("*").over(w)).where("_n >= 2 AND _first > 1 AND entered IS NULL")
    out = inner.groupBy("method", F.col("source").alias("node")).agg(F.collect_set("label").alias("labels"), F.count("*").alias("n_out"))
    full = written(statements.join(out, _NODE, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))), "arity")
    forks = full.where("kind IN ('branch', 'loop')").withColumn("is_switch", F.coalesce(F.col("construct").isin(*SWITCHES), F.lit(False)))
    unnamed = forks.where((F.size("labels") == 0) | (F.col("is_switch") & ~F.arrays_overlap("labels", F.array(F.lit("case"), F.lit("default")))))
    vague = forks.where(~F.col("is_switch") & F.array_contains("labels", "flow") & (F.col("n_out") > 1))
    closing = inner.where("back").select("method", F.explode(F.array("source", "target")).alias("node")).distinct()
    open_ = full.where((F.col("kind") == "loop") & F.array_contains("labels", "true")).join(closing, _NODE, "left_anti")
    ways = arms_leaving(statements, local).select("method").unionByName(full.where("kind = 'return' OR size(labels) = 0").select("method")).distinct()
    shut = statements.select("method").distinct().join(ways, "method", "left_anti")
    rows = code(local.where("NOT (has_source AND has_target)"), "dangling-edge", None).unionByName(code(alone, "disconnected-node")).unionByName(code(unnamed, "branch-arity")).unionByName(code(vague, "unlabeled-arm"))
    return rows.unionByName(code(open_, "loop-no-back-edge")).unionByName(code(shut, "exit-unreachable", None))


def runs(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """(method, node, head, place, n): maximal runs, two at least, of statements without a signal, along flow that neither forks nor joins.

    The successor chains are followed by pointer doubling, so that rounds grow with the logarithm of a run's length; a
    cycle has no head and is no run.
    """
    inner = written(local_flow(statements, flow).where("has_source AND has_target"), "inner")
    out = inner.groupBy("method", F.col("source").alias("node")).agg(F.count("*").alias("n_out"))
    into = inner.groupBy("method", F.col("target").alias("node")).agg(F.count("*").alias("n_in"))
    plain = statements.where("kind IN ('statement', 'call', 'return') AND construct IS NULL AND condition IS NULL AND NOT signal")
    plain = plain.join(out, _NODE, "left").join(into, _NODE, "left").where("coalesce(n_out, 0) <= 1 AND coalesce(n_in, 0) <= 1").select(*_NODE)
    steps = inner.where("label = 'flow' AND NOT back AND source <> target").join(plain.withColumnRenamed("node", "source"), ["method", "source"], "left_semi").join(plain.withColumnRenamed("node", "target"), ["method", "target"], "left_semi")
    live = plain.join(steps.select("method", F.col("target").alias("node"), F.col("source").alias("up")), _NODE, "left").select(*_NODE, "up", F.coalesce("up", "node").alias("head"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("place"))
    live = written(live, "runs")
    size = live.count()
    reach = 1
    while reach <= size:  # a chain is no longer than all statements; what still has an up then lies on a cycle
        if live.where("up IS NOT NULL").isEmpty():
            break
        above = live.select("method", F.col("node").alias("up"), F.col("up").alias("next"), F.col("head").alias("far"), F.col("place").alias("more"))
        live = live.join(above, ["method", "up"], "left").select(*_NODE, F.col("next").alias("up"), F.coalesce("far", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
        live, reach = written(live, "runs"), 2 * reach
    done = live.where("up IS NULL")
    return done.withColumn("n", F.count("*").over(Window.partitionBy("method", "head"))).where("n >= 2").select(*_NODE, "head", "place", "n")


def canvas(nodes: DataFrame, edges: DataFrame, statements: DataFrame, flow: DataFrame, expanded: DataFrame, opened: DataFrame, remote: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is drawn of assembled flow: nodes (endpoint_id, id, type, n) and edges (endpoint_id, source, target, kind, back).

    expanded: endpoint_id, method: methods shown by statement, the others are one node each. opened: method, head: runs that are
    shown by statement, the others of expanded methods are one node each. remote: method, node, remote_call_id; targets:
    remote_call_id, target (its service or host), NULL where nothing is known of the call, which then stands for itself.
    A call leads to its callee's first statement where that is expanded.
    """
    run = runs(statements, flow).join(opened, ["method", "head"], "left_anti").select(*_NODE, "head")
    shown = nodes.where("node IS NOT NULL").join(expanded.withColumn("open", F.lit(True)), ["endpoint_id", "method"], "left").join(run, _NODE, "left")
    of_method = F.concat(F.lit("method:"), F.col("method").cast("string"))
    drawn = F.when(F.col("open").isNull(), of_method).when(F.col("head").isNotNull(), F.concat(F.lit("run:"), node_id(F.col("method"), F.col("head")))).otherwise(F.concat(F.lit("stmt:"), F.col("id")))
    kind = F.when(F.col("open").isNull(), "method").when(F.col("head").isNotNull(), "condensed").otherwise("statement")
    shown = written(shown.select("endpoint_id", "method", "node", "id", drawn.alias("drawn"), kind.alias("type"), F.col("open").isNotNull().alias("open")), "drawn")
    bare = nodes.where("kind = 'entry'").join(expanded, ["endpoint_id", "method"], "left_anti").select("endpoint_id", of_method.alias("id"), F.lit("method").alias("type"))
    parts = shown.groupBy("endpoint_id", F.col("drawn").alias("id"), "type").agg(F.count("*").alias("n"))
    parts = parts.unionByName(bare.join(parts.select("endpoint_id", "id"), ["endpoint_id", "id"], "left_anti").withColumn("n", F.lit(0).cast("long")))
    at = lambda c: shown.select("endpoint_id", F.col("id").alias(c), F.col("drawn").alias(f"{c}_drawn"), F.col("open").alias(f"{c}_open"))
    inner = edges.where("kind NOT IN ('call', 'return')").join(at("source"), ["endpoint_id", "source"]).join(at("target"), ["endpoint_id", "target"]).where("source_open AND source_drawn <> target_drawn")
    inner = inner.select("endpoint_id", F.col("source_drawn").alias("source"), F.col("target_drawn").alias("target"), "kind", "back")
    first = statements.groupBy("method").agg(F.min_by("node", F.struct("line", "node")).alias("node"))
    begins = shown.where("open").join(first, _NODE, "left_semi").select("endpoint_id", _end(F.col("method"), "entry").alias("target"), F.col("drawn").alias("begin"))
    calls = edges.where("kind = 'call'").join(at("source"), ["endpoint_id", "source"]).join(begins, ["endpoint_id", "target"], "left")
    to = F.coalesce("begin", F.concat(F.lit("method:"), F.regexp_extract("target", "^m(.*):entry$", 1)))
    calls = calls.select("endpoint_id", F.col("source_drawn").alias("source"), to.alias("target"), F.lit("call").alias("kind"), F.lit(False).alias("back")).where("source <> target").distinct()
    ghosts = shown.join(remote, _NODE).join(targets, "remote_call_id", "left").select("endpoint_id", F.col("drawn").alias("source"), F.concat(F.lit("ghost:"), F.coalesce("target", "remote_call_id")).alias("target"), F.lit("remote").alias("kind"), F.lit(False).alias("back")).distinct()
    lifted = ghosts.groupBy("endpoint_id", F.col("target").alias("id")).agg(F.lit("ghost").alias("type"), F.count("*").alias("n"))
    return parts.unionByName(lifted), inner.unionByName(calls).unionByName(ghosts)


def downstream(nodes: DataFrame, remote: DataFrame, stitched: DataFrame) -> DataFrame:
    """(endpoint_id, remote_call_id, target_endpoint_id): the analysed endpoints that calls in each endpoint's flow reach, one step far.

    A call with several targets has a row for each, one without an analysed endpoint none.
    """
    made = nodes.where("node IS NOT NULL").join(remote, _NODE).select("endpoint_id", "remote_call_id").distinct()
    return made.join(stitched.where("target_endpoint_id IS NOT NULL").select("remote_call_id", "target_endpoint_id").distinct(), "remote_call_id").select("endpoint_id", "remote_call_id", "target_endpoint_id")
