"""Small flows put together, checked and drawn."""

from skylark.operators import assembly as A

STATEMENTS = "method long, node long, kind string, construct string, condition string, line int, callee long, resolved boolean, signal boolean"
FLOW = "method long, source long, target long, label string, back boolean"


def _frames(spark, statements, flow):
    rows = [(m, n, kind, *((x + [None] * 2)[:2]), n, callee, callee is not None and callee < 90, signal) for m, n, kind, x, callee, signal in statements]
    edges = [(m, *map(int, e.split(":")[0].split(">")), (e.split(":") + ["flow"])[1].rstrip("*") or "flow", e.endswith("*")) for m, text in flow.items() for e in text.split()]
    return spark.createDataFrame(rows, STATEMENTS), spark.createDataFrame(edges, FLOW)


def _s(m, n, kind="statement", x=(), callee=None, signal=False):
    return m, n, kind, list(x), callee, signal


def test_methods_are_inlined_once_with_matched_calls(spark):
    # 1 calls 2 twice and itself; 2 calls 3 (no statements) and an unresolved 95; 4 is not reached
    statements, flow = _frames(spark, [_s(1, 1, "call", callee=2), _s(1, 2, "call", callee=2), _s(1, 3, "call", callee=1), _s(2, 4, "call", callee=3), _s(2, 5, "call", callee=95), _s(4, 6)], {1: "1>2 2>3", 2: "4>5"})
    methods = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "method long")
    endpoints = spark.createDataFrame([(10, 1), (11, 3), (12, 77)], "endpoint_id long, method long")
    nodes, edges = A.assembled(endpoints, methods, statements, flow)
    assert {(r.endpoint_id, r.id) for r in nodes.collect()} == {(10, x) for x in ("m1:entry", "m1:exit", "m1:n1", "m1:n2", "m1:n3", "m2:entry", "m2:exit", "m2:n4", "m2:n5", "m3:entry", "m3:exit")} | {(11, "m3:entry"), (11, "m3:exit")}
    got = sorted((r.source, r.target, r.kind) for r in edges.where("endpoint_id = 10").collect())
    calls = [(f"m1:n{i}", "m2:entry", "call") for i in (1, 2)] + [("m2:exit", f"m1:n{i}", "return") for i in (1, 2)] + [("m1:n3", "m1:entry", "call"), ("m1:exit", "m1:n3", "return"), ("m2:n4", "m3:entry", "call"), ("m3:exit", "m2:n4", "return")]
    own = [("m1:entry", "m1:n1"), ("m1:n1", "m1:n2"), ("m1:n2", "m1:n3"), ("m1:n3", "m1:exit"), ("m2:entry", "m2:n4"), ("m2:n4", "m2:n5"), ("m2:n5", "m2:exit"), ("m3:entry", "m3:exit")]
    assert got == sorted([*calls, *((a, b, "flow") for a, b in own)])
    assert [(r.source, r.target) for r in edges.where("endpoint_id = 11").collect()] == [("m3:entry", "m3:exit")]


def test_arms_that_leave_the_method(spark):
    cases = {
        1: ("branch", ["if"], "1>2:true", {"false"}), 2: ("branch", ["if"], "1>2:flow", set()), 3: ("branch", ["switch"], "1>2:case", {"default"}), 4: ("branch", ["switch-arrow"], "1>2:default", set()),
        5: ("loop", ["while", "x"], "1>2:true 2>1:flow*", {"false"}), 6: ("loop", ["while", " true "], "1>2:true 2>1:flow*", set()), 7: ("loop", ["for", None], "1>2:true 2>1:flow*", set()), 8: ("loop", ["foreach", "xs"], "1>2:true 2>1:flow*", {"false"}),
        9: ("statement", ["try"], "1>2:exception", {"flow"}), 10: ("branch", ["if"], "1>2:true 1>3:false", set()), 11: ("call", [], "1>2", set()),
    }
    statements, flow = _frames(spark, [r for m, (kind, x, _, _) in cases.items() for r in (_s(m, 1, kind, x), _s(m, 2), _s(m, 3))], {m: e for m, (_, _, e, _) in cases.items()})
    got = {m: set() for m in cases}
    for r in A.arms_leaving(statements, A.local_flow(statements, flow)).collect():
        assert r.node == 1
        got[r.method].add(r.label)
    assert got == {m: want for m, (*_, want) in cases.items()}


def test_anomalies(spark):
    statements, flow = _frames(
        spark,
        [
            _s(1, 1), _s(1, 2), _s(1, 3), _s(2, 1, "branch", ["if"]), _s(3, 1, "branch", ["if"]), _s(3, 2), _s(3, 3), _s(4, 1, "loop", ["while", "true"]), _s(4, 2), _s(5, 1, "branch", ["switch"]), _s(5, 2),
            _s(6, 1), _s(6, 2), _s(7, 1), _s(8, 1, "branch", ["if"]), _s(8, 2), _s(9, 1, "loop", ["for", "i"]),
        ],
        {1: "1>2", 3: "1>2:true 1>3", 4: "1>2:true 2>1:flow*", 5: "1>2:flow", 6: "1>2 2>1", 7: "1>99", 8: "1>2:flow", 9: "9>9"},
    )
    got = sorted((r.code, r.method, r.node) for r in A.anomalies(statements, flow).select("code", "method", "node").fillna(0).collect())
    assert got == sorted([("disconnected-node", 1, 3), ("branch-arity", 2, 1), ("unlabeled-arm", 3, 1), ("exit-unreachable", 4, 0), ("branch-arity", 5, 1), ("exit-unreachable", 6, 0), ("dangling-edge", 7, 0), ("branch-arity", 9, 1), ("dangling-edge", 9, 0)])


def test_runs_follow_edges(spark):
    # 1-2-3 a run; 4 forks; 5-6 joined by a back edge; 7-8-9 a cycle; 10-11 with a signal; node order is no order of flow
    statements, flow = _frames(
        spark,
        [*[_s(1, n) for n in (30, 2, 17)], _s(2, 1, "branch", ["if"]), _s(2, 2), _s(2, 3), _s(2, 4), *[_s(3, n) for n in (7, 8, 9)], _s(4, 1), _s(4, 2, signal=True), _s(4, 3), *[_s(5, n) for n in range(40)]],
        {1: "30>2 2>17", 2: "1>2:true 1>3:false 2>4 3>4", 3: "7>8 8>9 9>7", 4: "1>2 2>3", 5: " ".join(f"{n}>{n + 1}" for n in range(39))},
    )
    got = {(r.method, r.head): [] for r in A.runs(statements, flow).collect()}
    for r in A.runs(statements, flow).orderBy("place").collect():
        got[r.method, r.head].append(r.node)
    assert got == {(1, 30): [30, 2, 17], (5, 0): list(range(40))}


def test_canvas(spark):
    statements, flow = _frames(spark, [_s(1, 1), _s(1, 2), _s(1, 3, "call", callee=2), _s(2, 4, "call", signal=True), _s(2, 5)], {1: "1>2 2>3", 2: "4>5"})
    methods = spark.createDataFrame([(1,), (2,)], "method long")
    nodes, edges = A.assembled(spark.createDataFrame([(10, 1)], "endpoint_id long, method long"), methods, statements, flow)
    remote = spark.createDataFrame([(2, 4, "c1"), (2, 4, "c2")], "method long, node long, remote_call_id string")
    targets = spark.createDataFrame([("c1", "shop")], "remote_call_id string, target string")

    def drawn(expanded, opened):
        n, e = A.canvas(nodes, edges, statements, flow, spark.createDataFrame(expanded, "endpoint_id long, method long"), spark.createDataFrame(opened, "method long, head long"), remote, targets)
        return {(r.id, r.type, r.n) for r in n.collect()}, {(r.source, r.target, r.kind) for r in e.collect()}

    ghosts = {("ghost:shop", "ghost", 1), ("ghost:c2", "ghost", 1)}
    assert drawn([], []) == ({("method:1", "method", 3), ("method:2", "method", 2), *ghosts}, {("method:1", "method:2", "call"), ("method:2", "ghost:shop", "remote"), ("method:2", "ghost:c2", "remote")})
    n, e = drawn([(10, 1), (10, 2)], [])
    assert n == {("run:m1:n1", "condensed", 3), ("stmt:m2:n4", "statement", 1), ("stmt:m2:n5", "statement", 1), *ghosts}
    assert e == {("run:m1:n1", "stmt:m2:n4", "call"), ("stmt:m2:n4", "stmt:m2:n5", "flow"), ("stmt:m2:n4", "ghost:shop", "remote"), ("stmt:m2:n4", "ghost:c2", "remote")}
    n, e = drawn([(10, 1)], [(1, 1)])
    assert ("stmt:m1:n1", "stmt:m1:n2", "flow") in e and ("stmt:m1:n3", "method:2", "call") in e and ("method:2", "method", 2) in n
    stitched = spark.createDataFrame([("c1", 10), ("c1", 20), ("c2", None)], "remote_call_id string, target_endpoint_id long")
    assert sorted(map(tuple, A.downstream(nodes, remote, stitched).collect())) == [(10, "c1", 10), (10, "c1", 20)]


def test_ids_are_made_after_rows_have_met(spark):
    statements, flow = _frames(spark, [_s(1, 1, "call", callee=2), _s(2, 4)], {1: "1>1", 2: "4>4"})
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, edges = A.assembled(spark.createDataFrame([(10, 1)], "endpoint_id long, method long"), spark.createDataFrame([(1,), (2,)], "method long"), statements, flow)
        for df in (nodes, edges):
            plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
            last = max(i for i, x in enumerate(plan) if "Exchange" in x)
            assert not any("concat(" in x for x in plan[min(i for i, x in enumerate(plan) if "Exchange" in x) : last + 1]), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {(r.source, r.target, r.kind) for r in edges.collect() if r.kind in ("call", "return")} == {("m1:n1", "m2:entry", "call"), ("m2:exit", "m1:n1", "return")}
