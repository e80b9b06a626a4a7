"""Small cases of the architecture operators."""

from pyspark.sql import functions as F

from skylark.functions import text as X
from skylark.operators import access, coverage, graph, measure, reads, stitch
from skylark.streaming import queue

SERVICES = "service_id long, name string, app_name string, port int, kind string, production_methods long, reachable_methods long"
CALLS = "call_id string, service_id long, url string, http_verb string, reachable boolean, suspected boolean"
ENDPOINTS = "endpoint_id long, service_id long, http_method string, uri string"


def _stitched(spark, calls):
    services = spark.createDataFrame([(1, "a", "app", 80, "service", 5, 3), (2, "b", "app", 81, "service", None, None)], SERVICES)
    endpoints = spark.createDataFrame([(10, 1, "GET", "/a/{?}"), (11, 1, "POST", "/a/b"), (12, 2, "GET", "/x")], ENDPOINTS)
    rows = stitch.stitch(spark.createDataFrame(calls, CALLS), services, endpoints).collect()
    return sorted((r.call_id, r.target_kind, r.target_endpoint_id, r.confidence, r.reason) for r in rows)


def test_stitch_keeps_every_call(spark):
    calls = [
        ("1", 1, "http://a/a/5", "GET", True, False), ("2", 1, None, "GET", True, False), ("3", 1, "/rel", "GET", True, False), ("4", 1, "http://a/none/at/all", "GET", True, False),
        ("5", 1, "http://api.x.com/y", "GET", True, False), ("6", 1, "http://who/y", "GET", True, False), ("7", 1, "http://app/x", "GET", True, False), ("8", 1, "http://a/a/5", "GET", False, False),
    ]
    assert _stitched(spark, calls) == [
        ("1", "endpoint", 10, "exact", None), ("2", "undetermined", None, "none", "url-undetermined"), ("3", "undetermined", None, "none", "url-unparseable"),
        ("4", "undetermined", None, "none", "no-endpoint-match"), ("5", "external", None, "exact", None), ("6", "placeholder", None, "heuristic", None), ("7", "endpoint", 12, "heuristic", None),
        ("7", "undetermined", None, "none", "no-endpoint-match"),
    ]


def test_stitch_by_the_rules_of_resolution(spark):
    services = spark.createDataFrame([(1, "gate", "g", 80, "service", 5, 3), (2, "shop", "shop-app", 81, "service", None, None), (3, "cart", "cart-app", 82, "service", None, None)], SERVICES)
    endpoints = spark.createDataFrame([(20, 2, "GET", "/items/{?}"), (21, 2, "POST", "/items"), (30, 3, "GET", "/carts/{?}")], ENDPOINTS)
    env = spark.createDataFrame([(1, "shop.url", "http://${shop.host}"), (1, "SHOP_HOST", "shop:81"), (3, "server.servlet.context-path", "/api/")], "service_id long, key string, value string")
    routes = spark.createDataFrame([(1, 0, "/s/**", "lb://shop-app", 1), (1, 1, "/s/x/**", "http://gone:9", 0), (1, 2, "/bad", "??", 0)], "service_id long, ord int, prefix string, target_uri string, strip int")
    locators = spark.createDataFrame([(1,)], "service_id long")
    want = {
        "${shop.url}/items/7": ("endpoint", 20, "exact", "config-resolved"), "http://{svc}/x": ("undetermined", None, "none", "machine-proven"), "HTTPS://API.x.com:8443/y": ("external", "api.x.com:8443", "exact", "machine-proven"),
        "http://shop.ns.svc.cluster.local/items/{id}": ("endpoint", 20, "exact", "config-resolved"), "http://shop.prod/items/1": ("endpoint", 20, "high", "config-resolved"), "http://localhost:82/api/carts/1": ("endpoint", 30, "heuristic", "heuristic"),
        "http://cart/api/carts/{x}?q=/z": ("endpoint", 30, "exact", "config-resolved"), "http://shop:99/items/1": ("endpoint", 20, "high", "config-resolved"), "http://gate/s/items/1": ("endpoint", 20, "high", "config-resolved"),
        "http://gate/s/x/1": ("placeholder", "gone", "high", "config-resolved"), "http://gate/bad": ("placeholder", "??", "high", "config-resolved"), "http://gate/cart-app/api/carts/1": ("endpoint", 30, "high", "config-resolved"),
        "http://gate/nobody/a": ("placeholder", "nobody", "high", "config-resolved"), "http://10.0.0.1/x": ("external", "10.0.0.1", "exact", "machine-proven"), "http://localhost/x": ("placeholder", "localhost", "heuristic", "heuristic"),
        "http://shop/items/:id/more": ("undetermined", None, "none", "machine-proven"),
    }
    calls = spark.createDataFrame([(u, 1, u, "GET", True, False) for u in want], CALLS)
    got = {r.call_id: (r.target_kind, r.target_endpoint_id or r.external_host, r.confidence, r.provenance) for r in stitch.stitch(calls, services, endpoints, env, routes, locators).collect()}
    assert got == want


def test_unknown_is_not_zero(spark):
    services = spark.createDataFrame([(1, "a", "x", 1, "service", 0, 0), (2, "b", "x", 1, "service", None, None), (3, "c", "x", 1, "service", 4, 1)], SERVICES)
    got = {r.service_id: (r.methods, r.percent) for r in coverage.method_coverage(services).collect()}
    assert got[1] == (0, None) and got[2] == (None, None) and float(got[3][1]) == 25.0 and got[None][0] == 4


def test_uri_and_ant(spark):
    df = spark.createDataFrame([("/a/{id:[0-9]+}//:x/b/?q=1",)], "u string").select(X.simplify_uri(F.col("u")).alias("s"))
    assert df.first().s == "/a/{?}/{?}/b"
    pats = {
        ("/a/**", "/a"): "exact", ("/a/**", "/a/b/c"): "exact", ("/a/*", "/a/b"): "exact", ("/a/*", "/a/b/c"): None, ("/**", "/z"): "exact", ("/a/**/b", "/a/b"): "exact", ("/a?c", "/abc"): "exact",
        ("/a?c", "/ac"): None, ("/contest/public/**", "/contest/{id}/camp"): "speculative", ("/orders/*", "/orders/{id}"): "exact", ("/**/x/**", "/a/x/b"): "exact", ("/a.b", "/axb"): None,
    }
    df = spark.createDataFrame(list(pats), "p string, u string")
    assert {(r.p, r.u): r.m for r in df.select("p", "u", X.ant_match(F.col("p"), F.col("u")).alias("m")).collect()} == pats


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "root long")
    assert sorted((r.node, r.level) for r in graph.closure(edges, roots).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert [r.path for r in graph.witness_paths(edges, roots).where("node = 4").collect()] == ["1>2>3>4"]
    assert sum(r.cycle for r in graph.call_tree(edges, roots).collect()) == 1


def test_access_counts_a_site_under_each_operation(spark):
    a = spark.createDataFrame([(1, "E", "delete", "s"), (1, "E", "read", "s"), (1, None, "read", "t")], "endpoint_id long, entity string, operation string, site string")
    got = {r.entity: (r.operations, r.n_sites, r.n_read, r.n_delete) for r in access.summaries(a).collect()}
    assert got == {"E": ("read,delete", 1, 1, 1), None: ("read", 1, 1, 0)}


def test_pairs_and_bounds(spark):
    a = spark.createDataFrame([("k", "1"), ("k", "2")], "key string, id string")
    b = spark.createDataFrame([("k", "9")], "key string, id string")
    assert sorted((r.oracle_id, r.found_id) for r in measure.paired(a, b, ["key"], "id").collect()) == [("1", "9"), ("2", None)]
    assert abs(measure.upper_bound(0, 40) - 0.0722) < 1e-3 and measure.upper_bound(3, 3) == 1.0 and measure.upper_bound(0, 0) is None
    assert {r.id: r.side for r in reads.difference(a.select("id"), b.select("id"), ["id"]).collect()} == {"1": "left-only", "2": "left-only", "9": "right-only"}


def test_queue_fold_equals_steps(spark):
    log = [(1, 1, 0, "enqueue"), (1, 2, 10, "claim"), (1, 3, 2000, "complete"), (1, 4, 2001, "claim"), (1, 5, 2002, "fail"), (2, 6, 0, "claim"), (1, 7, 2003, "claim"), (1, 8, 2004, "complete")]
    got = {r.job_id: (r.status, r.attempts) for r in queue.replay(spark.createDataFrame(log, "job_id long, event_id long, at long, action string")).collect()}
    want = {}
    for job in (1, 2):
        state = ("none", 0, 0)
        for j, _, at, action in log:
            state = queue.step(state, action, at) if j == job else state
        want[job] = state[:2]
    assert got == want == {1: ("succeeded", 3), 2: ("none", 0)}
