"""Calls that ask the same of the same place are resolved once; calls are never sorted or dealt out by a missing key."""

from pyspark.sql import functions as F

from skylark.operators import stitch
from skylark.plans import synthetic as V

SERVICES = "service_id long, name string, app_name string, port int"
CALLS = "call_id string, service_id long, url string, http_verb string, reachable boolean, suspected boolean, url_confidence string, evidence string"
ENDPOINTS = "endpoint_id long, service_id long, http_method string, uri string"


def test_equal_asks_are_resolved_once(spark, monkeypatch):
    services = spark.createDataFrame([(i, f"s-{i}", "shared", 80 + i) for i in range(9)], SERVICES)
    endpoints = spark.createDataFrame([(100 + i, i, "GET", "/a/{?}") for i in range(9)], ENDPOINTS)
    urls = ["http://S-1:81/a/7", "http://s-1:81/a/7", "${k}/a/7", "http://localhost:82/a/7", "http://who/x", "http://h.example.com:8443", "/x", None]
    calls = [(f"{n}-{u}", n, u, "GET", True, False, ("exact", "high", None)[n % 3], "slice-budget-truncated [unsupported-idiom:x]") for n in range(40) for u in urls]
    calls = spark.createDataFrame(calls + calls[:3] + [(None, None, "http://who/x", None, True, False, "exact", None)], CALLS)
    env = spark.createDataFrame([(n, "k", "${l}") for n in range(20)] + [(n, "l", "http://s-2") for n in range(19)], "service_id long, key string, value string")
    met, resolved = [], stitch.resolved
    monkeypatch.setattr(stitch, "resolved", lambda c, *rest: met.append(c.count()) or resolved(c, *rest))
    full = stitch.stitch(calls, services, endpoints, env).cache()
    assert met == [6]  # two spellings of s-1, the key's s-2, localhost, who without a verb and with GET, and the external host
    kinds = {r.target_kind: r["count"] for r in full.groupBy("target_kind").count().collect()}
    assert kinds == {"endpoint": 80 + 40 + 19 + 3, "placeholder": 41, "external": 40, "undetermined": 80 + 21}
    own = {(r.target_kind, r.confidence, r.provenance, r.reason) for r in full.select("target_kind", "confidence", "provenance", "reason").distinct().collect()}
    assert own == {("endpoint", c, "config-resolved", None) for c in ("exact", "high", "none")} | {("endpoint", "heuristic", "heuristic", None), ("endpoint", "none", "heuristic", None)} | {
        ("placeholder", "heuristic", "heuristic", None), ("external", "exact", "machine-proven", None), ("external", "high", "heuristic", None), ("external", None, "heuristic", None),
        ("undetermined", "none", "machine-proven", "slice-budget-truncated"), ("undetermined", "none", "machine-proven", "unsupported-idiom:x"),
    }


def test_calls_are_made_without_a_sort(spark):
    d = "/root/testdata/sf0.001"

    def of(name):
        return spark.read.parquet(f"{d}/{name}.parquet") if name in V.TABLES else spark.sql(V.VIEWS[name], **{n: of(n) for n in V._names(V.VIEWS[name])})

    plan = V.PLANS["syn_remote"](of)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
