"""Writes by key, whole sets, parts and their reassembly."""

import uuid

import pytest

from skylark.sources import tables
from skylark.sources.shared import shared_folder

ROW = "id long, v string, snapshot_id string"


def _table(spark, rows):
    return spark.createDataFrame(rows, ROW)


def _read(spark, path):
    return sorted((r.snapshot_id, r.id, r.v) for r in spark.read.schema(ROW).parquet(path).collect())


def test_upsert_and_whole_sets(spark):
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    tables.upsert(_table(spark, [(1, "a", "s1"), (2, "b", "s1"), (1, "c", "s2")]), path, ["id"])
    files = {f for f in spark.read.parquet(path).inputFiles() if "=s2/" in f}
    for _ in range(2):
        tables.upsert(_table(spark, [(2, "x", "s1"), (2, "y", "s1"), (3, None, "s1"), (1, "n", "s3")]), path, ["id"])
    assert _read(spark, path) == [("s1", 1, "a"), ("s1", 2, "y"), ("s1", 3, None), ("s2", 1, "c"), ("s3", 1, "n")]
    assert {f for f in spark.read.parquet(path).inputFiles() if "=s2/" in f} == files
    for _ in range(2):
        tables.replace_set(_table(spark, [(9, "z", "s1")]), path, ["s1", "s3", "none"], ["id"])
    assert _read(spark, path) == [("s1", 9, "z"), ("s2", 1, "c")]
    tables.replace_set(_table(spark, []), path, ["s1"], ["id"])
    assert _read(spark, path) == [("s2", 1, "c")]
    with pytest.raises(ValueError, match="not replaced"):
        tables.replace_set(_table(spark, [(9, "z", "s1")]), path, ["s2"], ["id"])


def test_parts(spark):
    sizes = {1: [5, 5, 1, 9, 2, 10, 1], 2: [10], 3: [1] * 25}
    rows = [(g, i, n, f"{g}-{i}") for g, own in sizes.items() for i, n in enumerate(own)]
    items = spark.createDataFrame(rows, "g long, i int, n int, v string").repartition(3)
    got = {(r.g, r.i): r.part for r in tables.packed_parts(items, ["g"], "i", "n", 10).collect()}
    want = {}
    for g, own in sizes.items():
        part = full = 0
        for i, n in enumerate(own):
            if i and full + n > 10:
                part, full = part + 1, 0
            full += n
            want[g, i] = part
    assert got == want
    parts = tables.chunked(items, ["g"], "i", "n", 10)
    assert sorted(map(tuple, tables.reassembled(parts, ["g"]).select("g", "i", "n", "v").collect())) == rows
    for broken in (parts.where("NOT (g = 1 AND part = 1)"), parts.union(parts.where("g = 3"))):
        with pytest.raises(Exception, match="incomplete"):
            tables.reassembled(broken, ["g"]).collect()
    with pytest.raises(Exception, match="beyond the budget"):
        tables.packed_parts(items, ["g"], "i", "n", 9).collect()


def test_graph_rows(spark):
    services = spark.createDataFrame([("s", 1), ("s", 2)], "snapshot_id string, service_id long")
    endpoints = spark.createDataFrame([("s", 1, 10)], "snapshot_id string, service_id long, endpoint_id long")
    calls = spark.createDataFrame([("s", 2, "c1"), ("s", 2, "c2"), ("s", 2, "c3")], "snapshot_id string, service_id long, call_id string")
    edges = spark.createDataFrame([("s", "c1", "endpoint", 1, 10, None), ("s", "c2", "placeholder", None, None, "who"), ("s", "c2", "external", None, None, "api.x"), ("s", "c3", "undetermined", None, None, None)], "snapshot_id string, call_id string, target_kind string, target_service_id long, target_endpoint_id long, external_host string")
    nodes, links = tables.graph_rows(services, endpoints, calls, edges)
    assert {(r.kind, r.id) for r in nodes.collect()} == {("service", "1"), ("service", "2"), ("endpoint", "10"), ("call", "c1"), ("call", "c2"), ("call", "c3"), ("placeholder", "who"), ("external", "api.x")}
    assert {(r.kind, r.src, r.dst) for r in links.collect()} == {("exposes", "1", "10"), ("makes", "2", "c1"), ("makes", "2", "c2"), ("makes", "2", "c3"), ("targets", "c1", "10"), ("targets-placeholder", "c2", "who"), ("targets-external", "c2", "api.x")}
