"""Compose files and profile documents, case by case."""

import pytest

from skylark.sources import deployment as D

pytestmark = pytest.mark.skipif(not D.available, reason="the reader of YAML is not here")

FILES = {
    ("r", "docker-compose.yml"): """
services:
  api:
    build: ./services/api/
    hostname: api-host
    container_name: api
    ports: ["8080", "9000:8081", "127.0.0.1:9001:8082/tcp", {target: 8083, published: 1}, "bad"]
    expose: [8084, "8080", x]
    networks: {front: {aliases: [edge, api-host, edge]}, back: null}
    env_file: [a.env, b.env]
    environment: {DB_URL: jdbc, FROM_ENV: null, NOWHERE: null, OVER: own, FLAG: true}
  web:
    build: {context: .}
    environment: ["API_HOST=api ", FROM_ENV, MISSING, "TARGET=http://api=x"]
  broken: text
""",
    ("r", "compose.yml"): "services: {ignored: {image: x}}", ("r", "docker-compose.override.yml"): "services: {api: {hostname: other}, extra: {image: y}}", ("bad", "compose.yaml"): "services: [", ("list", "compose.yml"): "- a", ("none", "readme.yml"): "services: {a: {}}",
}


def _files(spark):
    return spark.createDataFrame([(f"{r}/{n}", r, n, c) for (r, n), c in FILES.items()], "path string, repo string, name string, content string")


def test_compose(spark):
    files = _files(spark)
    services = D.compose_services(files, D.documents(files))
    got = {r.service: (r.repo, r.hostnames, r.ports, r.context) for r in D.identities(services).collect()}
    assert got == {"api": ("r", ["api", "other", "edge", "api-host"], [8080, 8081, 8082, 8083, 8084], "services/api"), "web": ("r", ["web"], [], "."), "extra": ("r", ["extra"], [], None)}
    dotenv = spark.createDataFrame([("r", "FROM_ENV", "dot")], "repo string, key string, value string")
    env_files = spark.createDataFrame([("r", "a.env", "OVER", "a"), ("r", "a.env", "LATE", "a"), ("r", "b.env", "LATE", "b"), ("x", "a.env", "OTHER", "x")], "repo string, file string, key string, value string")
    env = D.environments(services, dotenv, env_files)
    rows = {(r.service, r.name): r.value for r in env.collect()}
    assert rows == {
        ("api", "OVER"): "own", ("api", "LATE"): "b", ("api", "DB_URL"): "jdbc", ("api", "FROM_ENV"): "dot", ("api", "NOWHERE"): "", ("api", "FLAG"): "true", ("web", "API_HOST"): "api", ("web", "FROM_ENV"): "dot", ("web", "TARGET"): "http://api=x",
    }
    assert {r.name for r in D.carried(env).collect()} == {"DB_URL", "API_HOST", "TARGET"}


BASE = """
server: {port: 80}
spring: {profiles: kept-in-the-first}
list: [1, two, true]
maps: [{a: 1}]
none: null
---
spring: {config: {activate: {on-profile: "dev, test"}}}
server: {port: 81}
---
spring.profiles: prod
server.port: 82
---
- no mapping
---
"""


def test_profiles(spark):
    files = spark.createDataFrame([(f"{s}/{n}", s, i, i > 0, c) for s in (1, 2, 3, 4) for i, (n, c) in enumerate([("application.yml", BASE)] + ([("application-dev.yml", "server: {port: 90}\nspring: {config: {activate: {on-profile: x}}}")] if s == 4 else []))], "path string, service_id long, file_ord int, is_profile boolean, content string")
    active = spark.createDataFrame([(1, []), (2, ["prod"]), (3, None), (4, ["dev"])], "service_id long, profiles array<string>")
    settings, notes = D.profile_entries(files.drop("content"), D.documents(files), active)
    got = {}
    for r in settings.collect():
        got.setdefault(r.service_id, {})[r.key] = r.value
    first = {"spring.profiles": "kept-in-the-first", "list": "1,two,True", "maps": "{'a': 1}"}
    assert got == {1: first | {"server.port": "80"}, 2: first | {"server.port": "82"}, 3: first | {"server.port": "82"}, 4: first | {"server.port": "90"}}
    assert {(r.service_id, r.note) for r in notes.collect()} == {(3, "config-profile-doc-merged:dev, test"), (3, "config-profile-doc-merged:prod")}


def test_routes(spark):
    content = """
spring:
  cloud.gateway:
    routes:
      - {id: a, uri: "lb://shop ", predicates: ["Path=/shop/**, /s/*", "Method=GET"], filters: ["StripPrefix=1", "AddHeader=x"]}
      - {id: b, uri: lb://cart, predicates: [{name: Path, args: {pattern: /cart/**, other: "/c , /d"}}], filters: [{name: StripPrefix, args: {parts: 2}}]}
      - {id: c, predicates: ["Path=/lost"]}
      - {id: d, uri: lb://x, predicates: ["Host=a"]}
      - text
"""
    docs = D.documents(spark.createDataFrame([("p", content), ("q", "spring: {cloud: {gateway: {routes: [{uri: u, predicates: [Path=/q]}]}}}")], "path string, content string"))
    got = sorted((r.path, r.ord, r.route_id or "", r.path_prefix, r.target_uri, r.strip) for r in D.gateway_routes(docs).collect())
    assert got == [("p", 0, "a", "/s/*", "lb://shop", 1), ("p", 0, "a", "/shop/**", "lb://shop", 1), ("p", 1, "b", "/c", "lb://cart", 2), ("p", 1, "b", "/cart/**", "lb://cart", 2), ("p", 1, "b", "/d", "lb://cart", 2), ("q", 0, "", "/q", "u", 0)]


def test_hostile_documents(spark):
    bomb = "a0: &a0 [x, x, x, x, x, x, x, x, x, x]\n" + "".join(f"a{i}: &a{i} [{', '.join([f'*a{i - 1}'] * 10)}]\n" for i in range(1, 12))
    docs = spark.createDataFrame([("bomb", bomb), ("deep", "[" * 5000), ("deeper", "{a: " * 3000 + "1" + "}" * 3000), ("tabs", "a:\n\t- b"), ("null", None), ("ok", "2: x\ntrue: y\n2020-01-01: z")], "path string, content string")
    assert [(r.path, r.content) for r in D.documents(docs).collect()] == [("ok", '{"2": "x", "True": "y", "2020-01-01": "z"}')]


def test_documents_are_dealt_out_and_read_once(spark, monkeypatch):
    plans, written = {}, D.written
    monkeypatch.setattr(D, "written", lambda df, label: plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString()) or written(df, label))
    files = spark.createDataFrame([(f"{s}/application.yml", s, 0, False, BASE) for s in range(40)], "path string, service_id long, file_ord int, is_profile boolean, content string").coalesce(1)
    docs = D.documents(files)
    settings, _ = D.profile_entries(files.drop("content"), docs, spark.createDataFrame([(1, ["prod"])], "service_id long, profiles array<string>"))
    assert [(k, len(v), sum(p.count("MapInPandas") for p in v)) for k, v in plans.items()] == [("documents", 1, 1), ("entries", 1, 1)]
    assert "hashpartitioning(path" in plans["documents"][0] and "REPARTITION_BY_NUM" in plans["documents"][0]
    assert "MapInPandas" not in settings._jdf.queryExecution().executedPlan().toString()
    assert settings.where("service_id = 1 AND key = 'server.port'").head().value == "82"
