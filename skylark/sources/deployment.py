"""Deployment and profile settings in YAML: documents become JSON rows, all else is read from those by Spark.

The reader of YAML is optional; ``available`` tells whether it is there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.functions import text as X
from skylark.sources.config import entries_of_json
from skylark.sources.shared import written

try:
    import yaml
except ImportError:  # documents cannot be read then
    yaml = None

available = yaml is not None
#: Values of a document at most, aliases written out; a document of more counts as unreadable.
MOST_VALUES = 200_000
# fixed values: file names in the order in which they are looked for, and what settings of a container are carried
COMPOSE = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
OVERRIDES = ("docker-compose.override.yml", "docker-compose.override.yaml", "compose.override.yml", "compose.override.yaml")
VALUE_SHAPES, NAME_ENDINGS = ("http://", "https://", "lb://"), ("_URL", "_URI", "_HOST", "_PORT")
NAMES = ("SERVER_PORT", "SPRING_APPLICATION_NAME", "SERVER_SERVLET_CONTEXT_PATH")
ROUTES = "spring.cloud.gateway.routes"


def _small(document: object) -> bool:
    left, stack = MOST_VALUES, [document]
    while stack and left:
        left -= 1
        x = stack.pop()
        stack += x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        if len(stack) > MOST_VALUES:
            return False
    return not stack


def _keyed(x: object) -> object:
    return {str(k): _keyed(v) for k, v in x.items()} if isinstance(x, dict) else [_keyed(v) for v in x] if isinstance(x, list) else x


def documents(files: DataFrame) -> DataFrame:
    """(path, doc, content): each document of YAML files (path, content) that is a mapping, as JSON, numbered with all others.

    Empty documents are left out and not counted. A file that cannot be read, nests too deep or is too large once
    aliases are written out has none. Files are dealt out by their path, as a small table of many would lie in one
    task, and read once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = [d for d in yaml.safe_load_all(content or "") if d is not None]
                    if all(map(_small, found)):
                        rows += [(path, i, json.dumps(_keyed(d), default=str, ensure_ascii=False)) for i, d in enumerate(found) if isinstance(d, dict)]
                except (yaml.YAMLError, RecursionError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "doc", "content"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(files.select("path", "content").repartition(n, "path").mapInPandas(run, "path string, doc int, content string"), "documents")


def _list(c: Column) -> Column:
    return F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(c, "array<string>"))


def _map(c: Column) -> Column:
    return F.when(F.startswith(F.ltrim(c), F.lit("{")), F.from_json(c, "map<string,string>"))


def compose_services(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(repo, service, spec): services of each repository's compose file, by key as JSON text.

    files: path, repo, name; docs: of ``documents``. The first file name that is there counts, and of the overriding ones the
    first; its services replace the keys that they name and keep the others, and new ones join.
    """
    rank = lambda names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    pick = lambda names: files.where(F.col("name").isin(*names)).groupBy("repo").agg(F.min_by("path", rank(names)).alias("path"))
    services = docs.where("doc = 0").select("path", F.explode(_map(F.get_json_object("content", "$.services"))).alias("service", "text"))
    first = pick(COMPOSE)
    own = first.join(services, "path").select("repo", "service", _map(F.col("text")).alias("own"))
    more = pick(OVERRIDES).join(first.select("repo"), "repo", "left_semi").join(services, "path").select("repo", "service", _map(F.col("text")).alias("more"))
    both = own.join(more, ["repo", "service"], "full")
    kept = F.map_concat(F.map_filter("own", lambda k, _: ~F.map_contains_key("more", k)), F.col("more"))
    return both.select("repo", "service", F.coalesce(kept, "more", "own").alias("spec")).where("spec IS NOT NULL")


def identities(services: DataFrame) -> DataFrame:
    """(repo, service, hostnames, ports, context): names, container ports and build folder of each service.

    A service answers to its own name, its host and container names and its aliases in networks, each once and in this order.
    """
    spec = lambda k: F.try_element_at("spec", F.lit(k))
    named = F.filter(F.array(*[F.trim(spec(k)) for k in ("hostname", "container_name")]), lambda h: h.isNotNull() & (h != ""))
    nets = F.transform(F.map_values(F.coalesce(_map(spec("networks")), F.create_map().cast("map<string,string>"))), lambda n: F.coalesce(_list(F.get_json_object(n, "$.aliases")), F.array().cast("array<string>")))
    port = lambda p: F.coalesce(F.when(F.startswith(p, F.lit("{")), F.get_json_object(p, "$.target").try_cast("int")), X.container_port(p))
    ports = F.concat(F.transform(F.coalesce(_list(spec("ports")), F.array().cast("array<string>")), port), F.transform(F.coalesce(_list(spec("expose")), F.array().cast("array<string>")), lambda p: p.try_cast("int")))
    build = spec("build")
    context = F.when(F.startswith(build, F.lit("{")), F.get_json_object(build, "$.context")).otherwise(build)
    folder = F.regexp_replace(F.regexp_replace(context, r"^\./", ""), "/+$", "")
    return services.select(
        "repo", "service", F.array_distinct(F.concat(F.array("service"), named, F.flatten(nets))).alias("hostnames"), F.array_sort(F.array_distinct(F.filter(ports, lambda p: p.isNotNull()))).alias("ports"),
        F.when(folder == "", ".").otherwise(folder).alias("context"),
    )


def environments(services: DataFrame, dotenv: DataFrame, env_files: DataFrame) -> DataFrame:
    """(repo, service, name, value): the settings that each service's container is given.

    dotenv: repo, key, value of the repository's own settings; env_files: repo, file, key, value. A service's files come first,
    in their order, then its own settings, as a mapping or a list of name=value. A name without a value takes the repository's:
    in a mapping an empty one where that has none, in a list none at all. Later ones win.
    """
    spec = lambda k: F.try_element_at("spec", F.lit(k))
    listed = F.when(F.startswith(F.ltrim(spec("env_file")), F.lit("[")), F.from_json(spec("env_file"), "array<string>")).when(spec("env_file").isNotNull(), F.array(spec("env_file")))
    wanted = services.select("repo", "service", F.posexplode(listed).alias("ord", "file"))
    from_files = wanted.join(env_files, ["repo", "file"]).select("repo", "service", F.col("ord"), F.lit(0).alias("place"), F.col("key").alias("name"), "value")
    text = spec("environment")
    mapped = services.select("repo", "service", F.posexplode(F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("{")), text), "map<string,string>")).alias("place", "name", "given")).withColumn("bare", F.col("given").isNull()).withColumn("empty", F.lit(""))
    entries = services.select("repo", "service", F.posexplode(_list(text)).alias("place", "entry"))
    has = F.contains("entry", F.lit("="))
    split = entries.select("repo", "service", "place", F.trim(F.substring_index("entry", "=", 1)).alias("name"), F.when(has, F.trim(F.col("entry").substr(F.instr("entry", F.lit("=")) + 1, F.length("entry")))).alias("given"), (~has).alias("bare"), F.lit(None).cast("string").alias("empty"))
    own = mapped.unionByName(split).join(dotenv.select("repo", F.col("key").alias("name"), F.col("value").alias("_env")), ["repo", "name"], "left")
    own = own.withColumn("value", F.when(F.col("bare"), F.coalesce("_env", "empty")).otherwise(F.col("given"))).where("value IS NOT NULL").select("repo", "service", F.lit(1 << 30).alias("ord"), "place", "name", "value")
    return from_files.unionByName(own).groupBy("repo", "service", "name").agg(F.max_by("value", F.struct("ord", "place")).alias("value"))


def carried(environment: DataFrame) -> DataFrame:
    """The settings that say where something is: by the shape of the value, the ending of the name, or the name."""
    name, value = F.upper("name"), F.col("value")
    keep = name.isin(*NAMES)
    for x in VALUE_SHAPES:
        keep = keep | F.startswith(value, F.lit(x))
    for x in NAME_ENDINGS:
        keep = keep | F.endswith(name, F.lit(x))
    return environment.where(keep)


def profile_entries(files: DataFrame, docs: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The settings of each service's documents that apply, last one first to count, and notes (service_id, note).

    files: path, service_id, file_ord, is_profile (a profile's own file); active: service_id, profiles (NULL where nothing
    tells which are active). A document for profiles applies if one of them is active; where that is not known all apply, with a
    note. A profile's own file applies whole. Of several settings of a key the last file's, document's and line's counts.
    """
    flat = written(entries_of_json(docs.select(F.concat_ws("#", "path", F.col("doc").cast("string")).alias("path"), "content")), "entries")
    at = flat.select(F.regexp_extract("path", "^(.*)#[0-9]+$", 1).alias("path"), F.regexp_extract("path", "#([0-9]+)$", 1).cast("int").alias("doc"), "ord", "key", "value")
    on, old = "spring.config.activate.on-profile", "spring.profiles"
    marks = at.where(F.col("key") == on).select("path", "doc", F.col("value").alias("a")).join(at.where((F.col("key") == old) & (F.col("doc") > 0)).select("path", "doc", F.col("value").alias("b")), ["path", "doc"], "full")
    marks = marks.select("path", "doc", F.coalesce(F.nullif("a", F.lit("")), F.nullif("b", F.lit(""))).alias("mark"))
    full = at.join(marks, ["path", "doc"], "left").join(files, "path").join(active, "service_id", "left")
    declared = F.filter(F.transform(F.split("mark", ","), lambda p: F.trim(p)), lambda p: p != "")
    free = F.col("mark").isNull() | F.col("is_profile") | F.col("profiles").isNull()
    applied = full.where(free | F.arrays_overlap(declared, "profiles")).where(~((F.col("key") == on) | ((F.col("key") == old) & (F.col("doc") > 0))))
    settings = applied.groupBy("service_id", "key").agg(F.max_by("value", F.struct("file_ord", "doc", "ord")).alias("value"))
    unsure = full.where("mark IS NOT NULL AND NOT is_profile AND profiles IS NULL")
    return settings, unsure.select("service_id", F.concat(F.lit("config-profile-doc-merged:"), "mark").alias("note")).distinct()


def gateway_routes(docs: DataFrame) -> DataFrame:
    """(path, doc, ord, route_id, path_prefix, target_uri, strip): routes of gateways, one row for each path pattern.

    Filters and predicates are texts (Path=/a,/b and StripPrefix=1) or mappings with a name and args. Routes without a
    target or a path have no row; of several strips the last counts.
    """
    keys = ("$.spring.cloud.gateway.routes", f"$['{ROUTES}']", "$['spring.cloud.gateway'].routes", "$.spring['cloud.gateway'].routes")
    found = F.coalesce(*[F.get_json_object("content", k) for k in keys])
    rows = docs.select("path", "doc", F.posexplode(_list(found)).alias("ord", "entry"))
    field = lambda k: F.get_json_object("entry", f"$.{k}")
    named = lambda x, name: F.trim(F.get_json_object(x, "$.name")) == name
    values = lambda x: F.map_values(F.coalesce(_map(F.get_json_object(x, "$.args")), F.create_map().cast("map<string,string>")))
    nothing = F.array().cast("array<string>")
    paths = lambda x: F.when(F.startswith(x, F.lit("{")), F.when(named(x, "Path"), F.filter(F.transform(F.split(F.array_join(values(x), ","), ","), lambda p: F.trim(p)), lambda p: p != "")).otherwise(nothing)).otherwise(X.predicate_paths(x))
    strip = lambda x: F.when(F.startswith(x, F.lit("{")), F.when(named(x, "StripPrefix"), F.get(F.filter(F.transform(values(x), lambda v: v.try_cast("int")), lambda v: v.isNotNull()), F.lit(0)))).otherwise(F.when(F.rlike(F.trim(x), F.lit(r"^StripPrefix\s*=")), X.stripped_segments(x)))
    strips = F.filter(F.transform(F.coalesce(_list(field("filters")), nothing), strip), lambda s: s.isNotNull())
    patterns = F.flatten(F.transform(F.coalesce(_list(field("predicates")), nothing), paths))
    out = rows.select("path", "doc", "ord", field("id").alias("route_id"), F.trim(field("uri")).alias("target_uri"), F.when(F.size(strips) > 0, F.element_at(strips, -1)).otherwise(0).alias("strip"), F.explode(patterns).alias("path_prefix"))
    return out.where("target_uri IS NOT NULL AND target_uri <> ''").select("path", "doc", "ord", "route_id", "path_prefix", "target_uri", "strip")
