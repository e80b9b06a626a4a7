"""Read views: lists, joins and first-of-a-kind choices behind the routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylark.functions import text as X
from skylark.operators.graph import merged_intervals
from skylark.operators.reconcile import files_met
from skylark.operators.stitch import Edges
from skylark.sources.shared import written


def services_with_counts(services: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Every service with its number of endpoints, 0 where it has none."""
    n = endpoints.groupBy("service_id").agg(F.count("*").alias("n_endpoints"))
    return services.join(n, "service_id", "left").select("service_id", "name", "kind", F.coalesce("n_endpoints", F.lit(0)).alias("n_endpoints"))


def endpoint_list(endpoints: DataFrame, service_id: int) -> DataFrame:
    """One service's endpoints by uri and method, without their schemas."""
    return endpoints.where(F.col("service_id") == service_id).select("endpoint_id", "http_method", "uri").orderBy("uri", "http_method", "endpoint_id")


def edge_rows(edges: Edges, services: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Edges with the caller's and the target's names.

    Names are joined to calls and to the endpoints that paths land on, and single edges are opened last, by nothing but their calls.
    """
    caller = services.select("service_id", F.col("name").alias("caller"))
    rows = edges.rows.join(caller, "service_id", "left")
    target = services.select(F.col("service_id").alias("target_id"), F.col("name").alias("target_service"))
    end = endpoints.select("endpoint_id", F.concat_ws(" ", "http_method", "uri").alias("endpoint"))
    matches = edges.matches.join(target, "target_id", "left").join(end, "endpoint_id", "left").withColumn("target", F.concat_ws(" ", "target_service", "endpoint"))
    ends = edges.landing(rows, edges.lists(matches, F.collect_list("target"))).select("call_id", "caller", "target_kind", F.explode("ends").alias("target"), "confidence")
    one = rows.where("state = 'none'").select("call_id", "caller", "target_kind", F.col("external_host").alias("target"), "confidence")
    rest = rows.where("state = 'rest'").select("call_id", "caller", "target_kind", F.lit(None).cast("string").alias("target"), "confidence", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return ends.unionByName(rest.drop("col")).unionByName(one)


def both_ways(edges: Edges) -> DataFrame:
    """Per service, edges out and edges in."""
    out = edges.rows.groupBy("service_id").agg(F.sum("n").alias("n")).withColumn("direction", F.lit("outbound"))
    asked = edges.rows.where("state = 'endpoint'").groupBy("at", "path", "guess", "http_verb", "state").agg(F.count("*").alias("n"))
    into = edges.reached(asked).groupBy(F.col("target_id").alias("service_id")).agg(F.sum("n").alias("n")).withColumn("direction", F.lit("inbound"))
    return out.unionByName(into)


def dependencies(edges: Edges) -> DataFrame:
    """Per service one row for each distinct target, its first call kept.

    A service's calls are numbered in their order, so that the first is the least number; arrays of its calls turn numbers into calls again.
    """
    of = edges.rows.where("state = 'endpoint'").withColumn("_s", F.coalesce("service_id", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_s", "service_id").orderBy(F.asc_nulls_last("call_id"))) - 1
    of = written(of.select("_s", "service_id", "call_id", "state", "at", "path", "guess", "http_verb", nth.alias("_k")), "numbered")
    ends = edges.landing(of.drop("call_id"), edges.lists(item=F.collect_list("endpoint_id")), "_s").select("_s", "service_id", "_k", F.explode("ends").alias("endpoint_id"))
    ends = ends.groupBy("_s", "service_id", "endpoint_id").agg(F.min("_k").alias("_k"))
    calls = of.groupBy(F.col("_s").alias("_t"), F.col("service_id").isNull().alias("_none"), F.shiftright("_k", 16).alias("_block"))
    calls = calls.agg(F.array_sort(F.collect_list(F.struct("_k", "call_id"))).alias("_calls"))
    # one array of 65536 calls holds those of a service as a rule; _s alone is written as a key, so that edges stay where they are
    met = (F.col("_s") == F.col("_t")) & (F.shiftright("_k", 16) - F.col("_block") + F.abs(F.col("service_id").isNull().cast("int") - F.col("_none").cast("int")) * (1 << 20) == 0)
    call = F.get("_calls", F.col("_k").bitwiseAND(65535))["call_id"]
    ends = ends.join(calls.hint("shuffle_hash"), met).select("service_id", F.concat(F.lit("endpoint:"), F.col("endpoint_id").cast("string")).alias("label"), call.alias("call_id"))
    hosts = edges.rows.where("external_host IS NOT NULL").groupBy("service_id", "external_host").agg(F.min("call_id").alias("call_id"))
    return ends.unionByName(hosts.select("service_id", F.concat(F.lit("host:"), "external_host").alias("label"), "call_id"))


def distinct_targets(edges: Edges) -> DataFrame:
    """(service_id, label): the distinct targets of each service, the undetermined as one."""
    asked = edges.rows.select("service_id", "state", "at", "path", "guess", "http_verb", "external_host").distinct()
    ends = edges.landing(asked.drop("external_host"), edges.lists(item=F.collect_list("endpoint_id")), "service_id").select("service_id", F.explode("ends").alias("endpoint_id")).distinct()
    ends = ends.select("service_id", F.concat(F.lit("endpoint:"), F.col("endpoint_id").cast("string")).alias("label"))
    others = asked.where("state <> 'endpoint'").select("service_id", F.coalesce(F.concat(F.lit("host:"), "external_host"), F.lit("undetermined")).alias("label"))
    return ends.unionByName(others.distinct())


def target_keys(edges: Edges) -> DataFrame:
    """(key): what identifies each distinct target."""
    asked = edges.rows.select("state", "at", "path", "guess", "http_verb", "target_kind", "external_host").distinct()
    key = lambda df, endpoint: df.select(X.target_key(F.col("target_kind"), endpoint, F.col("external_host")).alias("key")).distinct()
    return key(edges.reached(asked), F.col("endpoint_id")).unionByName(key(asked.where("state <> 'endpoint'"), F.lit(None)))


def unresolved(edges: Edges) -> DataFrame:
    """(reason, n, n_services): undetermined edges by reason."""
    per = edges.rows.where("reason IS NOT NULL").groupBy("reason", "service_id").agg(F.sum("n").alias("n"))
    return per.groupBy("reason").agg(F.sum("n").alias("n"), F.count("service_id").alias("n_services"))


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def disambiguated(df: DataFrame, name: str, by: list[str], longer: str) -> DataFrame:
    """A display name, or the longer one where it collides within its group."""
    n = F.count("*").over(Window.partitionBy(*by, name))
    return df.withColumn("shown", F.when(n > 1, F.col(longer)).otherwise(F.col(name)))


def capped(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group and whether more were cut off."""
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= most)
    return ranked.join(n, by).withColumn("truncated", F.col("_n") > most).drop("_n")


def conflicts(book: DataFrame) -> DataFrame:
    """Keys that more than one service claims within a namespace."""
    return book.groupBy("prio", "host").agg(F.count_distinct("service_id").alias("n"), F.array_join(F.array_sort(F.collect_set("service_id")), ",").alias("services")).where("n > 1")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of only one side, and those that agree."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "left-only").when(F.col("_a").isNull(), "right-only").otherwise("agree")
    return x.join(y, keys, "full").select(*keys, side.alias("side"))


def sampled(df: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """A seeded simple random sample of n rows with ids in its order."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    top = df.withColumn("_place", place).orderBy("_place").limit(n)
    return top.withColumn("sample_id", F.format_string("b%03d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_place")))).drop("_place")


def search(df: DataFrame, columns: list[str], query: str, id_col: str) -> DataFrame:
    """Rows of which a column contains the query, case aside, with the column's name."""
    parts = [df.where(F.contains(F.lower(c), F.lit(query.lower()))).select(id_col, F.lit(c).alias("field")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def listed(df: DataFrame, order: list, columns: list[str], **where) -> DataFrame:
    """Rows with the given values, if any, of the given columns only, in order; filter and columns reach the scan."""
    for column, value in where.items():
        df = df if value is None else df.where(F.col(column) == value)
    return df.select(*columns).orderBy(*order)


def point(df: DataFrame, columns: list[str], **key) -> DataFrame:
    """The one row of a key."""
    return listed(df, columns[:1], columns, **key).limit(1)


def exists(df: DataFrame) -> DataFrame:
    """Whether there is any row."""
    return df.limit(1).agg((F.count("*") > 0).alias("found"))


def edges_of(edges: Edges, service_id: int, direction: str) -> DataFrame:
    """The edges that leave a service or arrive at it."""
    if direction == "outbound":
        return edges.where(F.col("service_id") == service_id).full()
    return Edges(edges.rows.where("state = 'endpoint'"), edges.matches.where(F.col("target_id") == service_id), edges.members).full()


def edges_of_calls(edges: Edges, calls: DataFrame) -> DataFrame:
    """The edges of some calls."""
    own = written(edges.rows.join(calls.select("call_id"), "call_id", "left_semi"), "own")
    return Edges(own, edges.matches, edges.members).full()


def outbound(flow_calls: DataFrame, edges: Edges, reports: DataFrame) -> DataFrame:
    """(endpoint_id, n_edges, stitched): each flow's edges; without a report of its snapshot the number is NULL and not 0."""
    n = flow_calls.join(edges.rows.groupBy("call_id").agg(F.sum("n").alias("n")), "call_id", "left").groupBy("endpoint_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    done = exists(reports).withColumnRenamed("found", "stitched")
    return n.join(F.broadcast(done), F.lit(True)).select("endpoint_id", F.when(F.col("stitched"), F.col("n")).alias("n_edges"), "stitched")


def system_graph(edges: Edges, services: DataFrame) -> DataFrame:
    """(caller, target, kind, n): stitched edges between names, and undetermined ones to nothing."""
    callers = services.select("service_id", F.col("name").alias("caller"))
    names = services.select(F.col("service_id").alias("target_id"), F.col("name").alias("target"))
    asked = edges.rows.join(callers, "service_id", "left").withColumn("caller", F.coalesce("caller", F.col("service_id").cast("string")))
    asked = asked.groupBy("caller", "state", "at", "path", "guess", "http_verb", "target_kind", "external_host").agg(F.sum("n").alias("_edges"), F.count("*").alias("_calls"))
    # of each path asked of a name, the endpoints by the name of their service; no other edges are of their kind
    named = edges.matches.join(names, "target_id", "left").groupBy("at", "path", "guess", "http_method", "target").agg(F.count("*").alias("_ends"), F.min("endpoint_id").alias("endpoint_id"))
    lists = edges.lists(named, F.collect_list(F.struct("target", "_ends")))
    ends = edges.landing(asked.drop("external_host", "_edges"), lists, "caller").select("caller", "target_kind", "_calls", F.inline("ends"))
    ends = ends.groupBy("caller", "target", F.col("target_kind").alias("kind")).agg(F.sum(F.col("_calls") * F.col("_ends")).alias("n"))
    others = asked.where("state <> 'endpoint'").groupBy("caller", F.col("external_host").alias("target"), F.col("target_kind").alias("kind")).agg(F.sum("_edges").alias("n"))
    return ends.unionByName(others)


def selected_entity(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, entity, n_candidates): by qualified name, else by simple name where it is unambiguous.

    rows: entity (qualified); wanted: wanted. An ambiguous simple name has no entity, its candidates are counted.
    """
    names = rows.select("entity").distinct().withColumn("simple", F.substring_index("entity", ".", -1))
    exact = wanted.join(names.select(F.col("entity").alias("wanted"), F.col("entity").alias("full")), "wanted", "left")
    short = names.groupBy(F.col("simple").alias("wanted")).agg(F.count("*").alias("n"), F.min("entity").alias("only"))
    return exact.join(short, "wanted", "left").select(
        "wanted", F.coalesce("full", F.when(F.col("n") == 1, F.col("only"))).alias("entity"), F.when(F.col("full").isNotNull(), 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_candidates"),
    )


def unique_names(rows: DataFrame, name: str, value: str) -> DataFrame:
    """A name catalogue: the value of each name, NULL where several claim it."""
    return rows.groupBy(name).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def tables_to_entities(uses: DataFrame, entities: DataFrame) -> DataFrame:
    """(use_id, entity): table names to entities, case aside unless quoted, by schema where both name one; ambiguous ones to none.

    uses: use_id, name, quoted, schema; entities: entity, table, schema.
    """
    u = uses.withColumn("_key", F.lower("name"))
    e = entities.select("entity", F.col("table").alias("_table"), F.col("schema").alias("_schema"), F.lower("table").alias("_key"))
    met = u.join(e, "_key").where((~F.col("quoted") | (F.col("name") == F.col("_table"))) & (F.col("schema").isNull() | F.col("_schema").isNull() | (F.lower("schema") == F.lower("_schema"))))
    one = unique_names(met, "use_id", "entity")
    return uses.select("use_id").join(one, "use_id", "left")


def inside_any(sites: DataFrame, spans: DataFrame) -> DataFrame:
    """The sites (site_id, file, line) that lie in a span (file, lo, hi) of the same file, told by its path's end.

    Spans of a file are merged first, and of its sites each line is looked up once: lines and spans are rows of one order and a line
    lies in the last span that begins at or before it, so no line is compared with all spans.
    """
    own = spans.where("lo <= hi").select(F.col("file").alias("o_file"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).distinct()
    own = merged_intervals(files_met(sites, own).join(own, "o_file").select("file", "lo", "hi").distinct(), ["file"])
    lines = sites.where("file IS NOT NULL AND line IS NOT NULL").select("file", F.col("line").cast("long").alias("line")).distinct()
    events = own.select("file", F.col("lo").alias("at"), F.lit(0).alias("is_line"), "hi").unionByName(lines.select("file", F.col("line").alias("at"), F.lit(1).alias("is_line"), F.lit(None).cast("long").alias("hi")))
    upto = Window.partitionBy("file").orderBy("at", "is_line").rowsBetween(Window.unboundedPreceding, 0)
    held = events.withColumn("_hi", F.last("hi", True).over(upto)).where("is_line = 1 AND at <= _hi").select(F.col("file").alias("_file"), F.col("at").alias("_line"))
    return sites.join(held, (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_line")), "left_semi")



def first_rule(rows: DataFrame, text: str, rules: list[tuple[str, str]], default: str):
    """Rows with the value of the first rule (prefix, value) that fits the text; a prefix ends where a capital letter or the text does."""
    value = F.lit(default)
    for prefix, own in reversed(rules):
        value = F.when(F.col(text).rlike(f"^{prefix}($|[A-Z])"), own).otherwise(value)
    return rows.withColumn("rule", value)


def superseding(jobs: DataFrame, by: list[str]) -> DataFrame:
    """The latest job of each group: the newest, of equal times the largest id."""
    return jobs.groupBy(*by).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n_jobs"))


def folded_copies(sites: DataFrame) -> DataFrame:
    """Copies of a library's sites (export, file, line, method, site_id) as one each: the nth of a place in each export is the same, the first export owns it."""
    key = ["file", "line", "method"]
    nth = F.row_number().over(Window.partitionBy("export", *key).orderBy("site_id"))
    return sites.withColumn("nth", nth).groupBy(*key, "nth").agg(F.min_by("site_id", F.struct("export", "site_id")).alias("site_id"), F.min("export").alias("owner"), F.count("*").alias("n_copies"))


def windowed_lines(lines: DataFrame, start: int, most: int) -> DataFrame:
    """At most so many lines of each text from a line on, with whether it goes on."""
    n = lines.groupBy("path").agg(F.max("line").alias("_n"))
    shown = lines.where(F.col("line").between(start, start + most - 1))
    return shown.join(n, "path").withColumn("truncated", F.col("_n") > start + most - 1).drop("_n")


def identity_conflicts(book: DataFrame) -> DataFrame:
    """Hosts that both namespaces know, for different services."""
    own = book.groupBy("host").agg(*[F.array_sort(F.collect_set(F.when(F.col("prio") == p, F.col("service_id")))).alias(f"_{p}") for p in (1, 2)])
    return own.where((F.size("_1") > 0) & (F.size("_2") > 0) & (F.col("_1") != F.col("_2"))).select("host", F.array_join("_1", ",").alias("by_host"), F.array_join("_2", ",").alias("by_name"))


def first_owner(needs: DataFrame, owners: DataFrame) -> DataFrame:
    """(module, artifact, owner): each needed artifact's owner, the first where several build it."""
    one = owners.groupBy("artifact").agg(F.min("owner").alias("owner"))
    return needs.join(one, "artifact").select("module", "artifact", "owner")


def binding_entries(rules: DataFrame, config: DataFrame) -> DataFrame:
    """(rule_id, key): a binding prefix's first entry in order, its own or one below it.

    rules: rule_id, prefix; config: ord, key. Entries meet prefixes by equality with one of their own prefixes; the first of each
    prefix is found before rules meet it, so that rules of one prefix are not joined with all of its entries.
    """
    parts = F.split("key", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    entries = config.select("ord", "key", F.explode(heads).alias("prefix"))
    firsts = entries.groupBy("prefix").agg(F.min_by("key", "ord").alias("key"), F.min("ord").alias("ord"))
    return rules.join(firsts, "prefix").groupBy("rule_id").agg(F.min_by("key", "ord").alias("key"))
