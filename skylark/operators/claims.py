"""What the evidence about an endpoint's protection adds up to; what could not be read is never taken for an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.functions.text import ant_match

#: Kinds of evidence that describe a service and let nothing through or back.
DESCRIBING = ("config", "authority-model")
#: Kinds that hold for the one endpoint that they stand in.
ENDPOINT_SCOPED = ("in-handler", "aspect")
#: Marks of an annotation and the switch of its family.
FAMILIES = (("PreAuthorize", "pre_post"), ("PostAuthorize", "pre_post"), ("Secured", "secured"), ("RolesAllowed", "jsr250"), ("DenyAll", "jsr250"), ("PermitAll", "jsr250"))


def gates(kind: Column) -> Column:
    """Whether a kind of evidence decides about requests at all."""
    return ~kind.isin(*DESCRIBING)


def governs(pattern: Column, uri: Column) -> Column:
    """How a rule's pattern decides an endpoint; one without any wildcard or hole must be its route."""
    return F.when(pattern.rlike(r"[*?{]"), ant_match(pattern, uri)).when(pattern == uri, "exact")


def in_scope(kind: Column, pattern: Column, uri: Column) -> Column:
    """Whether an enforcement covers an endpoint."""
    return F.when(kind.isin(*ENDPOINT_SCOPED), pattern == uri).otherwise(ant_match(pattern, uri).isNotNull())


def in_chain(scope: Column, uri: Column) -> Column:
    """Whether one of a chain's comma-separated patterns covers an endpoint; a chain without any covers all."""
    parts = F.filter(F.transform(F.split(scope, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.size(parts) == 0, F.lit(True)) | F.coalesce(F.exists(parts, lambda p: ant_match(p, uri).isNotNull()), F.lit(False))


def annotation_activity(payload: Column, present: Column, switches: dict[str, Column], resolution: Column) -> Column:
    """struct(active, resolution) of an annotation under its service's method security.

    ``present`` is NULL where an export does not know, which changes nothing; FALSE, where nothing
    switches it on, makes the annotation unreadable; else its family's switch decides.
    """
    flag = F.lit(None).cast("string")
    for mark, name in reversed(FAMILIES):
        flag = F.when(F.contains(payload, F.lit(mark)), name).otherwise(flag)
    on = F.lit(None).cast("boolean")
    for name, switch in switches.items():
        on = F.when(flag == name, switch).otherwise(on)
    silent = flag.isNull() | present.isNull()
    return F.struct(F.when(silent | ~present, True).otherwise(on).alias("active"), F.when(~silent & ~present, "opaque").otherwise(resolution).alias("resolution"))


def merged(evidence: DataFrame) -> DataFrame:
    """(endpoint_id, authenticated, denied, roles, n_evidence) of evidence rows.

    evidence: endpoint_id, kind, effect (permit, deny, other), active, resolution (opaque or other),
    covers_route, roles. Only active evidence that gates counts. Every readable effect but permit asks
    for a login, and a bypass takes the request around them. The claim is withheld (NULL) where what
    could not be read might change it: where an unread guard may let requests through or around, where
    nothing readable asks for a login beside an unread guard or a permit of some requests only.
    """
    gating = F.col("active") & gates(F.col("kind"))
    opaque = gating & (F.col("resolution") == "opaque")
    permit, bypass = F.col("effect") == "permit", F.col("kind") == "chain-bypass"
    requiring = gating & (F.col("resolution") != "opaque") & ~permit
    flag = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    f = evidence.groupBy("endpoint_id").agg(
        F.count("*").alias("n_evidence"), flag(gating, "any"), flag(requiring, "requires"), flag(gating & bypass, "bypassed"), flag(opaque, "unread"), flag(opaque & (bypass | permit), "removes"),
        flag(gating & permit & ~F.col("covers_route"), "partly"), flag(requiring & (F.col("effect") == "deny"), "denies"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(requiring, F.col("roles")))))), ",").alias("roles"),
    )
    unsure = (~F.col("requires") & F.col("partly")) | F.col("removes") | (F.col("unread") & ~(F.col("requires") & ~F.col("bypassed")))
    held = ~F.col("any") | unsure
    claim = F.when(~held, F.col("requires") & ~F.col("bypassed"))
    return f.select("endpoint_id", claim.alias("authenticated"), F.coalesce(claim & F.col("denies"), F.lit(False)).alias("denied"), F.when(claim.isNotNull(), F.col("roles")).alias("roles"), "n_evidence")


def parameter_origin(origin: Column, callers: Column) -> Column:
    """a parameter takes its callers' origin where all agree; one hop only."""
    one = F.array_distinct(callers)
    return F.when(origin != "parameter", origin).when(F.size(one) == 1, F.get(one, F.lit(0))).otherwise("parameter")


def published(candidates: DataFrame, flags: DataFrame, version: str) -> DataFrame:
    """the candidates (site, basis, operation) with the verb that is published: their own only by a flag that is on and scored under these rules."""
    on = flags.where(F.col("enabled") & (F.col("scored_version") == version)).select("basis", "operation", F.lit(True).alias("_on")).distinct()
    return candidates.join(on, ["basis", "operation"], "left").withColumn("published", F.when(F.col("_on"), F.col("operation")).otherwise("create-or-update")).drop("_on")
