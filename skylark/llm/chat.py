"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import materialise

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_RESULT = re.compile(r"<tool_result>(.*?)</tool_result>", re.S)
#: An argument that is another call's result: {"$result": "<call id>"}.
_REFERENCE = "$result"
#: Levels up to which calls and results may nest; deeper ones count as no objects.
DEEPEST = 100
_PARSED = (
    "row long, conv_id long, turn long, role string, content string, "
    "calls array<struct<id:string,name:string,arguments:string,errors:array<string>,refs:array<string>>>, results array<struct<id:string,content:string>>"
)


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def shallow(value: object, deepest: int) -> bool:
    """Whether lists and objects nest at most so many levels; level by level, so no depth is too much for this."""
    level = [value]
    for _ in range(deepest):
        level = [y for x in level if isinstance(x, list | dict) for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, list | dict)]
        if not level:
            return True
    return False


_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def violations(value: object, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a JSON schema: type, enum, required, properties, additionalProperties, items, minimum, maximum."""
    if isinstance(value, dict) and _REFERENCE in value:  # stands for a result that is not known yet
        return []
    kinds = schema.get("type")
    out = []
    if kinds:
        number = isinstance(value, int | float) and not isinstance(value, bool)
        fits = {k: isinstance(value, t) for k, t in _TYPES.items()} | {"number": number, "integer": number and float(value).is_integer()}
        if not any(fits.get(k, False) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return [f"{path}: type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: enum")
    if isinstance(value, int | float) and not isinstance(value, bool):
        out += [f"{path}: minimum"] * (value < schema.get("minimum", value)) + [f"{path}: maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{path}.{k}: required" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: unknown" for k in sorted(value) if k not in own]
        for k in sorted(own.keys() & value.keys()):
            out += violations(value[k], own[k], f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    return out


def _references(value: object) -> set[str]:
    if isinstance(value, dict):
        own = {value[_REFERENCE]} if isinstance(value.get(_REFERENCE), str) else set()
        return own.union(*map(_references, value.values()))
    return set().union(*map(_references, value)) if isinstance(value, list) else set()


def _objects(pattern: re.Pattern, text: str) -> list[dict | None]:
    out = []
    for m in pattern.finditer(text):
        try:
            x = json.loads(m[1])
            # what is no canonical JSON is no object: too deep, NaN, infinite, or with half a surrogate pair
            x = x if shallow(x, DEEPEST) and canonical(x).encode() else None
        except (ValueError, RecursionError):
            x = None
        out.append(x if isinstance(x, dict) else None)
    return out


def parse(text: str, schemas: dict[str, dict]) -> tuple[str, list[tuple], list[tuple]]:
    """The text without its tool elements, its calls and its results."""
    calls, results = [], []
    for x in _objects(_CALL, text):
        if x is None or not isinstance(x.get("id"), str):
            calls.append((None, None, None, ["call: no object with an id"], []))
            continue
        name, arguments = x.get("name"), x.get("arguments", {})
        schema = schemas.get(name) if isinstance(name, str) else None
        errors = ["name: unknown tool"] if schema is None else violations(arguments, schema)
        calls.append((x["id"], name if isinstance(name, str) else None, canonical(arguments), errors, sorted(_references(arguments))))
    for x in _objects(_RESULT, text):
        if x is not None and isinstance(x.get("id"), str):
            results.append((x["id"], canonical(x.get("content"))))
    bare = _RESULT.sub("", _CALL.sub("", text)).strip() if calls or results or "<tool_" in text else text
    return bare, calls, results


def order(needs: DataFrame, turns: DataFrame) -> DataFrame:
    """(row, at, depth): after which turn and how many steps behind it a row comes, for rows with needs.

    needs: (row, before): ``before`` must come first. Rows settle once all that they need has; what
    is left when no row settles any more lies on or behind a cycle and has no place here.
    """
    needs = materialise(needs.distinct(), "needs")
    own = turns.select("row", "turn")
    # rows that nothing holds back stand at their own turn
    free = needs.select(F.col("before").alias("row")).distinct().join(needs.select("row").distinct(), "row", "left_anti")
    settled = materialise(free.join(own, "row").select("row", F.col("turn").alias("at"), F.lit(0).alias("depth")), "settled")
    left = needs
    while not left.isEmpty():  # a round settles a row or is the last
        known = left.join(settled.withColumnRenamed("row", "before"), "before", "left")
        ready = known.groupBy("row").agg(F.max(F.struct("at", F.col("depth"))).alias("last"), F.count_if(F.col("at").isNull()).alias("open")).where("open = 0")
        ready = ready.join(own, "row").select("row", F.greatest("turn", "last.at").alias("at"), F.when(F.col("turn") > F.col("last.at"), 0).otherwise(F.col("last.depth") + 1).alias("depth"))
        ready = materialise(ready, "ready")
        if ready.isEmpty():
            break
        settled = materialise(settled.unionByName(ready), "settled")
        left = materialise(left.join(ready.select("row"), "row", "left_anti"), "needs")
    return settled


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, order_turn, order_depth, role, message, n_calls, n_linked, n_invalid, n_orphans, cyclic.

    messages: conv_id, turn, role, text. Calls stand in a text as <tool_call>{"id", "name", "arguments"}
    </tool_call> and results as <tool_result>{"id", "content"}</tool_result>. Results are joined to
    calls by (conv_id, id); of calls with the same id in a conversation the first counts. A message
    follows the calls whose results it has and the results that its arguments refer to; sorted by
    (order_turn, order_depth, turn) a conversation is in topological order. Messages on or behind a
    cycle stay at their own turn and are marked cyclic.

    A null text counts as empty, a null role as "unknown"; null conv_ids or turns stay null and link
    with nothing. Malformed calls are counted as invalid, results without a call as orphans. Repeated
    rows are formatted each; an empty table gives no rows; other columns are ignored.
    """
    schemas = schemas or {}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [parse(t if isinstance(t, str) else "", schemas) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(content=[p[0] for p in parsed], calls=[p[1] for p in parsed], results=[p[2] for p in parsed])

    rows = messages.select(
        F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.col("text").cast("string").alias("text"),
    )
    parsed = materialise(rows.mapInPandas(read, _PARSED), "chat")
    calls = parsed.select("row", "conv_id", "turn", F.posexplode("calls").alias("i", "call")).where("call.id IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    first = calls.groupBy("conv_id", F.col("call.id").alias("id")).agg(F.min(F.struct("turn", "row", "i")).alias("at"))
    first = first.select("conv_id", "id", F.col("at.row").alias("call_row"), F.col("at.i").alias("i"))
    results = parsed.select("row", "conv_id", F.explode("results").alias("result")).where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("row").alias("result_row"), "conv_id", F.col("result.id").alias("id"))
    links = materialise(results.join(first, ["conv_id", "id"]), "chat-links")
    refs = calls.select(F.col("row").alias("ref_row"), "conv_id", F.explode("call.refs").alias("id"))
    needs = links.select(F.col("result_row").alias("row"), F.col("call_row").alias("before")).union(refs.join(links, ["conv_id", "id"]).select("ref_row", "result_row")).where("row <> before")
    needs = materialise(needs, "chat-needs")
    turns = parsed.select("row", "turn")
    place = order(needs, turns)
    cyclic = needs.select("row").distinct().join(place.select("row"), "row", "left_anti").withColumn("cyclic", F.lit(True))
    answered = links.groupBy(F.col("call_row").alias("row")).agg(F.collect_set("i").alias("linked"))
    found = links.groupBy(F.col("result_row").alias("row")).agg(F.countDistinct("id").alias("known"))
    full = parsed.join(place, "row", "left").join(cyclic, "row", "left").join(answered, "row", "left").join(found, "row", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, n_calls, n_linked, n_invalid, n_orphans = [], [], [], [], []
            for r in pdf.itertuples(index=False):
                linked = set() if r.linked is None else {int(i) for i in r.linked}
                message: dict = {"role": r.role, "content": r.content}
                if len(r.calls):
                    message["tool_calls"] = [
                        {"id": c["id"], "name": c["name"], "arguments": None if c["arguments"] is None else json.loads(c["arguments"]), "linked": i in linked, "errors": list(c["errors"])} for i, c in enumerate(r.calls)
                    ]
                if len(r.results):
                    message["tool_results"] = [{"id": x["id"], "content": json.loads(x["content"])} for x in r.results]
                text.append(canonical(message))
                n_calls.append(len(r.calls))
                n_linked.append(len(linked))
                n_invalid.append(sum(len(c["errors"]) > 0 for c in r.calls))
                n_orphans.append(len({x["id"] for x in r.results}) - (0 if pd.isna(r.known) else int(r.known)))
            yield pdf[["conv_id", "turn", "order_turn", "order_depth", "role", "cyclic"]].assign(message=text, n_calls=n_calls, n_linked=n_linked, n_invalid=n_invalid, n_orphans=n_orphans)

    shown = full.select(
        "conv_id", "turn", F.coalesce("at", "turn").alias("order_turn"), F.coalesce("depth", F.lit(0)).cast("int").alias("order_depth"), "role",
        "content", "calls", "results", "linked", "known", F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )
    return shown.mapInPandas(write, "conv_id long, turn long, order_turn long, order_depth int, role string, cyclic boolean, message string, n_calls long, n_linked long, n_invalid long, n_orphans long")
