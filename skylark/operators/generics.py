"""Generic declarations: signatures read into columns, and type arguments carried up chains of extends."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.sources.shared import written

#: The letters of primitive types in signatures.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
#: Names of the type that all extend.
TOP = ("Object", "java.lang.Object")
_ARGUMENT = "struct<kind:string,text:string>"
_DECLARATION = f"struct<params:array<string>,supers:array<struct<name:string,args:array<{_ARGUMENT}>>>>"
_TOKEN = re.compile(r"[LT][^<>;:()]+|[<>;:()*+\[-]|.", re.S)


class _Unreadable(Exception):
    pass


class _Types:
    """The types of a signature, one token after the other; nesting is kept on a stack of its own, so no depth is too much."""

    def __init__(self, text: str):
        self.tokens, self.at = _TOKEN.findall(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        token = self.peek()
        if not token or wanted and token != wanted:
            raise _Unreadable
        self.at += 1
        return token

    def type(self) -> tuple[str, str, list[tuple[str, str]]]:
        """(kind: class, var or other; source text; arguments of a class as (kind, text)) of the next type."""
        # frames of open types: arrays around, name, arguments so far, what stands before the next argument
        frames: list[list] = []
        arrays, before = 0, ""
        while True:
            token = self.take()
            if token == "[":
                arrays += 1
                continue
            if token[0] == "T" and len(token) > 1:
                self.take(";")
                done = ("other" if arrays else "var", token[1:] + "[]" * arrays, [])
            elif token[0] == "L" and len(token) > 1:
                if self.peek() == "<":
                    self.take()
                    frames.append([arrays, token[1:], [], before])
                    arrays, before = 0, self._mark(frames[-1])
                    done = None if self.peek() != ">" else ()
                    if before and done == ():
                        raise _Unreadable
                else:
                    self.take(";")
                    done = ("other" if arrays else "class", token[1:] + "[]" * arrays, [])
            elif token in PRIMITIVES:
                done = ("other", PRIMITIVES[token] + "[]" * arrays, [])
            else:
                raise _Unreadable
            if done is None:
                continue
            while True:
                if not frames:
                    return done
                if done:
                    frames[-1][2].append((("exact-var" if done[0] == "var" else "exact" if done[0] != "class" or done[2] else "exact-name") if not before else "wild", before + done[1]))
                own = frames[-1]
                arrays, before = 0, self._mark(own)
                if self.peek() != ">":
                    break
                if before or not own[2]:  # a bound or an argument is due
                    raise _Unreadable
                self.take()
                self.take(";")
                frames.pop()
                text = f"{own[1]}<{', '.join(t for _, t in own[2])}>" + "[]" * own[0]
                done, before = ("other" if own[0] else "class", text, [(own[1], ""), *own[2]]), own[3]

    def _mark(self, own: list) -> str:
        """Wildcards before the next argument; those without a bound are arguments themselves."""
        while self.peek() == "*":
            self.take()
            own[2].append(("any", "?"))
        return {"+": "? extends ", "-": "? super "}[self.take()] if self.peek() in ("+", "-") else ""

    def parameters(self) -> list[str]:
        """Names of type parameters; their bounds are read and left out."""
        out = []
        self.take("<")
        while self.peek() != ">":
            name = ""
            while self.peek() != ":":
                name += self.take()
            out.append(name)
            while self.peek() == ":":
                self.take()
                if self.peek() != ":":
                    self.type()
        self.take(">")
        return out


def declared(signature: str | None) -> dict | None:
    """Parameters and supertypes of a type's signature; None for one that cannot be read whole."""
    if not signature or signature == "<empty>":
        return None
    try:
        types = _Types(signature)
        params, supers = types.parameters() if types.peek() == "<" else [], []
        while types.peek():
            kind, text, args = types.type()
            if kind != "class":
                return None
            supers.append({"name": args[0][0] if args else text, "args": [{"kind": k, "text": t} for k, t in args[1:]]})
        return {"params": params, "supers": supers}
    except _Unreadable:
        return None


def declaration(signature: Column) -> Column:
    """Params and supers (name, args as kind and source text) of type signatures, NULL for an unreadable one."""

    def read(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([declared(x) or {"params": None, "supers": None} for x in s], columns=["params", "supers"])

    both = F.pandas_udf(read, _DECLARATION)(signature)
    return F.when(both["params"].isNotNull(), both)


def supertypes(types: DataFrame) -> DataFrame:
    """(type, params, ord, parent, args): what each type extends, in order, args NULL where nothing tells them.

    types: type (qualified), signature, parents (qualified, erased). A written name stands for the parent that ends in it.
    """
    # dealt out by type, as a small table of many would be read in one task
    dealt = types.select("type", "parents", "signature").repartition(int(types.sparkSession.conf.get("spark.sql.shuffle.partitions")), "type")
    read = written(dealt.select("type", "parents", declaration(F.col("signature")).alias("d")), "declared")
    named = read.where("d IS NOT NULL").select("type", "parents", "d.params", F.posexplode("d.supers").alias("ord", "s")).where(~F.col("s.name").isin(*TOP))
    tail = lambda x: F.substring_index(x, ".", -1)
    match = F.filter("parents", lambda p: (p == F.col("s.name")) | ((tail(p) == tail(F.col("s.name"))) & ~F.contains(F.col("s.name"), F.lit("."))))
    told = named.select("type", "params", "ord", F.coalesce(F.get(match, F.lit(0)), F.col("s.name")).alias("parent"), F.col("s.args").alias("args"))
    blind = read.where("d IS NULL").select("type", F.array().cast("array<string>").alias("params"), F.posexplode("parents").alias("ord", "parent"), F.lit(None).cast(f"array<{_ARGUMENT}>").alias("args"))
    return told.unionByName(blind)


#: What an argument stands for: a parameter of the type where a path begins, or a text and the type that wrote it.
_VALUE = "struct<var:string,text:string,written_in:string>"


def _through(values: Column, names: Column, onward: Column) -> Column:
    """``onward``, which tells of the parameters ``names``, told by the values that those have."""
    return F.transform(onward, lambda v: F.when(v["var"].isNotNull(), F.get(values, F.array_position(names, v["var"]).cast("int") - 1)).otherwise(v))


def _jumps(steps: DataFrame) -> DataFrame:
    """(type, parent, their, is_marker, values): where the chain of each type with one way up leaves such types, by doubling.

    A round joins each open jump with the jump of the type where it ends, so a chain takes as many rounds as its length
    has binary digits. Chains that only lead to themselves reach nothing and have no row.
    """
    one = steps.groupBy("at").agg(F.count("*").alias("ways")).where("ways = 1").select("at")
    single = steps.join(one, "at", "left_semi").select(F.col("at").alias("type"), "parent", "their", "is_marker", "values")
    goes_on = one.select(F.col("at").alias("parent"), F.lit(True).alias("goes_on"))
    all_ = written(single.join(goes_on, "parent", "left").select("type", "parent", "their", "is_marker", "values", (F.col("is_marker").isNull() & F.col("goes_on").isNotNull()).alias("open")), "jumps")
    done, front = all_.where("NOT open"), all_.where("open")
    ends = done
    while not front.isEmpty():
        # only jumps at which others end are joined; the nearer the top, the fewer
        wanted = front.select(F.col("parent").alias("type")).distinct()
        onward = done.unionByName(front).join(wanted, "type", "left_semi").select(F.col("type").alias("parent"), F.struct("parent", "their", "is_marker", "values", "open").alias("on"))
        here = front.withColumnsRenamed({"their": "names", "values": "given"})  # a lambda would take a new column for an old one of its name
        new = here.join(onward, "parent").select("type", "on.parent", "on.their", "on.is_marker", _through(F.col("given"), F.col("names"), F.col("on.values")).alias("values"), "on.open")
        new = written(new, "jumps")
        closed = new.where("NOT open")
        if closed.isEmpty():  # what is open still goes round
            break
        ends, done, front = ends.unionByName(closed), done.unionByName(closed), new.where("open")
    return ends.drop("open")


def bindings(types: DataFrame, markers: DataFrame) -> DataFrame:
    """(type, marker, bound, written_in): the first marker that each type reaches up its extends, and the marker's first argument.

    markers: marker. Types are walked in the order in which supertypes are written, depth first, each carrying what its
    parameters stand for by position; a type's own parameters stand for nothing. A parameter stands for nothing
    either where the reference is raw or has another number of arguments, and a wildcard binds nothing. ``bound``
    is source text, ``written_in`` the type that wrote it. Cycles end where they close; a type without a marker has no row.
    Chains of types with one way up are jumped, so only types with several are walked one by one.
    """
    known = written(supertypes(types), "supers")
    first = types.select("type").distinct()
    parameters = known.groupBy("type").agg(F.first("params").alias("their")).withColumnRenamed("type", "parent")
    mark = markers.select(F.col("marker").alias("parent"), F.lit(True).alias("is_marker")).distinct()
    project = first.select(F.col("type").alias("parent"), F.lit(True).alias("is_project"))

    def stands_for(a: Column) -> Column:
        own = (a["kind"] == "exact-var") | ((a["kind"] == "exact-name") & F.array_contains("params", a["text"]))
        exact = a["kind"].isin("exact", "exact-name")
        none = F.lit(None).cast("string")
        return F.when(own, F.struct(a["text"].alias("var"), none.alias("text"), none.alias("written_in"))).when(exact, F.struct(none.alias("var"), a["text"].alias("text"), F.col("type").alias("written_in")))

    values = F.transform(F.coalesce("args", F.array().cast(f"array<{_ARGUMENT}>")), stands_for)
    blank = F.transform("their", lambda _: F.lit(None).cast(_VALUE))
    steps = known.withColumn("values", values).join(mark, "parent", "left").join(project, "parent", "left").join(parameters, "parent", "left").where("is_marker OR is_project").withColumn("their", F.coalesce("their", F.array().cast("array<string>")))
    steps = steps.withColumn("values", F.when(F.col("is_marker") | (F.size("values") == F.size("their")), F.col("values")).otherwise(blank))
    steps = written(steps.select(F.col("type").alias("at"), "ord", "parent", "their", "is_marker", "values"), "steps")
    jumps = written(_jumps(steps), "chains")
    several = steps.groupBy("at").agg(F.count("*").alias("ways")).where("ways > 1").select("at")
    jump = jumps.select(F.col("type").alias("parent"), F.struct("parent", "their", "is_marker", "values").alias("j"))
    far = steps.join(several, "at", "left_semi").withColumn("up", F.struct("parent", "their", "is_marker", "values")).join(jump, "parent", "left")
    # a way up from a type with several goes on through the chain that it enters, where it enters one
    skips = F.col("up.is_marker").isNull() & F.col("j").isNotNull()
    skipped = F.struct(F.col("j.parent").alias("parent"), F.col("j.their").alias("their"), F.col("j.is_marker").alias("is_marker"), _through(F.col("up.values"), F.col("up.their"), F.col("j.values")).alias("values"))
    far = written(far.select("at", "ord", F.when(skips, skipped).otherwise(F.col("up")).alias("to")).select("at", "ord", "to.*"), "ways")
    nowhere = F.array().cast("array<int>")
    found = jumps.where("is_marker").select(F.col("type").alias("root"), nowhere.alias("trail"), F.col("parent").alias("marker"), F.get("values", F.lit(0)).alias("b"))
    start = jumps.where("is_marker IS NULL").select(F.col("type").alias("root"), F.col("parent").alias("at"), "their", "values").join(several, "at", "left_semi")
    own = several.join(parameters.withColumnRenamed("parent", "at"), "at", "left").select(F.col("at").alias("root"), "at", F.coalesce("their", F.array().cast("array<string>")).alias("their")).withColumn("values", blank)
    front = written(start.select("root", "at", "their", "values").unionByName(own.select("root", "at", "their", "values")).select("*", nowhere.alias("trail"), F.array_distinct(F.array("root", "at")).alias("seen")), "walk")
    while not front.isEmpty():
        here = front.select("root", "at", F.col("their").alias("names"), F.col("values").alias("env"), "trail", "seen")
        met = here.join(far, "at").withColumn("trail", F.concat("trail", F.array("ord"))).withColumn("values", _through(F.col("env"), F.col("names"), F.col("values")))
        met = written(met.select("root", "parent", "their", "is_marker", "values", "trail", "seen"), "walk")
        found = found.unionByName(met.where("is_marker").select("root", "trail", F.col("parent").alias("marker"), F.get("values", F.lit(0)).alias("b")))
        on = met.where("is_marker IS NULL").where(~F.array_contains("seen", F.col("parent"))).select("root", F.col("parent").alias("at"), "their", "values", "trail", F.concat("seen", F.array("parent")).alias("seen"))
        # of several ways of one length to a type the first in order counts
        front = written(on.groupBy("root", "at").agg(F.min_by(F.struct("their", "values", "trail", "seen"), "trail").alias("s")).select("root", "at", "s.*"), "walk")
    best = found.groupBy("root").agg(F.min_by(F.struct("marker", "b"), "trail").alias("f"))
    return best.select(F.col("root").alias("type"), "f.marker", F.col("f.b.text").alias("bound"), F.col("f.b.written_in").alias("written_in"))


def resolved(bound: DataFrame, types: DataFrame) -> DataFrame:
    """bound with ``entity``: the qualified type that its text names where it was written: by full name, in the same package, else alone of that name."""
    package = lambda c: F.regexp_replace(c, r"[.]?[^.]+$", "")
    full = types.select(F.col("type").alias("bound"), F.lit(True).alias("_full")).distinct()
    beside = types.select(F.substring_index("type", ".", -1).alias("bound"), package(F.col("type")).alias("_package"), F.col("type").alias("_beside")).distinct()
    alone = types.groupBy(F.substring_index("type", ".", -1).alias("bound")).agg(F.when(F.count_distinct("type") == 1, F.min("type")).alias("_alone"))
    out = bound.withColumn("_package", package(F.col("written_in"))).join(full, "bound", "left").join(beside, ["bound", "_package"], "left").join(alone, "bound", "left")
    return out.withColumn("entity", F.coalesce(F.when(F.col("_full"), F.col("bound")), "_beside", "_alone")).drop("_full", "_package", "_beside", "_alone")
