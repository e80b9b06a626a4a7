"""What annotated queries do: each shape of statements as rows of tokens, read by windows, names by joins to a catalog.

queries: query_id, service_id, text, native, mongo, repository_entity, repository_text.
entities: service_id, entity (qualified), jpql_name, storage_name, storage_schema, delete_rewritten.
fields: service_id, owner, field, type_name, declared_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylark.sources.shared import written

_WORD = r"[\p{L}_$][\p{L}\p{N}_$]*+"
_SEGMENT = rf"""(?:{_WORD}|"[^"]*+(?:""[^"]*+)*+"?|`[^`]*+(?:``[^`]*+)*+`?)"""
_SPEL = r"#\{[^{}]*+(?:\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}[^{}]*+)*+\}"
#: White space, comments, literals, expressions, parameters, numbers, names, anything else; each repeat is possessive or lazy, so no text backtracks.
TOKEN = "(?s)" + "|".join((
    r"[\s\p{Z}]++", r"--[^\n]*+\n?", r"/\*.*?(?:\*/|\z)", r"'[^']*+(?:''[^']*+)*+'?", _SPEL, rf"[?:]{_SPEL}", r"\?[\p{L}\p{N}_]*+", r":[\p{L}_$][\p{L}\p{N}_]*+",
    r"\p{Nd}[\p{L}\p{N}.]*+", rf"{_SEGMENT}(?:\.{_SEGMENT})*+", "::", ".",
))

# fixed values: verbs with what they do, words that end a from clause, words that are no alias, modifiers of SQL, erased collection types
VERBS = {"select": "read", "update": "update", "delete": "delete", "insert": "create"}
CLAUSES = ("where", "group", "order", "having", "union", "intersect", "except", "set", "limit", "offset", "fetch", "for", "returning", "window", "values", "select")
NO_ALIAS = (*CLAUSES, "from", "join", "left", "right", "inner", "outer", "cross", "full", "natural", "on", "using", "with")
MODIFIERS = ("ignore", "low_priority", "delayed", "high_priority", "quick", "only")
CONTAINERS = (
    "Collection", "List", "Set", "SortedSet", "NavigableSet", "Queue", "Deque", "Map", "SortedMap", "NavigableMap", "ArrayList", "LinkedList", "HashSet", "LinkedHashSet", "TreeSet",
    "HashMap", "LinkedHashMap", "TreeMap",
)
OWN_ENTITY = "#{#entityName}"
_QUALIFIED = (*(f"java.util.{c}" for c in CONTAINERS), "java.lang.Iterable")
_DOLLAR = r"^\$([A-Za-z_][A-Za-z0-9_]*)?\$"
#: All words that reading by position tells apart; shapes keep them.
GRAMMAR = tuple(sorted({*VERBS, *NO_ALIAS, *MODIFIERS, "into", "as", "in", "lateral", "dual", "duplicate", "key", "conflict", "do"}))
#: What parts the tokens of a shape.
_PART = "\x01"
#: Bytes of read shapes up to which they go to every task.
SMALL = 32 << 20


def element_type(declared: Column) -> Column:
    """the type that a declared field type holds: its last type argument, else itself; NULL where a wildcard leaves it open."""
    text = F.trim(declared)
    at = F.instr(text, F.lit("<"))
    inner = text.substr(at + 1, F.length(text) - at - 1)
    for _ in range(8):
        inner = F.regexp_replace(inner, "<[^<>]*>", "")
    last = F.when((at > 0) & F.endswith(text, F.lit(">")), F.trim(F.substring_index(inner, ",", -1))).otherwise(text)
    name = F.trim(F.regexp_replace(F.trim(F.substring_index(last, "<", 1)), r"^\? extends ", ""))
    return F.when((name != "") & ~F.startswith(name, F.lit("?")), name)


def field_targets(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """(service_id, owner, field, target, is_entity): the entity that a field reaches.

    A written type that is no entity's has is_entity false; one that cannot be read, or that several
    entities share, has neither. Fields of other owners than entities reach nothing known.
    """
    full = entities.select("service_id", F.col("entity").alias("_full")).distinct()
    simple = full.groupBy("service_id", F.substring_index("_full", ".", -1).alias("_simple")).agg(F.count("*").alias("_n"), F.min("_full").alias("_only"))
    own = fields.dropDuplicates(["service_id", "owner", "field"]).withColumn("_element", element_type(F.col("declared_type")))
    met = own.join(full.withColumnRenamed("_full", "owner"), ["service_id", "owner"], "left_semi")
    met = met.join(full.select("service_id", F.col("_full").alias("type_name"), F.lit(True).alias("_direct")), ["service_id", "type_name"], "left")
    met = met.join(full.select("service_id", F.col("_full").alias("_element"), F.lit(True).alias("_exact")), ["service_id", "_element"], "left")
    met = met.join(simple.withColumnRenamed("_simple", "_element"), ["service_id", "_element"], "left")
    raw = F.col("type_name").isin(*_QUALIFIED) & F.col("_element").isin(*_QUALIFIED, *CONTAINERS)
    known = F.col("_element").isNotNull() & ~F.coalesce(raw, F.lit(False))
    target = F.when(F.col("_direct"), F.col("type_name")).when(known & F.col("_exact"), F.col("_element")).when(known & (F.col("_n") == 1), F.col("_only"))
    return met.select("service_id", "owner", "field", target.alias("target"), F.when(target.isNotNull(), True).when(known & F.col("_n").isNull(), False).alias("is_entity"))


def _gap(t: Column) -> Column:
    return t.rlike(r"^([\s\p{Z}]|--|/\*)")


def _hidden(t: Column) -> Column:
    return F.startswith(t, F.lit("/*")) & (F.startswith(t, F.lit("/*!")) | F.contains(F.substring(t, 3, 1 << 30), F.lit("/*")))


def _bad(t: Column) -> Column:
    return _hidden(t) | (t == "#") | t.rlike(_DOLLAR) | (F.startswith(t, F.lit("'")) & F.contains(t, F.lit("\\")))


def tokens(queries: DataFrame) -> DataFrame:
    """(query_id, native, n, t, off, word, glued, bad): each statement's tokens in order, comments and spaces dropped.

    ``word`` is a single unquoted name in lower case, ``off`` a token's place in its text, ``glued`` whether nothing
    parts it from the token before, ``bad`` a construct that could hide text from this reader: an executable or
    nested comment, a lone ``#``, a dollar quote, a backslash in a literal, or anything after a semicolon.
    """
    w = Window.partitionBy("query_id").orderBy("k")
    raw = queries.where("text IS NOT NULL").select("query_id", "native", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("k", "t"))
    t = F.col("t")
    gap, bad = _gap(t), _bad(t)
    ended = F.coalesce(F.max(t == ";").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    raw = raw.withColumn("off", F.sum(F.length("t")).over(w) - F.length("t")).withColumn("gap", gap).withColumn("bad", bad | (~gap & ended))
    raw = raw.withColumn("glued", ~F.coalesce(F.lag("gap").over(w), F.lit(True))).where("NOT gap OR bad")
    word = F.when(t.rlike(f"^{_WORD}$"), F.lower(t))
    return raw.select("query_id", "native", F.row_number().over(w).alias("n"), "t", "off", word.alias("word"), "glued", "bad")


def shaped(queries: DataFrame) -> DataFrame:
    """queries with ``tokens`` (comments and spaces dropped) and ``shape``: all that reading them by position depends on.

    In a shape every name but a word of the grammar, every literal, number and parameter stands for its kind. A
    space before a token tells that it is not glued to the one before. Shapes of SQL start with s, others with o.
    """
    space = lambda t: F.regexp_replace(t, r"[\s\p{Z}]+", "")
    kind = lambda t: (
        F.when(t.isin("(", ")", ",", ".", ";", "#"), t).when(t.rlike(_DOLLAR), "$$").when(t.rlike(f"^{_WORD}$"), F.when(F.lower(t).isin(*GRAMMAR), F.lower(t)).otherwise("x"))
        .when(t.rlike(f"^{_SEGMENT}"), "x.x").when(F.startswith(t, F.lit("#{")), F.when(space(t) == OWN_ENTITY, OWN_ENTITY).otherwise("#{x}"))
        .when(F.startswith(t, F.lit("'")), F.when(F.contains(t, F.lit("\\")), "'\\").otherwise("'")).when(t.rlike(r"^\p{Nd}"), "1").when(F.startswith(t, F.lit("/*")), "/*!").otherwise("~")
    )
    raw = queries.withColumn("_raw", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).withColumn("_gaps", F.transform("_raw", _gap))
    glued = lambda i: (i > 0) & ~F.coalesce(F.get("_gaps", i - 1), F.lit(True))
    kept = F.filter(F.transform("_raw", lambda t, i: F.struct(t.alias("t"), F.get("_gaps", i).alias("gap"), glued(i).alias("glued"))), lambda x: ~x["gap"] | _hidden(x["t"]))
    kept = raw.withColumn("_kept", kept).withColumn("tokens", F.transform("_kept", lambda x: x["t"]))
    shape = F.array_join(F.transform("_kept", lambda x: F.concat(F.when(x["glued"], "").otherwise(" "), kind(x["t"]))), _PART)
    return kept.withColumn("shape", F.when(F.size("tokens") > 0, F.concat(F.when(F.col("native"), "s").otherwise("o"), shape))).drop("_raw", "_gaps", "_kept")


def shape_tokens(shapes: DataFrame) -> DataFrame:
    """The columns of ``tokens`` for each shape, by its query_id; a token of a shape has no place in a text, so ``off`` is 0."""
    w = Window.partitionBy("query_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    parts = shapes.select("query_id", F.startswith("shape", F.lit("s")).alias("native"), F.posexplode(F.split(F.substring("shape", 2, 1 << 30), _PART)).alias("k", "s"))
    t = F.ltrim("s")
    raw = parts.select("query_id", "native", (F.col("k") + 1).alias("n"), t.alias("t"), F.lit(0).alias("off"), F.when(t.rlike(f"^{_WORD}$"), t).alias("word"), (~F.startswith("s", F.lit(" "))).alias("glued"))
    return raw.withColumn("bad", _bad(F.col("t")) | F.coalesce(F.max(F.col("t") == ";").over(w), F.lit(False)))


def parsed(df: DataFrame) -> DataFrame:
    """rows of ``tokens`` with what each does in its statement, read by position.

    Beside the columns of ``tokens``: ``depth`` and ``frame`` (the parenthesis that a token lies in, by the place
    of its opening, with ``close``), ``top`` (in the statement itself), ``first`` (place of the verb) and ``verb``,
    ``into`` and ``from_clause`` for words of the statement itself, ``named`` (a declaration starts here), ``target``
    (it is what a write statement writes), ``called`` (a parenthesis follows) and what follows for aliases.

    A parenthesis is a query's if ``select`` follows it. ``from``, ``join`` and the commas of a from clause open a
    declaration unless they are names themselves; a clause word in a name's place ends no from clause.
    """
    w = Window.partitionBy("query_id").orderBy("n")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    no = F.lit(False)
    t, word = F.col("t"), F.col("word")
    ahead = lambda c, i: F.lead(c, i).over(w)
    step = F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
    df = df.withColumn("_sum", F.sum(step).over(upto)).withColumn("next_t", ahead("t", 1)).withColumn("next_word", ahead("word", 1)).withColumn("then_word", ahead("word", 2)).withColumn("in_t", ahead("t", 2))
    df = df.withColumn("in_close", ahead("t", 3)).withColumn("last_word", F.lag("word").over(w)).withColumn("first", F.min(F.when(t != "(", F.col("n"))).over(Window.partitionBy("query_id")))
    df = df.withColumn("_after", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto))).withColumn("depth", F.col("_after") - (t == "(").cast("int"))
    level = Window.partitionBy("query_id", "_level").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opening = F.when(t == "(", F.struct("n", (F.coalesce(F.col("next_word"), F.lit("")) == "select").alias("query")))
    df = df.withColumn("_level", F.col("_after") + (t == ")").cast("int")).withColumn("_in", F.last(opening, True).over(level))
    df = df.withColumn("frame", F.coalesce("_in.n", F.lit(0))).withColumn("query", F.coalesce("_in.query", F.lit(True)))
    df = df.withColumn("close", F.min(F.when(t == ")", F.col("n"))).over(Window.partitionBy("query_id", "frame"))).withColumn("top", F.col("depth") < F.col("first"))
    df = df.withColumn("_skip", F.col("native") & F.coalesce(word.isin(*MODIFIERS), no))
    # what stands before a token, modifiers of SQL aside
    prev = lambda c: F.last(F.when(~F.col("_skip"), c), True).over(before)
    df = df.withColumn("verb", F.max(F.when(F.col("n") == F.col("first"), word)).over(Window.partitionBy("query_id")))
    df = df.withColumn("_head", (F.col("n") == F.col("first")) & F.coalesce(word.isin("update", "delete", "insert"), no))
    df = df.withColumn("_fj", F.col("query") & F.coalesce(word.isin("from", "join"), no)).withColumn("_fetch", F.coalesce((word == "fetch") & (F.col("last_word") == "join"), no))
    df = df.withColumns({"_p_t": prev(t), "_p_head": F.coalesce(prev(F.col("_head")), no), "_p_fj": F.coalesce(prev(F.col("_fj")), no), "_p_fetch": F.coalesce(prev(F.col("_fetch")), no)})
    df = df.withColumn("_lead_in", F.col("_p_head") & F.coalesce(word.isin("from", "into"), no))
    df = df.withColumns({"_p_into": F.coalesce(prev(F.col("_lead_in") & (word == "into")), no), "_run": F.sum((F.col("_fj") & ~F.col("_p_fj")).cast("int")).over(upto)})
    # in a run of from and join every second one is a name; the first is one where a name is due
    run = Window.partitionBy("query_id", "_run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("_fj") & ~F.col("_p_fj")
    due = F.col("_p_into") | F.col("_p_fetch") | (F.col("_p_head") & (word == "join"))
    df = df.withColumns({"_nth": F.sum(F.col("_fj").cast("int")).over(run), "_due": F.coalesce(F.max(starts & due).over(run), no), "_comma_run": F.coalesce(F.max(starts & (F.col("_p_t") == ",")).over(run), no)})
    df = df.withColumn("_open", F.col("_fj") & ((F.col("_nth") + F.col("_due").cast("int")) % 2 == 1))
    df = df.withColumn("_p_open", F.coalesce(prev(F.col("_open")), no))
    name_due = F.col("_p_open") | F.col("_p_fetch") | F.col("_p_into") | (F.col("_p_head") & ~F.col("_lead_in"))
    ends = F.coalesce(word.isin(*CLAUSES), no) & ~name_due & ~F.col("_fetch") & (F.coalesce(F.col("_p_t"), F.lit("")) != ",")
    change = F.when(F.col("_open") & (word == "from") & ~F.col("_comma_run"), True).when(ends, False)
    inside = Window.partitionBy("query_id", "frame").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in_from", F.coalesce(F.last(change, True).over(inside), no)).withColumn("_comma", (t == ",") & F.col("query") & F.col("_in_from"))
    df = df.withColumn("_p_comma", F.coalesce(prev(F.col("_comma")), no))
    df = df.withColumn("_due", F.col("_due") | F.coalesce(F.max(starts & F.col("_p_comma")).over(run), no)).withColumn("_open", F.col("_fj") & ((F.col("_nth") + F.col("_due").cast("int")) % 2 == 1))
    df = df.withColumn("_p_open", F.coalesce(prev(F.col("_open")), no)).withColumn("_p_lead", F.coalesce(prev(F.col("_lead_in")), no))
    named = ~F.col("_skip") & ~F.col("_fetch") & (F.col("_p_open") | F.col("_p_comma") | F.col("_p_fetch") | F.col("_p_into") | (F.col("_p_head") & ~F.col("_lead_in")))
    df = df.withColumn("named", named).withColumn("target", named & (F.col("_p_head") | F.col("_p_lead"))).withColumn("called", F.coalesce(F.col("next_t") == "(", no))
    df = df.withColumn("from_clause", F.col("top") & ((F.col("_open") & (word == "from") & ~F.col("_p_head")) | F.col("_comma")))
    # names and expressions written against each other are one name
    name, spel = t.rlike(f"^{_SEGMENT}"), F.startswith(t, F.lit("#{"))
    df = df.withColumns({"name": name, "spel": spel, "_part": name | spel | (t == ".") | t.rlike(r"^\p{Nd}")}).withColumn("_island", F.sum((~(F.col("glued") & F.col("_part"))).cast("int")).over(upto))
    onward = Window.partitionBy("query_id", "_island").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("query_id").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(~(F.col("glued") & F.col("_part")), F.struct("word", "next_word", "n"))
    df = df.withColumns({"run_spel": F.max("spel").over(onward), "run_n": F.count("*").over(onward), "run_end": F.max(F.col("off") + F.length("t")).over(onward), "_beyond": F.last(start, True).over(back)})
    as_name = lambda a, b: F.when(a == "as", b).otherwise(a)
    alias = F.when(F.col("run_spel"), as_name(F.col("_beyond.word"), F.col("_beyond.next_word"))).otherwise(as_name(F.col("next_word"), F.col("then_word")))
    df = df.withColumn("alias", F.when(F.col("named") & ~alias.isin(*NO_ALIAS), alias))
    past = lambda word, n: F.when(word == "as", n + 1).otherwise(n)
    alias_n = F.when(F.col("run_spel"), past(F.col("_beyond.word"), F.col("_beyond.n"))).otherwise(past(F.col("next_word"), F.col("n") + 1))
    df = df.withColumn("alias_n", F.when(F.col("alias").isNotNull(), alias_n))
    taken = F.coalesce((F.lag("alias").over(w) == "into") | ((F.col("last_word") == "as") & (F.lag("alias", 2).over(w) == "into")), no)
    return df.withColumn("into", F.coalesce(F.col("top") & (word == "into") & ~named & ~taken & ~F.col("_lead_in"), no))


def _read_shapes(shapes: DataFrame) -> DataFrame:
    """(shape, verb, sound, calls, table, own_table, declared) of each shape: what a statement of it is, with its declarations by token numbers."""
    df = written(parsed(shape_tokens(shapes)).where("verb IS NOT NULL OR bad"), "tokens")
    word, no = F.col("word"), F.lit(False)
    member = ~F.col("native") & F.coalesce(word == "in", no) & F.col("called") & F.coalesce(F.col("in_close") == ")", no) & ~F.col("run_spel")
    path = F.col("in_t").rlike(f"^{_SEGMENT}")
    plain = F.col("name") & (F.col("target") | ~F.col("called"))
    kind = F.when(F.col("run_spel"), F.when((F.col("run_n") == 1) & (F.col("t") == OWN_ENTITY), "own").otherwise("opaque")).when(member, "name").when(plain, "name")
    found = df.where("named").withColumn("_member", member).withColumn("kind", kind).withColumn("_at", F.when(F.col("_member"), F.col("n") + 2).otherwise(F.col("n")))
    one = F.struct("n", "frame", "close", "kind", F.col("_at").alias("at"), F.when(~F.col("_member"), F.col("alias_n")).alias("alias_n"), "target", F.col("run_n").cast("int").alias("run_n"))
    dual = F.when(F.col("_member"), F.col("in_t")).otherwise(F.col("t")) == "dual"
    tables = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("declared"), F.max(F.col("top") & (F.col("kind") == "own")).alias("own_table"),
        F.max(F.col("top") & F.coalesce(F.col("kind") == "opaque", no) | (F.col("top") & (F.col("kind") == "name") & ~dual)).alias("_table"), F.max(F.col("_member") & ~path).alias("_no_path"),
        F.max(F.col("top") & F.col("kind").isNull() & ((F.col("t") == "(") | F.coalesce(word == "lateral", no))).alias("_derived"),
    )
    words = F.concat(F.lit(" "), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("verb") == "insert", F.struct("n", F.coalesce("word", F.lit("?")).alias("word"))))), lambda x: x["word"]), " "), F.lit(" "))
    upsert = F.contains(words, F.lit(" on duplicate key update ")) | (F.contains(words, F.lit(" on conflict ")) & F.contains(words, F.lit(" do update ")))
    told = df.groupBy("query_id").agg(F.max("verb").alias("verb"), F.max("bad").alias("_bad"), F.max("into").alias("_into"), F.max("from_clause").alias("_from"), upsert.alias("_upsert"))
    told = told.join(tables, "query_id", "left").join(shapes, "query_id")
    sound = F.coalesce(F.col("verb").isin(*VERBS) & ~F.col("_bad") & ~F.col("_upsert") & ~F.coalesce("_no_path", no), no)
    return told.select("shape", "verb", sound.alias("sound"), (F.col("_into") | ~F.col("_from")).alias("calls"), (F.coalesce("_table", no) | F.coalesce("_derived", no)).alias("table"), F.coalesce("own_table", no).alias("own_table"), "declared")


def declarations(queries: DataFrame) -> DataFrame:
    """Every query with ``operation`` (its verb's), ``is_read`` and, where it is read, what it ``declared``.

    declared: n, frame, close, kind (own, opaque, name), t (the name), written, target, alias. Each shape of
    statements is read once, however many statements have it.
    Not read, so NULL and never a guess: no text, documents' queries, verbs beside the four, inserts that update on
    conflict, text with a construct of ``tokens``' bad, member declarations over no path, and SQL that only calls.
    """
    own = ["query_id", "service_id", "native", "mongo", "repository_entity", "repository_text"]
    rows = written(shaped(queries).select(*own, "tokens", "shape"), "shaped")
    shapes = written(rows.where("shape IS NOT NULL").select("shape").distinct().withColumn("query_id", F.monotonically_increasing_id()), "shapes")
    known = written(_read_shapes(shapes), "read-shapes")
    size = known.agg(F.sum(F.length("shape") + 100 * F.coalesce(F.size("declared"), F.lit(0)) + 100)).first()[0] or 0
    met = rows.join(F.broadcast(known) if size <= SMALL else known, "shape", "left")
    no = F.lit(False)
    table = F.col("table") | (F.col("own_table") & (F.lower(F.coalesce("repository_text", F.lit(OWN_ENTITY))) != "dual"))
    calls_only = F.col("native") & (F.col("verb") == "select") & (F.col("calls") | ~table)
    read = F.coalesce(F.col("sound") & ~calls_only & (F.col("native") | ~F.col("mongo")), no)
    operation = F.lit(None).cast("string")
    for verb, value in VERBS.items():
        operation = F.when(F.col("verb") == verb, value).otherwise(operation)
    token = lambda n: F.get("tokens", n - 1)
    shown = lambda d: F.when(d["kind"] == "own", F.coalesce("repository_text", F.lit(OWN_ENTITY))).when(d["kind"] == "opaque", F.array_join(F.slice("tokens", d["n"], d["run_n"]), "")).otherwise(token(d["at"]))
    declared = F.transform("declared", lambda d: F.struct(d["n"].alias("n"), d["frame"].alias("frame"), d["close"].alias("close"), d["kind"].alias("kind"), token(d["at"]).alias("t"), shown(d).alias("written"), d["target"].alias("target"), F.lower(token(d["alias_n"])).alias("alias")))
    met = met.withColumn("is_read", read)
    return met.select("query_id", "service_id", "native", "repository_entity", "repository_text", operation.alias("operation"), "is_read", F.when(F.col("is_read"), declared).alias("declared"))


def _unquoted(segment: Column) -> Column:
    body = F.regexp_replace(segment, r'^["`]|["`]$', "")
    return F.when(F.startswith(segment, F.lit('"')), F.replace(body, F.lit('""'), F.lit('"'))).when(F.startswith(segment, F.lit("`")), F.replace(body, F.lit("``"), F.lit("`"))).otherwise(segment)


def _table_part(text: Column) -> Column:
    """A written part of a table's name as a key: exact in quotes, else case aside."""
    return F.when(text.rlike('^["`]'), F.concat(F.lit("q"), _unquoted(text))).otherwise(F.concat(F.lit("l"), F.lower(text)))


def _table_key(t: Column) -> Column:
    parts = F.regexp_extract_all(t, F.lit(_SEGMENT), F.lit(0))
    key = F.concat(F.lit("t"), _table_part(F.element_at(parts, -1)), F.lit(_PART), F.when(F.size(parts) == 2, _table_part(F.element_at(parts, -2))).otherwise(""))
    return F.when(F.size(parts).between(1, 2), key)


def catalog(entities: DataFrame) -> DataFrame:
    """(service_id, key, resolved): the entity of each key that exactly one has.

    Names have n before them: a qualified name is exact, another the declared entity name where exactly one has
    it, else the class name of one that declared none. Tables (``_table_key``) have t: case aside unless quoted, with
    exactly the schema that is written, so that an entity has a key for each way to write its table.
    """
    e = entities.select("service_id", "entity", "jpql_name").distinct()
    none, own = F.lit(None).cast("string"), F.col("entity")
    rows = e.where("jpql_name IS NOT NULL").select("service_id", F.col("jpql_name").alias("t"), own.alias("renamed"), none.alias("class"), none.alias("full"))
    rows = rows.unionByName(e.where("jpql_name IS NULL").select("service_id", F.substring_index("entity", ".", -1).alias("t"), none.alias("renamed"), own.alias("class"), none.alias("full")))
    rows = rows.unionByName(e.select("service_id", own.alias("t"), none.alias("renamed"), none.alias("class"), own.alias("full")))
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    names = rows.groupBy("service_id", "t").agg(only("renamed").alias("renamed"), only("class").alias("class"), F.min("full").alias("full"))
    names = names.select("service_id", F.concat(F.lit("n"), "t").alias("key"), F.when(F.contains("t", F.lit(".")), F.col("full")).otherwise(F.coalesce("renamed", "class")).alias("resolved"))
    ways = lambda c: F.array(F.concat(F.lit("q"), c), F.concat(F.lit("l"), F.lower(c)))
    tables = entities.where("storage_name IS NOT NULL AND storage_name <> ''").select("service_id", "entity", F.explode(ways("storage_name")).alias("_table"), F.when(F.col("storage_schema").isNull(), F.array(F.lit(""))).otherwise(ways("storage_schema")).alias("_schemas"))
    tables = tables.withColumn("_schema", F.explode("_schemas")).select("service_id", "entity", F.concat(F.lit("t"), "_table", F.lit(_PART), "_schema").alias("key"))
    return names.unionByName(tables.groupBy("service_id", "key").agg(only("entity").alias("resolved"))).where("resolved IS NOT NULL")


def _walked(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows with ``resolved`` led along ``fields``; past what is no entity nothing resolves. ``no_entity`` tells a path that ends at a written type of none."""
    longest = rows.agg(F.max(F.size("fields"))).first()[0] or 0
    rows = rows.withColumn("no_entity", F.lit(False))
    for i in range(longest):
        own = rows.withColumn("owner", F.col("resolved")).withColumn("field", F.get("fields", F.lit(i))).join(targets, ["service_id", "owner", "field"], "left")
        on = F.size("fields") > i
        rows = own.withColumn("resolved", F.when(on, F.col("target_")).otherwise(F.col("resolved"))).withColumn("no_entity", F.when(on, F.coalesce(~F.col("is_entity"), F.lit(False))).otherwise(F.col("no_entity"))).drop("owner", "field", "target_", "is_entity")
    return rows


def mentions(stated: DataFrame, entities: DataFrame, fields: DataFrame) -> DataFrame:
    """What ``declarations`` found, with the entity that each names: query_id, service_id, native, operation, n, resolved, no_entity, written, target.

    SQL names tables. Elsewhere a name is an entity's, and a path starts at the latest alias of that name in the
    nearest parenthesis around it; aliases over aliases are followed round by round, each round a join. Only
    statements with a path take part in that.
    """
    own = ["query_id", "service_id", "native", "operation", "repository_entity"]
    dotted = ~F.col("native") & F.exists("declared", lambda d: (d["kind"] == "name") & F.contains(d["t"], F.lit(".")))
    d = stated.where("is_read").select(*own, dotted.alias("has_path"), F.inline("declared"))
    segments = F.when((F.col("kind") == "name") & ~F.col("native"), F.transform(F.regexp_extract_all("t", F.lit(_SEGMENT), F.lit(0)), _unquoted))
    d = d.withColumn("_segments", segments).withColumn("fields", F.coalesce(F.slice("_segments", 2, 1 << 30), F.array().cast("array<string>")))
    aliases = d.where("alias IS NOT NULL AND has_path").select("query_id", "alias", F.col("n").alias("_an"), F.col("frame").alias("_af"), F.col("close").alias("_ac"))
    on_path = d.where("has_path AND size(fields) > 0")
    scoped = on_path.select("query_id", "n", F.lower(F.get("_segments", F.lit(0))).alias("alias")).join(aliases, ["query_id", "alias"])
    scoped = scoped.where((F.col("_an") < F.col("n")) & (F.col("_af") < F.col("n")) & (F.col("n") < F.coalesce("_ac", F.lit(1 << 60)))).groupBy("query_id", "n").agg(F.max_by("_an", F.struct("_af", "_an")).alias("parent"))
    paths = written(on_path.join(scoped, ["query_id", "n"], "left"), "paths")
    keep = ["query_id", "service_id", "native", "operation", "has_path", "n", "resolved", "no_entity", "written", "target"]
    flat = lambda df: df.withColumn("no_entity", F.lit(False)).select(*keep)
    done = flat(d.where("kind <> 'name'").withColumn("resolved", F.when(F.col("kind") == "own", F.col("repository_entity"))))
    named = d.where("kind = 'name' AND size(fields) = 0").unionByName(paths.where("parent IS NULL").drop("parent"))
    plain = F.concat(F.lit("n"), F.when(F.size("fields") == 0, F.get("_segments", F.lit(0))).otherwise(F.col("t")))
    named = named.withColumn("key", F.when(F.col("native"), _table_key(F.col("t"))).otherwise(plain)).select("query_id", "service_id", "native", "operation", "has_path", "n", "written", "target", "key")
    done = written(done.unionByName(flat(named.join(catalog(entities), ["service_id", "key"], "left"))), "resolved")
    live = paths.where("parent IS NOT NULL")
    if live.isEmpty():
        return done
    targets = written(field_targets(entities, fields).withColumnRenamed("target", "target_"), "targets")
    near = done.where("has_path")
    while not live.isEmpty():
        known = near.select("query_id", F.col("n").alias("parent"), F.when(~F.col("no_entity"), F.col("resolved")).alias("resolved"))
        step = written(_walked(live.join(known, ["query_id", "parent"]), targets).select(*keep), "resolved")
        if step.isEmpty():
            break
        live = written(live.join(step.select("query_id", "n"), ["query_id", "n"], "left_anti"), "paths")
        near, done = step, done.unionByName(step)
    return done


def accesses(queries: DataFrame, entities: DataFrame, fields: DataFrame) -> DataFrame:
    """(query_id, ord, entity, operation, is_read, unresolved): what every query does to which entity, in order of appearance.

    The verb holds for a write statement's target and for all that a select names; whatever else is named is
    read. A name that resolves to nothing keeps its operation on a NULL entity, and a statement without names
    keeps its verb. A query that is not read is ``unknown`` on the repository's own entity. A delete outside SQL
    of an entity whose deletes are rewritten is unknown too (Z27). ``unresolved`` lists the names as written where none
    of a query's resolved.
    """
    stated = written(declarations(queries), "statements")
    m = mentions(stated, entities, fields).where("NOT no_entity").withColumn("operation", F.when(F.col("target"), F.col("operation")).otherwise("read"))
    keep = ["query_id", "n", "operation", "resolved", "written"]
    rewritten = entities.where("delete_rewritten").select("service_id", F.col("entity").alias("resolved"), F.lit(True).alias("_rewritten")).distinct()
    doubtful = F.coalesce((F.col("operation") == "delete") & ~F.col("native") & F.col("resolved").isNotNull(), F.lit(False))
    told = m.where(doubtful).join(rewritten, ["service_id", "resolved"], "left").withColumn("operation", F.when(F.col("_rewritten"), "unknown").otherwise("delete"))
    # a row for each statement itself has no n
    whole = stated.where("is_read").select("query_id", F.lit(None).cast("int").alias("n"), "operation", F.lit(None).cast("string").alias("resolved"), F.lit(None).cast("string").alias("written"))
    rows = m.where(~doubtful).select(*keep).unionByName(told.select(*keep)).unionByName(whole).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "operation", "resolved", "written")))).alias("all"), F.max(F.when(F.col("n").isNull(), F.col("operation"))).alias("verb"),
    )
    # operations hold no colon, so an operation and its entity are one text, of which the first of its kind stays
    both = F.array_distinct(F.transform("all", lambda x: F.when(x["resolved"].isNull(), x["operation"]).otherwise(F.concat(x["operation"], F.lit(":"), x["resolved"]))))
    names = F.array_distinct(F.transform("all", lambda x: x["written"]))
    some = F.exists("all", lambda x: x["resolved"].isNotNull())
    rows = rows.select("query_id", F.when((F.size("all") > 0) & ~some, F.array_join(names, ", ")).alias("unresolved"), F.posexplode(F.when(F.size("all") > 0, both).otherwise(F.array("verb"))).alias("ord", "_both"))
    at = F.instr("_both", F.lit(":"))
    read = rows.select("query_id", "ord", F.when(at > 0, F.col("_both").substr(at + 1, F.length("_both"))).alias("entity"), F.substring_index("_both", ":", 1).alias("operation"), F.lit(True).alias("is_read"), "unresolved")
    unread = stated.where("NOT is_read").select(
        "query_id", F.lit(0).alias("ord"), F.col("repository_entity").alias("entity"), F.lit("unknown").alias("operation"), F.lit(False).alias("is_read"), F.when(F.col("repository_entity").isNull(), F.col("repository_text")).alias("unresolved"),
    )
    return read.unionByName(unread)
