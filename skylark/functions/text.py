"""Scalar functions on URIs, hosts, ids, roles and markup; Columns in, Columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HOLE = "{?}"
#: Confidence tiers from the strongest to the weakest.
CONFIDENCE = ("exact", "high", "heuristic", "none")


def simplify_uri(uri: Column) -> Column:
    """a route's identity form: path only, no empty segments, parameters as holes; applying it again changes nothing."""
    bare = F.trim(uri)
    # a question mark within a hole begins no query
    path = F.when(bare.contains("://"), F.regexp_extract(bare, r"://[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_replace(F.regexp_replace(bare, r"(?s)(^|[^{])\?.*$", "$1"), r"(?s)#.*$", ""))
    hole = lambda s: s.rlike(r"^\{[^/{}]*(:[^{}]*)?\}$") | s.rlike("^:[A-Za-z_][A-Za-z0-9_]*$")
    parts = F.transform(segments(path), lambda s: F.when(hole(s), HOLE).otherwise(s))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def segments(path: Column) -> Column:
    """The non-empty segments of a path."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def content_id(prefix: str, kind: str, *parts: Column) -> Column:
    """A content-derived id: prefix and 16 hexadecimal digits of the hash of kind and parts."""
    text = F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))


#: An authority with an optional scheme and port, and a path.
_AUTHORITY = r"(?i)^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]+)(?::([0-9]+))?(/.*)?$"


def authority(bare: Column, group: int) -> Column:
    """Group 1, 2 or 3 of a trimmed URL: its host, port or path as text."""
    return F.regexp_extract(bare, _AUTHORITY, group)


def told_parts(bare: Column, host: Column, port: Column, path: Column) -> Column:
    """struct(host, port, path) of a trimmed URL whose groups are at hand, so that a caller can match it once."""
    known = (bare != "") & ~bare.startswith("/") & (host != "") & ~host.contains("{") & ~host.contains("$")
    return F.struct(
        F.when(known, host).alias("host"), F.when(known, F.nullif(port, F.lit("")).try_cast("int")).alias("port"),
        F.when(known, F.when(path == "", "/").otherwise(path)).alias("path"),
    )


def url_parts(url: Column) -> Column:
    """struct(host, port, path) of a candidate URL; host is NULL where it cannot be told.

    Relative URLs have no host, and one that still has a hole or a key in it is none.
    """
    bare = F.trim(url)
    return told_parts(bare, *[authority(bare, n) for n in (1, 2, 3)])


def url_host(url: Column) -> Column:
    """The lower-case host of a URL, NULL where it cannot be told."""
    return F.lower(url_parts(url)["host"])


def is_ip(host: Column) -> Column:
    """Whether a host is an IPv4 address without leading zeros, each part at most 255."""
    return host.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}$") & ~host.endswith(".")


def kubernetes_name(host: Column) -> Column:
    """The service name of a cluster's DNS spelling: name.ns.svc[.cluster.local] or name.ns, else NULL."""
    cut = F.regexp_replace(host, r"\.svc(\.cluster\.local)?$", "")
    first = F.substring_index(cut, ".", 1)
    return F.when(cut != host, F.nullif(first, F.lit(""))).when(host.rlike(r"^[^.]+\.[^.]+$"), first)


def two_labels(host: Column) -> Column:
    """Whether a name was told from two labels only, which is an inference."""
    return ~host.rlike(r"\.svc(\.cluster\.local)?$")


def strip_segments(path: Column, n: Column) -> Column:
    """a path without its first n segments."""
    parts = segments(path)
    return F.when(n <= 0, path).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")))


_KEY = r"\$\{([^}:]+)(:[^}]*)?\}"


def expand_keys(text: Column, env: Column) -> Column:
    """F06, one pass: every ${key:default} by the map ``env``: the key, its variable's spelling, the default, or itself."""
    keys, between = F.regexp_extract_all(text, F.lit(_KEY), F.lit(0)), F.split(text, _KEY)

    def value(token: Column) -> Column:
        key = F.trim(F.regexp_extract(token, _KEY, 1))
        default = F.regexp_extract(token, _KEY, 2)
        return F.coalesce(env[key], env[env_key(key)], F.when(default != "", F.substring(default, F.lit(2), F.length(default))), token)

    done = F.array_join(F.zip_with(between, F.transform(keys, value), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return F.when(text.contains("${"), done).otherwise(text)


def marker(evidence: Column) -> Column:
    """the reason that a bracketed marker in some evidence names, NULL without one."""
    return F.nullif(F.regexp_extract(evidence, r"\[(unsupported-idiom:[^\]]*)\]", 1), F.lit(""))


def context_path(env: Column) -> Column:
    """the path that a service's settings put before all its endpoints, '' for none."""
    raw = F.coalesce(F.nullif(env["server.servlet.context-path"], F.lit("")), env["SERVER_SERVLET_CONTEXT_PATH"], F.lit(""))
    return F.when(raw.startswith("/"), F.regexp_replace(raw, "/+$", "")).otherwise("")


def is_external(host: Column) -> Column:
    """Dotted hosts and addresses lie outside the system; bare names are placeholders."""
    return host.contains(".")


def env_key(key: Column) -> Column:
    """A configuration key as an environment variable."""
    return F.upper(F.translate(key, ".-", "__"))


def percent(part: Column, whole: Column) -> Column:
    """A percentage with one decimal, NULL of nothing."""
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), 1)


def weakest(*tiers: Column) -> Column:
    """The weakest of some confidence tiers; unknown tiers count as none."""
    names = F.array(*[F.lit(c) for c in CONFIDENCE])
    ranks = [F.coalesce(F.nullif(F.array_position(names, t), F.lit(0)), F.lit(len(CONFIDENCE))) for t in tiers]
    return F.element_at(names, (F.greatest(*ranks) if len(ranks) > 1 else ranks[0]).cast("int"))


def path_tier(heuristic: Column, verb_known: Column) -> Column:
    """A path that a hole of the call had to fit is heuristic, an unknown verb high."""
    return F.when(heuristic, "heuristic").when(verb_known, "exact").otherwise("high")


def host_tier(indirect: Column, unsure: Column, softened: Column) -> Column:
    """an inferred name is high, an ambiguous or guessed one heuristic, a forwarded one or one with another port high."""
    return F.when(indirect, "high").when(unsure, "heuristic").when(softened, "high").otherwise("exact")


def target_key(kind: Column, endpoint: Column, host: Column) -> Column:
    """what identifies the target of an edge."""
    return F.when(kind == "endpoint", endpoint.cast("string")).when(kind == "external", F.concat(F.lit("external:"), host)).when(kind == "placeholder", F.concat(F.lit("placeholder:"), host)).otherwise("undetermined")


def repository(source: Column) -> Column:
    """one spelling of a repository's address: scp-like, with a scheme, or a local path."""
    src = F.trim(source)
    scp = r"^[A-Za-z0-9_.-]+@([A-Za-z0-9_.-]+):(.+)$"
    tidy = lambda p: F.regexp_replace(F.regexp_replace(p, r"^/+|/+$", ""), r"\.git$", "")
    host = F.lower(F.regexp_extract(src, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return (
        F.when(src.rlike(scp) & ~src.rlike(r"^[^:]*://") & ~src.rlike(r"^[^:]*:[/][/]"), F.concat(F.lower(F.regexp_extract(src, scp, 1)), F.lit("/"), tidy(F.regexp_extract(src, scp, 2))))
        .when(src.contains("://"), F.concat(host, F.lit("/"), tidy(F.regexp_extract(src, r"://[^/?#]*([^?#]*)", 1))))
        .otherwise(F.coalesce(F.nullif(F.regexp_replace(src, "/+$", ""), F.lit("")), F.lit("/")))
    )


def role_name(role: Column) -> Column:
    """A role without its prefix."""
    return F.regexp_replace(role, "^ROLE_", "")


def strip_markup(text: Column) -> Column:
    """Markup text without comments, scripts, styles and tags, white space collapsed."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?s)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def ant_segment(pattern: Column, segment: Column) -> Column:
    """how one segment of an ant pattern fits one of a route: exact, speculative where a hole had to be the literal, or NULL.

    The star stands for any text, the question mark for one character.
    """
    escaped = F.regexp_replace(pattern, r"([.+^$()\[\]{}|\\])", r"\\$1")
    regex = F.concat(F.lit("(?s)^"), F.replace(F.replace(escaped, F.lit("?"), F.lit(".")), F.lit("*"), F.lit("[^/]*")), F.lit("$"))
    hole = segment.startswith("{") & segment.endswith("}")
    plain = ~pattern.rlike("[*?]")  # a pattern made for one row is compiled for it, so only where it must be
    fits = F.when((pattern == segment) | (pattern == "*"), True).when(plain, False).otherwise(F.rlike(segment, regex))
    return F.when(fits, "exact").when(hole, "speculative")


def ant_match(pattern: Column, path: Column) -> Column:
    """How an ant pattern fits a route: exact, speculative or NULL; ** stands for any segments, none included.

    A pattern of literals, but for a last * or **, is a test of the beginning on routes without holes. For
    others the states are the numbers of pattern segments passed, each with its best precision (2 exact,
    1 speculative, 0 not reached); each path segment moves them all on at once.
    """
    even = ~pattern.rlike("//|.(?<!^)/$") & ~path.rlike("//|.(?<!^)/$|^[^/]|^$|[{]") & pattern.startswith("/")
    deep, flat = F.regexp_replace(pattern, "/[*][*]$", ""), F.regexp_replace(pattern, "/[*]$", "")
    plain = lambda c: ~c.rlike("[*?{]") & (c != "/")
    below = lambda c: F.startswith(path, F.concat(c, F.lit("/")))
    rest = path.substr(F.length(flat) + 2, F.length(path))
    return (
        F.when(pattern == "/**", "exact").when(even & pattern.endswith("/**") & plain(deep), F.when((path == deep) | below(deep), "exact"))
        .when(even & pattern.endswith("/*") & plain(flat), F.when(below(flat) & (rest != "") & ~rest.contains("/"), "exact")).otherwise(_ant_general(pattern, path))
    )


def _ant_general(pattern: Column, path: Column) -> Column:
    return _once(F.struct(segments(pattern).alias("p"), segments(path).alias("s")), lambda both: _ant_states(both["p"], both["s"]))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _ant_states(p: Column, s: Column) -> Column:
    n = F.size(p)
    deep = lambda i: F.get(p, i) == "**"

    def closed(states: Column) -> Column:
        """A ** may stand for nothing: the state before it reaches the one behind."""
        start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            before = F.when((i > 0) & F.coalesce(deep(i - 1), F.lit(False)), acc["last"]).otherwise(0)
            own = F.greatest(F.get(states, i), before)
            return F.struct(own.alias("last"), F.concat(acc["out"], F.array(own)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), n), start, step)["out"]

    def move(states: Column, segment: Column) -> Column:
        def reach(i: Column) -> Column:
            stay = F.when(F.coalesce(deep(i), F.lit(False)), F.get(states, i)).otherwise(0)
            fit = ant_segment(F.get(p, i - 1), segment)
            rank = F.when(fit == "exact", 2).when(fit == "speculative", 1).otherwise(0)
            step = F.when((i > 0) & ~F.coalesce(deep(i - 1), F.lit(False)), F.least(F.get(states, i - 1), rank)).otherwise(0)
            return F.greatest(stay, F.coalesce(step, F.lit(0)))

        return _once(F.transform(F.sequence(F.lit(0), n), reach), closed)

    first = closed(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, 2).otherwise(0)))
    end = F.element_at(F.aggregate(s, first, move), n + 1)
    return F.when(end == 2, "exact").when(end == 1, "speculative")


def source_lines(text: Column) -> Column:
    """The lines of a text as compilers split it."""
    return F.split(text, "\r\n|\n|\r")


#: Comments and literals of Java; its repeats give nothing back, as a group that may would take a stack frame for each round and so fail on long texts.
_NOISE = r'(?s)/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/|//[^\n]*+|"(?:[^"\\\n]++|\\.)*+"|\'(?:[^\'\\\n]++|\\.)*+\''


def blank_noise(source: Column) -> Column:
    """Java source with comments and literals blanked out, so that their words match nothing; line breaks stay."""
    return F.regexp_replace(F.regexp_replace(source, _NOISE, "\x01"), "\x01", " ")


def matching_lines(text: Column, pattern: str) -> Column:
    """the 1-based numbers of the lines on which a pattern begins to match, one entry for each match."""
    numbered = F.transform(source_lines(text), lambda line, i: F.array_repeat(i + 1, F.regexp_count(line, F.lit(pattern))))
    return F.flatten(numbered)


#: What an access expression calls, and whether it takes one argument or several.
GRANTS = {"roles": ("hasRole", "hasAnyRole"), "authorities": ("hasAuthority", "hasAnyAuthority")}


def grants(expression: Column, kind: str) -> Column:
    """the quoted arguments of an expression's role or authority calls, sorted and distinct, without ROLE_ for roles."""
    calls = F.regexp_extract_all(expression, F.lit(rf"(?:{'|'.join(GRANTS[kind])})\s*\(([^)]*)\)"), F.lit(1))
    args = F.flatten(F.transform(calls, lambda c: F.regexp_extract_all(c, F.lit("[\"']([^\"']+)[\"']"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(args, lambda a: role_name(a)) if kind == "roles" else args))


def unresolved_arguments(expression: Column) -> Column:
    """whether a role or authority call has an argument that is no quoted literal."""
    calls = F.regexp_extract_all(expression, F.lit(r"(?:hasRole|hasAnyRole|hasAuthority|hasAnyAuthority)\s*\(([^)]*)\)"), F.lit(1))
    return F.exists(calls, lambda c: F.exists(F.split(c, ","), lambda a: ~F.trim(a).rlike("^(\"[^\"]*\"|'[^']*')$")))


def access_effect(expression: Column) -> Column:
    """what an access expression means: permit, deny, authenticated, role or opaque."""
    e = F.trim(expression)
    alone = lambda name: e.rlike(rf"^{name}(\s*\(\s*\))?$")
    return (
        F.when(alone("permitAll"), "permit").when(alone("denyAll"), "deny").when(alone("authenticated") | alone("isAuthenticated") | alone("fullyAuthenticated") | alone("isFullyAuthenticated"), "authenticated")
        .when(unresolved_arguments(e), "opaque").when((F.size(grants(e, "roles")) > 0) | (F.size(grants(e, "authorities")) > 0), "role").otherwise("opaque")
    )


def config_access(names: Column, prefix: str) -> Column:
    """a configured list of grants as an access expression; sentinels decide before names."""
    tidy = F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.trim(n))
    low = F.transform(tidy, lambda n: F.lower(n))
    quoted = F.array_join(F.transform(tidy, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ",")
    return (
        F.when(F.size(tidy) == 0, None).when(F.arrays_overlap(low, F.array(F.lit("denyall"), F.lit("deny"))), "denyAll").when(F.arrays_overlap(low, F.array(F.lit("permitall"), F.lit("anonymous"))), "permitAll")
        .when(F.arrays_overlap(low, F.array(F.lit("authenticated"), F.lit("*"))), "authenticated").otherwise(F.concat(F.lit(f"{prefix}("), quoted, F.lit(")")))
    )


def resolve_or_null(text: Column, env: Column) -> Column:
    """F06 in one pass; NULL if a key is left over."""
    done = expand_keys(text, env)
    return F.when(~done.contains("${"), done)


def container_port(entry: Column) -> Column:
    """the container's port of 80, 8080:80, 127.0.0.1:8080:80 or any of them with a protocol; of a range none."""
    return F.nullif(F.regexp_extract(F.trim(entry), r"(?:^|:)([0-9]+)(?:/[a-z]+)?$", 1), F.lit("")).try_cast("int")


def short_signature(signature: Column) -> Column:
    """class and method of a full signature, without package, types and arguments."""
    name = F.substring_index(F.substring_index(signature, "(", 1), ":", 1)
    return F.substring_index(name, ".", -2)


def path_slug(source: Column) -> Column:
    """a folder name for an address: its tidy end and the start of its hash."""
    canonical = repository(source)
    return F.concat(F.substring(F.regexp_replace(F.lower(canonical), "[^a-z0-9]+", "-"), 1, 40), F.lit("-"), F.substring(F.sha2(canonical, 256), 1, 8))


def version_parts(version: Column) -> Column:
    """a version as an array of numbers, so that arrays compare as versions do; NULL if it is none."""
    bare = F.regexp_replace(F.trim(version), "^v", "")
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.transform(F.split(bare, r"\."), lambda p: p.cast("int")))


def tag_parts(tag: Column) -> Column:
    """struct(namespace, value) of namespace=value; NULL if it does not fit."""
    return F.when(tag.rlike("^[a-z][a-z0-9-]*=.+$"), F.struct(F.substring_index(tag, "=", 1).alias("namespace"), F.regexp_extract(tag, "^[^=]*=(.*)$", 1).alias("value")))


def predicate_paths(predicate: Column) -> Column:
    """the patterns of a gateway's Path=a,b predicate."""
    inner = F.regexp_extract(F.trim(predicate), "^Path\\s*=\\s*(.*)$", 1)
    return F.when(inner != "", F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def stripped_segments(filters: Column) -> Column:
    """how many segments a gateway's StripPrefix=n filter takes away."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(filters), "^StripPrefix\\s*=\\s*([0-9]+)$", 1), F.lit("")).try_cast("int"), F.lit(0))
