"""URLs of expressions, each written as a nested form."""

from pyspark.sql import functions as F

from skylark.operators import slicing as S

EXPRS = "expr long, method long, kind string, text string, callee long, place int"


class Code:
    """Collects the tables of expressions; a form is a literal's text or (kind, ...)."""

    def __init__(self):
        self.exprs, self.children, self.assignments, self.returns, self.sinks = [], [], [], [], []

    def add(self, form, method):
        i = len(self.exprs) + 1
        self.exprs.append(None)
        kind, *rest = ("literal", form) if isinstance(form, str) else form
        text = callee = place = None
        if kind in ("literal", "config", "local", "member", "other"):
            text = rest[0] if rest else None
        elif kind == "parameter":
            place = rest[0]
        else:
            if kind == "call":
                callee, *rest = rest
            for n, child in enumerate(rest, start=1 if kind == "call" else 0):
                role, child = child if kind == "builder" else (None, child)
                self.children.append((i, n, self.add(child, method), role))
        self.exprs[i - 1] = (i, 900 if kind == "member" else method, kind, text, callee, place)
        return i

    def sink(self, form, method):
        self.sinks.append((self.add(form, method),))

    def let(self, name, method, *forms):
        self.assignments += [(method, name, n, self.add(f, method)) for n, f in enumerate(forms)]

    def gives(self, method, *forms):
        self.returns += [(method, n, self.add(f, method)) for n, f in enumerate(forms)]

    def slices(self, spark, **budget):
        frame = spark.createDataFrame
        rows = S.sliced(
            frame(self.sinks, "expr long"), frame(self.exprs, EXPRS), frame(self.children or [(-1, 0, -1, None)], "expr long, ord int, child long, role string"), frame(self.assignments or [(-1, "-", 0, -1)], "method long, name string, ord int, expr long"),
            frame(self.returns or [(-1, 0, -1)], "method long, ord int, expr long"), **budget,
        ).orderBy("ord").collect()
        out = [[] for _ in self.sinks]
        at = {s[0]: i for i, s in enumerate(self.sinks)}
        for r in rows:
            out[at[r.root]].append((r.url, r.confidence) + (("cut",) if r.truncated else ()))
        return out


def test_every_form(spark):
    c, want = Code(), []

    def case(form, *urls, method=1):
        c.sink(form, method)
        want.append(list(urls))

    c.let("one", 1, "http://one")
    c.let("two", 1, "http://a", "http://b")
    c.let("self", 1, ("concat", ("local", "self"), "/x"))
    c.let("base", 900, ("config", "svc.url"))
    c.let("host", 900, "http://field")
    c.gives(2, ("concat", ("parameter", 1), "/v1"))
    c.gives(3, ("call", 2, ("parameter", 1)))
    c.gives(4, ("call", 3, ("parameter", 1)))
    c.gives(5, ("call", 5), "http://five")
    c.gives(6, "http://x", "http://y")
    case("http://h/a", ("http://h/a", "exact"))
    case(("concat", "http://h", "/", ("other",)), ("http://h/{?}", "high"))
    case(("concat", "http://h/a", ("other",)), ("http://h/a{?}", "heuristic"))
    case(("concat", ("other",), "/stock/5"), ("{?}/stock/5", "heuristic"))
    case(("concat", ("other",), ""), (None, "none"))
    case(("ternary", "http://a", "http://b"), ("http://a", "heuristic"), ("http://b", "heuristic"))
    case(("local", "one"), ("http://one", "exact"))
    case(("concat", ("local", "two"), "/p"), ("http://a/p", "heuristic"), ("http://b/p", "heuristic"))
    case(("local", "none"), (None, "none"))
    case(("concat", ("member", "base"), "/p"), ("${svc.url}/p", "high"))
    case(("concat", ("member", "host"), "/p"), ("http://field/p", "high"))
    case(("format", "http://h-%s/p/%05d?x=%s", ("local", "one"), ("other",)), ("http://h-http://one/p/{?}?x={?}", "heuristic"))
    case(("format", "http://h/%s", ("ternary", "a", "b")), ("http://h/a", "heuristic"), ("http://h/b", "heuristic"))
    case(("builder", ("base", "http://h"), ("path", "/a"), ("segment", ("parameter", 1)), ("neutral", "q")), ("http://h/a/{?}", "high"))
    case(("builder", ("base", "http://h"), ("other", "9")), ("http://h{?}", "heuristic"))
    case(("call", 2, "http://arg"), ("http://arg/v1", "high"))
    case(("call", 3, "http://arg"), ("http://arg/v1", "high"))
    case(("call", 4, "http://arg"), (None, "none"))
    case(("call", 5), (None, "none"), ("http://five", "heuristic"))
    case(("call", 6), ("http://x", "heuristic"), ("http://y", "heuristic"))
    case(("call", 77), (None, "none"))
    case(("concat", "http://h", ("concat", "/a", ("concat", "/b", ("concat", "/c", ("concat", "/d", ("concat", "/e", ("concat", "/f", ("concat", "/g", ("concat", "/h", "/i"))))))))), ("http://h/a/b/c/d/e/f/g/h/i", "exact"))
    got = c.slices(spark)
    assert got[: len(want)] == want, [(g, w) for g, w in zip(got, want, strict=True) if g != w]


def test_budgets_are_told(spark):
    c = Code()
    for name in "xyz":
        c.let(name, 1, *[f"{name}{i}" for i in range(3)])
    c.sink(("concat", ("local", "x"), ("local", "y"), ("local", "z")), 1)
    c.let("deep", 1, ("ternary", "end", ("ternary", "end", ("ternary", "end", ("local", "deep")))))
    c.sink(("local", "deep"), 1)
    products, deep = c.slices(spark)
    assert [u for u, *_ in products] == ["x0y0z0", "x0y0z1", "x0y0z2", "x0y1z0", "x0y1z1", "x0y1z2", "x0y2z0", "x0y2z1"] and all(r[1:] == ("heuristic", "cut") for r in products)
    assert deep == [("end", "heuristic"), (None, "none", "cut")]
    wide = Code()
    wide.let("v", 1, *[("concat", "http://h/", str(i)) for i in range(300)])
    wide.sink(("local", "v"), 1)
    few = wide.slices(spark, most=1000, visited=100)[0]
    # the name, then three expressions for each of 33 assignments
    assert [u for u, *_ in few[:33]] == [f"http://h/{i}" for i in range(33)] and few[33:] == [(None, "none", "cut")]
    assert len(wide.slices(spark)[0]) == 8


def test_benign_holes(spark):
    cases = {"http://inventory:8080/stock/{?}": True, "{?}/stock/5": False, "{?}": False, "/a/{?}/b": True, "/a/x{?}": False, "http://{?}/a": False, "http://h": True, "http://h/{?}x": False, "${a}/{?}": True, "http://h{?}": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.b for r in df.select("t", S.benign(F.col("t")).alias("b")).collect()} == cases
