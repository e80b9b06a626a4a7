"""Chains of types are jumped in few rounds, and what is walked agrees with a walk of every path."""

import random

from skylark.operators import generics as G

SCHEMA = "type string, signature string, parents array<string>"


def test_long_chains_take_few_tables(spark, monkeypatch):
    labels, written = [], G.written
    monkeypatch.setattr(G, "written", lambda df, label: labels.append(label) or written(df, label))
    rows = [("a.T0", "<A:LObject;B:LObject;>LCrud<TB;>;", ["a.Crud"])] + [(f"a.T{i}", f"<A:LObject;B:LObject;>LT{i - 1}<{'LX;TA;' if i == 20 else 'TB;TA;' if i % 3 else 'TA;TB;'}>;", [f"a.T{i - 1}"]) for i in range(1, 40)]
    rows += [("a.C0", "LC1;", ["a.C1"]), ("a.C1", "LC2;", ["a.C2"]), ("a.C2", "LC0;", ["a.C0"]), ("a.C3", "LC2;", ["a.C2"])]
    got = {r.type: (r.bound, r.written_in) for r in G.bindings(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a.Crud",)], "marker string")).collect()}
    want = {}
    for i in range(40):
        b, at = "B", i  # T<at> has parameters A, B; which argument reaches the marker
        env = {"A": None, "B": None}
        while at:
            args = ["X", "A"] if at == 20 else ["B", "A"] if at % 3 else ["A", "B"]
            env = dict(zip("AB", [("X", "a.T20") if x == "X" else env[x] for x in args], strict=True))
            at -= 1
        want[f"a.T{i}"] = env[b] or (None, None)
    assert got == want and ("X", "a.T20") in got.values()
    assert len(labels) <= 16  # 41 rounds of two tables before


def test_branching_types_agree_with_every_path(spark):
    rng = random.Random(5)
    shapes = {}
    for i in range(36):
        ups = rng.sample([f"a.T{j}" for j in range(36) if j != i], rng.choice([1, 1, 1, 2, 2, 3])) if rng.random() < 0.9 else []
        if rng.random() < 0.2:
            ups.insert(rng.randrange(len(ups) + 1), "a.Crud")
        shapes[f"a.T{i}"] = [(u, rng.choice([["TA", "TB"], ["TB", "TA"], [f"LE{i}", "TA"], ["TB"], [], ["+LW", "TB"]])) for u in ups]
    rows = [(t, "<A:LObject;B:LObject;>LObject;" + "".join(f"L{u[2:]}{'<' + ''.join(a + ';' for a in args) + '>' if args else ''};" for u, args in ups), [u for u, _ in ups]) for t, ups in shapes.items()]

    def walk(t, env, seen):
        for u, args in shapes[t]:
            values = [env[a[1]] if a[0] == "T" else (a[1:], t) if a[0] == "L" else None for a in args]
            if u == "a.Crud":
                return (values[0] if values else None,)
            if u not in seen:
                hit = walk(u, dict(zip("AB", values if len(values) == 2 else [None, None], strict=True)), seen | {u})
                if hit:
                    return hit
        return None

    want = {t: (hit[0] or (None, None)) for t in shapes if (hit := walk(t, {"A": None, "B": None}, {t}))}
    got = {r.type: (r.bound, r.written_in) for r in G.bindings(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a.Crud",)], "marker string")).collect()}
    assert got == want and len(want) > 20


def test_signatures_are_dealt_out(spark, monkeypatch):
    plans, written = {}, G.written
    monkeypatch.setattr(G, "written", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and written(df, label))
    assert G.supertypes(spark.createDataFrame([("a.A", "LB;", ["a.B"])], SCHEMA).coalesce(1)).count() == 1
    assert "hashpartitioning(type" in plans["declared"] and "REPARTITION_BY_NUM" in plans["declared"]
