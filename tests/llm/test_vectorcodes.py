"""Vector codes against brute force in Python integers, with odd rows, ties and components beyond int64."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylark.llm import vectorcodes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, vec string"


def _want(rows, parts=8, entries=16, rounds=6):
    """The contract in plain loops: (vec_id, code, error, label_error, sha) of each kept row."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in sorted({len(v) for _, v, _ in kept}):
        own = [r for r in kept if len(r[1]) == dim]
        cut = lambda v, p: v[dim * p // parts : dim * (p + 1) // parts]  # noqa: E731, B023
        first = {}
        for i, v, _ in own:
            first[i] = min(first.get(i, v), v)
        start = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
        books = [[cut(first[i], p) for i in start] for p in range(parts)]
        dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        near = lambda a, book: min(range(len(book)), key=lambda e: (dist(a, book[e]), e))
        for _ in range(rounds):
            for p in range(parts):
                got = [near(cut(v, p), books[p]) for _, v, _ in own]
                for e in set(got):
                    mine = [cut(v, p) for (_, v, _), g in zip(own, got, strict=True) if g == e]
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, label in own:
            codes = [near(cut(v, p), books[p]) for p in range(parts)]
            error = sum(dist(cut(v, p), books[p][c]) for p, c in enumerate(codes))
            out.append((i, "".join(f"{c:02x}" for c in codes), error if error < 1 << 63 else None, label, sha))
    total = {}
    for r in out:
        total.setdefault(r[3], []).append(r[2])
    total = {k: None if None in e or sum(e) >= 1 << 63 else sum(e) for k, e in total.items()}
    return sorted(((i, c, e, total[label], s) for i, c, e, label, s in out), key=repr)


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)


def _got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.1, (150, 16))
    x[20:60] = x[20]
    x[60:80] = np.round(x[60:80] * 4) / 4096  # small lattice: many ties
    rows = [(i + 5, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(x)]
    rows += [(7, x[9].tolist(), 1), (None, x[11].tolist(), None), (1, None, 1), (2, [0.5, None] * 8, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, 2), (400, [], 1)]
    rows += [(500 + i, rng.normal(size=11).tolist(), 9) for i in range(20)] + [(600 + i, [0.25 * i] * 3, 8) for i in range(4)]
    df = _frame(spark, rows)
    assert _got(V.compress(df)) == _want(rows)
    monkeypatch.setattr(V, "BROADCAST_LABELS", 0)
    assert _got(V.compress(df.repartition(7), rounds=2)) == _want(rows, rounds=2)
    assert V.compress(df.limit(0)).count() == 0


def test_components_beyond_int64(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * 10.0 ** (i % 4 * 9)).tolist(), i % 2) for i in range(40)]
    assert _got(V.compress(_frame(spark, rows), rounds=2)) == _want(rows, rounds=2)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 9), st.sampled_from([3, 400, 2**20, 2**26]))
def test_screening_keeps_every_nearest_entry(seed, d, size):
    rng = np.random.default_rng(seed)
    c = rng.integers(-size, size, (16, d))
    c[5] = c[3]
    x = np.concatenate([rng.integers(-size, size, (40, d)), c, (c[:8] + c[8:]) // 2])
    exact = ((x[:, None].astype(object) - c[None]) ** 2).sum(2)
    index, dist = V.nearest(x, c)
    assert dist.tolist() == exact.min(1).tolist() and index.tolist() == [r.tolist().index(min(r)) for r in exact]


def test_screening_leaves_few_entries_to_measure():
    x = np.floor(np.random.default_rng(1).normal(0, 500, (4000, 8))).astype(np.int64)
    assert V.screened(x, x[:16]).sum() < 1.01 * len(x)


@pytest.mark.parametrize("dim", [1, 8, 64, 4096])
def test_limit_is_safe(dim):
    assert dim * (2 * V.limit(dim)) ** 2 < 1 << 62
