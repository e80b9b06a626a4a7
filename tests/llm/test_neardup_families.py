"""Families of near copies that are larger than a region, against brute force."""

import numpy as np
import pandas as pd

from skylark.llm import neardup


def test_large_region_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 8)
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in range(1000)]
    texts = []
    for k in range(80):  # two members of a cluster are alike, those of different clusters are not, nor is the first text
        own = list(words)
        own[20 + 12 * k] = f"c{k}"
        other = list(own)
        other[int(rng.integers(0, 16))] = f"d{k}"
        texts += [own, other]
    texts = [words[:900], *texts]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 99 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert len(set(root)) == 81
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=99).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_confirmed_links(spark):
    pairs = spark.createDataFrame([(0, i) for i in range(1, 201)], "a long, b long")
    sets = spark.createDataFrame([(i, list(range(5, 15)) if i % 2 else list(range(10))) for i in range(201)], "rep long, shingles array<long>")
    assert sorted((r.a, r.b) for r in neardup.confirm(pairs, sets, 80).collect()) == [(0, i) for i in range(2, 201, 2)]


def test_blocks_hold_every_pair_of_different_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 8)
    members = spark.createDataFrame([(0, 5, i, 60) for i in range(60)] + [(1, 6, i, 9) for i in range(9)], f"tree int, k{neardup.STEPS[0]} long, rep long, n long")
    comps = spark.createDataFrame([(i, 0 if i < 30 else i // 5 * 5) for i in range(60)], "node long, root long")
    def met(pdf):
        rows = list(zip(pdf["rep"], pdf["side"], strict=True))
        assert len(rows) <= 40
        return pd.DataFrame([(min(a, b), max(a, b)) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if x == -1 or x != y], columns=["a", "b"])

    got = {(r.a, r.b) for r in neardup.blocks(members, comps).groupBy("region").applyInPandas(met, "a long, b long").collect()}
    comp = [0 if i < 30 else i // 5 * 5 for i in range(60)]
    want = {(i, j) for j in range(60) for i in range(j) if comp[i] != comp[j]}
    assert want <= got and len([p for p in got if comp[p[0]] == comp[p[1]] == 0]) == 0


def test_sketches_let_links_at_the_threshold_through():
    rng = np.random.default_rng(5)
    lost = {neardup.COARSE: 0, neardup.BINS: 0}
    for n in (20, 60, 160, 1000):
        for _ in range(500):
            both, k = rng.integers(0, 2**64, n, np.uint64), n // 10
            x, y = np.sort(both[: n - k]), np.sort(both[k:])  # 8 of 10 in common
            f = [neardup.fine_sketch(s)[None] for s in (x, y)]
            for bins in lost:
                lost[bins] += not neardup.fine_near(f[0][:, :bins], f[1][:, :bins], np.array([len(x) + len(y)]), 0.8)[0][0]
    assert max(lost.values()) <= 1
