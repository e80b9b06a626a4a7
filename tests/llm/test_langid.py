"""The conditional random field against enumeration and finite differences, and on held-out and code-switched texts."""

import itertools
import os
import zlib

import numpy as np
import pytest

from skylark.llm import langid as L

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string, runs string"
EN, DE = "the house and the river with that thing", "der Garten und die Blume nicht für das Haus"


def _enumerated(psi, moves, start):
    n, k = psi.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = start[path[0]] * np.prod([psi[t, y] for t, y in enumerate(path)]) * np.prod([moves[a, b] for a, b in itertools.pairwise(path)])
        out[np.arange(n), path] += p
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("piece", [1, 2, 3, 256])
def test_posteriors_equal_enumeration(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    rng = np.random.default_rng(piece)
    lengths = np.array([3, 1, 7, 2, 6, 1])
    psi, moves, start = rng.random((lengths.sum(), 3)) + 1e-6, rng.random((3, 3)) * 3, rng.random(3)
    want = np.concatenate([_enumerated(x, moves, start) for x in np.split(psi, np.cumsum(lengths)[:-1])])
    assert np.allclose(L.posteriors(psi, lengths, moves, start), want)


def test_pieces_change_nothing_in_long_texts(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = np.array([5000, 40, 700])
    psi, moves, start = np.exp(-30 * rng.random((lengths.sum(), 4))), np.exp(rng.normal(size=(4, 4))), np.ones(4)
    whole = L.posteriors(psi, lengths, moves, start)
    monkeypatch.setattr(L, "PIECE", 10_000)
    assert np.allclose(L.posteriors(psi, lengths, moves, start), whole) and np.isfinite(whole).all()


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    score, labels, moves, start = rng.normal(size=(3, 5, 3)), rng.integers(0, 3, (3, 5)), rng.normal(size=(3, 3)), rng.normal(size=3)
    value, *gradients = L.likelihood(score, labels, moves, start)
    for which, g in enumerate(gradients):
        for at in itertools.product(*map(range, g.shape)):
            moved = [score.copy(), moves.copy(), start.copy()]
            moved[which][at] += 1e-6
            assert abs((L.likelihood(moved[0], labels, moved[1], moved[2])[0] - value) / 1e-6 - g[at]) < 1e-4
    paths = sum(np.exp(sum(score[0, t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)) + start[p[0]]) for p in itertools.product(range(3), repeat=5))
    own = sum(score[0, t, y] for t, y in enumerate(labels[0])) + sum(moves[a, b] for a, b in itertools.pairwise(labels[0])) + start[labels[0, 0]]
    assert abs(L.likelihood(score[:1], labels[:1], moves, start)[0] - (own - np.log(paths))) < 1e-9


def test_features_are_those_of_each_word_alone():
    words = ["a", "Straße", "été", "x" * 200, "漢字"]
    index, starts = L.features(words)
    for w, part in zip(words, np.split(index, starts[1:]), strict=True):
        assert (L.features([w])[0] == part).all() and (part[:, 0] != L.BUCKETS).all() and (part[:, -1] != L.BUCKETS).sum() == 1
        assert (part[:, :-1] != L.BUCKETS).sum() == sum(max(0, len(w) + 2 - n + 1) for n in range(1, L.LONGEST + 1))


def _docs(spark, extra=()):
    rows = [(i, " ".join((EN if i % 2 else DE).split()[i % 5 :]), "en" if i % 2 else "de", "x", "y") for i in range(60)]
    return spark.createDataFrame([*rows, *((i, t, x, "x", "y") for i, t, x in extra)], SCHEMA)


def test_odd_rows_and_code_switching(spark):
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 345 !!", "en"), (103, "²", None), (104, "the house and that", None), (105, "das Haus und die Blume " * 30_000, None), (None, "the river", "xx"), (7, EN, "en"), (7, EN, "en"), (106, "x" * 300_000, None)]
    docs = _docs(spark, odd)
    got = {}
    for r in L.languages(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for rows in got.values() for r in rows)
    assert [got[i][0].lang_pred for i in (100, 101, 102, 103)] == ["und"] * 4 and got[100][0].score == 0
    assert [got[i][0].lang_pred for i in (104, 105, None)] == ["en", "de", "en"] and len(got[7]) == 3
    assert all(got[i][0].lang_pred == ("en" if i % 2 else "de") for i in range(60)) and all(0 <= r.score <= 1 for rows in got.values() for r in rows)
    text = "the house and the river, der Garten und die Blume; with that thing"
    mixed = spark.createDataFrame([(1, text), (2, None), (3, "1 2")], "doc_id long, text string")
    runs = {r.doc_id: r.runs for r in L.language_runs(mixed, L.train(docs)).collect()}
    assert [(text[x.start : x.end], x.lang) for x in runs[1]] == [("the house and the river", "en"), ("der Garten und die Blume", "de"), ("with that thing", "en")]
    assert runs[2] == runs[3] == []


def test_nothing_or_one_language_to_learn(spark):
    docs = _docs(spark)
    assert L.languages(docs.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in L.languages(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {("und", 0.0)}
    assert {(r.lang_pred, r.score) for r in L.languages(docs.selectExpr("doc_id", "text", "'en' AS lang")).collect()} == {("en", 1.0)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the data folders are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = L.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
