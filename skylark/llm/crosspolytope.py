"""Approximate nearest neighbours: cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.llm import vectors as V
from skylark.llm.common import materialise

#: Probes of each table up to which a query looks, step by step, and the axes of a rotation that they combine.
PROBES = (8, 16, 32, 64, 128, 256)
AXES = 32

def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    x, d, h = x.copy(), x.shape[1], 1
    while h < d:
        y = x.reshape(len(x), d // (2 * h), 2, h)
        a, b = y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]
        x = np.stack([a, b], axis=2).reshape(len(x), d)
        h *= 2
    return x


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """A pseudo-rotation: three rounds of seeded sign flips and a Hadamard transform."""
    for i in range(3):
        signs = np.random.default_rng((seed, table, i)).integers(0, 2, x.shape[1]) * 2 - 1
        x = hadamard(x * signs.astype(x.dtype)) / np.sqrt(np.float32(x.shape[1]))
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, padded with zeros to a power of two."""
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, d - x.shape[1]))).astype(np.float32)


def signed(u: np.ndarray, rotation: int, seed: int) -> np.ndarray:
    """How near each rotated unit vector is to every signed axis: axis i, then d + i for the negative ones."""
    r = rotate(u, rotation, seed)
    return np.concatenate([r, -r], axis=1)


def codes(x: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """The bucket of each row in each table: the nearest signed axes under two rotations."""
    u = unit(x)
    out = np.zeros((tables, len(u)), np.int32)
    for t in range(tables):
        first, second = signed(u, 2 * t, seed), signed(u, 2 * t + 1, seed)
        out[t] = first.argmax(1) * first.shape[1] + second.argmax(1)
    return out


def probes_of(u: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The buckets of a table for each query, the most promising first, at most PROBES[-1]: pairs of its nearest axes."""
    near, axes = [], []
    for r in (2 * table, 2 * table + 1):
        s = signed(u, r, seed)
        top = np.argsort(-s, axis=1, kind="stable")[:, :AXES]
        near.append(np.take_along_axis(s, top, 1))
        axes.append(top)
    both = (near[0][:, :, None] + near[1][:, None, :]).reshape(len(u), -1)
    code = (axes[0][:, :, None] * s.shape[1] + axes[1][:, None, :]).reshape(len(u), -1)
    return np.take_along_axis(code, np.argsort(-both, axis=1, kind="stable")[:, : PROBES[-1]], 1)


def collect(u: np.ndarray, code: np.ndarray, seed: int, least: int) -> np.ndarray:
    """Which rows each query meets: it probes on in all tables until it has met ``least`` rows, at last all."""
    tables, n = code.shape
    hit = np.zeros((len(u), n), bool)
    order = np.argsort(code, axis=1, kind="stable")
    ordered = np.take_along_axis(code, order, 1)
    probes = [probes_of(u, t, seed) for t in range(tables)]
    live, done = np.arange(len(u)), 0
    for upto in PROBES:
        for t in range(tables):
            own = probes[t][live, done:upto]
            lo, hi = np.searchsorted(ordered[t], own, "left"), np.searchsorted(ordered[t], own, "right")
            size = (hi - lo).reshape(-1)
            at = np.repeat(lo.reshape(-1) - np.cumsum(size) + size, size) + np.arange(size.sum())
            hit[np.repeat(np.repeat(live, own.shape[1]), size), order[t][at]] = True
        done = upto
        live = live[hit[live].sum(1) < least]
    hit[live] = True
    return hit


def search(k: int, tables: int, least: int, seed: int):
    """The search of one block of queries in the hash tables of one shard."""

    def run(x, ids, coded, q, q_ids, floor) -> pd.DataFrame:
        hit, m = collect(unit(q), np.frombuffer(coded, np.int32).reshape(tables, len(x)), seed, least), k + 1
        best_s, best_i = np.full((len(q), m), np.nan), np.full((len(q), m, k + 1), np.iinfo(np.int64).max)
        squares = (x * x).sum(1)
        for i in range(len(q)):
            at = np.flatnonzero(hit[i])
            if len(at) > m:  # near by the expanded square, with slack for its rounding
                rough = squares[at] - 2 * (x[at] @ q[i])
                far = np.partition(rough, m - 1)[m - 1]
                at = at[rough <= far + 1e-9 * (1 + abs(far) + squares[at].max() + (q[i] * q[i]).sum())]
            s = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
            o = np.lexsort((ids[at, 0], s))[:m]
            best_s[i, : len(o)], best_i[i, : len(o)] = s[o], ids[at[o]]
        return V.expand(q_ids, best_s, best_i, k, smaller_is_better=True)

    return run


def neighbours(embeddings: DataFrame, *, k: int = 10, query_mod: int = 100, tables: int = 32, least: int = 512, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k nearest found by Euclidean distance: query_id, rank, vec_id, score.

    Every row is hashed in every table of its shard, by the nearest signed axes of two rotations. A
    query probes the buckets nearest to it in all tables until it has met ``least`` rows of the
    shard, or else all of them, and what it has met is reranked exactly on the original vectors.
    Buckets have no cap. Queries: ids divisible by ``query_mod``; candidates: every row but the
    query's own; ties go to the smaller id.

    Null ids, and null, zero, empty or non-finite vectors take no part; vectors meet only those of
    their own length. Of rows that share an id, the smallest vector counts. An empty table gives no
    rows; columns besides the two named are ignored.
    """
    df = materialise(V.usable(embeddings, id_col, vec_col, nonzero=True), "nn-vectors")
    distinct = materialise(V.distinct_vectors(df, k, df.count()), "nn-distinct")
    shards, n_shards = V.pack_shards(distinct, k, lambda x: codes(x, tables, seed).tobytes(), distinct.count())
    blocks, n_blocks = V.pack_queries(df.where(F.col("vec_id") % query_mod == 0))
    found = V.search_blocks(shards, range(n_shards), blocks, n_blocks, k, search(k, tables, least, seed))
    return V.best(found, k, smaller_is_better=True).select("query_id", "rank", "vec_id", "score")
