"""Exact inner-product search: a ball tree for each shard, branch and bound, and a shared kth score."""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.llm import vectors as V
from skylark.llm.common import materialise

LEAF = 128


def build(x: np.ndarray) -> bytes:
    """A complete ball tree as arrays: the row order, then of every node its slice, centre and radius.

    Node i has the children 2i + 1 and 2i + 2; a node is halved along the line between two far points.
    """
    n = len(x)
    depth = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    nodes = 2 ** (depth + 1) - 1
    order, lo, hi = np.arange(n), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    centre, radius = np.zeros((nodes, x.shape[1])), np.zeros(nodes)
    hi[0] = n
    for i in range(nodes):
        rows = order[lo[i] : hi[i]]
        if len(rows):
            centre[i] = x[rows].mean(0)
            radius[i] = math.sqrt(((x[rows] - centre[i]) ** 2).sum(1).max())
        if 2 * i + 2 < nodes:
            mid = (lo[i] + hi[i]) // 2
            if len(rows) > 1:
                a = x[rows[((x[rows] - centre[i]) ** 2).sum(1).argmax()]]
                b = x[rows[((x[rows] - a) ** 2).sum(1).argmax()]]
                order[lo[i] : hi[i]] = rows[np.argsort(x[rows] @ (b - a), kind="stable")]
            lo[2 * i + 1], hi[2 * i + 1], lo[2 * i + 2], hi[2 * i + 2] = lo[i], mid, mid, hi[i]
    to = io.BytesIO()
    np.savez(to, order=order, lo=lo, hi=hi, centre=centre, radius=radius)
    return to.getvalue()


def _keep(top_s: np.ndarray, top_i: np.ndarray, rows: np.ndarray, s: np.ndarray, at: np.ndarray, first: np.ndarray) -> None:
    """Merge scores s (rows x leaf) of vectors ``at`` into the best of the queries ``rows``."""
    m = top_s.shape[1]
    all_s = np.concatenate([top_s[rows], s], axis=1)
    all_i = np.concatenate([top_i[rows], np.broadcast_to(at, s.shape)], axis=1)
    tie = np.where(all_i >= 0, first[all_i], np.iinfo(np.int64).max)
    o = np.lexsort((tie, -all_s), axis=1)[:, :m]
    top_s[rows], top_i[rows] = np.take_along_axis(all_s, o, 1), np.take_along_axis(all_i, o, 1)


def search(k: int):
    """The search of one block of queries in one shard."""

    def run(x, ids, tree, q, q_ids, floor) -> pd.DataFrame:
        t = np.load(io.BytesIO(tree))
        order, lo, hi, centre, radius = (t[c] for c in ("order", "lo", "hi", "centre", "radius"))
        m, nodes = k + 1, len(radius)
        norm = np.sqrt((q * q).sum(1))
        slack = 1e-9 * (1 + norm * np.sqrt((x * x).sum(1).max(initial=0)))
        bound = q @ centre.T + norm[:, None] * radius[None, :] + slack[:, None]
        top_s, top_i = np.full((len(q), m), -np.inf), np.full((len(q), m), -1)
        least = lambda r: np.maximum(top_s[r, -1], floor[r])
        first = ids[:, 0]

        def score(leaf: int, rows: np.ndarray) -> None:
            at = order[lo[leaf] : hi[leaf]]
            if len(at) and len(rows):
                _keep(top_s, top_i, rows, q[rows] @ x[at].T, at, first)

        # first the leaf that the larger bounds lead to, for a good kth score
        node = np.zeros(len(q), np.int64)
        while 2 * node[0] + 2 < nodes:
            a, b = 2 * node + 1, 2 * node + 2
            r = np.arange(len(q))
            node = np.where(bound[r, a] >= bound[r, b], a, b)
        for leaf in np.unique(node):
            score(leaf, np.flatnonzero(node == leaf))
        # then every branch whose bound reaches the kth score, leaves with the largest bounds first
        live, level = {0: np.arange(len(q))}, [0]
        while 2 * level[0] + 2 < nodes:
            down = []
            for p in level:
                for c in (2 * p + 1, 2 * p + 2):
                    rows = live[p]
                    live[c] = rows[bound[rows, c] >= least(rows)]
                    down.append(c)
            level = down
        for leaf in sorted((c for c in level if len(live[c])), key=lambda c: -bound[live[c], c].max()):
            rows = live[leaf]
            score(leaf, rows[(bound[rows, leaf] >= least(rows)) & (node[rows] != leaf)])
        s = np.where(top_i >= 0, top_s, np.nan)
        return V.expand(q_ids, s, np.where(top_i[:, :, None] >= 0, ids[top_i], np.iinfo(np.int64).max), k, smaller_is_better=False)

    return run


def top_k(embeddings: DataFrame, *, k: int = 5, query_mod: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k largest integer inner products: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries: ids divisible by ``query_mod``; candidates: every
    row but the query's own; ties go to the smaller id. Shards are searched in waves that double,
    and the kth scores so far bound the branches of the next wave.

    Null ids, null vectors and vectors with null or non-finite components take no part. Vectors
    meet only those of their own length. Of rows that share an id, the smallest vector counts. An
    empty table gives no rows; columns besides the two named are ignored. Scores must fit in 53 bits.
    """
    df = V.usable(embeddings, id_col, vec_col, nonzero=False).withColumn("vec", F.transform("vec", lambda v: F.floor(v * scale).cast("double")))
    df = materialise(df, "ip-vectors")
    distinct = materialise(V.distinct_vectors(df, k, df.count()), "ip-distinct")
    shards, n_shards = V.pack_shards(distinct, k, build, distinct.count())
    shards = materialise(shards, "ip-shards")
    queries = df.where(F.col("vec_id") % query_mod == 0)
    found, kth, done = None, None, 0
    while done < n_shards:
        # each wave searches as many shards as all before it, bounded by the kth scores that they have found
        wave = range(done, min(n_shards, max(1, 2 * done)))
        blocks, n_blocks = V.pack_queries(queries, kth)
        part = V.search_blocks(shards, wave, blocks, n_blocks, k, search(k))
        part = part if found is None else found.unionByName(part)
        found = materialise(V.best(part, k, smaller_is_better=False), "ip-found")
        kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        found, done = found.drop("rank"), wave.stop
    return V.best(found, k, smaller_is_better=False).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
