"""Vector tables as blocks: distinct vectors in shards, queries in blocks, one task for each pair.

A shard or block is one row with numpy arrays as bytes, of bounded size. Equal vectors are stored
once with their ``k + 1`` smallest ids: no query can need more of them, as ties go to smaller ids
and a query leaves out its own id only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
SALT_ROWS = 65536

SHARD_SCHEMA = "dim int, shard int, ids binary, vecs binary, extra binary"
BLOCK_SCHEMA = "dim int, block int, ids binary, vecs binary, floor binary"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def usable(embeddings: DataFrame, id_col: str, vec_col: str, *, nonzero: bool) -> DataFrame:
    """Rows (vec_id, vec as doubles) that take part.

    Left out: null ids, null vectors and vectors with null or non-finite components, and zero or
    empty vectors if ``nonzero``. Of rows with the same id the smallest vector counts.
    """
    x = F.col("vec")
    df = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    df = df.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~bad)
    if nonzero:
        df = df.where(F.exists(x, lambda v: v != 0.0))
    return df.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def distinct_vectors(df: DataFrame, k: int, rows: int) -> DataFrame:
    """(vec, ids): every distinct vector with its k + 1 smallest ids. A hot vector is counted in salted parts first."""
    part = F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1)
    salted = df.groupBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, math.ceil(rows / SALT_ROWS)))).alias("salt")).agg(part.alias("ids"))
    return salted.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def pack_shards(df: DataFrame, k: int, extra: Callable[[np.ndarray], bytes], count: int) -> tuple[DataFrame, int]:
    """Shards of about SHARD_ROWS distinct vectors and what ``extra`` builds over each."""
    n = max(1, math.ceil(count / SHARD_ROWS))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.full((len(pdf), k + 1), np.iinfo(np.int64).max, np.int64)
        for i, x in enumerate(pdf["ids"]):
            ids[i, : len(x)] = x
        order = np.argsort(ids[:, 0], kind="stable")
        vecs = np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), -1)[order]
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "ids": _blob(ids[order]), "vecs": _blob(vecs), "extra": extra(vecs)}])

    keyed = df.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec"), F.lit(n)).cast("int").alias("shard"), "vec", "ids")
    return keyed.groupBy("dim", "shard").applyInPandas(pack, SHARD_SCHEMA), n


def pack_queries(df: DataFrame, floors: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Query blocks of about BLOCK_ROWS rows; floors (query_id, floor): a score that the kth best has already."""
    n = max(1, math.ceil(df.count() / BLOCK_ROWS))
    q = df.select("vec_id", "vec")
    q = q.join(floors, q.vec_id == floors.query_id, "left").drop("query_id") if floors is not None else q.withColumn("floor", F.lit(None).cast("double"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        vecs = np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), -1)
        floor = pdf["floor"].fillna(-np.inf).to_numpy(np.float64)
        return pd.DataFrame([{"dim": key[0], "block": key[1], "ids": _blob(pdf["vec_id"].to_numpy(np.int64)), "vecs": _blob(vecs), "floor": _blob(floor)}])

    keyed = q.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"), "vec_id", "vec", "floor")
    return keyed.groupBy("dim", "block").applyInPandas(pack, BLOCK_SCHEMA), n


def expand(query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, *, smaller_is_better: bool) -> pd.DataFrame:
    """The k best (query, id, score) of each query from its best distinct vectors.

    scores: queries x m, not-found as NaN; ids: queries x m x (k + 1).
    """
    nq, m, c = ids.shape
    flat_ids, flat = ids.reshape(nq, m * c), np.repeat(scores, c, axis=1)
    out = []
    for i in range(nq):
        ok = (flat_ids[i] != np.iinfo(np.int64).max) & (flat_ids[i] != query_ids[i]) & ~np.isnan(flat[i])
        s, v = flat[i][ok], flat_ids[i][ok]
        o = np.lexsort((v, s if smaller_is_better else -s))[:k]
        out.append(pd.DataFrame({"query_id": np.full(len(o), query_ids[i]), "vec_id": v[o], "score": s[o]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search_blocks(shards: DataFrame, numbers: range, blocks: DataFrame, n_blocks: int, k: int, search: Callable) -> DataFrame:
    """Run ``search(vecs, ids, extra, query_vecs, query_ids, floor) -> DataFrame`` on every pair of a shard of the given numbers and a block.

    The query set is stated, so each block meets each shard once; a task holds one of each.
    """
    left = shards.where(F.col("shard").between(numbers[0], numbers[-1])).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(numbers[0]), F.lit(numbers[-1]))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        s, q = a.iloc[0], b.iloc[0]
        ids = np.frombuffer(s["ids"], np.int64).reshape(-1, k + 1)
        q_ids = np.frombuffer(q["ids"], np.int64)
        return search(
            np.frombuffer(s["vecs"], np.float64).reshape(len(ids), -1), ids, s["extra"],
            np.frombuffer(q["vecs"], np.float64).reshape(len(q_ids), -1), q_ids, np.frombuffer(q["floor"], np.float64),
        )

    keys = ["dim", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, FOUND_SCHEMA)


def best(found: DataFrame, k: int, *, smaller_is_better: bool) -> DataFrame:
    """The k best rows of each query over all shards, with their rank; a shard has sent k at most."""
    by = F.col("score").asc() if smaller_is_better else F.col("score").desc()
    w = Window.partitionBy("query_id").orderBy(by, F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
