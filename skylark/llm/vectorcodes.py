"""Vector code compression: a codebook for each part of the vectors, fitted and applied in exact integers.

Distances are screened by float32 matrix products with bounds on their rounding error; every entry
that may still be the nearest is measured again in int64, and ties go to the smaller index. So the
codes equal those of exact arithmetic whatever the hardware's order of summation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylark.llm.common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of label sums that are broadcast at most; more are joined in SALTS shuffled copies.
BROADCAST_LABELS = 100_000
SALTS = 16

#: Codebooks by vector length: for each part an array of entries x components.
Books = dict[int, list[np.ndarray]]

FIRST_SCHEMA = "dim int, vec_id long, vec array<double>"
SUM_SCHEMA = "dim int, part int, entry int, n long, sums array<string>"


def limit(dim: int) -> int:
    """The largest component for which squared distances over ``dim`` components fit int64 with room to spare."""
    return math.isqrt((1 << 61) // max(1, dim)) // 2


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; they are equal if ``parts`` divides the length, else differ by one."""
    return [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]


def integers(vecs: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 where ``limit`` allows it, else as Python integers; scale is a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(vecs * float(scale))
    if not y.size or np.abs(y).max() <= limit(vecs.shape[1]):
        return y.astype(np.int64)
    return np.array([[math.floor(Fraction(x) * scale) for x in row] for row in vecs.tolist()], object)


def book(entries: list[list[int]], dim: int) -> np.ndarray:
    """Entries as int64 where ``limit`` allows it, else as Python integers."""
    small = all(abs(x) <= limit(dim) for e in entries for x in e)
    return np.array(entries, np.int64 if small else object).reshape(len(entries), -1)


def screened(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which entries may be the nearest to each row, by float32 products and bounds on their error.

    A float32 product of d terms, its inputs rounded too, is off by at most g = (d + 2)u / (1 - (d + 2)u)
    times the sum of the terms' sizes, in any order of summation, u = 2**-24; that sum is at most the
    product of the norms. The row's own square is the same for all entries and left out.
    """
    d, u = x.shape[1], 2.0**-24
    g = (d + 2) * u / (1 - (d + 2) * u)
    dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    squares = (c * c).sum(1).astype(np.float64)
    norms = np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * np.sqrt(squares)[None]
    score = squares[None] - 2 * dot
    slack = 2 * g * norms * (1 + 2.0**-30) + 2.0**-50 * (squares[None] + 2 * np.abs(dot))
    return score - slack <= (score + slack).min(1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry to each row, ties to the smaller, and the squared distance, both exact."""
    if x.dtype == object or c.dtype == object:
        dist = np.array([[sum((a - b) ** 2 for a, b in zip(row, e, strict=True)) for e in c.tolist()] for row in x.tolist()], object)
        best = np.array([min(range(len(r)), key=r.__getitem__) for r in dist.tolist()], np.int64)
        return best, dist[np.arange(len(x)), best]
    rows, cols = np.nonzero(screened(x, c))
    dist = ((x[rows] - c[cols]) ** 2).sum(1)
    starts = np.searchsorted(rows, np.arange(len(x)))
    best = np.minimum.reduceat(dist, starts)
    hit = np.flatnonzero(dist == best[rows])
    return cols[hit[np.searchsorted(rows[hit], np.arange(len(x)))]], best


def by_length(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, integer vectors) of a batch; rows too large for int64 come apart from the others."""
    vec = batch.column("vec")
    lengths = vec.value_lengths().to_numpy(zero_copy_only=False)
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)]
        wide = np.abs(x).max(1, initial=0) > limit(dim) / (2 * scale)
        for mask in (~wide, wide):
            if mask.any():
                yield dim, rows[mask], integers(x[mask], scale)


def first_vectors(kept: DataFrame, entries: int) -> DataFrame:
    """The vectors of the ``entries`` smallest ids of each length, null as the largest; of equal ids the smallest vector.

    Each task sends its own smallest ones only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            ids, vecs = batch.column("vec_id").to_pylist(), batch.column("vec")
            lengths = vecs.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                own = held.setdefault(dim, {})
                worst = max(map(_id_order, own), default=None) if len(own) >= entries else None
                for i in np.flatnonzero(lengths == dim).tolist():
                    if worst is None or _id_order(ids[i]) <= worst:
                        v = vecs[i].as_py()
                        own[ids[i]] = min(own.get(ids[i], v), v)
                        if len(own) > entries:
                            del own[max(own, key=_id_order)]
                            worst = max(map(_id_order, own))
        rows = [(dim, i, v) for dim, own in held.items() for i, v in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["dim", "vec_id", "vec"])

    return kept.select("vec_id", "vec").mapInArrow(run, FIRST_SCHEMA).groupBy("dim", "vec_id").agg(F.min("vec").alias("vec"))


def _id_order(x: int | None) -> tuple:
    return x is None, x or 0


def starting_books(kept: DataFrame, parts: int, entries: int, scale: int) -> Books:
    """The parts of the first vectors of each length; at most ``entries`` of a length reach the driver from each task's own."""
    w = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last())
    rows = first_vectors(kept, entries).withColumn("place", F.row_number().over(w)).where(F.col("place") <= entries).orderBy("dim", "place").collect()
    books: dict[int, list[list[list[int]]]] = {}
    for r in rows:
        v = integers(np.array([r.vec], np.float64).reshape(1, -1), scale)[0].tolist()
        own = books.setdefault(r.dim, [[] for _ in range(parts)])
        for p, (a, b) in enumerate(bounds(r.dim, parts)):
            own[p].append(v[a:b])
    return {dim: [book(e, dim) for e in own] for dim, own in books.items()}


def part_sums(books: Books, parts: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's counts and componentwise sums of the parts that each entry is nearest to, as exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[int, list[int]]] = {}
        for batch in batches:
            for dim, _, x in by_length(batch, scale):
                for p, (a, b) in enumerate(bounds(dim, parts)):
                    own, _ = nearest(x[:, a:b], books[dim][p])
                    order = np.argsort(own, kind="stable")
                    used, starts, sizes = np.unique(own[order], return_index=True, return_counts=True)
                    sums = np.add.reduceat(x[order, a:b], starts, axis=0).tolist()
                    for e, n, s in zip(used.tolist(), sizes.tolist(), sums, strict=True):
                        m, t = held.get((dim, p, e), (0, [0] * (b - a)))
                        held[dim, p, e] = m + n, [i + j for i, j in zip(t, s, strict=True)]
        if held:
            yield pa.RecordBatch.from_pylist([{"dim": d, "part": p, "entry": e, "n": n, "sums": [str(s) for s in t]} for (d, p, e), (n, t) in held.items()], _SUMS)

    return run


_SUMS = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    one = pdf.iloc[:1].copy()
    one["n"] = pdf["n"].sum()
    one["sums"] = [[str(sum(map(int, xs))) for xs in zip(*pdf["sums"], strict=True)]]
    return one


def refined(kept: DataFrame, books: Books, parts: int, scale: int) -> Books:
    """One round: every part to its nearest entry, then each entry the floor of its parts' mean; unused entries stay."""
    out = {dim: [[list(e) for e in b.tolist()] for b in own] for dim, own in books.items()}
    for r in kept.select("vec").mapInArrow(part_sums(books, parts, scale), SUM_SCHEMA).groupBy("dim", "part", "entry").applyInPandas(_total, SUM_SCHEMA).collect():
        out[r.dim][r.part][r.entry] = [int(s) // r.n for s in r.sums]
    return {dim: [book(e, dim) for e in own] for dim, own in out.items()}


def digest(own: list[np.ndarray]) -> str:
    """The sha256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in own for e in b.tolist() for x in e).encode()).hexdigest()


def fitted(kept: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Books:
    """Codebooks of ``kept`` (vec_id, vec): the first ids' vectors, then ``rounds`` rounds over all rows."""
    books = starting_books(kept, parts, entries, scale)
    for _ in range(rounds):
        books = refined(kept, books, parts, scale)
    return books


def encoded(kept: DataFrame, books: Books, *, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every row under the given codebooks."""
    digests = {dim: digest(own) for dim, own in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes, errors, shas = np.empty(n, object), np.empty(n, object), np.empty(n, object)
            for dim, rows, x in by_length(batch, scale):
                index, error = np.zeros((len(rows), parts), np.uint8), 0
                for p, (a, b) in enumerate(bounds(dim, parts)):
                    index[:, p], dist = nearest(x[:, a:b], books[dim][p])
                    error = error + dist.astype(object)
                codes[rows], shas[rows] = [r.tobytes().hex() for r in index], digests[dim]
                errors[rows] = [e if e < 1 << 63 else None for e in error]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors.tolist(), pa.int64()), pa.array(shas, pa.string())], names=names)

    names = ["vec_id", "label", "code", "error", "codebooks_sha256"]
    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")


def _sum_of(error: Column) -> Column:
    """A sum as long; null if a value is null or the sum is no long."""
    total = F.sum(error.cast("decimal(38,0)"))
    return F.when((F.count(error) == F.count(F.lit(1))) & (total <= F.lit((1 << 63) - 1).cast("decimal(38,0)")), total).cast("long")


def compress(embeddings: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: every vector as the indexes of its parts' nearest entries.

    Components become floor(scale * x). ``entries`` is 256 at most. The codebooks start as the vectors
    of the smallest ids and are refined in ``rounds`` rounds over all rows; ties go to the smaller index.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors of each
    length have codebooks of their own; parts of a length that ``parts`` does not divide differ by one
    component and may be empty, at distance 0. Repeated rows give a row each; of repeated ids the
    smallest vector starts a codebook; a null id is the largest. Components too large for int64 are
    computed in Python integers; an error beyond a long is null, and so is a sum over it. Null labels
    count together. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    x = F.col("vec")
    kind = embeddings.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    df = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = materialise(df.where(x.isNotNull()).where(~bad), "codes-vectors")
    books = fitted(kept, parts=parts, entries=entries, rounds=rounds, scale=scale)
    rows = materialise(encoded(kept, books, parts=parts, scale=scale), "codes-rows")
    sums = materialise(rows.groupBy("label").agg(_sum_of(F.col("error")).alias("label_error")), "codes-sums").withColumnRenamed("label", "_label")
    if sums.count() <= BROADCAST_LABELS:
        joined = rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        copies = sums.withColumn("_own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_own")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
