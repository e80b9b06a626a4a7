"""Near-duplicate documents: an LSH forest over MinHash signatures, links confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import materialise as written
from skylark.llm.components import components
from skylark.llm.vocab import Words

#: Orders of the forest and the hashes of each; a signature holds them all.
TREES, DEPTH = 16, 6
#: Prefix lengths that regions may have: the first that leaves at most REGION members.
STEPS = (3, 4, 6)
REGION = 2048
#: Orders whose neighbours are linked before regions are compared.
ORDERS = 4
#: Bins of the sketch by which pairs are told, of which the first COARSE are looked at before the
#: others, and the standard deviations that it allows.
BINS, COARSE, SPREAD = 512, 64, 4
_SEED = np.random.default_rng(20240607)
_MUL = _SEED.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_PLACES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_HASHED = Words(lambda part: [xxhash.xxh3_64_intdigest(w) for w in part], limit=60_000)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes of 64 bits; fewer words make one shingle, none an empty set."""
    split = [(t or "").encode().lower().split() for t in texts]
    _HASHED.learn(set().union(*split))
    out = []
    for own in split:
        h = np.fromiter(map(_HASHED.__getitem__, own), np.uint64, len(own))
        if len(h) < words:
            s = np.array([xxhash.xxh3_64_intdigest(b"\x20".join(own))], np.uint64) if len(h) else h
        else:
            n = len(h) - words + 1
            s = np.zeros(n, np.uint64)
            for i in range(words):
                s += _mix(h[i : i + n] + _PLACES[i]) * _PLACES[-1 - i]
            s = np.unique(_mix(s))
        out.append(s)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets, a row each: the low 16 bits of 32-bit minima."""
    out = np.zeros((len(sets), TREES * DEPTH), np.uint16)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 16384):
            size += len(sets[end])
            end += 1
        h = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for i in range(TREES * DEPTH):
            out[at:end, i] = np.minimum.reduceat(((h * _MUL[i] + _ADD[i]) >> np.uint64(32)).astype(np.uint32), starts) & np.uint32(0xFFFF)
        at = end
    return out


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """One-permutation sketch of a sorted set: each of BINS bins holds 8 bits of its smallest hash, or 0 if it is empty."""
    bins = (shingles >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = shingles[first] % np.uint64(255) + np.uint64(1)
    return out


def fine_near(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sketches (rows), or of their first bins, which can belong to sets as similar as ``ratio``, given the sum of their sizes, and how much they agree.

    The hashes in the bins are drawn from the union without replacement, so the spread falls to
    nothing for sets that fit into them.
    """
    used = ((x | y) != 0).sum(1)
    same = ((x == y) & (x != 0)).sum(1)
    union = np.maximum(sizes / (1 + ratio), used)
    rest = np.maximum(union - 1, 1)
    spread = np.sqrt(ratio * (1 - ratio) * np.maximum((1 + 1 / rest) / np.maximum(used, 1) - 1 / rest, 0))
    return same >= (ratio - SPREAD * spread) * used - 1, same / np.maximum(used, 1)


def _batches(batches: Iterator[pa.RecordBatch], words: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, shingle_sets(part.column("text").to_pylist(), words)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, fine): the size, a 128-bit key, the signature and the sketch of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _batches(batches, words):
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([fine_sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], names=["doc_id", "n_shingles", "set_key", "sig", "fine"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary, fine binary")


def forest(reps: DataFrame) -> DataFrame:
    """(tree, hi, lo, k3, k4, k6, rep): each signature's place in every order, and its prefixes' hashes.

    An order sorts signatures by its DEPTH hashes, of which ``hi`` holds the first four and ``lo``
    the others; so the signatures with the longest common prefixes stand side by side.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), TREES, DEPTH).astype(np.uint64)
            packed = [np.zeros(sig.shape[:2], np.uint64), np.zeros(sig.shape[:2], np.uint64)]
            for i in range(DEPTH):
                packed[i // 4] = packed[i // 4] << np.uint64(16) | sig[:, :, i]
            out = {"tree": np.tile(np.arange(TREES, dtype=np.int32), len(pdf)), "hi": packed[0].view(np.int64).reshape(-1), "lo": packed[1].view(np.int64).reshape(-1)}
            h = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) * _PLACES[0], sig.shape[:2]).copy()
            for i in range(DEPTH):
                h = _mix(h * _PLACES[1] + sig[:, :, i])
                if i + 1 in STEPS:
                    out[f"k{i + 1}"] = h.view(np.int64).reshape(-1)
            yield pd.DataFrame(out | {"rep": np.repeat(pdf["rep"].to_numpy(), TREES)})

    return reps.select("rep", "sig").mapInPandas(run, "tree int, hi long, lo long, " + ", ".join(f"k{s} long" for s in STEPS) + ", rep long")


def sized(df: DataFrame, key: str, name: str, least: int) -> DataFrame:
    """The rows of df whose key is on at least so many rows, with that number."""
    sizes = df.groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) >= least)
    return df.join(sizes.hint("shuffle_hash"), key)


def in_order(members: DataFrame) -> DataFrame:
    """(a, b): neighbours in the first ORDERS orders that share a region; of all prefixes they share the longest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            if len(pdf):
                pdf = pdf if last is None else pd.concat([last, pdf], ignore_index=True)
                key, rep = pdf[f"k{STEPS[0]}"].to_numpy(), pdf["rep"].to_numpy()
                same = key[1:] == key[:-1]
                yield pd.DataFrame({"a": np.minimum(rep[:-1], rep[1:])[same], "b": np.maximum(rep[:-1], rep[1:])[same]})
                last = pdf.iloc[-1:]

    place = ["tree", "hi", "lo", "rep"]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = members.where(F.col("tree") < ORDERS).select(f"k{STEPS[0]}", *place).repartitionByRange(n, *place).sortWithinPartitions(*place)
    return own.mapInPandas(run, "a long, b long").distinct()


def regions(members: DataFrame) -> DataFrame:
    """(tree, region, side, whole, rep): regions of two or more, each as deep as its size asks for.

    A region of at most REGION members at the first step is whole. Of a larger one, here only its
    parts with longer prefixes appear, of the first step that leaves at most REGION members.
    """
    row = lambda key, whole: ("tree", F.col(key).alias("region"), F.lit(-1).alias("side"), F.lit(whole).alias("whole"), "rep")
    out, left = members.where(F.col("n") <= REGION).select(*row(f"k{STEPS[0]}", True)), members.where(F.col("n") > REGION)
    for step in STEPS[1:]:
        key = f"k{step}"
        left = sized(left.drop("n"), key, "n", 2)
        out = out.unionByName(left.where(F.col("n") <= REGION).select(*row(key, False)))
        left = left.where(F.col("n") > REGION)
    return out


def blocks(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(tree, region, side, whole, rep): the large regions of the first step, cut into pairs of runs.

    Members of a component that is large within its region form runs of their own, the others share
    some, of about REGION each. Two runs meet in one block, where members of the same side are not
    compared, unless both are of one component; a shared run meets itself too, with side -1.
    """
    key, shared = f"k{STEPS[0]}", F.lit(-(1 << 63)).cast("long")
    own = with_comps(members.where(F.col("n") > REGION).select("tree", key, "rep"), comps)
    per = own.groupBy(key, "comp").agg(F.count("*").alias("m")).withColumn("of", F.when(F.col("m") > REGION // 2, F.col("comp")))
    # a region without a second component has no rows here
    pools = per.groupBy(key, "of").agg(F.sum("m").alias("m"), F.count("*").alias("c"))
    mixed = pools.groupBy(key).agg(F.sum("c").alias("c")).where("c > 1").select(key)
    pools = pools.join(mixed, key).withColumn("runs", F.ceil(F.col("m") / REGION).cast("int"))
    runs = written(pools.select(key, "of", "c", "runs", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run")), "runs")
    other = runs.select(F.col(key).alias("_k"), F.col("of").alias("other_of"), F.col("run").alias("other_run"))
    first = F.struct(F.coalesce("of", shared).alias("of"), F.col("run").alias("run"))
    second = F.struct(F.coalesce("other_of", shared).alias("of"), F.col("other_run").alias("run"))
    apart = F.col("of").isNull() | F.col("other_of").isNull() | (F.col("of") != F.col("other_of"))
    meets = runs.join(other, F.col(key) == F.col("_k")).where(apart & (F.to_json(first) <= F.to_json(second)))
    meets = meets.select(key, F.xxhash64(key, F.to_json(first), F.to_json(second)).alias("region"), F.struct(first.alias("x"), second.alias("y")).alias("p"))
    same = F.to_json("p.x") == F.to_json("p.y")
    sides = meets.select(key, "region", F.when(same, -1).otherwise(0).alias("side"), F.col("p.x").alias("r")).unionByName(
        meets.where(~same).select(key, "region", F.lit(1).alias("side"), F.col("p.y").alias("r")))
    sides = sides.select(key, "region", "side", F.col("r.of").alias("_of"), F.col("r.run").alias("run"))
    placed = own.join(per.select(key, "comp", "of"), [key, "comp"]).select("tree", key, "rep", F.coalesce("of", shared).alias("_of"))
    counts = pools.select(key, F.coalesce("of", shared).alias("_of"), "runs")
    placed = placed.join(counts, [key, "_of"]).withColumn("run", F.pmod(F.xxhash64("rep", "tree"), F.col("runs")).cast("int"))
    return placed.join(sides, [key, "_of", "run"]).select("tree", "region", "side", F.lit(True).alias("whole"), "rep")


def with_comps(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members with their components so far as comp."""
    named = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    return named.withColumn("comp", F.coalesce("root", "rep")).drop("root")


def _all_pairs(starts: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all pairs within the runs of a sorted table, some at a time.

    In a run with firsts, its first so many members are compared with its others only.
    """
    for m in np.unique(sizes[(sizes > 1) & (firsts == 0)]):
        i, j = np.triu_indices(int(m), 1)
        at = starts[(sizes == m) & (firsts == 0)]
        step = max(1, 50_000 // len(i))
        for k in range(0, len(at), step):
            own = at[k : k + step, None]
            if len(i) <= 50_000:
                yield (own + i).reshape(-1), (own + j).reshape(-1)
            else:
                for c in range(0, len(i), 50_000):
                    yield own[0] + i[c : c + 50_000], own[0] + j[c : c + 50_000]
    for at, n, m in zip(starts[firsts > 0], sizes[firsts > 0], firsts[firsts > 0], strict=True):
        j = np.arange(at + m, at + n)
        step = max(1, 50_000 // max(1, len(j)))
        for k in range(at, at + m, step):
            i = np.arange(k, min(k + step, at + m))
            yield np.repeat(i, len(j)), np.tile(j, len(i))


def _links(pdf: pd.DataFrame, ratio: float, best: bool) -> pd.DataFrame:
    """Pairs (a, b, score) between different components of whole regions whose sizes and sketches allow for a link.

    Of a pair that several whole regions hold, only the first tree in which both share the shortest
    prefix tells. With ``best``, of each a only the pair that agrees most, told both ways.
    """
    rep, comp, tree, whole, size = (pdf[c].to_numpy() for c in ("rep", "comp", "tree", "whole", "n_shingles"))
    fine = np.frombuffer(b"".join(pdf["fine"]), np.uint8).reshape(len(pdf), BINS)
    coarse = np.ascontiguousarray(fine[:, :COARSE])
    heads = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), TREES, DEPTH)[:, :, : STEPS[0]]
    region = pdf["region"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
    sizes = np.diff(np.append(starts, len(pdf)))
    firsts = np.add.reduceat((pdf["side"].to_numpy() == 0).astype(np.int64), starts)
    # a run with one side only has no pairs
    sizes = np.where(firsts == sizes, 1, sizes)
    found = []
    for i, j in _all_pairs(starts, sizes, firsts):
        ok = (comp[i] != comp[j]) & (np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        score = np.zeros(0)
        for part, step in ((coarse, 50_000), (fine, 5_000)):
            cuts = np.array_split(np.arange(len(i)), len(i) // step + 1)
            ok, score = (np.concatenate(x) for x in zip(*(fine_near(part[i[k]], part[j[k]], size[i[k]] + size[j[k]], ratio) for k in cuts), strict=True))
            i, j, score = i[ok], j[ok], score[ok]
        shared = (heads[i] == heads[j]).all(2)
        ok = ~whole[i] | (shared.argmax(1) >= tree[i])
        i, j, score = i[ok], j[ok], score[ok]
        if best:
            i, j, score = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([score, score])
            order = np.lexsort((rep[j], -score, i))
            order = order[np.concatenate([[True], np.diff(i[order]) != 0])] if len(order) else order
            i, j, score = i[order], j[order], score[order]
        found.append((rep[i], rep[j], score))
    a, b, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pd.DataFrame({"a": a, "b": b, "score": score}) if best else pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score})


def across(members: DataFrame, reps: DataFrame, comps: DataFrame, ratio: float, best: bool) -> DataFrame:
    """(a, b): all pairs of a region, between components, whose sketches can belong to a link, or of each member the ``best`` one.

    Sets whose sizes differ by more than ``ratio`` cannot be that similar, and regions of a single
    component are not read.
    """
    own = with_comps(members, comps)
    mixed = own.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("region")
    own = own.join(mixed, "region")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf["region"] == pdf["region"].iat[-1]
            kept = pdf[last]  # the next batch may go on with it
            if not last.all():
                yield _links(pdf[~last], ratio, best)
        if kept is not None:
            yield _links(kept, ratio, best)

    full = own.join(reps.select("rep", "n_shingles", "sig", "fine"), "rep").select("tree", "region", "side", "whole", "rep", "comp", "n_shingles", "sig", "fine")
    n = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = full.repartition(n, "region").sortWithinPartitions("region", "side", "rep").mapInPandas(run, "a long, b long, score double")
    if best:
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.select("a", "b").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, shingles): the whole sets of the wanted (rep, set_key) documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _batches(batches, words):
            own = [(i, s.view(np.int64)) for i, s, k in zip(part.column("doc_id").to_pylist(), sets, part.column("set_key").to_pylist(), strict=True) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([s for _, s in own], pa.list_(pa.int64()))], names=["rep", "shingles"])

    named = wanted.withColumnRenamed("rep", "doc_id").hint("shuffle_hash")
    return docs.join(named, "doc_id").select("doc_id", "text", "set_key").mapInArrow(run, "rep long, shingles array<long>").dropDuplicates(["rep"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their sets.

    A join by either end brings the sets; what one set has in many pairs is split as a skewed join is.
    """
    x, y = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")


def near_duplicates(docs: DataFrame, *, words: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents grouped by links of near-equal shingle sets.

    Words are runs of anything but ASCII white space, A-Z in lower case; a set holds the distinct
    shingles of ``words`` words, or the whole of a shorter text. Documents are linked if 100 *
    intersection >= percent * union; component_id is the smallest id that a document reaches and
    kept marks it. Equal sets are one class, whatever their number. Candidates come from the forest:
    first each one's neighbours in some sorted orders, which share the longest prefixes with it; then,
    within regions as deep as their sizes ask for, in two rounds each one's best neighbour of another
    component and in a third all pairs that no link joins yet; at last, of regions that are large at
    their shortest prefix, all pairs that no link joins yet. Pairs whose
    sketches cannot belong to a link are left out and all others confirmed on full sets. So a pair
    just at the threshold is lost only if no tree has its first hashes equal, or by its sketch.

    A text without words, or null, has an empty set and is linked with nothing. Rows with a null id
    keep a null component_id and are kept. Repeated rows are returned as often as they appear; of
    different texts under one id, one stands for that id's links. An empty table gives no rows; other
    columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = written(sketch(docs, words), "sketches")
    has = sketched.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    reps = has.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "fine")])
    reps = written(reps, "reps")
    classes, reps = reps.select("set_key", "rep"), reps.dropDuplicates(["rep"])
    members = written(sized(forest(reps), f"k{STEPS[0]}", "n", 2), "members")
    sets = written(full_sets(docs, reps.join(members.select("rep").distinct(), "rep").select("rep", "set_key"), words), "sets")
    ratio = percent / 100
    seen = written(in_order(members), "candidates")
    links = written(confirm(seen, sets, percent), "links")
    comps = written(components(links), "components")
    for best, near in ((True, regions), (True, regions), (False, regions), (False, blocks)):
        near = blocks(members, comps) if near is blocks else regions(members)
        more = written(across(near, reps, comps, ratio, best).join(seen, ["a", "b"], "left_anti"), "candidates")
        found = written(confirm(more, sets, percent), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            comps = written(components(links), "components")
        seen = seen.unionByName(more)
    classes = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("class"))
    out = sketched.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
