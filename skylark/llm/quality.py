"""Quality scores from preference pairs: a Bradley-Terry model on differences of text features."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on at most, and the pairs drawn from them.
FIT_ROWS = 20_000
FIT_PAIRS = 20_000
#: Buckets of hashed letter trigrams beside the general features, and how much more their weights are held back.
BUCKETS = 256
LEXICAL_RIDGE = 0.3
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_STOPS, _SIGNS = b".,;:'\"()-", b"%$#&*|!<>{}[]=_~^\\/@+`?"
_WIDE = bytes(range(128, 256))
GENERAL = 14
FEATURES = GENERAL + BUCKETS


def trigrams(raw: bytes) -> np.ndarray:
    """The square roots of the shares of hashed byte trigrams, A-Z in lower case, in BUCKETS buckets."""
    x = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(BUCKETS)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.sqrt(np.bincount((h >> np.uint32(16)) % np.uint32(BUCKETS), minlength=BUCKETS) / len(h))


def features(text: str | None) -> np.ndarray:
    """FEATURES numbers of a whole text, an empty one for null: shares and logarithms of counts, then trigrams."""
    text = text or ""
    raw = text.encode()
    n = max(1, len(raw))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    upper, lower = share(_UPPER), share(_LOWER)
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    general = [
        upper / max(upper + lower, 1 / n), lower, share(_DIGIT), share(_STOPS), share(_SIGNS), share(_WIDE), len(set(words)) / m, sum(map(operator.eq, words, words[1:])) / m,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n), np.log1p(len(words)), np.log1p(n / m), np.log1p(len(lines)), float(not words),
    ]
    return np.concatenate([general, trigrams(raw)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(x: np.ndarray, y: np.ndarray, *, cut: float, ridge: float = 1e-3, steps: int = 40, seed: int = 5) -> dict[str, np.ndarray | float]:
    """Weights by logistic loss on feature differences of (better, worse) pairs, and the quantile threshold.

    A document's strength is weights . standardised features. The threshold is the strength quantile
    at the share of worse documents among the labelled, refined to where fewest labelled rows lie on
    the wrong side near it; scores are shifted so that the threshold scores ``cut``.
    """
    mean, std = (x.mean(0), x.std(0)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    std = np.where(std > 1e-9, std, 1.0)
    z = (x - mean) / std
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(FEATURES)
    if not len(good) or not len(bad):
        return {"mean": mean, "std": std, "w": w, "shift": 0.0}
    held = ridge * np.where(np.arange(FEATURES) < GENERAL, 1.0, LEXICAL_RIDGE / ridge)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, FIT_PAIRS)] - z[rng.choice(bad, FIT_PAIRS)]
    for _ in range(steps):  # Newton's method
        p = _sigmoid(d @ w)
        gradient = d.T @ (p - 1) / len(d) + held * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + np.diag(held)
        move = np.linalg.solve(curve, gradient)
        w -= move / max(1.0, np.abs(move).max() / 2)
        if np.abs(move).max() < 1e-8:
            break
    strength = z @ w
    base = len(bad) / len(y)
    shares = np.unique(np.clip(np.linspace(0.5, 1.5, 81) * base, 0, 1))
    cuts = np.quantile(strength, shares)
    wrong = [((strength[good] < c).sum() + (strength[bad] >= c).sum()) for c in cuts]
    least = np.flatnonzero(np.array(wrong) == min(wrong))
    threshold = float(cuts[least[len(least) // 2]])
    # half way to the next strength below, so that no labelled row lies on it
    below = strength[strength < threshold - 1e-6]
    threshold = (threshold + float(below.max())) / 2 if len(below) else threshold
    return {"mean": mean, "std": std, "w": w, "shift": np.log(cut / (1 - cut)) - threshold}


def held_out(doc_id):
    """Whether crc32 of the id's text is a multiple of 5; such rows' labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, cut: float, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model from FIT_ROWS labelled rows at most, picked by a hash of their ids."""
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(y), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "x": [features(t).astype("<f4").tobytes() for t in pdf["text"]]})

    rows = picked.select("doc_id", "quality", "text").mapInPandas(run, "doc_id long, quality int, x binary").toPandas()
    rows = rows.sort_values("doc_id").drop_duplicates("doc_id")
    return fit(np.frombuffer(b"".join(rows["x"]), "<f4").astype(float).reshape(-1, FEATURES), rows["quality"].to_numpy(int), cut=cut)


def score(docs: DataFrame, labels: DataFrame, *, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Scores lie between 0 and 1, higher for better; predicted is 1 from ``cut`` on. Only the text is
    used for a score. A null text counts as empty, and empty texts get a score too; a null id is not
    held out. Repeated rows give one result each; without labels of both kinds every score is 0.5; an
    empty table gives no rows; columns with other names are ignored.
    """
    model = train(docs, labels, cut=cut, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([features(t) for t in pdf["text"]], float).reshape(-1, FEATURES)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": _sigmoid((x - model["mean"]) / model["std"] @ model["w"] + model["shift"])})

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose own text scores ``cut`` or more, with all their columns, whatever their ids."""
    model = train(docs, labels, cut=cut, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            x = np.array([features(t) for t in batch.column(text_col).to_pylist()], float).reshape(-1, FEATURES)
            score = _sigmoid((x - model["mean"]) / model["std"] @ model["w"] + model["shift"])
            yield batch.filter(pa.array(score >= cut))

    return docs.mapInArrow(run, docs.schema)
