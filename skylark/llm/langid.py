"""Language of texts: a linear-chain conditional random field that labels the words of code-switched text.

Words score by hashed affixes and letter n-grams, by themselves and by their places in learned
lexicons; transitions between the labels of neighbouring words are learned too. Posteriors come from
the forward-backward algorithm, and a text's language is the one with the most words expected.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylark.llm.vocab import Words

#: Labelled rows of each language that the model is fitted on at most, and the runs of words that each gives.
FIT_ROWS = 600
RUNS, RUN_WORDS = 4, 24
#: Words of each language's lexicon, hashed features, the longest n-gram and rounds of the fit.
LEXICON, BUCKETS, LONGEST, ROUNDS = 1000, 1 << 17, 5, 30
#: Words of a training sequence, and of a piece that one step of the recurrences works on.
SEQUENCE, PIECE = 64, 256
#: Words labelled at a time, words longer than which are never kept, and words kept by a worker.
CHUNK_WORDS, LONG_WORD, KEPT_WORDS = 250_000, 64, 200_000
#: Scores of a word for two languages differ by this much at most.
WIDEST = 30.0
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_STEP = np.uint32(0x01000193)


class Model(NamedTuple):
    """Learned values: hashed weights (BUCKETS + 1) x languages, lexicon weights, transitions and starts as factors."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    lexical: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    key: str


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in order; none if no character is a letter."""
    found = _WORD.findall(text) if text else []
    return found if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w) else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of places x orders, first place of each word): hashed n-grams of ^word$ in lower case, and the word.

    An n-gram at a boundary is an affix. Order n has no n-gram at places too near the word's end: those
    hold BUCKETS, whose weight is zero. The last order holds the whole word's hash, once a word.
    """
    marked = [f"^{w.lower()}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in marked])
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    out = np.full((len(codes), LONGEST + 1), BUCKETS, np.int32)
    h = np.full(len(codes), 0x811C9DC5, np.uint32)
    for n in range(1, min(LONGEST, len(codes)) + 1):
        h[: len(codes) - n + 1] = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * _STEP
        fits = left >= n
        out[fits, n - 1] = _bucket(h[fits] + np.uint32(n))
    powers = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, np.uint64))
    whole = np.add.reduceat(codes * powers[np.arange(len(codes)) - np.repeat(starts, sizes)], starts)
    out[starts, LONGEST] = _bucket((whole ^ (whole >> np.uint64(29))).astype(np.uint32))
    return out, starts


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(12))) % np.uint32(BUCKETS)).astype(np.int32)


def _lexical(lexicon: dict[str, int], words: list[str], n: int) -> np.ndarray:
    """Words x languages: 1 where the word is in the language's lexicon."""
    held = np.array([lexicon.get(w.lower(), 0) for w in words], np.int64)
    return (held[:, None] >> np.arange(n) & 1).astype(np.float32)


def emissions(model: Model, words: list[str]) -> np.ndarray:
    """The score of each word for each language, as a factor of 1 for the best and exp(-WIDEST) at least."""
    index, starts = features(words)
    score = np.add.reduceat(model.weights[index].sum(1), starts, axis=0) + _lexical(model.lexicon, words, len(model.languages)) @ model.lexical
    return np.exp(np.maximum(score - score.max(1, keepdims=True), -WIDEST)).astype(np.float32)


def posteriors(psi: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each word's probability of each label, for texts of the given lengths (1 at least) one after the other.

    Texts are cut into pieces of PIECE words, all of which are worked on side by side: the product of
    a piece's factors first, then what comes into it from both sides, then the words within it.
    """
    k = len(start)
    count = -(-lengths // PIECE)
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(text)) - first[text]
    begin = (np.cumsum(lengths) - lengths)[text] + nth * PIECE
    size = np.minimum(PIECE, lengths[text] - nth * PIECE)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    live = np.searchsorted(-size, -np.arange(size[0]), "left")
    scaled = lambda x: x / x.sum(tuple(range(1, x.ndim)), keepdims=True)
    into, behind = np.empty((len(text), k)), np.ones((len(text), k))
    into[first] = start
    if count.max() > 1:
        through = np.eye(k)[None] * psi[begin][:, None]
        for t in range(1, size[0]):
            n = live[t]
            through[:n] = scaled((through[:n].reshape(-1, k) @ moves).reshape(n, k, k) * psi[begin[:n] + t][:, None])
        product = np.empty_like(through)
        product[order] = through
        for i in range(1, count.max()):
            at = first[count > i] + i
            into[at] = scaled((into[at - 1, None] @ product[at - 1])[:, 0] @ moves)
        for i in range(count.max() - 1, 0, -1):
            at = first[count > i] + i
            behind[at - 1] = scaled((product[at] @ behind[at, :, None])[:, :, 0] @ moves.T)
    a, b, out = into[order], behind[order], np.empty((len(psi), k))
    for t in range(size[0]):
        n = live[t]
        rows = begin[:n] + t
        out[rows] = a[:n] = scaled((a[:n] @ moves if t else a[:n]) * psi[rows])
    for t in range(size[0] - 1, -1, -1):
        n = live[t]
        rows = begin[:n] + t
        out[rows] = scaled(out[rows] * b[:n])
        b[:n] = scaled((b[:n] * psi[rows]) @ moves.T)
    return out


def likelihood(score: np.ndarray, labels: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of labelled sequences, sequences x words x labels, and its gradients by scores, transitions and starts (as logarithms)."""
    s, n, k = score.shape
    top = score.max(2, keepdims=True)
    psi, e_moves = np.exp(score - top), np.exp(moves)
    alpha, scale = np.empty_like(psi), np.empty((s, n, 1))
    for t in range(n):
        x = (alpha[:, t - 1] @ e_moves if t else np.exp(start)[None]) * psi[:, t]
        scale[:, t] = x.sum(1, keepdims=True)
        alpha[:, t] = x / scale[:, t]
    gamma, d_moves, beta = np.empty_like(psi), np.zeros((k, k)), np.ones((s, k))
    for t in range(n - 1, -1, -1):
        gamma[:, t] = alpha[:, t] * beta
        right = psi[:, t] * beta / scale[:, t]
        if t:
            d_moves -= e_moves * (alpha[:, t - 1].T @ right)
        beta = right @ e_moves.T
    seq, place = np.arange(s)[:, None], np.arange(n)[None]
    d_start = -gamma[:, 0].sum(0) + np.bincount(labels[:, 0], minlength=k)
    np.add.at(d_moves, (labels[:, :-1], labels[:, 1:]), 1)
    value = score[seq, place, labels].sum() + moves[labels[:, :-1], labels[:, 1:]].sum() + start[labels[:, 0]].sum() - np.log(scale).sum() - top.sum()
    gamma *= -1
    gamma[seq, place, labels] += 1
    return float(value), gamma, d_moves, d_start


def sequences(runs: list[tuple[list[str], int]], seed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word numbers, labels), the last two as sequences x SEQUENCE: parts of runs in a drawn order, so that languages switch."""
    rng = np.random.default_rng(seed)
    parts = []
    for words, label in runs:
        at = 0
        while at < len(words):
            n = int(rng.integers(4, RUN_WORDS + 1))
            parts.append((words[at : at + n], label))
            at += n
    flat = [(w, parts[i][1]) for i in rng.permutation(len(parts)) for w in parts[i][0]]
    short = -len(flat) % SEQUENCE
    flat += [flat[i % len(flat)] for i in range(short)]
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w, _ in flat]
    return list(number), np.array(ids).reshape(-1, SEQUENCE), np.array([y for _, y in flat]).reshape(-1, SEQUENCE)


def fit(runs: list[tuple[list[str], str]], *, rounds: int = ROUNDS, rate: float = 0.15, ridge: float = 1e-6, seed: int = 3) -> Model:
    """A model from runs of words with their language, by gradient ascent with moments on the regularised likelihood."""
    languages = sorted({y for _, y in runs})
    k, label = len(languages), {y: i for i, y in enumerate(languages)}
    model = Model(languages, np.zeros((BUCKETS + 1, k), np.float32), {}, np.zeros((k, k), np.float32), np.ones((k, k)), np.ones(k), uuid.uuid4().hex)
    if k < 2:
        return model
    counts = {y: Counter() for y in languages}
    for words, y in runs:
        counts[y].update(w.lower() for w in words)
    for y, c in counts.items():
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            model.lexicon[w] = model.lexicon.get(w, 0) | 1 << label[y]
    words, ids, labels = sequences([(w, label[y]) for w, y in sorted(runs)], seed)
    index, starts = features(words)
    held = _lexical(model.lexicon, words, k)
    sizes = np.diff(np.append(starts, len(index)))
    values = [np.zeros((BUCKETS + 1, k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, rounds + 1):
        score = np.add.reduceat(values[0][index].sum(1), starts, axis=0) + held @ values[1]
        _, by_place, d_moves, d_start = likelihood(score[ids], labels, values[2], values[3])
        by_word = np.stack([np.bincount(ids.ravel(), by_place[:, :, y].ravel(), len(words)) for y in range(k)], 1)
        by_index = np.repeat(np.repeat(by_word, sizes, axis=0), index.shape[1], axis=0)
        hashed = np.stack([np.bincount(index.ravel(), by_index[:, y], BUCKETS + 1) for y in range(k)], 1)
        hashed[BUCKETS] = 0
        for i, g in enumerate((hashed, held.T @ by_word, d_moves, d_start)):
            g = g / ids.size - ridge * values[i]
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            values[i] += rate * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-7)
    return model._replace(weights=values[0].astype(np.float32), lexical=values[1].astype(np.float32), moves=np.exp(values[2]), start=np.exp(values[3]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 1 when divided by 3; such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def runs_of(text: str | None) -> list[list[str]]:
    """At most RUNS runs of RUN_WORDS words, spread over the whole text; words longer than LONG_WORD are left out."""
    words = [w for w in words_of(text) if len(w) <= LONG_WORD]
    if len(words) <= RUNS * RUN_WORDS:
        return [words[i : i + RUN_WORDS] for i in range(0, len(words), RUN_WORDS)]
    return [words[at : at + RUN_WORDS] for at in ((len(words) - RUN_WORDS) * i // (RUNS - 1) for i in range(RUNS))]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from FIT_ROWS rows of each language at most, those with the smallest hashes of their ids; a few words of each reach the driver."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # a language's rows are thinned by the same hash before they are ordered, so that a hot language is no hot task
    ids = rows.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    counts = ids.groupBy("lang").agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    near = ids.join(F.broadcast(counts), "lang").where(place * F.col("_n") < 2 * FIT_ROWS * F.lit(1 << 32).cast("double"))
    w = Window.partitionBy("lang").orderBy(place, "doc_id")
    ids = near.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= FIT_ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            runs = [[" ".join(r) for r in runs_of(t)] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "runs": runs})

    picked = rows.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    found = picked.mapInPandas(run, "doc_id long, lang string, runs array<string>").groupBy("doc_id", "lang").agg(F.min("runs").alias("runs")).collect()
    return fit([(r.split(" "), x.lang) for x in sorted(found, key=lambda x: x.doc_id) for r in x.runs])


_KEPT: dict[str, Words] = {}


def labelled(model: Model, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, words x languages) of each text with words: the posteriors of its words' labels."""
    if model.key not in _KEPT:
        _KEPT.clear()  # one model is in use at a time in a worker

        def encode(words: list[str]) -> list[bytes]:
            return [e for i in range(0, len(words), 20_000) for e in map(np.ndarray.tobytes, emissions(model, words[i : i + 20_000]))]

        _KEPT[model.key] = Words(encode, KEPT_WORDS)
    kept, k = _KEPT[model.key], len(model.languages)
    chunk: list[int] = []
    size = 0
    for i, words in enumerate([*texts, None]):
        if chunk and (words is None or size + len(words) > CHUNK_WORDS):
            flat = [w for j in chunk for w in texts[j]]
            distinct = set(flat)
            long = {w: emissions(model, [w])[0].tobytes() for w in distinct if len(w) > LONG_WORD}
            kept.learn(distinct - long.keys())
            own = {w: kept[w] for w in distinct if w not in long} | long
            psi = np.frombuffer(b"".join([own[w] for w in flat]), np.float32).reshape(-1, k)
            lengths = np.array([len(texts[j]) for j in chunk])
            found = posteriors(psi, lengths, model.moves, model.start)
            yield from zip(chunk, np.split(found, np.cumsum(lengths)[:-1]), strict=True)
            chunk, size = [], 0
        if words:
            chunk.append(i)
            size += len(words)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text under a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang, score = np.full(len(pdf), UNKNOWN, object), np.zeros(len(pdf))
            if model.languages:
                for i, p in labelled(model, [words_of(t) for t in pdf["text"]]):
                    share = p.mean(0)
                    lang[i], score[i] = model.languages[int(share.argmax())], min(1.0, float(share.max()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score})

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_runs(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs: maximal runs of words with the same likeliest language, by their first and last code points (end exclusive)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[list[dict]] = [[] for _ in range(len(pdf))]
            texts = pdf["text"].tolist()
            for i, p in labelled(model, [words_of(t) for t in texts]):
                for m, y in zip(_WORD.finditer(texts[i]), p.argmax(1).tolist(), strict=True):
                    if out[i] and out[i][-1]["lang"] == model.languages[y]:
                        out[i][-1]["end"] = m.end()
                    else:
                        out[i].append({"start": m.start(), "end": m.end(), "lang": model.languages[y]})
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "runs": out})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInPandas(run, "doc_id long, runs array<struct<start: long, end: long, lang: string>>")


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language of every whole text, learnt from rows that are not held out.

    ``score`` is the expected share of the text's words in that language; equal shares go to the
    smaller name. A text that is null or has no letter is ``und`` with score 0, and so is every text
    where no row teaches a language. Only a row's text counts for its prediction. A row with a null id
    is not held out but teaches nothing; repeated rows get a result each and teach once. An empty table
    gives no rows; columns besides the three named are ignored. Memory grows with the longest text.
    """
    return predict(docs, train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col=id_col, text_col=text_col)
