"""Best-fit packing: a configuration linear program over the length histogram.

The histogram has at most ``capacity`` entries however many documents there are, so the program
is solved on the driver: multiplicative weights hold a price for each length, a knapsack dynamic
program finds the configuration of highest price, and the averaged configurations are rounded. Its
table also has the best configuration that begins with any given length. The program is solved
again for what rounding leaves over, until little of it can be placed so; the last pieces are placed by
best fit, again on counts. Executors then number the pieces of each length and look up each number's
sequence and offset.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylark.llm.common import bucket_of, materialise
from skylark.llm.vocab import CACHE_WORDS, PLAIN, Words, loaded, pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_CACHES: dict[tuple[str, int], tuple[Words, Words]] = {}


def _ids_by_word(path: str, kept: int) -> tuple[Words, Words]:
    """Caches from UTF-8 chunks without ASCII white space, and from parts of them, to their ids' little-endian bytes.

    Neither normalisation nor a token of this vocabulary crosses white space, so chunks can be
    encoded one by one, and the two parts of a plain word too.
    """

    parts = Words(lambda part: [np.array(pieces(path, p), "<u4").tobytes() for p in part], kept)

    def chunks(part: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in part]
        cut = [PLAIN.fullmatch(t) for t in texts]
        odd = [t for t, m in zip(texts, cut, strict=True) if not m]
        whole = iter(loaded(path).encode_batch(odd, add_special_tokens=False))
        parts.learn({p for m in cut if m for p in (m[1].lower(), m[2])})
        return [parts[m[1].lower()] + parts[m[2]] if m else np.array(next(whole).ids, "<u4").tobytes() for m in cut]

    if (path, kept) not in _CACHES:
        _CACHES[path, kept] = Words(chunks, kept), parts
    return _CACHES[path, kept]


def encode_pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str, kept: int = CACHE_WORDS) -> DataFrame:
    """The pieces of every document; its ids end with id 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (known, parts), step = _ids_by_word(path, kept), 4 * capacity
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                texts = [(t or "").encode().split() for t in part["text"]]
                known.learn(set().union(*texts))
                for doc, words in zip(part["doc_id"], texts, strict=True):
                    ids = b"".join(map(known.__getitem__, words)) + b"\0\0\0\0"
                    for i in range(0, len(ids), step):
                        own = ids[i : i + step]
                        rows.append((doc, i // step, i // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        known.older, parts.older = {}, {}  # the worker may go on with other work

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECES)


def _knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """For every room, the length that the fill of highest total value takes first, 0 where it leaves a token free."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    short = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        n = short[room]
        if n:
            v = value[:n] + best[room - lengths[:n]]
            i = int(v.argmax())
            best[room], took[room] = v[i], lengths[i]
        if best[room - 1] > best[room]:
            best[room], took[room] = best[room - 1], 0
    return took


def _fill(took: np.ndarray, room: int, first: int = 0) -> Counter:
    """The multiset of lengths of highest total value that fits into the room, after ``first`` if it is given."""
    config = Counter({first: 1}) if first else Counter()
    room -= first
    while room > 0:
        if took[room]:
            config[int(took[room])] += 1
            room -= int(took[room])
        else:
            room -= 1
    return config


def _best_fit(left: Counter, capacity: int) -> Counter:
    """Best fit by decreasing length on counts: configuration -> number of sequences."""
    groups: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(left, reverse=True):
        n = left[length]
        room = length
        while n > 0 and room < capacity:
            if groups[room]:
                config, m = next(iter(groups[room].items()))
                used = min(m, n)
                groups[room].subtract({config: used})
                groups[room] += Counter()
                groups[room - length][(*config, length)] += used
                n -= used
            else:
                room += 1
        if n > 0:  # a new sequence takes as many of this length as fit
            each = capacity // length
            if n // each:
                groups[capacity - each * length][(length,) * each] += n // each
            if n % each:
                groups[capacity - (n % each) * length][(length,) * (n % each)] += 1
    out: Counter = Counter()
    for g in groups.values():
        out.update({c: m for c, m in g.items() if m})
    return out


def solve(left: Counter, capacity: int, rounds: int, step: float) -> tuple[dict[tuple, float], np.ndarray]:
    """The program over the lengths that are left, by multiplicative weights: how often each configuration is used, and the last prices' table."""
    lengths = np.array(sorted(left), np.int64)
    need = np.array([left[int(x)] for x in lengths], np.float64)
    at = {int(x): i for i, x in enumerate(lengths)}
    price, used, total = np.log(need * lengths / capacity), Counter(), np.zeros(len(lengths))
    took = np.zeros(capacity + 1, np.int64)
    for _ in range(rounds):
        took = _knapsack(np.exp(price - price.max()) / need, lengths, capacity)
        config = _fill(took, capacity)
        gain = np.zeros(len(lengths))
        for x, n in config.items():
            gain[at[x]] = n / need[at[x]]
        # as often as makes the most covered length grow by one step
        times = 1 / gain.max()
        used[tuple(sorted(config.elements(), reverse=True))] += times
        total += times * gain
        price -= step * gain * times
    return {c: x / max(total.mean(), 1e-12) for c, x in used.items()}, took


def plan(histogram: dict[int, int], capacity: int, rounds: int = 40, step: float = 0.35, slack: int = 2, little: float = 0.02) -> tuple[Counter, int]:
    """Configurations and how often each is used, so that every piece has a place, and how many sequences come from the program.

    Each pass solves the program for what is left, rounds its configurations (down, but once at
    least where the pieces are there) and takes the best one that begins with each length. Pieces
    longer than half a sequence are covered first, as they alone need a sequence each. When a pass
    adds less than the share ``little``, configurations may leave twice as much free as before, up to
    a 64th of a sequence; then shorter pieces begin configurations too, with up to ``slack`` tokens
    free. Best fit places what a pass leaves over, and of all passes the one with the fewest sequences
    counts, the last of several.
    """
    left, chosen, fewest = Counter({int(x): int(n) for x, n in histogram.items()}), Counter(), None

    def use(config: Counter, times: int) -> int:
        n = min(times, *(left[x] // m for x, m in config.items()))
        if n > 0:
            chosen[tuple(sorted(config.elements(), reverse=True))] += n
            left.subtract({x: n * m for x, m in config.items()})
        return max(n, 0)

    for least, most in ((capacity // 2, capacity // 64), (0, slack)):
        free = 0
        while free <= most and max(+left, default=0) > least:
            left = +left
            used, took = solve(left, capacity, rounds, step)
            n = 0
            for config, times in sorted(used.items(), key=lambda c: (-c[1], c[0])):
                if config[0] > least and sum(config) >= capacity - free:
                    n += use(Counter(config), max(1, math.floor(times)))
            for x in sorted((x for x in left if x > least), reverse=True):
                config = _fill(took, capacity, x)
                if sum(k * m for k, m in config.items()) >= capacity - free:
                    n += use(config, left[x])
            if n <= little * chosen.total():
                free = 2 * free or 1
            rest = _best_fit(+left, capacity)
            if fewest is None or chosen.total() + rest.total() <= fewest[0].total():
                fewest = chosen + rest, chosen.total()
    return fewest or (_best_fit(+left, capacity), 0)


def _slots(plans: Counter) -> dict[int, np.ndarray]:
    """length -> rows (first number, pieces a sequence, first sequence, first offset)."""
    taken, first, out = Counter(), 0, defaultdict(list)
    for config, n in sorted(plans.items()):
        offset = 0
        for length, m in sorted(Counter(config).items(), reverse=True):
            out[length].append((taken[length], m, first, offset))
            taken[length] += n * m
            offset += length * m
        first += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 50_000, kept_words: int = CACHE_WORDS) -> DataFrame:
    """Pack whole documents into as few sequences of at most ``capacity`` tokens as it can.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document's ids are the
    tokenizer's without special tokens, then id 0, so a null or empty text is one piece of length 1.
    Longer documents are cut into pieces of ``capacity``; the last may be shorter. Repeated rows are
    packed as often as they appear; an empty table gives no rows; other columns are ignored. A worker
    keeps the ids of ``kept_words`` words in each generation of its caches, which changes no result.
    """
    cut = materialise(encode_pieces(docs, tokenizer, capacity, id_col, text_col, kept_words), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity)[0])
    parts = max(1, math.ceil(max(histogram.values(), default=0) / group_rows))
    # a length can hold a third of all pieces: number it in hashed parts, each from where the part before ends
    keyed = cut.withColumn("part", bucket_of(parts, "doc_id", "piece"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    in_part = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = keyed.withColumn("rn", F.row_number().over(in_part)).join(starts, ["length", "part"]).withColumn("number", F.col("base") + F.col("rn") - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            length, number = pdf["length"].to_numpy(), pdf["number"].to_numpy()
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                s = slots[int(x)]
                s = s[np.searchsorted(s[:, 0], number[rows], side="right") - 1]
                r = number[rows] - s[:, 0]
                sequence[rows], offset[rows] = s[:, 2] + r // s[:, 1], s[:, 3] + (r % s[:, 1]) * x
            yield pdf.assign(sequence_id=sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInPandas(place, PIECES + ", sequence_id long, offset long")
