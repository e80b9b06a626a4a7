"""Token counts: pieces counted once per distinct pre-token, then summed by pre-token frequencies."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import materialise
from skylark.llm.vocab import CACHE_WORDS, PLAIN, Words, loaded, pieces

#: Unicode white space as the byte-level pre-tokenizer's \s has it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A pre-token never holds white space before its end, so a text falls into these coarser chunks first.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The same by Python's \s, which is faster and has four separators more.
_QUICK, _SEPARATORS = re.compile(r" ?\S+|\s+(?!\S)|\s+"), re.compile("[\x1c-\x1f]")
#: Distinct pre-tokens that each task gets with it; the rest are joined.
COMMON = 300_000
#: Distinct chunks that a task gathers before it cuts them into pre-tokens, each once.
OPEN_CHUNKS = 100_000
#: Each line of a text: the two parts of a plain chunk, or none of another.
_LINES = re.compile(f"^(?:{PLAIN.pattern}|.*)$", re.M)
_FINE: dict[str, Words] = {}


def _pretokens(path: str) -> Words:
    """Cache from chunks that are not plain to the library's own pre-tokens of them."""
    pre = loaded(path).pre_tokenizer

    def cut(chunk: str) -> tuple[str, ...]:
        # the byte-level form shows pre-tokens in an alphabet of their own, so cut the chunk by their offsets
        return tuple(chunk[a:b] for _, (a, b) in pre.pre_tokenize_str(chunk))

    if path not in _FINE:
        _FINE[path] = Words(lambda part: list(map(cut, part)))
    return _FINE[path]


@cache
def _specials(path: str) -> tuple[re.Pattern | None, frozenset]:
    found = [t.content for t in loaded(path).get_added_tokens_decoder().values()]
    return (re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")") if found else None), frozenset(found)


def chunked(texts: list[str], path: str) -> Iterator[list[str]]:
    """Each text's chunks; an added token's string is a chunk, and a pre-token, of its own."""
    special, names = _specials(path)
    for text in texts:
        cut = (_CHUNK if _SEPARATORS.search(text) else _QUICK).findall
        if any(n in text for n in names):
            yield [c for s in special.split(text) for c in ((s,) if s in names else cut(s))]
        else:
            yield cut(text)


def pretokens_of(chunks: Iterable[str], path: str) -> list[tuple[str, ...]]:
    """The pre-tokens of each chunk."""
    _, names = _specials(path)
    chunks = list(chunks)
    # one search for all; what holds a line end is white space, and not plain either
    cut = _LINES.findall("\n".join(["~" if "\n" in c else c for c in chunks])) if chunks else []
    out = [(c,) if c in names else (pair if pair[1] else pair[:1] if pair[0] else None) for c, pair in zip(chunks, cut, strict=True)]
    if None in out:
        fine = _pretokens(path)
        fine.learn({c for c, own in zip(chunks, out, strict=True) if own is None})
        out = [fine[c] if own is None else own for c, own in zip(chunks, out, strict=True)]
    return out


def vocabulary(docs: DataFrame, path: str, text_col: str) -> DataFrame:
    """(pretoken, pieces, freq): every distinct pre-token of all texts with its number of pieces."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = defaultdict(int)
        own: Counter = Counter()  # chunks that are not cut yet

        def cut() -> None:
            for pretokens, n in zip(pretokens_of(own, path), own.values(), strict=True):
                for p in pretokens:
                    seen[p] += n
            own.clear()

        for pdf in batches:
            for chunks in chunked([t for t in pdf["text"] if t], path):
                own.update(chunks)
                if len(own) > OPEN_CHUNKS:
                    cut()
            if len(seen) > 400_000:
                yield pd.DataFrame({"pretoken": list(seen), "freq": list(seen.values())})
                seen.clear()
        cut()
        if seen:
            yield pd.DataFrame({"pretoken": list(seen), "freq": list(seen.values())})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            plain = pdf["pretoken"].map(lambda p: PLAIN.fullmatch(p) is not None)
            counts = pd.Series(0, pdf.index, "int64")
            counts[plain] = [len(pieces(path, p)) for p in pdf["pretoken"][plain]]
            odd = pdf["pretoken"][~plain].tolist()
            counts[~plain] = [len(e) for e in loaded(path).encode_batch_fast(odd, add_special_tokens=False)] if odd else []
            yield pdf.assign(pieces=counts)

    seen = docs.select(F.col(text_col).alias("text")).mapInPandas(distinct, "pretoken string, freq long")
    return seen.groupBy("pretoken").agg(F.sum("freq").alias("freq")).mapInPandas(count, "pretoken string, freq long, pieces long")


def token_counts(docs: DataFrame, *, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, without making ids.

    The COMMON most frequent pre-tokens, at most that many, go to every task; a document's other
    pre-tokens leave it as (doc_id, pretoken, freq) rows and are joined. A null text counts as empty:
    0 bytes and 0 tokens. Repeated rows give one result each; an empty table gives none; other columns
    are ignored. A special token's string inside a text is one token, as the library's default has it.
    """
    spark, path = docs.sparkSession, tokenizer
    counted = materialise(vocabulary(docs, path, text_col), "pretokens")
    # a histogram of the frequencies' magnitudes tells from which one on COMMON pre-tokens are left
    size = F.floor(F.log2("freq") * 16).cast("int")
    held, least = 0, 1 << 30
    for r in counted.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
        held += r["n"]
        if held > COMMON:
            break
        least = r["size"]
    top = counted.where(size >= least).select("pretoken", "pieces").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(top["pretoken"], top["pieces"].astype(int), strict=True)))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = known.value.get
        # a chunk that is itself a pre-token is looked up as it is; sums of other chunks of common ones come beside
        held = dict(known.value)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            rows = []
            for doc_id, row, text, chunks in zip(pdf["doc_id"], pdf["row"], texts, chunked(texts, path), strict=True):
                counts = list(map(held.get, chunks, repeat(0)))
                summed, rare = sum(counts), {}
                if 0 in counts:
                    odd = [c for c, n in zip(chunks, counts, strict=True) if not n]
                    if len(held) > len(known.value) + CACHE_WORDS:
                        held = dict(known.value)
                    for c, pretokens in zip(odd, pretokens_of(odd, path), strict=True):
                        found = list(map(common, pretokens))
                        if None not in found:
                            held[c] = n = sum(found)
                            summed += n
                            continue
                        for p, n in zip(pretokens, found, strict=True):
                            if n is None:
                                rare[p] = rare.get(p, 0) + 1
                            else:
                                summed += n
                rows.append((doc_id, row, len(text.encode()), summed, list(rare), list(rare.values())))
            yield pd.DataFrame(rows, columns=["doc_id", "row", "n_bytes", "known", "rare", "freq"])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    base = materialise(keyed.mapInPandas(sums, "doc_id long, row long, n_bytes long, known long, rare array<string>, freq array<long>"), "known-tokens")
    rare = base.select("row", F.explode(F.arrays_zip("rare", "freq")).alias("z")).select("row", F.col("z.rare").alias("pretoken"), F.col("z.freq").alias("n"))
    rest = rare.join(counted.select("pretoken", "pieces"), "pretoken").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0))
    return base.drop("rare", "freq").join(rest, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
