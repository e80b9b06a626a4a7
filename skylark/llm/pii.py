"""Personal data with offsets: base patterns on the text, and the same patterns on its undisguised form."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a later start in a run of digits cannot fit where its first does not
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Letters of other scripts that look like these Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B",
    "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
#: Characters that show nothing.
UNSEEN = "­​‌‍⁠﻿"
#: Digits as words in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words for @ and the words for a dot that may follow them. After those of the second
#: list, which are words of plain prose too, only an ending of ENDINGS makes an address.
AT_WORDS = {"at": "dot", "arroba": "punto|dot", "arobase": "point|dot", "ät": "punkt|dot"}
AT_PROSE = {"bei": "punkt", "chez": "point", "en": "punto"}
DOT_WORDS = ("dot", "punkt", "punto", "point")
#: Endings that make an address of words of plain prose.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "co", "de", "fr", "es", "info", "uk", "eu", "at", "ch", "it", "nl", "ru")

_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_SPELLED = re.compile(rf"(?i)(?<![^\W\d_]){_WORD}(?:[\s,-]+{_WORD}){{2,}}(?![^\W\d_])")
_ONE_WORD = re.compile(rf"(?i){_WORD}(?![^\W\d_])")
_PLUS = re.compile(r"(?i)(?<![^\W\d_])(?:plus|más)(?=\s+[0-9])\s+")
_DOTS, _NAME = "(?:" + "|".join(DOT_WORDS) + ")", "[a-z0-9][a-z0-9_+-]*"
# where white space may lead, a match starts at its first character or none, so that long runs are read once
_BLANK = r"(?:(?<!\s)\s++)?"
_BRACKET_AT = re.compile(rf"(?i){_BLANK}[\[({{<]\s*+(?:{'|'.join([*AT_WORDS, *AT_PROSE])}|a|@)\s*+[\])}}>]\s*+")
_BRACKET_DOT = re.compile(rf"(?i){_BLANK}[\[({{<]\s*+(?:{_DOTS}|\.)\s*+[\])}}>]\s*+")
_NUMBER_DOT = re.compile(rf"(?i)(?<=[0-9])\s++{_DOTS}\s++(?=[0-9])")
_SPOKEN_DOTS = frozenset(DOT_WORDS)
_SPOKEN_AT = re.compile(rf"(?i)(?<=\s)(?:{'|'.join([*AT_WORDS, *AT_PROSE])})(?=\s)")
_SPOKEN_DOT = re.compile(rf"(?i)(?<!\s)\s++{_DOTS}\s++")


def _around(dots: str, prose: bool) -> tuple[re.Pattern, re.Pattern]:
    """What stands before a word for @, on the text read backwards, and what stands after it."""
    name, back = "[a-z0-9_+-]*[a-z0-9]", "|".join(d[::-1] for d in dots.split("|"))
    chain = rf"(?:(?:\s++(?:{back})\s++|\.){name})*" if prose else rf"(?:\.{name})*(?:\s++(?:{back})\s++{name})*"
    ending = f"(?:{'|'.join(ENDINGS)})" if prose else "[a-z]{2,24}"
    return re.compile(rf"(?i)\s++{name}{chain}(?![a-z0-9])"), re.compile(rf"(?i)\s++[a-z0-9-]+(?:(?:\s++(?:{dots})\s++|\.)[a-z0-9-]+)*\s++(?:{dots})\s++{ending}(?![a-z0-9])")


_SIDES = {a: _around(d, False) for a, d in AT_WORDS.items()} | {a: _around(d, True) for a, d in AT_PROSE.items()}


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, user@host) of spoken addresses: around each word for @ the longest name before it and the host after it.

    The @ stands for the last word for it, as a user's name comes first. Names and hosts of different
    words do not overlap but for one label, so that the text is read a few times at most.
    """
    backwards, n, done = "", len(text), 0
    for at in _SPOKEN_AT.finditer(text):
        if at.start() < done:
            continue
        before, after = _SIDES[at[0].lower()]
        host = after.match(text, at.end())
        if not host:
            continue
        backwards = backwards or text[::-1]
        user = before.match(backwards, n - at.start(), n - done)
        if user:
            start, done = n - user.end(), host.end()
            yield start, done, _SPOKEN_DOT.sub(".", text[start : at.start()].rstrip()) + "@" + _SPOKEN_DOT.sub(".", host[0].lstrip())


_NEAR = re.compile(rf"(?i)@[a-z0-9-]+(?:(?:\s++{_DOTS}\s++|\.)[a-z0-9-]+)+")
_BRACKETS = re.compile(rf"(?i)[\[({{<]\s*+(?:{'|'.join([*AT_WORDS, *AT_PROSE, *DOT_WORDS])}|a|@|\.)\s*+[\])}}>]")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        m = _AFTER_AT.match(text, at)
        if m:
            start = at
            while start > done:  # the local part reaches back over its characters, in steps
                back = max(done, start - 64)
                run = _LOCAL.search(text, back, start)
                if not run:
                    break
                start = run.start()
                if start > back:
                    break
            if start < at:
                out.append((start, 0, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Mapped:
    """A text under rewriting that knows for each character which source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.lo, self.hi = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, found: Iterable[tuple[int, int, str]]) -> None:
        """Put each new text in the place of what lies from its start to its end, all of whose source it stands for."""
        parts, lo, hi, done = [], [], [], 0
        for a, b, new in found:
            if new == self.text[a:b]:
                continue
            parts += [self.text[done:a], new]
            lo += self.lo[done:a] + [self.lo[a]] * len(new)
            hi += self.hi[done:a] + [self.hi[b - 1]] * len(new)
            done = b
        if parts:
            self.text = "".join(parts) + self.text[done:]
            self.lo, self.hi = lo + self.lo[done:], hi + self.hi[done:]


def _plain(m: re.Match) -> str:
    out = []
    for c in m[0]:
        if c in LOOKALIKES:
            out.append(LOOKALIKES[c])
        elif c not in UNSEEN:
            n = unicodedata.normalize("NFKC", c)
            out.append(str(unicodedata.digit(n)) if len(n) == 1 and not n.isascii() and unicodedata.digit(n, None) is not None else n if n.isascii() and len(n) == 1 and not n.isspace() else c)
    return "".join(out)


_FOREIGN = re.compile("[" + "".join(LOOKALIKES) + UNSEEN + "⁰-₉①-⑨！-～\U0001d400-\U0001d7ff﹒﹫²³¹]|(?![0-9])\\d")


def _each(pattern: re.Pattern, to: Callable[[re.Match], str]) -> Callable[[str], Iterator[tuple[int, int, str]]]:
    """A transducer that puts ``to`` of each match in its place."""
    return lambda text: ((*m.span(), to(m)) for m in pattern.finditer(text))


#: The transducers after that of single characters, in their order; each keeps every character's source range.
TRANSDUCERS = (
    _each(_SPELLED, lambda m: "".join(DIGIT_WORDS[w.lower()] for w in _ONE_WORD.findall(m[0]))),
    _each(_PLUS, lambda m: "+"),
    _each(_NUMBER_DOT, lambda m: "."),
    _each(_BRACKET_AT, lambda m: "@"),
    _each(_BRACKET_DOT, lambda m: "."),
    _addresses,
    _each(_NEAR, lambda m: _SPOKEN_DOT.sub(".", m[0])),
)


def disguised_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in source characters, of what the patterns find once disguises are undone."""
    foreign = not text.isascii() and _FOREIGN.search("".join(set(text))) is not None
    words = text.lower().replace(",", " ").replace("-", " ").split()
    # three digits as words in a row
    spelled = b"\1\1\1" in bytes(map(DIGIT_WORDS.__contains__, words))
    worded = not _SPOKEN_DOTS.isdisjoint(words) or any(c in text for c in "[({<") and _BRACKETS.search(text) is not None
    if not (foreign or spelled or worded):
        return []
    m = Mapped(text)
    if foreign:
        m.rewrite(_each(_FOREIGN, _plain)(m.text))
    for transducer in TRANSDUCERS:
        m.rewrite(transducer(m.text))
    return [(m.lo[s], kind, m.hi[e - 1]) for s, kind, e in base_spans(m.text)]


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): a disguised one is added where it meets no base span of its kind."""
    base = base_spans(text)
    found = disguised_spans(text)
    if not found:
        return base, base
    added: list[tuple[int, int, int]] = []
    for kind in range(len(KINDS)):
        own = sorted((s, e) for s, k, e in base if k == kind)
        taken, last = [s for s, _ in own], 0
        for s, k, e in found:
            if k != kind or s < last:
                continue
            i = bisect_left(taken, e)  # base spans of a kind do not overlap, so the last that starts before the end tells
            if not i or own[i - 1][1] <= s:
                added.append((s, kind, e))
                last = e
    return base, sorted(base + added)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text.

    Offsets are code points of the source, ends exclusive. Texts with look-alike letters, digits of
    other scripts, spelled digits or at/dot disguises are rewritten by transducers that keep each
    character's source range, searched with the same patterns and mapped back; such spans are added to
    the base ones. A null text counts as empty and has no spans. Repeated rows give one result each; an
    empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                base, every = spans(text or "")
                n = [sum(k == i for _, k, _ in every) for i in range(4)]
                rows.append((doc, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with every span of personal data replaced by its kind in angle brackets."""
    if not text:
        return text
    out, done = [], 0
    for s, k, e in spans(text)[1]:
        if s >= done:
            out += [text[done:s], f"<{KINDS[k]}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data masked, and the length column, if there is one, brought up to date."""
    schema = docs.schema
    plain = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{text_col: [masked(t if isinstance(t, str) else None) for t in pdf[text_col]]})

    out = docs.mapInPandas(run, schema)
    if length_col in plain:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(schema[length_col].dataType)))
    return out.select(plain)
