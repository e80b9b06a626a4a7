"""Main text of web pages: block structure, and a suffix array of each host for repeated boilerplate."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import materialise

#: Elements whose content is no text of the page.
SILENT = ("script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "select", "option", "button", "textarea", "title", "head")
#: Elements around the article's text.
OUTSIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog")
#: Elements that hold the article.
MAIN = ("article", "main")
#: Elements that begin and end a block.
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
#: Words of class, id or role that mark what is no part of the article.
MARKED = (
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "copyright", "disqus", "footer", "menu",
    "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "search", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo",
)
#: Those of them that an article's own parts are called too; they only ask, but in a role.
DOUBTFUL = ("banner", "copyright", "menu", "notice", "related", "search", "share", "social", "toolbar", "widget")
#: Words beside them in a class or id that say nothing else.
FILLERS = ("area", "bar", "block", "box", "bottom", "btn", "button", "buttons", "container", "inner", "item", "left", "link", "links", "list", "message", "panel", "right", "section", "slot", "text", "top", "unit", "wrap", "wrapper")
#: Elements of running text, whose ids are anchors.
RUNNING = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "blockquote", "figure", "figcaption", "pre", "td", "th")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements that end where the next one like them begins, and the elements around both.
ENDING = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}

# each repeat is possessive or ends at the next tag, so that no page is read twice; a "<" that begins no closed tag is text
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_NAME = re.compile(r"[A-Za-z]+")
_UNSHOWN = re.compile(r"(?i)display\s*:\s*none")
_ENDS = {name: re.compile(rf"</{name}\b[^<>]*+>", re.I) for name in SILENT}

#: Tokens that a repeated string must have on two pages at least to count as boilerplate.
LEAST_TOKENS = 6
#: Words of a host's streams that share a suffix array, about; what streams of several arrays share is found by their windows.
SHARD_WORDS = 2_000_000
#: What markup says of an element: nothing, that its host's array shall decide, that it is no part of the article.
PLAIN, ASKED, OUT = 0, 1, 2


def marking(name: str, attributes: str) -> int:
    """PLAIN, ASKED or OUT, by an element's class, id, role and visibility; values of other attributes say nothing.

    A class or role that consists of marked words is out, and so is an id but for running text, where it is
    an anchor. A marked word among others, and doubtful ones in a class or id, only ask.
    """
    if "=" not in attributes and "hidden" not in attributes.lower():
        return PLAIN
    found = PLAIN
    for m in _ATTRIBUTE.finditer(attributes):
        own, value = m[1].lower(), (m[2] or "").strip("\"'")
        if own == "hidden" or own == "aria-hidden" and value.lower() == "true" or own == "style" and _UNSHOWN.search(value):
            return OUT
        if own in ("class", "id", "role"):
            for part in value.split():
                words = [w.lower() for w in _NAME.findall(part)]
                marked = [w for w in words if w in MARKED]
                if marked:
                    sure = len(marked) + sum(w in FILLERS for w in words) == len(words) and not (own == "id" and name in RUNNING)
                    sure = sure and (own == "role" or any(w not in DOUBTFUL for w in marked))
                    found = max(found, OUT if sure else ASKED)
    return found


def blocks(page: str | None) -> tuple[list[tuple[str, bool, int]], bool]:
    """(text, in main element, marking) of each block, and if there is a main element that markup doesn't put outside.

    A paragraph ends at the next block, a list item, row or cell at the next of its kind, and inline elements
    with the block that they are in. Text of an inline element that is out is cut out of its block.
    """
    page = page or ""
    stack: list[tuple[str, tuple[bool, int], bool]] = []  # name, state and muteness around it
    places: dict[str, list[int]] = {}
    shells: list[int] = []  # places of blocks
    out: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    state, mute, has_main, at = (False, PLAIN), False, False, 0
    last = lambda names: max((places[x][-1] for x in names if places.get(x)), default=-1)

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, *state))
        parts.clear()

    def close(upto: int) -> None:
        nonlocal state, mute
        while len(stack) > upto:
            name, state, mute = stack.pop()
            places[name].pop()
            if shells and shells[-1] == len(stack):
                shells.pop()

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if not mute and (page[m.start()] != "<" or m.end() - m.start() == 1):
                parts.append(m[0])
            continue
        name = name.lower()
        block = name in BLOCKS
        if m[1]:
            if block:
                flush()
            opened = last((name,))
            if opened >= 0 and (block or not shells or opened > shells[-1]):
                close(opened)
            continue
        if name in SILENT and name != "head":
            if not m[3].endswith("/"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if block:
            flush()
            paragraph = last(("p",))
            if paragraph >= 0:
                close(paragraph)
            if name in ENDING:
                like, around = ENDING[name]
                if last(like) > last(around):
                    close(last(like))
        if name in VOID or m[3].endswith("/"):
            continue
        own = OUT if name in OUTSIDE else PLAIN if name in (*MAIN, "html", "body") else marking(name, m[3])
        places.setdefault(name, []).append(len(stack))
        if block or name == "head":
            shells.append(len(stack))
            stack.append((name, state, mute))
            inside = state[0] or name in MAIN and state[1] != OUT and not mute
            has_main |= inside
            state, mute = (inside, max(state[1], own, OUT if mute else PLAIN)), False
        else:
            stack.append((name, state, mute))
            mute = mute or own == OUT
    flush()
    return out, has_main


def repeated(streams: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a string of ``least`` tokens or more that another page has too.

    The streams are joined with separators of their own; the suffix array comes from prefix
    doubling and the longest common prefixes of neighbours from Kasai's method over it. A suffix
    is covered to the longest prefix that it shares with a suffix of another page.
    """
    sizes = np.array([len(s) for s in streams])
    if not len(streams) or sizes.sum() == 0:
        return [np.zeros(n, bool) for n in sizes]
    page = np.repeat(np.arange(len(streams)), sizes + 1)
    _, tokens = np.unique(np.concatenate([np.append(s, np.uint64(0)) for s in streams]), return_inverse=True)
    ends = np.cumsum(sizes + 1) - 1
    tokens = tokens.astype(np.int64) + len(streams)
    tokens[ends] = np.arange(len(streams))
    n = len(tokens)
    rank, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:] if width < n else after[: n - width]
        order = np.lexsort((after, rank))
        new = np.concatenate([[0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1]))])
        rank[order] = new
        if new[-1] == n - 1:
            break
        width *= 2
    # the common prefix of each suffix with the one before it in the order (Kasai)
    text, at, place = tokens.tolist(), order.tolist(), rank.tolist()
    common, h = np.zeros(n, np.int64), 0
    for i, r in enumerate(place):
        if r:
            j = at[r - 1]
            while text[i + h] == text[j + h]:
                h += 1
            common[r] = h
            h = max(0, h - 1)
        else:
            h = 0
    # from there to the nearest suffix of another page, before and after it in the order, the least one between counts
    reach, own = np.zeros(n, np.int64), page[order]
    for way in (1, -1):
        pages, steps = own[::way].tolist(), (common if way == 1 else np.append(common[1:], 0)[::-1]).tolist()
        best, found = 0, np.zeros(n, np.int64)
        for r in range(1, n):
            best = steps[r] if pages[r] != pages[r - 1] else min(best, steps[r])
            found[r] = best
        reach[order] = np.maximum(reach[order], found[::way])
    long = np.where(reach >= least, reach, 0)
    covered = np.maximum.accumulate(np.arange(n) + long) > np.arange(n)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [covered[a : a + k] for a, k in zip(starts, sizes, strict=True)]


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the article of every page, blocks joined by line feeds.

    Markup decides what it can: text in scripts, navigation, headers, footers, asides, forms and
    elements marked as adverts, notices, comments and the like is never main text, and unmarked text in
    an article or main element is, on however many pages it repeats, as copies of an article stay
    whole. Where it cannot (a page without such an element, a block with a marked word among others
    in a class or id) the host's suffix array does: all blocks of the host's pages are its token
    streams, pages with the same stream count once, and a doubtful block is dropped if strings that
    another page has too cover it whole. A host with many words has several arrays, of about SHARD_WORDS
    each by a hash of the stream; as a token lies in a repeated string exactly if one of the windows
    of LEAST_TOKENS tokens over it is repeated, windows found in another array decide what one leaves
    open, and the result does not depend on the size of an array.

    A null or empty html has the empty text. Pages are rows: repeated ones give a result each. A url
    without a host, or null, counts as the host "". An empty table gives no rows; other columns are
    ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.monotonically_increasing_id().alias("row"), F.col(html_col).cast("string").alias("html"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page in pdf["html"]:
                found, has_main = blocks(page)
                own = [(t, mark) for t, main, mark in found if mark != OUT and (main or not has_main)]
                frame = [t for t, main, mark in found if mark == OUT or has_main and not main]
                out.append(([t for t, _ in own], [i for i, (_, mark) in enumerate(own) if mark == ASKED or not has_main], frame, sum(t.count(" ") + 1 for t, *_ in found)))
            yield pdf[["page_id", "url", "row"]].assign(**dict(zip(("own", "asked", "frame", "n_words"), map(list, zip(*out, strict=True)), strict=True)))

    parsed = materialise(rows.mapInPandas(parse, "page_id long, url string, row long, own array<string>, asked array<int>, frame array<string>, n_words long"), "parsed-pages")
    hosts = parsed.withColumn("host", _host(F.col("url")))
    # written first, so that Spark knows its size before it decides how the texts travel
    asking = hosts.where(F.size("asked") > 0).select("host").distinct()
    sizes = materialise(hosts.select("host", "n_words").join(asking, "host").groupBy("host").agg(F.ceil(F.sum("n_words") / SHARD_WORDS).cast("int").alias("n")), "asking")
    stream = F.concat("own", "frame")
    placed = hosts.join(sizes, "host").select("host", "row", "asked", "n", stream.alias("stream"), F.sha2(F.array_join(stream, "\n"), 256).alias("key"))
    # copies of a page are one stream, however many there are
    streams = placed.groupBy("host", "n", "key").agg(F.first("stream").alias("stream"), F.array_distinct(F.flatten(F.collect_set("asked"))).alias("asked"))
    streams = materialise(streams.withColumn("shard", F.pmod(F.xxhash64("key"), F.greatest("n", F.lit(1))).cast("int")), "streams")
    judged = materialise(streams.groupBy("host", "shard").applyInPandas(_judged, "host string, shard int, key string, block int, token int, windows array<long>"), "judged")
    covered = judged.where("token < 0").select("host", "key", "block")
    # what an array leaves open may repeat in others of the host: a token is covered if one of its windows does
    windows = streams.where("n > 1").select("host", "shard", "stream").mapInPandas(_windows, "host string, shard int, h long")
    places = windows.groupBy("host", "h").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"))
    open_ = judged.where("token >= 0").select("host", "shard", "key", "block", "token", F.explode_outer("windows").alias("h"))
    met = open_.join(places, ["host", "h"], "left").groupBy("host", "key", "block", "token").agg(F.max(F.coalesce((F.col("lo") != F.col("shard")) | (F.col("hi") != F.col("shard")), F.lit(False))).alias("hit"))
    across = met.groupBy("host", "key", "block").agg(F.min("hit").alias("whole")).where("whole").select("host", "key", "block")
    gone = covered.unionByName(across).groupBy("host", "key").agg(F.collect_set("block").alias("gone"))
    drop = placed.where(F.size("asked") > 0).select("host", "key", "row", "asked").join(gone, ["host", "key"]).select("row", F.array_intersect("asked", "gone").alias("drop"))
    text = lambda own: F.array_join(own, "\n")
    sure = parsed.where(F.size("asked") == 0).select("page_id", "url", text(F.col("own")).alias("text"))
    kept = F.filter("own", lambda _, i: ~F.array_contains(F.coalesce("drop", F.array().cast("array<int>")), i))
    judged = parsed.where(F.size("asked") > 0).join(drop, "row", "left").select("page_id", "url", text(kept).alias("text"))
    return sure.unionByName(judged).withColumn("n_chars", F.length("text").cast("long"))


def _hashes(stream: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a stream's blocks, and the place where each block ends."""
    words = [b.split(" ") for b in stream]
    return np.array([xxhash.xxh3_64_intdigest(w) | 1 for own in words for w in own], np.uint64), np.cumsum([len(w) for w in words])


def _grams(hashes: np.ndarray) -> np.ndarray:
    """A hash of each window of LEAST_TOKENS words."""
    n = len(hashes) - LEAST_TOKENS + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(LEAST_TOKENS if n > 0 else 0):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for host, shard, stream in zip(pdf["host"], pdf["shard"], pdf["stream"], strict=True):
            h = np.unique(_grams(_hashes(list(stream))[0]))
            yield pd.DataFrame({"host": [host] * len(h), "shard": [shard] * len(h), "h": h})


def _judged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The asked blocks of one array that repeated strings cover whole (token -1), else, where there are more arrays, each open token with the windows over it."""
    parts = [_hashes(list(x)) for x in pdf["stream"]]
    out = []
    for host, shard, n, key, asked, (hashes, ends), hit in zip(pdf["host"], pdf["shard"], pdf["n"], pdf["key"], pdf["asked"], parts, repeated([h for h, _ in parts], LEAST_TOKENS), strict=True):
        grams = _grams(hashes) if n > 1 else None
        for b in asked:
            a, e = int(ends[b - 1]) if b else 0, int(ends[b])
            left = a + np.flatnonzero(~hit[a:e])
            if not len(left):
                out.append((host, shard, key, int(b), -1, None))
            elif grams is not None:
                out += [(host, shard, key, int(b), int(t), grams[max(0, t - LEAST_TOKENS + 1) : t + 1].tolist()) for t in left]
    return pd.DataFrame(out, columns=["host", "shard", "key", "block", "token", "windows"])
