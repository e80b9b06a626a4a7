"""Texts and pages made to be slow or to crash, odd markup, and results that do not depend on the size of an array."""

import json
import time

import numpy as np
import pytest

from skylark.llm import chat, htmltext, pii

M = 1_000_000
PII = {
    "names": "a-" * (M // 2) + " dot", "dots": "a dot " * (M // 6), "ats": "a at " * (M // 5) + "dot", "digits": "9" * M, "digit dots": "9." * (M // 2), "blanks": "(" + " " * M + "dot x",
    "gaps": "a dot b" + " " * (M // 2) + "at" + " " * (M // 2) + "c dot com", "words": "one " * (M // 4), "many": "a@b.co " * (M // 7) + "x dot yа", "brackets": "( " * (M // 2) + "dot", "hosts": "x at " + "b dot " * (M // 6) + "c0m",
    "signs": "+1(" * (M // 3), "signs at": "a@" * (M // 2) + " dot",
}
PAGES = {
    "open tags": "<a " * (M // 3) + '"', "quotes": "<a '\"" * (M // 5), "deep": "<div>" * (M // 5) + "</span>" * (M // 7), "items": "<ul><div>" * (M // 18) + "<li>x" * (M // 10), "scripts": "<script>" + "</script " * (M // 9), "less": "<" * M,
    "spans": "<span class='ad'>" * (M // 17) + "x" + "</span>" * (M // 17), "attributes": "<p " + "a=b " * (M // 4) + ">x", "comments": "<!-- " * (M // 5),
}


@pytest.mark.parametrize("name", PII)
def test_personal_data_takes_linear_time(name):
    began = time.time()
    pii.spans(PII[name])
    assert time.time() - began < 10


@pytest.mark.parametrize("name", PAGES)
def test_pages_take_linear_time(name):
    began = time.time()
    htmltext.blocks(PAGES[name])
    assert time.time() - began < 10


def test_nearly_equal_streams_take_linear_time():
    a = np.arange(1, 100_001, dtype=np.uint64)
    b = a.copy()
    b[50_000] = 7
    began = time.time()
    got = htmltext.repeated([a, b, np.full(50_000, 3, np.uint64), np.full(50_000, 3, np.uint64)], 6)
    assert time.time() - began < 20 and (~got[0]).sum() == (~got[1]).sum() == 1 and got[2].all()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p title="the hidden door">Real text</p>', ["Real text"]), ('<p data-x="display:none">a</p><p style="display : none">b</p><p hidden>c</p><p aria-hidden=true>d</p>', ["a"]),
        ('<p class="ad">Buy<p>Real text after</p>', ["Real text after"]), ('<ul><li class="ad">a<li>b</ul>', ["b"]), ('<p>text <span class="ad">x</p><p>next para</p>', ["text", "next para"]),
        ('<p>Hello <span class="ad">buy now</span> world</p>', ["Hello world"]), ('<a class="ad"><div>inside</div></a><p>after</p>', ["after"]), ("<p>a<table><tr><td class=ad>x<td>y<tr><td>z</table>", ["a", "y", "z"]),
        ("<ul><li>a<ul><li class=ad>b</ul>c<li>d</ul>", ["a", "c", "d"]), ("<span>a<div>b</span>c</div>", ["a", "bc"]), ("1 < 2 <b>and</b> 3", ["1 < 2 and 3"]),
    ],
)
def test_markup(page, want):
    assert [t for t, _, mark in htmltext.blocks(page)[0] if mark != htmltext.OUT] == want


@pytest.mark.parametrize(("tag", "mark"), [("<section class=search>", 1), ("<p class=notice>", 1), ("<section id=related>", 1), ("<div role=search>", 2), ("<div class=ad>", 2), ("<div class='menu ad-slot'>", 2), ("<div class=reading>", 0)])
def test_doubtful_words_ask(tag, mark):
    assert [m for _, _, m in htmltext.blocks(tag + "x")[0]] == [mark]


def test_results_do_not_depend_on_the_size_of_an_array(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(0, 400)}"
    shared = [" ".join(word() for _ in range(n)) for n in (3, 6, 9, 14)]
    pages = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.integers(1, 9))), *rng.choice(shared, 2)]
        rng.shuffle(parts)
        pages.append((i, f"http://h{i % 2}/{i}", "".join(f"<div>{x}</div>" for x in parts)))
    pages += [(100 + i, "http://h0/x", pages[4][2]) for i in range(20)] + [(200, None, pages[0][2]), (201, "http://H0/y", "<p>" + "long text " * 20_000)]
    df = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, row string, key int")
    got = []
    for size in (10_000_000, 90, 7):
        monkeypatch.setattr(htmltext, "SHARD_WORDS", size)
        got.append({r.page_id: r.text for r in htmltext.main_text(df).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == len(pages)
    own = {i: [x.removesuffix("</div>") for x in h.split("<div>")[1:]] for i, _, h in pages if i < 60}
    for host in (0, 1):
        streams = {i: " ".join(x).split(" ") for i, x in own.items() if i % 2 == host}
        grams = {i: {tuple(s[k : k + 6]) for k in range(len(s) - 5)} for i, s in streams.items()}
        for i, s in streams.items():
            others = set().union(*(g for j, g in grams.items() if j != i and streams[j] != s))
            hit = np.zeros(len(s), bool)
            for k in range(len(s) - 5):
                if tuple(s[k : k + 6]) in others:
                    hit[k : k + 6] = True
            at, want = 0, []
            for x in own[i]:
                n = len(x.split(" "))
                want += [] if hit[at : at + n].all() else [x]
                at += n
            assert got[0][i] == "\n".join(want)


def test_deep_and_invalid_json(spark):
    deep = lambda n: "<tool_call>" + '{"id":"a","name":"search","arguments":{"x":' + "[" * n + "]" * n + "}}</tool_call>"
    texts = [deep(10), deep(98), deep(99), deep(1500), deep(200_000), *(f'<tool_call>{{"id":"a","name":"search","arguments":{{"x":{v}}}}}</tool_call>' for v in ("NaN", "-Infinity", "1e999", '"\\ud800"', "1")), "x" * M + "<tool_result>" + json.dumps({"id": "a", "content": "y" * M}) + "</tool_result>"]
    for i, t in enumerate(texts):
        _, calls, results = chat.parse(t, {"search": {"type": "object"}})
        assert [bool(c[3]) for c in calls] == [[False], [False], [True], [True], [True], [True], [True], [True], [True], [False], []][i] and len(results) == (i == 10)
    rows = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(rows, {"search": {"type": "object"}}).count() == len(texts)
