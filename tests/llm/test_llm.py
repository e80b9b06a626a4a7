"""The training-data operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import json
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylark.llm import balltree, chat, crosspolytope, htmltext, mixing, neardup, packing, pii, quality, tokencount
from skylark.llm.queries import MIX_WEIGHTS, mix_levels
from skylark.llm.vocab import public_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, rep string"
ODD = [None, "", "  \n ", "one two", "Hello <|endoftext|> wOrld  it's 12 Été!!  x", "w " * 5000]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "x", "y") for i, t in enumerate(texts)], DOCS)


def _vectors(spark, n=300, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)
    x[10:40] = x[10]
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)] + [(900, None, "c"), (950, [1.0, float("nan")] * 4, "c"), (None, [1.0] * 8, "c")]
    return x.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_top_k_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(balltree.V, "SHARD_ROWS", 40)
    test_top_k_is_exact(spark)


def test_neighbours_of_many_shards_are_never_short(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope.V, "SHARD_ROWS", 100)
    x, df = _vectors(spark, n=301)
    got = crosspolytope.neighbours(df, least=40).groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in got) == [(i, 10) for i in (0, 100, 200, 300)]
    few = spark.createDataFrame([(i, [1.0, float(i)], "c") for i in (0, 1, 2)], "vec_id long, embedding array<double>, score string")
    assert sorted((r.vec_id, r["rank"]) for r in crosspolytope.neighbours(few).collect()) == [(1, 1), (2, 2)]


def test_top_k_is_exact(spark):
    x, df = _vectors(spark)
    q, ids = np.floor(256 * x), np.arange(len(x))
    got = balltree.top_k(df).collect()
    for i in range(0, 300, 50):
        s = q @ q[i]
        s[i] = -1e18
        want = np.lexsort((ids, -s))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want.tolist()
    assert balltree.top_k(df.limit(0)).count() == 0


def test_neighbours_recall(spark):
    x, df = _vectors(spark)
    got = crosspolytope.neighbours(df).collect()
    hits = []
    for i in range(0, 300, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = 9e9
        hits.append(len({r.vec_id for r in got if r.query_id == i} & set(np.lexsort((np.arange(300), d))[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.9 and crosspolytope.neighbours(df.limit(0)).count() == 0


def test_packing_round_trip(spark):
    t = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    rows = packing.pack(_docs(spark, ODD * 3), tokenizer=public_path("word_bpe_49k.json")).collect()
    for i, text in enumerate(ODD * 3):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    histogram = {x: int(n) for x, n in zip(*np.unique([r.length for r in rows], return_counts=True), strict=True)}
    assert packing.plan(histogram, 2048)[0].total() == len({r.sequence_id for r in rows})
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert packing.pack(_docs(spark, ["a"]).limit(0), tokenizer=public_path("word_bpe_49k.json")).count() == 0


def test_packing_comes_from_the_program():
    rng = np.random.default_rng(2)
    pieces = np.concatenate([rng.integers(1, 300, 3000), rng.integers(300, 2049, 600)])
    histogram = dict(zip(*(x.tolist() for x in np.unique(pieces, return_counts=True)), strict=True))
    chosen, solved = packing.plan(histogram, 2048)
    placed = {}
    for config, n in chosen.items():
        assert sum(config) <= 2048
        for x in config:
            placed[x] = placed.get(x, 0) + n
    assert placed == histogram
    assert solved >= 0.8 * chosen.total() and chosen.total() <= packing._best_fit(packing.Counter(histogram), 2048).total()


def test_token_counts_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "COMMON", 3)  # so that most pre-tokens are joined
    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    rows = [*ODD, *ODD, "x" * 3000 + " don't" * 2000]
    docs = _docs(spark, rows).withColumn("n_tokens", F.lit("clash")).withColumn("pretoken", F.lit(1))
    got = tokencount.token_counts(docs.union(docs.where("doc_id = 4")), tokenizer=public_path("byte_bpe_50k.json")).collect()
    want = [(i, len(t.encode(x or "").ids)) for i, x in enumerate(rows)]
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted([*want, want[4]])
    assert tokencount.token_counts(docs.limit(0), tokenizer=public_path("byte_bpe_50k.json")).count() == 0


def test_token_counts(spark):
    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    rows = tokencount.token_counts(_docs(spark, ODD), tokenizer=public_path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == [(i, len((x or "").encode()), len(t.encode(x or "").ids)) for i, x in enumerate(ODD)]


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(400, 200).astype(str)) for _ in range(6)]
    near = [b.replace(" 1", " z1", 3) for b in base[:3]]
    texts = [*base, *near, base[0].upper(), None, "", "a b", "A  b"]
    rows = {r.doc_id: r for r in neardup.near_duplicates(_docs(spark, texts)).collect()}
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set() for w in words]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [rows[i].component_id for i in range(len(texts))] == root
    assert [rows[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert neardup.near_duplicates(_docs(spark, ["a"]).limit(0)).count() == 0


def test_quality_learns(spark):
    texts = [("Plain words of prose here. " * 5) if i % 2 else ("LOUD!! %%% ### " * 9) for i in range(120)] + [None, ""]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    rows = quality.score(_docs(spark, texts), labels).collect()
    assert len(rows) == 122 and all(r.predicted == r.doc_id % 2 for r in rows if r.held_out and r.doc_id < 120)
    assert quality.score(_docs(spark, texts), labels.limit(0)).where("score = 0.5").count() == 122


def test_personal_data(spark):
    texts = ["mail a.b@c.de or +1 (988) 555-2485 ip 1.2.3.4 300.1.1.1 card 4111 1111 1111 1111", "jоhn [at] exаmple (dot) com", None, "", "plain one two"]
    rows = {r.doc_id: r for r in pii.find(_docs(spark, texts)).collect()}
    assert rows[0].spans == "email:5:13,phone:17:34,ip:38:45,card:61:80"
    assert rows[1].spans == "email:0:27" and rows[2].spans == rows[4].spans == ""
    masked = {r.doc_id: r.text for r in pii.redact(_docs(spark, texts)).collect()}
    assert masked[0].startswith("mail <email> or <phone>") and masked[2] is None


def test_base_spans_against_the_plain_patterns():
    rng = np.random.default_rng(6)
    parts = ["a.b@c.de", "@", "x@y", "u+v@h-1.co.uk.", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "007.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "12", " ", "\n", "é", "+", "a@b.c@d.e", "5500000000000004"]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    for _ in range(400):
        text = "".join(rng.choice(parts, rng.integers(0, 12)).tolist())
        want = sorted((m.start(), kind, m.end()) for kind, (pattern, ok) in enumerate(rules) for m in re.finditer(pattern, text) if ok(m[0]))
        assert pii.base_spans(text) == want


def test_disguises_map_back_to_the_source(spark):
    texts = {
        "juan arroba ejemplo punto es": "email:0:28", "so hans bei beispiel punkt de": "email:3:29", "mail john dot smith at example dot com now": "email:5:38", "name at foo dot ru": "email:0:18",
        "plus eins zwei drei vier fünf sechs sieben acht neun null": "phone:0:57", "ip 10 dot 0 dot 0 dot 1 ok": "ip:3:23", "+١٢٣٤٥٦٧٨٩٠": "phone:0:11", "look at this point we are": "", "x " * 200_000: "",
    }
    rows = [*texts, next(iter(texts))]
    docs = _docs(spark, rows).withColumn("spans", F.lit(1)).withColumn("n_email", F.lit("x"))
    assert {(r.doc_id, r.spans) for r in pii.find(docs).collect()} == {(i, texts[t]) for i, t in enumerate(rows)}
    assert pii.find(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_mixture_holds_its_budget(spark):
    docs = _docs(spark, [None, "", *["w " * (5 + i % 7) for i in range(60)]])
    rows = mixing.mix(docs, levels=mix_levels(), weights=MIX_WEIGHTS, permille=500).collect()
    total = sum(5 + i % 7 for i in range(60))
    assert total // 2 - 12 <= sum(r.taken for r in rows) <= total // 2
    assert all(0 < r.taken <= r.tokens for r in rows) and mixing.mix(docs.limit(0), levels=mix_levels(), weights=MIX_WEIGHTS).count() == 0


def test_main_text(spark):
    page = "<html><body><nav>menu here</nav><div class='ad'>buy</div><article><h1>T &amp; U</h1><p>one<br>two  three<p>four</article><footer>f</footer>"
    bare = "<body><div>shared words of the host frame</div><p>{}</p></body>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", bare.format("first own text")), (3, "http://h/3", bare.format("second one differs")), (4, None, None)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & U\none two three\nfour", 2: "first own text", 3: "second one differs", 4: ""}


def test_repeated_tokens_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(40):
        streams = [rng.integers(1, 4, rng.integers(0, 14)).astype(np.uint64) for _ in range(4)]
        got = htmltext.repeated(streams, 3)
        for i, own in enumerate(streams):
            want = np.zeros(len(own), bool)
            others = [tuple(x[k : k + 3].tolist()) for j, x in enumerate(streams) if j != i for k in range(len(x) - 2)]
            for k in range(len(own) - 2):
                if tuple(own[k : k + 3].tolist()) in others:
                    want[k : k + 3] = True
            assert got[i].tolist() == want.tolist()


def test_marked_words_alone_remove_nothing(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "SHARD_WORDS", 60)
    page = lambda i: (
        f"<body><aside><article>teaser {i}</article></aside><article><h2 id='search-methods'>Search methods {i}</h2><p class='social-history'>Social history {i}"
        f"<p class='share-this-now'>share this page with all of your dear friends<div class='cookie-notice'>we use {i}</div></article>"
    )
    rows = [(i, "http://h/x", page(i)) for i in range(9)] + [(20, "http://other/x", "<aside><main>no</main></aside><div>yes</div>")]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Search methods {i}\nSocial history {i}" for i in range(9)} | {20: "yes"}
    assert htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_chat_links_and_order(spark):
    call = lambda i, **a: "<tool_call>" + json.dumps({"id": i, "name": "search", "arguments": a}) + "</tool_call>"
    result = lambda i: "<tool_result>" + json.dumps({"id": i, "content": "r"}) + "</tool_result>"
    rows = [(1, 0, "tool", result("a")), (1, 1, "assistant", call("a", query="x")), (1, 2, "assistant", call("b", query={"$result": "a"}, limit=0)), (1, 3, "user", None), (1, 4, "tool", result("zz")), (None, 0, None, "<tool_call>{</tool_call>")]
    schema = {"search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"]}}
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schema).collect()}
    assert (got[1, 0].order_turn, got[1, 0].order_depth) == (1, 1) and (got[1, 1].order_turn, got[1, 1].n_linked) == (1, 1)
    assert got[1, 2].n_invalid == 1 and got[1, 4].n_orphans == 1 and got[None, 0].n_invalid == 1
    assert got[1, 3].message == '{"content":"","role":"user"}'
    empty = spark.createDataFrame(rows[:1], "conv_id long, turn long, role string, text string").withColumn("message", F.lit(1)).limit(0)
    assert chat.format_chats(empty, schema).count() == 0


def test_chat_order_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, needs, turns = [], {}, {}
    for conv in range(12):
        n = int(rng.integers(2, 9))
        for i in range(n):
            refs = [int(j) for j in rng.integers(0, n, 2) if rng.random() < 0.5]
            at = rng.permutation(2 * n)[:2]
            rows.append((conv, 2 * i, "assistant", "<tool_call>" + json.dumps({"id": f"c{i}", "name": "search", "arguments": {"query": [{"$result": f"c{j}"} for j in refs]}}) + "</tool_call>"))
            rows.append((conv, 2 * i + 1, "tool", "<tool_result>" + json.dumps({"id": f"c{i}", "content": int(at[0])}) + "</tool_result>"))
            needs[conv, 2 * i], needs[conv, 2 * i + 1] = {2 * j + 1 for j in refs}, {2 * i}
    schema = {"search": {"type": "object", "properties": {"query": {"type": "array", "items": {"type": "string"}}}}}
    doubled = spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string").withColumn("row", F.lit("clash"))
    got = chat.format_chats(doubled.dropDuplicates(), schema).collect()
    assert len(got) == len(rows) and all(r.n_invalid == 0 for r in got)
    for conv in range(12):
        own = {r.turn: r for r in got if r.conv_id == conv}
        settled = {}
        while True:  # brute force: a message follows all that it needs
            new = {t: max([(t, 0), *((settled[b][0], settled[b][1] + 1) for b in needs[conv, t])]) for t in own if t not in settled and needs[conv, t] <= settled.keys()}
            if not new:
                break
            settled |= new
        assert {t for t, r in own.items() if r.cyclic} == own.keys() - settled.keys()
        place = {t: (r.order_turn, r.order_depth, t) for t, r in own.items()}
        assert all(place[b] < place[t] for t in settled for b in needs[conv, t])
