"""Fill-in-middle against a brute-force version, with odd rows."""

import hashlib

from skylark.llm import fim

ODD = [None, "", " ", "a", "ab", "<", "x<P>y", "<S", "a<S>b", "<M>", "<M", "P><S", "S>", "\n\r\n\t", "é̂ñ😀漢字 z", "<<P<S<M>"[:-1], "<P<S<M" * 40, "ab\n😀" * 20_000]


def _want(doc_id, text, seed=1):
    text = text or ""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    spm = h[3] % 100 < 20
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if spm else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, n, "spm" if spm else "psm", a, b - a, out, text


def test_equals_brute_force(spark):
    rows = [(i * 7 + j, t, "c") for i, t in enumerate(ODD) for j in range(6)] + [(3, "same", "c")] * 3 + [(None, "no id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = sorted(map(tuple, fim.fill_in_middle(docs).collect()), key=repr)
    assert got == sorted((_want(i, t) for i, t, _ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"} and fim.fill_in_middle(docs.limit(0)).count() == 0
    digest = {(r.doc_id, r.n): (r.output_sha256, r.restored_sha256) for r in fim.digests(fim.fill_in_middle(docs, seed=5)).collect()}
    for i, t, _ in rows:
        want = _want(i, t, 5)
        assert digest[i, want[1]] == tuple(hashlib.sha256(x.encode()).hexdigest() for x in want[5:])


def test_larger_units(spark):
    docs = spark.createDataFrame([(i, "one  two three\nfour\n\n five") for i in range(40)], "doc_id long, text string")
    rows = fim.fill_in_middle(docs, unit=r"(?s)\s*\S+\s*", rate=100).collect()
    assert {r.n for r in rows} == {5} and all(r.restored == "one  two three\nfour\n\n five" for r in rows) and all(r.form != "plain" for r in rows)
