"""Chunks of texts for token counts: cut as the library cuts, plain ones without it."""

import random

from tokenizers import Tokenizer

from skylark.llm import tokencount as T
from skylark.llm.vocab import public_path

PATH = public_path("byte_bpe_50k.json")


def test_plain_chunks_leave_the_librarys_cache_alone():
    words = [" plain", "word,", " it's", "Été!!", " 12", "\n\n", " a\x1cb", "<|endoftext|>", "~"]
    T._FINE.clear()
    assert T.pretokens_of(words, PATH) == [(" plain",), ("word", ","), (" it", "'s"), ("Été", "!!"), (" 12",), ("\n\n",), (" a", "\x1c", "b"), ("<|endoftext|>",), ("~",)]
    assert set(T._FINE[PATH]) == {" it's", " 12", "\n\n", " a\x1cb", "~"}
    assert T.pretokens_of([], PATH) == []


def test_chunks_fall_into_the_librarys_pretokens():
    rng, pre = random.Random(7), Tokenizer.from_file(PATH).pre_tokenizer
    signs = [" ", " ", "\n", "\r", "\t", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "a", "Été", "x,", "'s", "12", "!", "漢", "​", "😀"]
    assert {bool(T._SEPARATORS.search(c)) for c in signs} == {True, False}
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randrange(12)))
        (chunks,) = T.chunked([text], PATH)
        got = [p for c in T.pretokens_of(chunks, PATH) for p in c]
        assert got == [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)], repr(text)
        assert all(T.pretokens_of(got, PATH)[i] == (p,) for i, p in enumerate(got)), repr(text)  # a pre-token is looked up as a chunk
