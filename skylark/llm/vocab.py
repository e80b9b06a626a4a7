"""Public tokenizers inside tasks: word caches over the library's own encodings."""

from __future__ import annotations

import re

from tokenizers import Tokenizer

#: Entries that a worker keeps in a generation of a cache.
CACHE_WORDS = 300_000

_LOADED: dict[str, Tokenizer] = {}


def public_path(name: str) -> str:
    """Where the installed public tokenizer file of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def loaded(path: str) -> Tokenizer:
    """The tokenizer of a file, read once in each worker."""
    if path not in _LOADED:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _LOADED[path] = tokenizer
    return _LOADED[path]


class Words(dict):
    """word -> what ``encode`` makes of it; unknown words are encoded in batches.

    When full, the words become the older generation, from which those still in use come back.
    """

    def __init__(self, encode, limit: int = CACHE_WORDS):
        super().__init__()
        self.encode, self.limit, self.older = encode, limit, {}

    def learn(self, words: set) -> None:
        """Make sure that all of these words are here; they stay until the next call."""
        new = [w for w in words if w not in self]
        if not new:
            return
        if len(self) + len(new) > self.limit:
            self.older = dict(self)
            self.clear()
            new = list(words)
        unknown = []
        for w in new:
            found = self.older.get(w)
            if found is None:
                unknown.append(w)
            else:
                self[w] = found
        if unknown:
            self.update(zip(unknown, self.encode(unknown), strict=True))


#: A plain word of Western letters with ASCII signs but the apostrophe after it, perhaps after one space.
#: No normalisation form changes it and letters never share a pre-token with signs, so its two parts
#: can be looked up apart.
PLAIN = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")

#: Fixed values of byte-level vocabularies: these bytes show as themselves, the others in their order from U+0100.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = {b: chr(0x100 + i) for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


def pieces(path: str, pretoken: str) -> list[int]:
    """The ids of one pre-token, straight from the model of a byte-level vocabulary."""
    shown = pretoken.encode().decode("latin-1").translate(_HIDDEN)
    return [t.id for t in loaded(path).model.tokenize(shown)]
