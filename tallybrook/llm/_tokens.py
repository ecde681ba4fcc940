"""Whole-text token ids through a cache of pre-token encodings.

No token spans ASCII white space, special strings hold none, and canonical composition does not cross it, so a
text's ids are the ids of its white-space-separated parts, one after another.  Parts are encoded by the library
once and then looked up; a full stop or comma at the end of a part, behind an ASCII letter, is a token run of its own.
"""

from __future__ import annotations

import os
from array import array
from itertools import islice

MOST = 300_000  # parts that a worker keeps besides the frequent ones (some 60 MB)
_loaded: dict = {}


def tokenizer(path: str):
    """The library's tokenizer of a file, once a worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def parts(text: bytes) -> list[bytes]:
    """The pre-tokens that the caches are keyed by.  ASCII is lower-cased unless a special string may be there."""
    return (text if b"<|" in text else text.lower()).split()


PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII without the apostrophe, which may begin a contraction
#: How the vocabulary spells bytes: printable Latin-1 by itself, the other 68 bytes from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_PLAIN))}


class Encoder:
    """Token counts or id bytes of whole texts; what is not in the frequent table goes through this worker's cache."""

    def __init__(self, path: str, frequent: dict[bytes, object] | None = None, ids: bool = True):
        self.tok, self.ids, self.frequent = tokenizer(path), ids, frequent or {}
        self.model = self.tok.model
        self.cache: dict[bytes, object] = dict(self.frequent)

    def encoded(self, some: list[bytes]) -> list:
        found = self.tok.encode_batch_fast([x.decode("utf-8") for x in some], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found] if self.ids else [len(e.ids) for e in found]

    def word(self, x: str):
        """A run of Latin-1 letters is one pre-token: straight to the library's model."""
        x = x.lower()
        y = x if x.isascii() else x.encode().decode("latin-1").translate(BYTES)
        found = self.model.tokenize(y)
        return array("I", [t.id for t in found]).tobytes() if self.ids else len(found)

    def learn(self, missing: set[bytes]) -> dict:
        """Encodings of parts that the cache lacks.  Punctuation behind a run of letters is a token run of its own."""
        found, whole, split = {}, set(), []
        for x in missing:
            bare = x.rstrip(PUNCTUATION)
            letters = bare.decode("utf-8")
            if letters.isalpha() and (bare.isascii() or max(letters) < "\u0100") and b"<|" not in x:
                if len(bare) == len(x):
                    found[x] = self.word(letters)
                else:
                    split.append((x, bare, x[len(bare) :], letters))
                    if x[len(bare) :] not in self.cache:
                        whole.add(x[len(bare) :])
            else:
                whole.add(x)
        own = [x for x in whole if x not in found]
        for i in range(0, len(own), 4096):
            found.update(zip(own[i : i + 4096], self.encoded(own[i : i + 4096]), strict=True))
        for x, bare, tail, letters in split:
            head = self.cache.get(bare)
            if head is None and (head := found.get(bare)) is None:
                head = found[bare] = self.word(letters)
            found[x] = head + (self.cache[tail] if tail in self.cache else found[tail])
        return found

    def of(self, text: bytes):
        """Little-endian unsigned 32-bit ids as bytes, or their number."""
        own = parts(text)
        got = list(map(self.cache.get, own))
        if None in got:
            found = self.learn({x for x, y in zip(own, got, strict=True) if y is None})
            got = [found[x] if y is None else y for x, y in zip(own, got, strict=True)]
            if len(self.cache) + len(found) > MOST + len(self.frequent):
                self.cache = dict(islice(self.cache.items(), len(self.frequent) + MOST // 2))  # common parts came early
            if len(found) <= MOST // 2:
                self.cache.update(found)
        return b"".join(got) if self.ids else sum(got)


_encoders: dict = {}


def forget() -> None:
    """Drop this worker's encoder and tokenizer."""
    _encoders.clear()
    _loaded.clear()


def encoder(path: str, frequent: dict[bytes, object] | None, ids: bool, tag: str = "") -> Encoder:
    """This worker's encoder; the cache outlives the task."""
    key = (path, ids, tag)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, frequent, ids)
    return _encoders[key]
