"""Vectorised byte work for tasks: words, window fingerprints and sliding minima over UTF-8 buffers.

Words are told by chained 64-bit fingerprints, which only preselect: equal ones are compared by their bytes.  A window's
fingerprint is a polynomial hash modulo 2**64 of its mixed eight-byte tuples, taken from prefix sums, so that any number of
windows of one buffer cost a few vector operations.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib

import numpy as np
import pyarrow as pa

from tallybrook.llm import _tokens

U64 = np.uint64
BLOCK = 1 << 20  # bytes that are hashed at a time
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for buffers of up to n bytes; kept for the usual size."""
    if "up" in _powers and len(_powers["up"]) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    up, down = np.full(n, _BASE, U64), np.full(n, pow(_BASE, -1, 2**64), U64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    if n <= BLOCK + 4096:
        _powers["up"], _powers["down"] = up, down
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


LONG = 64  # bytes of a word beyond which it is digested by itself
_CHAIN, _SIZE = U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def eights(low: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer on, as numbers; behind its end are zeros."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    return np.ndarray(len(low), "<u8", padded, strides=(1,))


def stir(x: np.ndarray) -> np.ndarray:
    """A cheaper mixing, of numbers that are summed up and mixed later; x is changed."""
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0x9FB21C651E98DF25)
    x ^= x >> U64(29)
    return x


class Prefix:
    """Prefix sums of one buffer, for the fingerprints of its ranges of at least eight bytes.

    The terms are the eight bytes from each place on, mixed, so that structure in the bytes is none in the sums.
    """

    def __init__(self, data: np.ndarray):
        n = max(0, len(data) - 7)
        self.up, self.down = _power(max(n + 1, BLOCK + 1))
        self.sums = np.zeros(n + 1, U64)
        terms = stir(eights(data)[:n] + _CHAIN)
        terms *= self.up[:n]
        np.cumsum(terms, out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop - 7] - self.sums[start]) * self.down[start] + (stop - start).astype(U64))

    def windows(self, k: int) -> np.ndarray:
        """Fingerprints of all ranges of k bytes."""
        n = len(self.sums) + 7 - k
        return mix((self.sums[k - 7 :] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return a worker's free memory to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such function in this C library
        ctypes.CDLL(None).malloc_trim(0)


def smaller(batches, column: int = 0, most: int = 4 << 20):
    """Batches cut so that one text column has at most so many bytes each, or a single text: what tasks hold at a time.

    Tasks that use it encode no tokens, so the worker's token caches go first; at the end its free memory is given back.
    """
    _tokens.forget()
    for b in batches:
        _, off = utf8(b.column(column))
        at = 0
        while at < len(b):
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end
    give_back()


#: Word bytes after lower-casing A-Z: 0-9, a-z and all bytes of non-ASCII characters; 0 elsewhere.
LOWER = np.zeros(256, np.uint8)
LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER[0x80:] = np.arange(0x80, 0x100)


def word_hashes(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word of a lower-cased buffer.

    Words of up to eight bytes of the same size never share one, as the bytes are the number that is mixed.  Longer ones
    are chained eight bytes at a time through the mixing, and very long ones digested by BLAKE2.
    """
    eight = eights(low)
    out = mix(eight[start] & _MASKS[np.minimum(size, 8)])
    some = np.flatnonzero((size > 8) & (size <= LONG))
    more, k = some, 8
    while len(more):
        out[more] = mix((out[more] + _CHAIN) ^ (eight[start[more] + k] & _MASKS[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    out[some] = mix(out[some] + size[some].astype(U64) * _SIZE)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[start[i] : start[i] + size[i]], digest_size=8).digest(), "little")
    return out


def same_words(low_a: np.ndarray, start_a: np.ndarray, low_b: np.ndarray, start_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether pairs of words of the same size, in two lower-cased buffers, are equal byte by byte."""
    out, a, b = np.ones(len(size), bool), eights(low_a), eights(low_b)
    more, k = np.flatnonzero(size <= LONG), 0
    while len(more):
        out[more] &= (a[start_a[more] + k] ^ b[start_b[more] + k]) & _MASKS[np.minimum(size[more] - k, 8)] == 0
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(low_a[start_a[i] : start_a[i] + size[i]], low_b[start_b[i] : start_b[i] + size[i]])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, first bytes, sizes) of all words of a batch of texts, and where each text's words begin (n + 1 places)."""
    found, counts, at, n = [], np.zeros(len(offsets) - 1, np.int64), 0, len(data)
    while at < n:
        end, step = at, BLOCK
        while end == at:  # end behind the last separator or text end of the block; a longer word is taken whole
            stop = min(n, at + step)
            breaks = np.flatnonzero(LOWER[data[at:stop]] == 0)
            edge = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            end = stop if stop == n else max(at + int(breaks[-1]) + 1 if len(breaks) else at, edge)
            step *= 2
        low = LOWER[data[at:end]]
        word = low != 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        lo, hi = np.searchsorted(offsets, [at, end])
        edges = offsets[lo:hi] - at  # text starts in this block
        first[edges] = word[edges]
        inner = edges[edges > 0] - 1
        last[inner] = word[inner]
        start = np.flatnonzero(first)
        if len(start):
            size = np.flatnonzero(last) + 1 - start
            found.append((word_hashes(low, start, size), start + at, size))
            counts += np.bincount(np.searchsorted(offsets, start + at, "right") - 1, minlength=len(counts))
        at = end
    places = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=places[1:])
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), places
    return *(np.concatenate(x) for x in zip(*found, strict=True)), places


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of a batch of texts, and where each text's words begin (n + 1 places)."""
    hashes, _, _, places = word_spans(data, offsets)
    return hashes, places


def word_numbers(low: np.ndarray, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each word of a lower-cased buffer, equal for equal words only: words of one fingerprint are compared by their bytes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[number]
    same = size == size[like]
    check = np.flatnonzero(same & (size > 8) & (like != np.arange(len(like))))
    same[check] = same_words(low, start[check], low, start[like[check]], size[check])
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        number[i] = others.setdefault(low[start[i] : start[i] + size[i]].tobytes(), len(first) + len(others))
    return number


def word_digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A 128-bit BLAKE2 digest of each text's words in their order; None without any."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        told, some, before = hashlib.blake2b(digest_size=16), False, False  # before: the last byte is a word's
        for at in range(a, b, BLOCK):
            low = LOWER[data[at : min(b, at + BLOCK)]]
            word = low != 0
            keep = word.copy()
            keep[1:] |= word[:-1]  # and one zero behind each word
            keep[0] |= before
            told.update(low[keep])
            some, before = some or bool(word.any()), bool(word[-1])
        if before:
            told.update(b"\0")
        out.append(told.digest() if some else None)
    return out


def sliding_min(h: np.ndarray, w: int, largest: bool = False) -> np.ndarray:
    """Minimum (maximum) of each w neighbouring values."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    op, fill = (np.maximum, 0) if largest else (np.minimum, np.iinfo(h.dtype).max)
    pad = (-len(h)) % w
    x = np.concatenate([h, np.full(pad, fill, h.dtype)]).reshape(-1, w)
    ahead = op.accumulate(x, 1).ravel()[w - 1 : w - 1 + n]
    behind = op.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()[:n]
    return op(ahead, behind)
