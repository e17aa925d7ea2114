"""Vectorised hashing of the words of a text, shared by operators that work on words."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []
#: Bytes that separate words, [\x20\x09-\x0D], and the lower-casing of A-Z.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of h reaches every bit of the result."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _hash_block(raw: np.ndarray) -> np.ndarray:
    word = IS_WORD[raw]
    edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    if not _POWERS or len(_POWERS[0]) < longest:
        p = np.full(max(64, longest), _P)
        p[0] = 1
        _POWERS[:] = [np.cumprod(p, dtype=np.uint64)]
    body = LOWERED[raw[word]].astype(np.uint64) + np.uint64(1)  # the words' bytes, one after the other
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(body)) - np.repeat(first, sizes)
    return mixed(np.add.reduceat(body * _POWERS[0][at], first) + sizes.astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    r"""64-bit hashes of a text's [^\x20\x09-\x0D]+, in order, A-Z lower-cased; in blocks that end between words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= BLOCK:
        return _hash_block(raw)
    found, at = [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw) and IS_WORD[raw[end]]:
            gap = np.flatnonzero(~IS_WORD[raw[end : end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(end + BLOCK, len(raw))
        found.append(_hash_block(raw[at:end]))
        at = end
    return np.concatenate(found)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; fewer words than that make one, none make the empty set."""
    h = word_hashes(text)
    if len(h) > words:
        out = np.zeros(len(h) - words + 1, np.uint64)
        for i in range(words):
            out = mixed(out * _P + h[i : len(h) - words + 1 + i])
        return np.unique(out)
    one = np.zeros(1, np.uint64)
    for x in h:
        one = mixed(one * _P + x)
    return one if len(h) else h
