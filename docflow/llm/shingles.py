"""Word shingles of many texts at once, as 64-bit hashes, with numpy.

Words are the runs of letters or digits of the lower-cased text. A word's hash is a polynomial over its code
points, taken from running sums over the whole batch, so there is no Python loop over words or characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters that are hashed together; longer texts are taken in pieces of about this size.
BLOCK_CHARS = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _letters_and_digits() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    n = 2 * BLOCK_CHARS
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, _BASE_INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_runs(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a text of at most twice ``BLOCK_CHARS`` characters."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(points) + 2, dtype=np.int8)
    inside[1:-1] = _letters_and_digits()[points]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers()
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return starts, mix64((sums[ends] - sums[starts]) * down[starts])


def _long_words(text: str) -> np.ndarray:
    """Word hashes of one text of any length, cut between words. A single word longer than a block is
    hashed in pieces."""
    table, parts, start = _letters_and_digits(), [], 0
    while start < len(text):
        stop = min(len(text), start + BLOCK_CHARS)
        while stop < len(text) and stop - start < 2 * BLOCK_CHARS and table[ord(text[stop])]:
            stop += 1
        parts.append(_hash_runs(text[start:stop])[1])
        start = stop
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def words_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order; a null text has no words."""
    block: list[str] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        ends = np.cumsum([len(t) + 1 for t in block])
        starts, hashes = _hash_runs(" ".join(block))
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        low = (text or "").lower()
        if size + len(low) + 1 > BLOCK_CHARS and block:
            yield from flush()
            block, size = [], 0
        if len(low) >= BLOCK_CHARS:
            yield _long_words(low)
        else:
            block.append(low)
            size += len(low) + 1
    if block:
        yield from flush()


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each place on; runs over the end are left out."""
    n = max(len(words) - width + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(_BASE) + words[k : k + n])
    return out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    hashes = np.sort(hashes)
    if len(hashes) > 1:
        hashes = hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]
    return hashes


def shingle_sets_of(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The distinct runs of ``width`` consecutive words of each text, as sorted hashes; none of a text with
    fewer words. Runs are hashed for a block of texts at once, those across two texts are dropped."""
    block: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes = shingle_hashes(np.concatenate(block), width)
        at = 0
        for words in block:
            yield distinct(hashes[at : at + max(len(words) - width + 1, 0)])
            at += len(words)

    for words in words_of(texts):
        block.append(words)
        size += len(words)
        if size > BLOCK_CHARS // 8:
            yield from flush()
            block, size = [], 0
    if block:
        yield from flush()


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct runs of ``width`` consecutive words of one text."""
    return distinct(shingle_hashes(words, width))
