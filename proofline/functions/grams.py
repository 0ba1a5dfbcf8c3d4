"""Hashed character grams, and the few of them that a text's own content chooses."""

from __future__ import annotations

import numpy as np

MOST_CHARS = 1 << 24  # characters of all texts of one call to ``chosen``: positions fill 24 bits

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` code points; wrap-around arithmetic is intended."""
    n = len(codes)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - k, _INVERSE, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _ODD * powers)])
    h = (sums[k:] - sums[:-k]) * inverse
    h ^= h >> np.uint64(31)
    h *= _ODD
    h ^= h >> np.uint64(29)
    return h


def chosen(texts: list[str], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, digest) of the gram of least hash among every ``window`` consecutive ones of ``k`` characters.

    Whatever has k+window-1 characters in common with a text has one of its chosen grams in common.  Each
    text must have that many characters; fewer than ``MOST_CHARS`` in all.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = gram_hashes(codes, k)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes wins
    span = 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    inside = np.ones(len(least), bool)
    for end in (starts + lengths)[:-1]:  # windows that would run over the end of a text
        inside[max(0, end - (k + window - 2)) : end] = False
    at = np.unique((least[inside] & low).astype(np.int64))
    which = np.searchsorted(starts, at, "right") - 1
    return which, at - starts[which], h[at].view(np.int64)
