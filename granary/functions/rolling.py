"""Vectorised rolling hashes over code points.

A polynomial hash modulo 2**64 with an odd base: prefix hashes are one
cumulative sum, the hash of any span is a difference of two prefix values times
the inverse power of the base at its start. Code points are first mapped to
fixed random 64-bit words, so that short alphabets spread over all bits.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_SEED = 20240229
_state: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_words() -> np.ndarray:
    """A fixed random 64-bit word for each code point."""
    if "words" not in _state:
        _state["words"] = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(BASE) + np.uint64(_SEED))
    return _state["words"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, grown as needed."""
    if "pow" not in _state or len(_state["pow"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("pow", BASE), ("inv", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _state[name] = np.multiply.accumulate(p)
    return _state["pow"][:n], _state["inv"][:n]


def code_points(text: str) -> np.ndarray:
    """The text as an array of code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_hashes(words: np.ndarray) -> np.ndarray:
    """Prefix hashes with a leading zero: length n + 1."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of the spans [start, end)."""
    inv = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling: O(n log w) vector steps."""
    m, s = x, 1
    while s * 2 <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[: -(w - s)], m[w - s :]) if w > s else m


def winnow(prefix: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are least in some window of w.

    Every stretch of w + k - 1 positions holds at least one selected k-gram, and
    which ones it holds depends on that stretch alone: equal stretches select
    equal k-grams. Ties are all kept. Shorter inputs select nothing.
    """
    n = len(prefix) - 1
    if n < w + k - 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inv = powers(len(prefix))[1]
    h = mix((prefix[k:] - prefix[:-k]) * inv[: n - k + 1] + np.uint64(k))
    least = window_min(h, w)
    pad = np.full(w - 1, 0, np.uint64)
    best = ~window_min(~np.concatenate([pad, least, pad]), w)
    at = np.flatnonzero(best == h)
    return at, h[at]
