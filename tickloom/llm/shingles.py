"""Word shingles of whole texts as 64-bit hashes, for a batch of texts at once.

Words are runs of `[^\\x20\\x09-\\x0D]` with A-Z in lower case. A text's set holds its distinct windows of `width` words; a text
with fewer words has the whole sequence as its one member; a text without words has none.
"""
from __future__ import annotations

import numpy as np

U = np.uint64
STEP = 1 << 20  # bytes hashed at once
_FINE = U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finish)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * _FINE)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = U(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of a byte array, in order."""
    starts, hashes, i, n = [], [], 0, len(buf)
    while i < n:
        j = min(i + STEP, n)
        while j < n and not _SPACE[buf[j]]:
            ahead = np.flatnonzero(_SPACE[buf[j:j + STEP]])
            j = j + int(ahead[0]) if len(ahead) else min(j + STEP, n)
        b = buf[i:j]
        inside = np.flatnonzero(~_SPACE[b])
        if len(inside):
            first = np.flatnonzero(np.r_[True, np.diff(inside) > 1])
            size = np.diff(np.r_[first, len(inside)])
            place = np.arange(len(inside)) - np.repeat(first, size)
            terms = _BYTE[b[inside]] * _powers(int(size.max()))[place]
            hashes.append(mix(np.add.reduceat(terms, first) + size.astype(U) * _FINE))
            starts.append(inside[first] + i)
        i = j
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """The set of each text: sorted distinct hashes."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, words = word_hashes(np.frombuffer(b" ".join(raw), dtype=np.uint8))
    cuts = np.searchsorted(starts, ends)
    weight = mix(np.arange(1, width + 1, dtype=U) * _BASE) | U(1)
    out, a = [], 0
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=U)
    for k in range(width):
        rolled += words[k:len(words) - width + 1 + k] * weight[k] if len(rolled) else U(0)
    rolled = mix(rolled)
    for b in cuts.tolist():
        n = b - a
        if n >= width:
            s = np.sort(rolled[a:b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif n:
            out.append(mix((words[a:b] * weight[:n]).sum(dtype=U, keepdims=True) + np.array([n], dtype=U) * _FINE))
        else:
            out.append(np.empty(0, dtype=U))
        a = b
    return out
