"""SuperMinHash signatures (Ertl 2017) for many sets at once.

Every element draws a random permutation of the K places and gives the place at step j the value j + random fraction; a
place keeps the lowest value. The ranks of one element differ from place to place, which lowers the variance against
independent hash functions. A set stops as soon as no later step can lower any of its places.
"""
from __future__ import annotations

import numpy as np

from .shingles import U, mix

HELD = 8_000_000  # entries of permutations held at once
_STEP = U(0xA0761D6478BD642F)


def _block(flat: np.ndarray, owner: np.ndarray, n_sets: int, places: int) -> np.ndarray:
    sig = np.full(n_sets * places, np.iinfo(np.uint64).max, dtype=U)
    perm = np.broadcast_to(np.arange(places, dtype=np.uint16 if places > 256 else np.uint8), (len(flat), places)).copy()
    salt = np.arange(1, places + 1, dtype=U) * _STEP
    for j in range(places):
        r = mix(flat + salt[j])
        k = j + ((r >> U(32)) * U(places - j) >> U(32)).astype(np.int64)
        row = np.arange(len(flat))
        got = perm[row, k]
        perm[row, k] = perm[:, j]
        perm[:, j] = got
        np.minimum.at(sig, owner * places + got, U(j) << U(32) | r & U(0xFFFFFFFF))
        open_ = sig.reshape(n_sets, places).max(axis=1) >= U(j + 1) << U(32)
        go = open_[owner]
        if not go.all():
            flat, owner, perm = flat[go], owner[go], perm[go]
        if not len(flat):
            break
    return sig.reshape(n_sets, places)


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """One row of `places` values for each set; a set without elements has the highest value everywhere."""
    out, size, most = np.empty((len(sets), places), dtype=U), [len(s) for s in sets], HELD // places
    i = 0
    while i < len(sets):
        j, n = i + 1, size[i]
        while j < len(sets) and n + size[j] <= most:
            n, j = n + size[j], j + 1
        out[i:j] = _block(np.concatenate(sets[i:j]), np.repeat(np.arange(j - i), size[i:j]), j - i, places)
        i = j
    return out


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` places; the number of the band is part of it."""
    d, k = sig.shape
    part = sig.reshape(d, k // rows, rows)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=U) * _STEP, (d, k // rows)).copy()
    for r in range(rows):
        key = mix(key ^ part[:, :, r]) + _STEP
    return key.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """One bit of each place, 64 places to a number; the places must be a multiple of 64."""
    bit = (mix(sig) & U(1)).reshape(len(sig), -1, 64) << np.arange(64, dtype=U)
    return np.bitwise_or.reduce(bit, axis=2).view(np.int64)
