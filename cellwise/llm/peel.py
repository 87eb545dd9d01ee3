"""Immutable fingerprint filters of three-way hashed sets, built by peeling, all in numpy."""

from __future__ import annotations

import numpy as np

BITS = 16
#: Chance that a key outside one filter is taken for a member.
RATE = 2.0**-BITS
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def _places(h: np.ndarray, seed: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = _mix(h.view(np.uint64) + np.uint64(seed + 1) * _C1)
        y = _mix(x + _C1)
    low, s = np.uint64(0xFFFFFFFF), np.uint64(segment)
    cut = np.uint64(32)
    a = ((x & low) * s >> cut).astype(np.int64)
    b = ((x >> cut) * s >> cut).astype(np.int64) + segment
    c = ((y & low) * s >> cut).astype(np.int64) + 2 * segment
    return a, b, c, (y >> np.uint64(48)).astype(np.uint16)


def build(h: np.ndarray) -> tuple[int, int, bytes]:
    """Filter of the distinct int64 hashes ``h``: (seed, segment length, fingerprints)."""
    h = np.unique(np.asarray(h, np.int64))
    n = len(h)
    segment = (int(1.23 * n) + 32 + 2) // 3
    for seed in range(100):
        a, b, c, f = _places(h, seed, segment)
        count = np.zeros(3 * segment, np.int64)
        held = np.zeros(3 * segment, np.int64)
        ids = np.arange(n)
        for p in (a, b, c):
            count += np.bincount(p, minlength=3 * segment)
            np.bitwise_xor.at(held, p, ids)
        rounds, done = [], 0
        single = np.flatnonzero(count == 1)
        while len(single):
            keys, first = np.unique(held[single], return_index=True)
            rounds.append((keys, single[first]))
            done += len(keys)
            touched = []
            for p in (a, b, c):
                at = p[keys]
                np.subtract.at(count, at, 1)
                np.bitwise_xor.at(held, at, keys)
                touched.append(at)
            near = np.unique(np.concatenate(touched))
            single = near[count[near] == 1]
        if done == n:
            table = np.zeros(3 * segment, np.uint16)
            for keys, slots in reversed(rounds):
                table[slots] = f[keys] ^ table[a[keys]] ^ table[b[keys]] ^ table[c[keys]]
            return seed, segment, table.tobytes()
    raise RuntimeError("peeling failed 100 times")


def probe(h: np.ndarray, seed: int, segment: int, table: bytes) -> np.ndarray:
    """True where a hash may be a member; never False for a member."""
    t = np.frombuffer(table, np.uint16)
    a, b, c, f = _places(np.asarray(h, np.int64), seed, segment)
    return (t[a] ^ t[b] ^ t[c]) == f
