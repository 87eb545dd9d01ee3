"""The bucket rule in plain Python, for sequential modes and tests."""

from __future__ import annotations

import functools
import hashlib


@functools.lru_cache(maxsize=100_000)
def bucket_of(key: str, row: int, width: int) -> int:
    digest = hashlib.sha256(f"{row:0>5}{key}".encode()).digest()
    value = 0
    for b in range(8):
        signed = digest[b] - 256 if digest[b] > 127 else digest[b]
        value ^= (signed << (8 * b)) & 0xFFFFFFFFFFFFFFFF
    if value >= 1 << 63:
        value -= 1 << 64
    return abs(int(value / 9223372036854775807.0 * width))
