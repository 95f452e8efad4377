"""64-bit XXH3 hashes of many short byte strings at once; those of xxhash.xxh3_64_intdigest."""

from __future__ import annotations

import numpy as np

_SECRET = bytes.fromhex(
    "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"
)
_WORD, _LONG = np.dtype("<u4"), np.dtype("<u8")


def _secret(at: int, kind: np.dtype = _LONG) -> np.uint64:
    a, b = np.frombuffer(_SECRET, kind, 2, at).astype(np.uint64)
    return a ^ b


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper half of a 128-bit product, xor the lower."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    ll, hl, lh = (a & low) * (b & low), (a >> half) * (b & low), (a & low) * (b >> half)
    middle = (ll >> half) + (hl & low) + lh
    return ((hl >> half) + (middle >> half) + (a >> half) * (b >> half)) ^ (a * b)


def short_hashes(letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of strings that lie one after the other in `letters` up to `ends`, none of them empty; and the numbers of
    those longer than 16 bytes, whose hashes are left to the caller."""
    n = np.diff(ends, prepend=0)
    starts, data = ends - n, np.concatenate([letters, np.zeros(8, np.uint8)])

    def read(at: np.ndarray, kind: np.dtype) -> np.ndarray:
        return np.ndarray((len(data) - kind.itemsize + 1,), kind, data, 0, (1,))[at].astype(np.uint64)

    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n <= 3)
    at, size = starts[some], n[some]
    h = data[at].astype(np.uint64) << np.uint64(16) | data[at + size // 2].astype(np.uint64) << np.uint64(24)
    h = (h | data[at + size - 1].astype(np.uint64) | size.astype(np.uint64) << np.uint64(8)) ^ _secret(0, _WORD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    out[some] = h ^ (h >> np.uint64(32))

    some = np.flatnonzero((n > 3) & (n <= 8))
    at, size = starts[some], n[some]
    h = (read(at + size - 4, _WORD) | read(at, _WORD) << np.uint64(32)) ^ _secret(8)
    h ^= (h << np.uint64(49) | h >> np.uint64(15)) ^ (h << np.uint64(24) | h >> np.uint64(40))
    h *= np.uint64(0x9FB21C651E98DF25)
    h = (h ^ ((h >> np.uint64(35)) + size.astype(np.uint64))) * np.uint64(0x9FB21C651E98DF25)
    out[some] = h ^ (h >> np.uint64(28))

    some = np.flatnonzero((n > 8) & (n <= 16))
    at, size = starts[some], n[some]
    low, high = read(at, _LONG) ^ _secret(24), read(at + size - 8, _LONG) ^ _secret(40)
    h = size.astype(np.uint64) + low.byteswap() + high + _fold(low, high)
    h = (h ^ (h >> np.uint64(37))) * np.uint64(0x165667919E3779F9)
    out[some] = h ^ (h >> np.uint64(32))
    return out, np.flatnonzero(n > 16)
