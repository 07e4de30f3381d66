"""Vectorised word identities and window hashes over whole Arrow batches.

A word of up to 15 bytes is its own bytes and length, 16 bytes in all, and a longer one its 120-bit BLAKE2b digest. A keyed
three-round Feistel network, which is a bijection, spreads these 128 bits over two lanes of 64: different words of up
to 15 bytes never have the same two lanes, and longer ones only if BLAKE2b collides. A window's hash is a polynomial over one
lane of its words, from running sums, so that its cost does not depend on the window's length.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD_BASE, SECOND_BASE = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Round keys of word identities where a caller gives none.
KEYS = (0x9E3779B97F4A7C15, 0x8F14E45FCEEA167A, 0x1B873593CC9E2D51)
#: Bytes that a word holds beside its length.
SHORT = 15
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to 2**bits."""
    n, out = (1 << bits) + 1, []
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.full(n, b, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(16, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def word_lanes(data: bytes, starts: np.ndarray, ends: np.ndarray, keys: tuple[int, int, int] = KEYS) -> tuple[np.ndarray, np.ndarray]:
    """The two lanes of each word of ``data``."""
    padded = np.frombuffer(data + bytes(16), dtype=np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(data) + 9,), strides=(1,), writeable=False)
    size = ends - starts
    low = eight[starts] & _LOW[np.minimum(size, 8)]
    high = eight[starts + 8] & _LOW[np.clip(size - 8, 0, SHORT - 8)]
    high |= np.minimum(size, SHORT + 1).astype(np.uint64) << np.uint64(56)
    for k in np.flatnonzero(size > SHORT).tolist():
        d = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=SHORT).digest()
        low[k], high[k] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | (SHORT + 1) << 56
    a, b, c = map(np.uint64, keys)
    low ^= mix(high ^ a)
    high ^= mix(low ^ b)
    low ^= mix(high ^ c)
    return low, high


def window_hashes(words: np.ndarray, length: int, base: int = WORD_BASE) -> np.ndarray:
    """The hash of each run of ``length`` words, by its first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    power, inverse = powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[length:] - total[:n]) * inverse[:n])


class Batch:
    """The words of several texts: ``hashes`` and ``second`` are the lanes of all words, ``first[i]:first[i+1]`` those of text i."""

    def __init__(self, texts: list[bytes], keys: tuple[int, int, int] = KEYS):
        data = b"\n".join(texts)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        starts, ends = word_bounds(np.frombuffer(data, dtype=np.uint8))
        self.first = np.searchsorted(starts, offsets)
        self.hashes, self.second = word_lanes(data, starts, ends, keys)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def inside(self, length: int) -> np.ndarray:
        """Whether the window that starts at each word ends in the same text."""
        n = max(0, len(self.owner) - length + 1)
        return self.owner[:n] == self.owner[length - 1 :][:n]


def slices(texts: list[bytes], limit: int = 1 << 20):
    """Ranges of texts with about ``limit`` bytes, at least one text each."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
