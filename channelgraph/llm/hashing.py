"""Vectorised hashes of stretches of bytes: words, shingles, windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.cumprod(np.full(n - 1, base, dtype=np.uint64))
    return out


def digests(items: pa.Array | list) -> np.ndarray:
    """A 64-bit hash of each byte string, without the arithmetic by which patterned strings cancel in sums of powers."""
    values = items.to_pylist() if isinstance(items, pa.Array) else items
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), dtype=np.uint64, count=len(values))


class Stretches:
    """Prefix sums of a byte array, from which the hash of any stretch [a, b) follows.

    Different hashes prove different bytes. Equal ones do not prove equal bytes where an adversary has chosen them.
    """

    def __init__(self, data: np.ndarray, salt: int = 0):
        base = (_BASE + 8 * salt) % 2**64
        self._down = _powers(len(data) + 1, pow(base, -1, 2**64))
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * _powers(len(data), base), out=self._sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self._sums[b] - self._sums[a]) * self._down[a] + (b - a).astype(np.uint64))

    def fixed(self, width: int) -> np.ndarray:
        """The hashes of all stretches of one width."""
        return mixed((self._sums[width:] - self._sums[:-width]) * self._down[: len(self._sums) - width])


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def numbered_words(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words (binary) of texts put end to end, the number of each word, and the words before each text's end."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    apart = np.ones(len(data), dtype=bool)
    apart[1:] = ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(inside & apart)
    held = np.cumsum(inside)
    offsets = np.append(held[starts] - 1, held[-1] if len(held) else 0).astype(np.int32)
    values = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.searchsorted(starts, ends)
