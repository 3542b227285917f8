"""Vectorised byte hashing shared by the text operators of this subpackage.

Everything here is a small numpy helper that works on the bytes of one piece
of text inside a Spark task. Hashes are polynomial over random byte values
modulo 2**64, so the hash of any substring comes from two prefix sums. Where
equal hashes stand for equal strings (names), a second hash modulo a prime is
mixed in: modulo a power of two some strings of two letters always collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once. It bounds the memory of a Python worker (about 100
#: bytes of numpy arrays per byte); it changes no result.
BLOCK_BYTES = 1 << 18

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Random 64-bit value of each byte (fixed seed: hashes agree between tasks).
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n, modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            out = np.ones(size, dtype=np.uint64)
            out[1:] = np.uint64(base)
            _powers[key] = np.multiply.accumulate(out)
    return _powers["p"][:n], _powers["q"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """out[i] = sum of value(data[j]) * B**j for j < i."""
    p, _ = powers(len(data))
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUES[data] * p, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end of each span, whatever its place."""
    _, q = powers(len(sums))
    return (sums[end] - sums[start]) * q[start]


#: Field of the second hash: products of two elements fit into 64 bits.
PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASE = 1_948_211_367
PRIME_VALUES = np.random.default_rng(20240301).integers(1, (1 << 31) - 1, 256, dtype=np.uint64)


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """C**i and C**-i for i < n, modulo PRIME."""
    if "c" not in _powers or len(_powers["c"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("c", _PRIME_BASE), ("d", pow(_PRIME_BASE, -1, int(PRIME)))):
            out = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:
                out[done:2 * done] = out[:done] * np.uint64(pow(base, done, int(PRIME))) % PRIME
                done *= 2
            _powers[key] = out
    return _powers["c"][:n], _powers["d"][:n]


def prime_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the second hash."""
    c, _ = prime_powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(PRIME_VALUES[data] * c % PRIME, out=out[1:])
    return out % PRIME


def span_names(sums: np.ndarray, primes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of the bytes start..end of each span, from both hashes."""
    _, d = prime_powers(len(primes))
    second = (primes[end] + PRIME - primes[start]) % PRIME * d[start] % PRIME
    return span_hashes(sums, start, end) ^ mix(second + np.uint64(1))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: spreads a 64-bit hash over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def text_groups(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows [i, j) of at most ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
