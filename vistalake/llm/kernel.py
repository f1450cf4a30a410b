"""Whole Arrow batches of texts as byte arrays: words, and hashes of any stretch of bytes.

A text is taken as its UTF-8 bytes; a null text is empty. Words are maximal stretches without the six white-space
characters of ASCII.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the polynomial hashes, modulo 2^64. Fixed values.
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes of a word beyond which it is hashed alone.
LONG_WORD = 512
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Hash values of the bytes as they are, and with A-Z as a-z.
EXACT, FOLDED = _VALUES, _VALUES[LOWER]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text stands alone."""
    _, offsets = as_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1)
        yield batch.slice(at, end - at)
        at = end


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and the offsets of the texts."""
    big = column.cast(pa.large_binary())
    if big.null_count:
        big = big.fill_null(b"")
    _, off, data = big.buffers()
    offsets = np.frombuffer(off, np.int64)[big.offset : big.offset + len(big) + 1] if len(big) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of each word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # no word spans two texts
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, ink[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, ink[1:]
    first = np.flatnonzero(ink & (~before | edge[:-1]))
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return first, end, np.searchsorted(offsets, first, "right") - 1


@functools.lru_cache(maxsize=8)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    return tuple(p[:n] for p in _powers(size, base))  # type: ignore[return-value]


def prefix(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of values[i] * base^i; difference() takes the hash of any stretch from them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1, base)[0][:-1], out=out[1:])
    return out


def stretch(sums: np.ndarray, first: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of the stretches [first, end): equal for equal values, wherever they stand."""
    return (sums[end] - sums[first]) * powers(len(sums), base)[1][first]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all of its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of each word, of 64 bits. Long words get a cryptographic one: modulo 2^64 some words of 1,024 letters are equal under every multiplier."""
    if not len(first):
        return np.zeros(0, np.uint64)
    out = mixed(stretch(prefix(values[data]), first, end) + (end - first).astype(np.uint64))
    for i in np.flatnonzero(end - first > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(values[data[first[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    return out
