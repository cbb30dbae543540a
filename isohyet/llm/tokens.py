"""Words, shingles and their hashes for whole Arrow batches of texts, in numpy.

A chunk of texts is one byte array. Each byte maps to a random number, a prefix sum of these times powers of an odd
base gives the hash of any byte range in constant time (modulo 2^64), and a finaliser spreads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are handled together; a longer text is handled alone.
CHUNK = 1 << 20
BASE = pow(0x9E3779B97F4A7C15 | 1, 1, 1 << 64)
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits parts words.
PUNCT = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])
#: Classes of bytes: upper case, lower case and beyond ASCII, digits; other bytes stand for themselves.
SHAPE = np.array([65 if 65 <= x < 91 else 97 if 97 <= x < 123 or x >= 128 else 48 if 48 <= x < 58 else x for x in range(256)], np.uint8)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Words(NamedTuple):
    hash: np.ndarray  # of each word
    doc: np.ndarray  # index of its text in the chunk
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray  # the chunk's bytes


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of texts; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, table: np.ndarray | None = LOWER) -> Words:
    """The words of a chunk; table maps bytes before they are hashed."""
    n = len(data)
    part = np.ones(n + 2, bool)
    part[1:-1] = separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inner = ~part[1:-1]
    start = np.flatnonzero(inner & (part[:-2] | edge[:-1]))
    end = np.flatnonzero(inner & (part[2:] | edge[1:])) + 1
    b = data if table is None else table[data]
    return Words(span_hash(_TABLE[b], start, end), np.searchsorted(offsets, start, "right") - 1, start, end, b)


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


#: The five primes of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer ranges are hashed one by one.
RANGE = 4096


def rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of byte ranges, step by step for all at once; data has 8 spare bytes at its end."""
    size = end - start
    out = np.empty(len(start), np.uint64)
    long = size > RANGE
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    if long.any():
        short = np.flatnonzero(~long)
        out[short] = xxh64(data, start[short], end[short], seed)
        return out
    data = np.ascontiguousarray(data)
    word8 = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    word4 = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    lane = lambda at: rotated(word8[at] * P2, 31) * P1
    h, at = np.full(len(start), (seed + int(P5)) % (1 << 64), np.uint64), start.copy()
    wide = np.flatnonzero(size >= 32)
    if len(wide):
        v = [np.full(len(wide), x % (1 << 64), np.uint64) for x in (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))]
        for k in range(int(size.max()) // 32):
            i = np.flatnonzero(size[wide] >= 32 * (k + 1))
            for j in range(4):
                v[j][i] = rotated(v[j][i] + word8[at[wide[i]] + 8 * j] * P2, 31) * P1
            at[wide[i]] += 32
        whole = rotated(v[0], 1) + rotated(v[1], 7) + rotated(v[2], 12) + rotated(v[3], 18)
        for x in v:
            whole = (whole ^ (rotated(x * P2, 31) * P1)) * P1 + P4
        h[wide] = whole
    h += size.astype(np.uint64)
    for _ in range(3):
        i = np.flatnonzero(end - at >= 8)
        h[i] = rotated(h[i] ^ lane(at[i]), 27) * P1 + P4
        at[i] += 8
    i = np.flatnonzero(end - at >= 4)
    h[i] = rotated(h[i] ^ (word4[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
    at[i] += 4
    for _ in range(3):
        i = np.flatnonzero(end > at)
        h[i] = rotated(h[i] ^ (data[at[i]].astype(np.uint64) * P5), 11) * P1
        at[i] += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def shapes(w: Words, raw: np.ndarray) -> np.ndarray:
    """Hash of each word's run of byte classes, equal neighbours once."""
    c = SHAPE[raw]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    new[w.start] = True
    at = np.cumsum(new) - 1
    runs = np.flatnonzero(new)
    return span_hash(_TABLE[c[runs]], at[w.start], at[w.end - 1] + 1) if len(w.start) else np.zeros(0, np.uint64)


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words in one text, and where each starts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9FB21C651E98DF25) + h[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(total[at]), at
