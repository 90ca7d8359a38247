"""Words, shingles and 64-bit hashes of whole texts, vectorised over Arrow buffers.

A word is a run of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. Word hashes are computed from the
UTF-8 bytes of a whole batch at once (a random table times powers of an odd number, summed per
word, then mixed), so no Python string is made per word. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SLICE_BYTES = 2 << 20  # texts are hashed in slices of about this size; it bounds temporary arrays

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[SPACE] = 0
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z as a-z
_POWER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seed(*parts: int) -> np.uint64:
    """A 64-bit constant that depends on all ``parts``."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = mix(h * _POWER + np.uint64(p % 2**64) + np.uint64(1))
    return h[0]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n+1 offsets of the texts in them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def word_hashes(data: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the n+1 offsets of the texts in that list.

    ``fold``: A-Z count as a-z.
    """
    table = _FOLDED if fold else _BYTE
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = off[:-1][off[:-1] < off[1:]]
    first[begin] = inside[begin]  # a text's first byte starts a word whatever stands before it
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, off)
    out = np.empty(len(starts), np.uint64)
    edges = np.append(starts, len(data))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, edges[a] + (1 << 20))))
        lens = np.diff(edges[a: b + 1])
        piece = table[data[edges[a]: edges[b]]]
        at = np.arange(len(piece)) - np.repeat(edges[a:b] - edges[a], lens)
        powers = np.cumprod(np.full(int(lens.max()), _POWER, np.uint64))
        out[a:b] = np.add.reduceat(piece * powers[at], edges[a:b] - edges[a])
        a = b
    return mix(out), bounds


_GRAM_FACTOR = _rng.integers(1, 2**31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
GRAM = _rng.integers(1, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def byte_grams(data: np.ndarray, off: np.ndarray, n: int, space: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``bits`` bits of every run of n bytes of one text, with the n+1 offsets of the texts.

    ``space`` marks the 256 bytes that count as white space; it may stand at both ends of a run
    (where it marks the border of a word), not inside.
    """
    code = np.where(space, GRAM[32], GRAM)[data]
    blank = space[data]
    m = max(0, len(data) - n + 1)
    ok = np.ones(m, bool)
    for j in range(1, n - 1):
        ok &= ~blank[j: j + m]
    if n <= 2:
        ok &= ~(blank[:m] & blank[n - 1: n - 1 + m])
    for cut in np.unique(off[1:-1]):
        ok[max(0, cut - n + 1): cut] = False
    h = np.full(m, n * 40503, np.uint32)
    for j in range(n):
        h += code[j: j + m] * _GRAM_FACTOR[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(ok)
    return (h[at] >> np.uint32(32 - bits)).astype(np.int32), np.searchsorted(at, off)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words; a text with 1 to k-1 words gives its whole sequence.

    Returns the hashes (repeats included) and the n+1 offsets of the texts in them.
    """
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    off = np.concatenate([[0], np.cumsum(counts)])
    full = np.flatnonzero(n >= k)
    out = np.empty(int(off[-1]), np.uint64)
    if len(full):
        c = counts[full]
        at = np.arange(int(c.sum())) - np.repeat(np.concatenate([[0], np.cumsum(c)[:-1]]), c)
        w = np.repeat(bounds[full], c) + at
        h = mix(words[w] + seed(k))
        for j in range(1, k):
            h = mix(h * _POWER + words[w + j])
        out[np.repeat(off[full], c) + at] = h
    for i in np.flatnonzero((n > 0) & (n < k)):
        h = np.zeros(1, np.uint64) + seed(int(n[i]), 77)
        for w in words[bounds[i]: bounds[i + 1]]:
            h = mix(h * _POWER + w)
        out[off[i]] = h[0]
    return out, off


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, as a flat array and n+1 offsets."""
    h, so = shingle_hashes(*word_hashes(data, off), k)
    sets = [np.unique(h[so[i]: so[i + 1]]) for i in range(len(so) - 1)]
    return (np.concatenate(sets) if sets else h), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of ``batch`` with about 2 MB of text each (one row at least), with bytes and offsets."""
    if not batch.num_rows:
        return
    data, off = utf8(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + _SLICE_BYTES, "right")) - 1)
        yield batch.slice(a, b - a), data[off[a]: off[b]], off[a: b + 1] - off[a]
        a = b


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum (modulo 2^64) of each segment; an empty one gives 0."""
    out = np.zeros(len(off) - 1, values.dtype)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full])
    return out


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's signed long, bit for bit."""
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))
