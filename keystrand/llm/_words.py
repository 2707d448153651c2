"""Vectorised word kernel over Arrow string arrays.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes, with A-Z folded to lower case.  Everything
works on the UTF-8 buffer of a whole chunk of texts: classification, run boundaries and 64-bit polynomial hashes come
from a handful of NumPy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = np.arange(256)
_FOLD = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE)
_IN_WORD = ((_FOLD >= 97) & (_FOLD <= 122)) | ((_BYTE >= 48) & (_BYTE <= 57)) | (_BYTE >= 128)
_VALUE = mix(_FOLD.astype(U) + U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, U)
        have[0] = 1
        k = 1
        with np.errstate(over="ignore"):
            while k < size:
                have[k : 2 * k] = have[:k] * U(pow(base, k, 1 << 64))
                k *= 2
        _powers[base] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: entry i covers the first i values."""
    out = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of values[start:end]."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start] + U(1))


@dataclass
class Words:
    hash: np.ndarray  # one 64-bit hash a word
    doc: np.ndarray  # text number of each word
    first: np.ndarray  # word number where each text begins; one more entry than texts


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n+1 offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(texts: pa.Array) -> Words:
    raw, at = buffers(texts)
    n = len(raw)
    if not n:
        return Words(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    inside = _IN_WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    h = span(prefix(_VALUE[raw]), s, e)
    first = np.searchsorted(s, at)
    return Words(h, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their text numbers; a text of 1 to k-1 words is one shingle."""
    sums = prefix(words.hash)
    count = np.diff(words.first)
    each = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), each)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    start = words.first[doc] + inner
    return span(sums, start, np.minimum(start + k, words.first[doc + 1])), doc


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` text bytes; a longer text is a slice by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
