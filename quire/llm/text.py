"""Vectorised tokenising of Arrow string columns: bytes in, 64-bit token hashes out.

No Python string is made per word. A block is a run of whole documents; token hashes are polynomial
hashes over the token's UTF-8 bytes, taken from one running sum per block, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


@lru_cache(1)
def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(_MUL))
    values[65:91] = values[97:123]  # A-Z count as a-z
    return values


#: Bytes that are hashed at a time; a token longer than that is a span of its own.
SPAN = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_MUL ** i and its inverse for i below n."""
    return _some_powers() if n <= SPAN else _made_powers(n)


@lru_cache(1)
def _some_powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(SPAN)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MUL, _INV):
        p = np.full(n, U64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(8)
def classes(kind: str) -> np.ndarray:
    """Byte classes; 0 is never part of a token.

    ``alnum``: digits, letters and all non-ASCII bytes. ``space``: all but space and \\x09-\\x0D.
    ``cut``: all but space and line feed.
    ``unit``: 1 for non-ASCII bytes, 2 for letters, 3 for digits, 4 for other visible ASCII.
    ``both``: 1 for alnum bytes, 2 for other printable ones; a token is a run of one class.
    """
    b = np.arange(256)
    alnum = ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    if kind == "alnum":
        return alnum.astype(np.uint8)
    if kind == "space":
        return (~blank).astype(np.uint8)
    if kind == "unit":
        letter, digit = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)), (b >= 48) & (b <= 57)
        return np.select([blank | (b < 33) | (b == 127), b >= 128, letter, digit], [0, 1, 2, 3], 4).astype(np.uint8)
    if kind == "cut":
        return ((b != 32) & (b != 10)).astype(np.uint8)
    return np.where(alnum, 1, np.where(b <= 32, 0, 2)).astype(np.uint8)


def column_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, most: int = 1 << 20, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole documents of about ``most`` bytes and at most ``rows`` documents; a longer document is a run of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


def tokens(data: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all tokens, and for each document the index of its first token (n+1 long)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    c = classes(kind)[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:n])
    edge[offs] = True
    at = np.flatnonzero(edge)
    keep = c[at[:-1]] != 0
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each token, the same for A-Z and a-z. starts ascend."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        out[i:j] = _span_hashes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data))
    sums = _byte_values()[data]
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    h = sums[ends - 1]
    before = sums[np.maximum(starts - 1, 0)]
    before[starts == 0] = 0
    h -= before
    h *= down[starts]
    h += (ends - starts).astype(U64)
    return mix(h)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values over each document's tokens."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def doc_index(first: np.ndarray) -> np.ndarray:
    """The document's index for each token."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
