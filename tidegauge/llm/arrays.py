"""Numpy helpers for columns of texts inside a task."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(_STEP) + U(seed))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    up, down = np.full(n + 1, base, U), np.full(n + 1, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


_BYTE = seeded(256, 77) | U(1)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; A-Z lower-cased."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return _FOLD[data], offs - offs[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Runs of documents (first, stop) of about ``size`` bytes; a larger document is a run of its own."""
    first = 0
    while first < len(offsets) - 1:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, stop
        first = stop


def pieces(batch: pa.RecordBatch, column: str, size: int = CHUNK):
    """A batch cut by rows into pieces of about ``size`` bytes of the column, to bound what a task holds."""
    sizes = pa.compute.binary_length(batch[column]).to_numpy(zero_copy_only=False)
    for a, b in chunks(np.r_[0, np.cumsum(sizes)].astype(np.int64), size):
        yield batch.slice(a, b - a)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every word, in order. Words are runs of bytes other than ASCII white space."""
    hashes, owners = [], []
    for a, b in chunks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        part, n = data[lo:hi], hi - lo
        if not n:
            continue
        up, down = _powers(1 << max(21, (n - 1).bit_length()))
        first = np.zeros(n + 1, bool)
        first[offsets[a : b + 1] - lo] = True
        space = np.ones(n + 2, bool)
        space[1:-1] = _SPACE[part]
        word = ~space[1:-1]
        starts = np.flatnonzero(word & (space[:-2] | first[:-1]))
        ends = np.flatnonzero(word & (space[2:] | first[1:])) + 1
        total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[part] * up[:n], out=total[1:])
        hashes.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U)))
        owners.append(np.searchsorted(offsets[a : b + 1] - lo, starts, side="right") - 1 + a)
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def word_ngrams(hashes: np.ndarray, owners: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, position of the first word) of every window of k words inside a document. With ``short``, a
    document of 1 to k - 1 words gives one shorter window of all its words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    sizes = np.diff(np.r_[heads, n])
    at = np.arange(n) - np.repeat(heads, sizes)
    left = np.repeat(sizes, sizes) - at
    acc = np.zeros(n, U)
    for j in range(min(k, n)):
        seen = hashes[j:] if j else hashes
        inside = left[: n - j] > j
        acc[: n - j] = np.where(inside, mix(acc[: n - j] * U(_STEP) + seen), acc[: n - j])
    keep = (left >= k) | ((at == 0) if short else False)
    return acc[keep], owners[keep], at[keep]


def _pack(low: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.zeros((len(data) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return raw.view("<u8").ravel()


def pack5(low: np.ndarray) -> bytes:
    """40-bit numbers as 5 bytes each."""
    return _pack(low, 5)


def unpack5(data: bytes) -> np.ndarray:
    return _unpack(data, 5)
