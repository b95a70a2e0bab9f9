"""Vectorised word handling over Arrow batches, shared by the operators that run in Python.

Texts are taken whole. A batch is cut into slices of a few MB, so a worker's
memory depends on the longest single text and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, unless one text alone is longer.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of each slice come to ``limit`` bytes or one text."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    # What the slices needed goes back to the system before the next batch comes.
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The texts, with null as empty and 64-bit offsets, copied to an array without offset:
    pyarrow's ascii_lower garbles some arrays that are slices of others."""
    own = batch.column(text).take(pa.array(np.arange(batch.num_rows)))
    return pc.fill_null(own.cast(pa.large_string()), "")


def pure(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of each text (runs of characters other than ASCII white space) as a flat
    array, and the offsets of each text's words in it."""
    lists = pc.ascii_split_whitespace(strings)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    if empty.any():
        keep = ~empty
        flat, owner = flat.filter(pa.array(keep)), owner[keep]
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(counts)), out=offsets[1:])
    return flat, offsets


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words, and the distinct words they stand for."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public SplitMix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


#: Odd multipliers for the places of a window.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes; run i starts at word i."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out * _PLACES[0] + h[k : k + n] * _PLACES[k % 8] + np.uint64(k))
    return out


def per_text_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each text; texts without words get 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
