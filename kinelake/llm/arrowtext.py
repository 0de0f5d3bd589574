"""Arrow and NumPy helpers for whole texts, used inside mapInArrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once inside a worker; one longer text is handled alone.
SLICE_BYTES = 1 << 20


def texts(column: pa.Array) -> pa.Array:
    """The column as strings, NULL as the empty text."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the n + 1 offsets into them."""
    _, ends, data = array.buffers()
    if len(array) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of `buffers`."""
    ends = pa.py_buffer(np.ascontiguousarray(offsets, np.int32))
    return pa.StringArray.from_buffers(len(offsets) - 1, ends, pa.py_buffer(np.ascontiguousarray(raw)))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        i = 0
        while i < n:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()  # the worker process stays for other tasks


def words(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of bytes other than space and \\t-\\r), and the n + 1 bounds of each text's."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(array))
    found, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    blank = pc.equal(pc.binary_length(found), 0)
    if pc.any(blank).as_py():  # an empty text splits into one empty word
        keep = pc.invert(blank)
        before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
        found, ends = found.filter(keep), before[ends]
    return found, ends


def coded(found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as indices into their distinct values."""
    d = found.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, zero for empty runs."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each element, the run that it is in."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def count_distinct(codes: np.ndarray, bounds: np.ndarray, n_codes: int) -> np.ndarray:
    """Distinct codes of each run."""
    keys = np.unique(row_of(bounds) * max(n_codes, 1) + codes)
    return np.bincount(keys // max(n_codes, 1), minlength=len(bounds) - 1)


def _alnum_bytes() -> np.ndarray:
    """Each byte lower-cased if it is a letter, digit or beyond ASCII, else a space."""
    lut = np.full(256, 32, np.uint8)
    lut[48:58] = np.arange(48, 58)
    lut[97:123] = np.arange(97, 123)
    lut[65:91] = np.arange(97, 123)
    lut[128:] = np.arange(128, 256)
    return lut


_ALNUM = _alnum_bytes()


def alnum_words(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of letters, digits and bytes beyond ASCII, A-Z lower-cased, and their bounds."""
    raw, offsets = buffers(array)
    return words(strings(_ALNUM[raw], offsets))


def hashed(found: pa.Array) -> np.ndarray:
    """XXH64 (seed 42) of each word."""
    codes, values = coded(found)
    hashes = np.array([xxhash.xxh64_intdigest(x, seed=42) for x in values.cast(pa.binary()).to_pylist()], np.uint64)
    return hashes[codes] if len(codes) else hashes
