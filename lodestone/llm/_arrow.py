"""Numpy views of Arrow text batches and vectorised word hashing.

Operators of this subpackage run in ``mapInArrow``: a batch is cut into slices
of bounded bytes (a longer text is a slice of its own) and handled as one byte
array with document offsets, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 2 << 20

#: ASCII lower-casing of bytes; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def worker_path(spark) -> None:
    """Let Python workers import this package when it lies beside the driver's code only on ``sys.path``."""
    import os
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in held.split(os.pathsep):
        env["PYTHONPATH"] = root + (os.pathsep + held if held else "")


#: Bytes of an Arrow batch between the JVM and Python, unless the session asks for fewer.
BATCH_BYTES = 4 << 20


def bound_batches(spark) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(text: str) -> int:
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    digits = text.lower().rstrip("b")
    return int(digits[:-1]) << units[digits[-1]] if digits[-1:] in units else int(digits or 0)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    worker_path(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back to the system: a worker's arrays would else stay with it from one task to the next."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        data, offsets = view(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of true bytes within documents."""
    n = len(inside)
    if not n:
        return (np.empty(0, np.int64),) * 3
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = offsets[:-1]
    before[first[first < n]] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, document_of(starts, offsets)


def document_of(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The document number of each of the ascending places."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(places, offsets)))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Spans longer than this are hashed and compared one by one, as bytes.
LONG = 1024
_KEEP = np.array([(1 << 8 * r) - 1 for r in range(9)], np.uint64)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


class Hasher:
    """64-bit hashes of any substrings of a byte array.

    A chain of splitmix64 over words of 8 bytes, begun with the length; long
    spans take BLAKE2.  It is not linear, so no rule makes unlike texts agree,
    but equal hashes prove nothing: ``distinct_spans`` and ``same_spans``
    compare the bytes.
    """

    def __init__(self, data: np.ndarray):
        self.data, self.words = data, words_at(data)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if len(size):
            h = mix(h ^ (self.words[starts] & _KEEP[np.minimum(size, 8)]))
        live, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(live):
            h[live] = mix(h[live] ^ (self.words[starts[live] + at] & _KEEP[np.minimum(size[live] - at, 8)]))
            at += 8
            live = live[size[live] > at]
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return h

    def windows(self, width: int) -> np.ndarray:
        """Hashes of the ``width`` bytes, a multiple of 8, from each byte on."""
        n = len(self.data) - width + 1
        h = np.full(n, np.uint64(width * 0x9E3779B97F4A7C15 % 2**64))
        for k in range(0, width, 8):
            h = mix(h ^ self.words[k : k + n])
        return h


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span of ``a`` are those of the span of ``b`` of the same length."""
    x = words_at(a)
    y = x if a is b else words_at(b)
    out = ((x[a_starts] ^ y[b_starts]) & _KEEP[np.minimum(size, 8)]) == 0
    live, at = np.flatnonzero(out & (size > 8) & (size <= LONG)), 8
    while len(live):
        same = ((x[a_starts[live] + at] ^ y[b_starts[live] + at]) & _KEEP[np.minimum(size[live] - at, 8)]) == 0
        out[live[~same]] = False
        at += 8
        live = live[same]
        live = live[size[live] > at]
    for i in np.flatnonzero(out & (size > LONG)).tolist():
        out[i] = np.array_equal(a[a_starts[i] : a_starts[i] + size[i]], b[b_starts[i] : b_starts[i] + size[i]])
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one, which): a span of each distinct text, and for each span the number of its text.

    Spans are grouped by hash and compared by bytes; where unlike texts share a
    hash, the later ones get numbers of their own at the end.
    """
    h = Hasher(data)(starts, ends) if hashes is None else hashes
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    size = ends - starts
    first = one[which]
    apart = np.flatnonzero((size != size[first]) | ~same_spans(data, starts, data, starts[first], np.minimum(size, size[first])))
    if len(apart):
        own: dict[bytes, int] = {}
        more: list[int] = []
        for i in apart.tolist():
            text = data[starts[i] : ends[i]].tobytes()
            if text not in own:
                own[text] = len(one) + len(more)
                more.append(i)
            which[i] = own[text]
        one = np.append(one, more)
    return one, which


def hash_strings(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(words) else np.empty(0, np.int64)
    return Hasher(np.frombuffer(b"".join(words), np.uint8))(starts, ends)


def slices_by(counts: np.ndarray) -> np.ndarray:
    """Offsets from counts."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, count), joined."""
    offsets = slices_by(counts)
    return np.repeat(starts - offsets[:-1], counts) + np.arange(offsets[-1])


def hex_digests(digests: list[str]) -> pa.Array:
    return pa.array(digests, pa.string())


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values data[bounds[i]:bounds[i + 1]]."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * width, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
