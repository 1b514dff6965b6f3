"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens on whole arrays.  A minimal perfect hash over
the vocabulary resolves the pre-tokens that are tokens themselves, which their
bytes confirm; the others are merged by a heap over linked bytes, once per
distinct pre-token and worker memory.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm._arrow import Hasher, binaries, distinct_spans, hash_strings, map_arrow, mix, same_spans, slices_by, spread, text_slices

#: Bytes of text handled at once, and pre-tokens remembered by a worker.
SLICE, MEMORY = 2 << 20, 300_000
LETTER, NUMBER, OTHER, WHITE, BLANK = range(5)
#: The code points of Unicode's White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of each code point as the split pattern sees it."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    out[WHITE_SPACE] = WHITE
    out[0x20] = BLANK
    return out


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and code points of the characters of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    if len(wide):
        p, lead = at[wide], code[wide]
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in (1, 2, 3):
            more = size > k
            value[more] = (value[more] << 6) | (data[p[more] + k] & 0x3F)
        code[wide] = value
    return at, code


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a match of the split pattern begins.

    Equal to the matches of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
    ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` in each document.
    """
    at, code = characters(data)
    n = len(at)
    if not n:
        return at
    kind = char_classes()[code]
    group = np.minimum(kind, WHITE)
    begins = np.zeros(n + 1, bool)
    begins[np.searchsorted(at, offsets)] = True  # of a document, and the end
    fresh = begins[:-1].copy()
    fresh[1:] |= group[1:] != group[:-1]
    white = group == WHITE
    start = fresh.copy()
    led = np.zeros(n, bool)  # a blank of this document stands before
    led[1:] = (kind[:-1] == BLANK) & ~begins[1:-1]
    start &= white | ~led
    last_white = np.zeros(n, bool)  # before something else in this document
    last_white[:-1] = white[:-1] & ~white[1:] & ~begins[1:-1]
    start |= last_white
    # Contractions: an apostrophe alone in its run that begins a match, then the fixed letters.
    mark = np.flatnonzero((code[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~begins[1:-1])
    if len(mark):
        one = code[mark + 1]
        two = np.where((mark + 2 < n) & ~begins[np.minimum(mark + 2, n)], code[np.minimum(mark + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 2, np.where(long, 3, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + size
        start[after[after < n]] = True
    return at[start]


class PerfectHash:
    """A minimal perfect hash of 64-bit keys: each key's slot is its own, 0 to n - 1.

    Keys fall into buckets; a bucket is given the first displacement that
    sends all its keys to free slots, the largest buckets first.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        self.displacement = np.zeros(self.buckets, np.uint64)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            mine = keys[order[bounds[b] : bounds[b + 1]]]
            if not len(mine):
                break
            tries, width = 0, 16
            while True:
                d = np.arange(tries, tries + width, dtype=np.uint64)
                slots = self._slots(mine[None, :], d[:, None])
                ok = free[slots].all(1)
                if len(mine) > 1:
                    s = np.sort(slots, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(1)
                if ok.any():
                    k = int(ok.argmax())
                    self.displacement[b] = d[k]
                    free[slots[k]] = False
                    break
                tries, width = tries + width, min(4 * width, 1 << 14)
        self.keys = np.zeros(n, np.uint64)
        self.keys[self(keys)] = keys

    def _slots(self, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(keys + d * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self._slots(keys, self.displacement[(keys % np.uint64(self.buckets)).astype(np.int64)])


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.ids = np.array([self.ranks[t] for t in tokens], np.uint32)
        self.table = PerfectHash(h := hash_strings(tokens))
        slot = self.table(h)
        self.id_of_slot = np.zeros(len(tokens), np.uint32)
        self.id_of_slot[slot] = self.ids
        self.size_of_slot = np.zeros(len(tokens), np.int64)
        self.size_of_slot[slot] = [len(t) for t in tokens]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.zeros(int(self.ids.max()) + 1, np.int64)
        size[self.ids] = [len(t) for t in tokens]
        self.size, self.start = size, slices_by(size)[:-1]
        self.memory: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The lowest rank first, the leftmost of equals, by a heap over linked bytes."""
        ranks, n = self.ranks, len(piece)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or right[j] != end:
                continue
            alive[j] = False
            right[i] = end
            if end < n:
                left[end] = i
                if (r := ranks.get(piece[i : right[end]])) is not None:
                    heapq.heappush(heap, (r, i, right[end]))
            if (h := left[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : right[i]]])
            i = right[i]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and the offsets of the documents in them."""
        starts = pre_tokens(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        h = Hasher(data)(starts, ends)
        slot = self.table(h)
        hit = (self.table.keys[slot] == h) & (self.size_of_slot[slot] == ends - starts)
        maybe = np.flatnonzero(hit)
        hit[maybe] = same_spans(data, starts[maybe], self.blob, self.start[self.id_of_slot[slot[maybe]]], (ends - starts)[maybe])
        counts = np.ones(len(starts), np.int64)
        miss = np.flatnonzero(~hit)
        one, which = distinct_spans(data, starts[miss], ends[miss], h[miss])
        memory, flat, sizes = self.memory, [], []
        text = data.tobytes()
        for s, e in zip(starts[miss[one]].tolist(), ends[miss[one]].tolist(), strict=True):
            piece = text[s:e]
            ids = memory.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if len(piece) <= 64:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[piece] = ids
            flat += ids
            sizes.append(len(ids))
        sizes = np.array(sizes, np.int64)
        counts[miss] = sizes[which]
        to = slices_by(counts)
        ids = np.empty(to[-1], np.uint32)
        ids[to[:-1][hit]] = self.id_of_slot[slot[hit]]
        flat = np.array(flat, np.uint32)
        ids[spread(to[miss], counts[miss])] = flat[spread(slices_by(sizes)[:-1][which], counts[miss])]
        return ids, to[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the offset of each id in them."""
        size = self.size[ids]
        return self.blob[spread(self.start[ids], size)], slices_by(size)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None, column: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with ``into``: the ids as little-endian unsigned 32-bit integers in a binary column.

    A null or empty text has no ids; texts of any length are encoded whole;
    repeated rows are encoded alike; a column called ``into`` is replaced.
    ``path`` must be readable on the executors.
    """
    path = path or default_path()
    names = [c for c in docs.columns if c != into]
    from pyspark.sql.types import BinaryType, StructType

    base = docs.select(names)
    schema = StructType([*base.schema.fields]).add(into, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for rows, data, offsets in text_slices(batches, column, SLICE):
            ids, bounds = v.encode(data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns, binaries(ids.astype("<u4"), bounds)], names=[*names, into])

    return map_arrow(base, run, schema)


def decode(frame: DataFrame, path: str | None = None, column: str = "token_ids", into: str = "text") -> DataFrame:
    """``frame`` with ``into``: the text of the ids in ``column``; bytes that are no UTF-8 become U+FFFD; null is empty."""
    path = path or default_path()
    names = [c for c in frame.columns if c != into]
    from pyspark.sql.types import StringType, StructType

    base = frame.select(names)
    schema = StructType([*base.schema.fields]).add(into, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for rows, data, offsets in text_slices(batches, column, SLICE):
            raw, at = v.decode(np.frombuffer(data.tobytes(), "<u4"))
            bounds = at[offsets // 4]
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*names, into])

    return map_arrow(base, run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: the number and digest of its ids, and the digest of the bytes that they decode to."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for rows, data, offsets in text_slices(batches, "text", SLICE):
            ids, bounds = v.encode(data, offsets)
            raw, at = v.decode(ids)
            ids = ids.astype("<u4")
            digest = lambda x, cut: [hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "n_tokens": np.diff(bounds), "ids_sha256": digest(ids, bounds), "decoded_sha256": digest(raw, at[bounds])})

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
