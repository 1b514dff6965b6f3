"""Removal of long repeated passages by longest-previous-factor arrays.

A byte goes if a 50-byte string that covers it also starts in a document of
smaller doc_id.  Equal strings share their minimizer (the least hash of their
16-byte pieces), so strings are compared only around minimizers that several
documents have:

1. documents are packed into slices, a table that later steps read in place;
2. slices send their distinct minimizer hashes to hash partitions, which
   answer with a bit for each that another slice has too;
3. slices send the distinct segments around shared minimizers, once each
   whatever the number of documents that hold it;
4. each partition keeps segments of equal bytes once, sorts the suffixes (to
   50 bytes) that may occur in several, and takes, for every suffix, the
   previous and next one of a smaller document in suffix order with their
   common prefixes: if the longer one, the longest previous factor, reaches 50,
   the position has an earlier match;
5. slices cover the marked strings and cut them out.

Hashes only choose what is compared: equal segments and equal strings are
settled by their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._arrow import Hasher, distinct_spans, map_arrow, mix, release, slices_by, spread, text_slices
from lodestone.llm._shared import removed_at_end, written

#: Bytes of text in a slice; its compressed row stays below the size from which a JVM keeps objects apart.
PACK_BYTES = 1 << 20
LENGTH, PIECE = 50, 16
SPAN = LENGTH - PIECE + 1


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each ``width`` neighbours."""
    y, s = x, 1
    while 2 * s <= width:
        y = f(y[:-s], y[s:])
        s *= 2
    return f(y[: len(y) - (width - s)], y[width - s :]) if width > s else y


class Anchors:
    """Minimizers of a slice: their places, hashes and distinct hashes, and the strings that each stands for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        if n < LENGTH:
            self.at = np.empty(0, np.int64)
            self.distinct, self.which = np.empty(0, np.uint64), np.empty(0, np.int64)
            self.doc, self.inside = self.at, np.empty(0, bool)
            return
        self.h = Hasher(data).windows(PIECE)
        least = slide(self.h, SPAN, np.minimum)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.int32)
        self.inside = doc[: len(least)] == doc[LENGTH - 1 : LENGTH - 1 + len(least)]
        self.least = np.where(self.inside, least, 0)
        edge = np.zeros(SPAN - 1, np.uint64)
        self.at = np.flatnonzero(slide(np.concatenate((edge, self.least, edge)), SPAN, np.maximum) == self.h)
        self.doc = doc[self.at]
        # Least hashes crowd at small values: partitions take a mixture of them.
        self.distinct, self.which = np.unique(mix(self.h[self.at] ^ np.uint64(0xD6E8FEB86659FD93)), return_inverse=True)

    def repeated_here(self, ids: np.ndarray) -> np.ndarray:
        """For each distinct hash, whether documents of several ids of this slice have it."""
        low, high = np.full(len(self.distinct), 2**63 - 1), np.full(len(self.distinct), -(2**63))
        mine = ids[self.doc]
        np.minimum.at(low, self.which, mine)
        np.maximum.at(high, self.which, mine)
        return low < high

    def parts(self, parts: int) -> np.ndarray:
        """Bounds of the hash partitions among the distinct hashes."""
        step = np.uint64(2**64 // parts + 1)
        return np.searchsorted(self.distinct // step, np.arange(parts + 1, dtype=np.uint64))

    def segments(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hash, first string, number of strings, document) for each place of a shared hash: the strings of which it is the leftmost minimizer."""
        use = shared[self.which]
        begin = np.flatnonzero(self.inside)
        if not use.any() or not len(begin):
            return (np.empty(0, np.int64),) * 4
        k = np.searchsorted(self.at, begin)
        todo = np.flatnonzero(self.h[self.at[np.minimum(k, len(self.at) - 1)]] != self.least[begin])
        while len(todo):
            k[todo] += 1
            todo = todo[self.h[self.at[k[todo]]] != self.least[begin[todo]]]
        of = use[k]
        begin, k = begin[of], k[of]
        new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (begin[1:] != begin[:-1] + 1)))
        return self.which[k[new]], begin[new], np.diff(np.append(new, len(k))), self.doc[k[new]]


def _pack(keys: np.ndarray):
    """Slices, numbered by their task; ``keys`` has a number for each bucket that falls into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn, bucket = divmod(TaskContext.get().partitionId(), len(keys))
        k = turn << 20
        for rows, data, offsets in text_slices(batches, limit=PACK_BYTES):
            ids = rows.column(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[bucket]], pa.int32()), pa.array([k], pa.int32()), pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([np.asarray(ids.is_null()).astype("u1").tobytes()], pa.binary()), pa.array([offsets.astype("<i8").tobytes()], pa.binary()), pa.array([_squeeze(data.tobytes())], pa.binary())],
                names=["task", "slice", "ids", "no_id", "offsets", "text"],
            )
            k += 1

    return run


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether they are null, offsets and bytes; a document without id is taken for itself only."""
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["no_id"], "u1").astype(bool), np.frombuffer(row["offsets"], "<i8"), np.frombuffer(_unsqueeze(row["text"]), np.uint8)


def _anchors(row: dict) -> tuple[Anchors, np.ndarray, np.ndarray]:
    ids, no_id, offsets, data = _open(row)
    if no_id.any():  # such documents neither match nor are matched
        keep = ~np.repeat(no_id, np.diff(offsets))
        sizes = np.where(no_id, 0, np.diff(offsets))
        return Anchors(data[keep], slices_by(sizes)), ids, np.flatnonzero(keep)
    return Anchors(data, offsets), ids, None


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, _, _ = _anchors(row)
                cut = a.parts(parts)
                # Within a partition the next 32 bits tell hashes apart well enough: a chance match costs work, not truth.
                step = 2**64 // parts + 1
                low = ((a.distinct % np.uint64(step)) >> np.uint64(max(0, step.bit_length() - 32))).astype("<u4")
                full = [p for p in range(parts) if cut[p + 1] > cut[p]]
                if full:
                    release()
                    yield pa.RecordBatch.from_arrays([pa.array([row["task"]] * len(full), pa.int32()), pa.array([row["slice"]] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([low[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary())], names=["task", "slice", "part", "low"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for each hash of each slice: whether another slice has it."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    arrays = [np.frombuffer(r["low"], "<u4") for r in rows]
    every = np.sort(np.concatenate(arrays))
    # Within a slice hashes are distinct (but for chance matches of the kept bits), so an equal neighbour is another slice's.
    repeated = np.unique(every[1:][every[1:] == every[:-1]])
    for i in range(0, len(rows), 256):
        out = []
        for x in arrays[i : i + 256]:
            at = np.searchsorted(repeated, x)
            out.append(np.packbits(repeated[np.minimum(at, len(repeated) - 1)] == x).tobytes() if len(repeated) else np.packbits(np.zeros(len(x), bool)).tobytes())
        yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows[i : i + 256]], pa.int32()) for c in ("task", "slice", "part")), pa.array(out, pa.binary())], names=["task", "slice", "part", "bits"])


SEGMENTS = "task int, slice int, part int, kind int, n long, a binary, b binary, c binary, d binary"
_SEGMENT_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
_SEGMENT_NAMES = ["task", "slice", "part", "kind", "n", "a", "b", "c", "d"]


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_SEGMENT_TYPES)], names=_SEGMENT_NAMES)


def _by_slice(replies: pa.Table) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in replies.to_pylist():
        out.setdefault(r["slice"], []).append(r)
    return out


def _cut(parts: int):
    """Kind 0: a slice's distinct segments for one partition (string counts, least ids, text).  Kind 1: where the slice holds each."""

    def run(packed: pa.Table, replies: pa.Table) -> pa.Table:
        asked, out = _by_slice(replies), []
        for batch in packed.to_batches(max_chunksize=1):
            for row in batch.to_pylist():
                a, ids, _ = _anchors(row)
                shared = a.repeated_here(ids) if len(a.distinct) else np.empty(0, bool)
                cut = a.parts(parts)
                for r in asked.get(row["slice"], []):
                    lo, hi = cut[r["part"]], cut[r["part"] + 1]
                    shared[lo:hi] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=hi - lo).astype(bool)
                which, begin, n, doc = a.segments(shared)
                if not len(begin):
                    continue
                _, text = distinct_spans(a.data, begin, begin + n + LENGTH - 1)
                order = np.lexsort((ids[doc], text, which))  # equal texts have one minimizer
                new = np.append(True, text[order][1:] != text[order][:-1])
                group = np.empty(len(order), np.int64)
                group[order] = np.cumsum(new) - 1
                first = order[new]  # of least id
                bound = np.searchsorted(which[first], cut)
                size = n[first] + LENGTH - 1
                for p in range(parts):
                    f = first[bound[p] : bound[p + 1]]
                    if len(f):
                        s = size[bound[p] : bound[p + 1]]
                        out.append((row["task"], row["slice"], p, 0, len(f), n[f].astype("u1").tobytes(), _squeeze(ids[doc[f]].astype("<i8").tobytes()), _squeeze(a.data[spread(begin[f], s)].tobytes()), None))
                later = ids[doc] > ids[doc[first]][group]  # an earlier document of this slice has the same segment
                release()
                out.append((row["task"], row["slice"], (31 * row["task"] + row["slice"]) % parts, 1, len(begin), _squeeze(group.astype("<u4").tobytes()), _squeeze(np.diff(begin, prepend=0).astype("<i8").tobytes()), n.astype("u1").tobytes(), np.packbits(later).tobytes()))
        return _rows(out)

    return run


def _nearest_smaller(owner: np.ndarray, lcp: np.ndarray, enough: int) -> np.ndarray:
    """For each place the common prefix with the nearest place before it of a smaller owner; 0 where it is under ``enough``.

    ``lcp`` has the common prefix with the place before.  All that stands
    between a place and the one it points at has no smaller owner, so a
    pointer may follow the pointer of where it points; all jump at once.
    """
    to, common = np.arange(len(owner)) - 1, lcp.copy()
    live = np.flatnonzero(common >= enough)
    while True:
        live = live[owner[to[live]] >= owner[live]]
        if not len(live):
            break
        through = to[live]
        to[live], common[live] = to[through], np.minimum(common[live], common[through])
        common[live[to[live] < 0]] = 0
        live = live[common[live] >= enough]
    return np.where(common >= enough, common, 0)


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each suffix (begun at ``starts``, read to 50 bytes) its longest common prefix with one of a smaller owner, if that has 50 bytes, else 0.

    The suffixes are sorted; the longest is the longer one of those with the
    previous and the next suffix of a smaller owner in that order.
    """
    n = len(starts)
    if not n:
        return np.empty(0, np.int64)
    words = []
    for k in range(0, LENGTH, 8):
        word = np.zeros(n, np.uint64)
        for j in range(k, k + 8):
            word <<= np.uint64(8)
            if j < LENGTH:
                word |= text[j:][starts]
        words.append(word)
    order = np.lexsort(words[::-1])
    lcp, alike = np.zeros(n + 1, np.int64), np.ones(n - 1, bool)  # with the one before; the end has none
    for k, word in enumerate(words):
        s = word[order]
        differs = s[1:] ^ s[:-1]
        zeros = np.zeros(n - 1, np.int64)  # leading bytes that agree
        for j in range(1, 9):
            zeros += (differs >> np.uint64(64 - 8 * j)) == 0
        lcp[1:n] += np.where(alike, zeros, 0)
        alike &= differs == 0
    np.minimum(lcp, LENGTH, out=lcp)
    mine = owner[order]
    before = _nearest_smaller(mine, lcp[:n], LENGTH)
    after = _nearest_smaller(mine[::-1], lcp[:0:-1], LENGTH)[::-1]
    out = np.empty(n, np.int64)
    out[order] = np.maximum(before, after)
    return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mask of marked strings for each segment of kind 0; rows of kind 1 pass."""
    rows = []
    release()
    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == 1:
                yield from _rows([tuple(r[c] for c in _SEGMENT_NAMES)]).to_batches()
            else:
                rows.append(r)
    if not rows:
        return
    n = np.concatenate([np.frombuffer(r["a"], "u1") for r in rows]).astype(np.int64)
    owner = np.concatenate([np.frombuffer(_unsqueeze(r["b"]), "<i8") for r in rows])
    text = np.concatenate([np.frombuffer(_unsqueeze(r.pop("c")), np.uint8) for r in rows])
    size = n + LENGTH - 1
    begin = slices_by(size)[:-1]
    # Equal segments of several slices are one suffix family; the least owner stands for all.
    _, family = distinct_spans(text, begin, begin + size)
    order = np.lexsort((owner, family))
    first = order[np.append(True, family[order][1:] != family[order][:-1])]
    marks = np.zeros(len(first), np.uint64)
    some, begin_, owner_ = n[first], begin[first], owner[first]
    starts = spread(begin_, some)
    # A string can only repeat in another family if its 64-bit hash does; the suffixes of these are sorted.
    g = Hasher(text)(starts, starts + LENGTH)
    s = np.sort(g)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, g), len(twice) - 1)
        sel = np.flatnonzero(twice[at] == g)
        of = np.repeat(np.arange(len(first)), some)[sel]
        hit = longest_previous_factors(text, starts[sel], owner_[of]) >= LENGTH
        of, sel = of[hit], sel[hit]
        bit = starts[sel] - begin_[of]
        np.bitwise_or.at(marks, of, np.uint64(1) << bit.astype(np.uint64))
    full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    mask = np.where(owner > owner_[family], full, marks[family])
    at = 0
    del text, starts, g, s, order, begin, size
    release()
    for i in range(0, len(rows), 128):
        out = []
        for r in rows[i : i + 128]:
            out.append((r["task"], r["slice"], r["part"], 0, r["n"], _squeeze(mask[at : at + r["n"]].astype("<u8").tobytes()), None, None, None))
            at += r["n"]
        yield from _rows(out).to_batches()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(with_text: bool):
    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        answered = _by_slice(answers)
        ids_, columns = [], {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "text": []}
        for batch in packed.to_batches(max_chunksize=1):
            for row in batch.to_pylist():
                ids, no_id, offsets, data = _open(row)
                covered = np.zeros(len(data) + 1, np.int32)
                mine = answered.get(row["slice"], [])
                where = [r for r in mine if r["kind"] == 1]
                if where:
                    w = where[0]
                    masks = [np.frombuffer(_unsqueeze(r["a"]), "<u8") for r in sorted((r for r in mine if r["kind"] == 0), key=lambda r: r["part"])]
                    masks = np.concatenate(masks)
                    group = np.frombuffer(_unsqueeze(w["a"]), "<u4")
                    begin, n = np.cumsum(np.frombuffer(_unsqueeze(w["b"]), "<i8")), np.frombuffer(w["c"], "u1").astype(np.uint64)
                    later = np.unpackbits(np.frombuffer(w["d"], np.uint8), count=len(begin)).astype(bool)
                    full = (np.uint64(1) << n) - np.uint64(1)
                    mask = np.where(later, full, masks[group])
                    if no_id.any():
                        begin = np.flatnonzero(~np.repeat(no_id, np.diff(offsets)))[begin]
                    some = np.flatnonzero(mask)
                    mask, begin, n = mask[some], begin[some], n[some].astype(np.int64)
                    bit = spread(np.zeros(len(n), np.int64), n)
                    marked = (np.repeat(mask, n) >> bit.astype(np.uint64)) & np.uint64(1) > 0
                    start = (np.repeat(begin, n) + bit)[marked]
                    np.add.at(covered, start, 1)
                    np.add.at(covered, start + LENGTH, -1)
                gone = np.cumsum(covered[:-1]) > 0
                removed = np.append(0, np.cumsum(gone))
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                first = offsets[:-1][offsets[:-1] < len(data)]
                edge[first] = gone[first]
                spans = np.append(0, np.cumsum(edge))
                ids_.append(pa.array(ids, pa.int64(), mask=no_id))
                columns["n_bytes"].append(np.diff(offsets))
                columns["n_removed"].append(np.diff(removed[offsets]))
                columns["n_spans"].append(np.diff(spans[offsets]))
                kept = data[~gone]
                at = (offsets - removed[offsets]).tolist()
                columns["kept_sha256"] += [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                if with_text:
                    columns["text"] += [kept[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        out = {"doc_id": pa.chunked_array(ids_, pa.int64())} | {c: pa.array(np.concatenate(columns[c]) if columns[c] else [], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")} | {"kept_sha256": pa.array(columns["kept_sha256"], pa.string())}
        return pa.table(out | ({"text": pa.array(columns["text"], pa.string())} if with_text else {}))

    return run


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Slices as a table in the warehouse, a bucket for each writing task: later steps read it without a shuffle."""
    spark = docs.sparkSession
    name = f"slices_{uuid.uuid4().hex}"
    number = F.col("id").cast("int")
    tried = spark.range(64 * buckets).groupBy(F.pmod(F.hash(number), F.lit(buckets)).alias("b")).agg(F.min(number).alias("i")).collect()  # a row a bucket
    keys = np.arange(buckets)
    for bucket, i in tried:
        keys[bucket] = i
    rows = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _pack(keys), "task int, slice int, ids binary, no_id binary, offsets binary, text binary")
    rows.write.bucketBy(buckets, "task").option("compression", "uncompressed").saveAsTable(name)
    path = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").select("data_type").first()[0]
    removed_at_end(spark, path)
    return spark.table(name)


def deduplicate(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, ``with_text``, the kept text.

    Strings are judged on the input.  Null and empty texts have no bytes;
    texts under 50 bytes lose nothing; rows of one doc_id do not match each
    other; rows without doc_id neither lose bytes nor cost others any.  In
    ``text`` a character cut in two becomes U+FFFD.  Other columns are not
    read.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = _packed(docs, parts)
    asked = map_arrow(packed, _ask(parts), "task int, slice int, part int, low binary")
    replies = written(map_arrow(asked.repartitionById(parts, F.col("part")), _answer, "task int, slice int, part int, bits binary"))
    segments = packed.groupBy("task").cogroup(replies.groupBy("task")).applyInArrow(_cut(parts), SEGMENTS)
    answers = written(map_arrow(segments.repartitionById(parts, F.col("part")), _match, SEGMENTS))
    return packed.groupBy("task").cogroup(answers.groupBy("task")).applyInArrow(_remove(with_text), RESULT + (", text string" if with_text else ""))


def report(docs: DataFrame) -> DataFrame:
    return deduplicate(docs, with_text=False)
