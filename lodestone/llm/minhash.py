"""Near-duplicate groups by one-permutation MinHash.

A document's shingle set is hashed once; the smallest hash of each bin is its
signature, and empty bins borrow from a bin chosen by optimal densification.
Equal sets are one class.  Class representatives meet in banded buckets, each
bucket gives star-shaped candidate edges from a centre, and every edge is
confirmed on the full sets.  In a bucket that still holds several components,
members of different ones are compared by bitmaps that bound the intersection
from above, and the pairs that pass are confirmed too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._arrow import IS_SPACE, LOWER, Hasher, binaries, map_arrow, mix, runs, slices_by, text_slices
from lodestone.llm._shared import discard, written

BINS, BANDS = 128, 32
#: Rows, and bytes of bitmaps, of a bucket that are compared in one block; members that are compared with one copy of a centre's set.
BLOCK, BLOCK_BYTES, MEMBERS = 8192, 4 << 20, 64
#: Bands whose buckets give star-shaped edges.
STAR_BANDS = 8
#: Ids up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_EMPTY = np.uint64(2**64 - 1)


def _orders() -> np.ndarray:
    """For each bin the order in which it looks for a filled bin, from a fixed seed."""
    rng = np.random.default_rng(20170806)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document, and the documents' offsets.

    Words are runs of anything but space and 0x09-0x0D, A-Z lowered; fewer than k words are one shingle.
    """
    low = LOWER[data]
    starts, ends, doc = runs(~IS_SPACE[low], offsets)
    n_docs = len(offsets) - 1
    h = Hasher(low)(starts, ends)
    counts = np.bincount(doc, minlength=n_docs)
    total = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        total = mix(total * np.uint64(0x9FB21C651E98DF25) + h[i : i + len(total)])
    same = doc[: len(total)] == doc[k - 1 :] if len(total) else np.empty(0, bool)
    values, of = [total[same]], [doc[: len(total)][same]]
    first = slices_by(counts)[:-1]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        x = np.uint64(counts[d])
        for y in h[first[d] : first[d] + counts[d]]:
            x = mix(np.array([x ^ y]))[0]
        values.append(np.array([x]))
        of.append(np.array([d]))
    values, of = np.concatenate(values), np.concatenate(of).astype(np.uint16 if n_docs < 1 << 16 else np.int64)
    order = np.argsort(values)
    order = order[np.argsort(of[order], kind="stable")]
    values, of = values[order], of[order]
    new = np.append(True, (values[1:] != values[:-1]) | (of[1:] != of[:-1])) if len(values) else np.empty(0, bool)
    values, of = values[new], of[new]
    return values, np.searchsorted(of, np.arange(n_docs + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, orders: np.ndarray) -> np.ndarray:
    n_docs = len(bounds) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    cell = doc * BINS + (values >> np.uint64(57)).astype(np.int64)
    out = np.full(n_docs * BINS, _EMPTY)
    if len(cell):
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        out[cell[first]] = values[first]  # sorted, so the first of a bin is its least
    filled = (out != _EMPTY).reshape(n_docs, BINS)
    out = out.reshape(n_docs, BINS)
    d, b = np.nonzero(~filled & filled.any(1)[:, None])
    for step in range(BINS):
        if not len(d):
            break
        source = orders[b, step]
        ok = filled[d, source]
        out[d[ok], b[ok]] = out[d[ok], source[ok]]
        d, b = d[~ok], b[~ok]
    return out


def _sliced(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            yield from text_slices([batch.slice(i, 4096)])


def _sketch(k: int, smallest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders()
        for rows, data, offsets in _sliced(batches):
            values, bounds = shingle_sets(data, offsets, k)
            n = np.diff(bounds)
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(mix(values), out=sums[1:])
            more = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(mix(values ^ np.uint64(0xD6E8FEB86659FD93)), out=more[1:])
            sig = signatures(values, bounds, orders)
            rows_per_band = BINS // BANDS
            keys = np.zeros((len(n), BANDS), np.uint64)
            for i in range(rows_per_band):
                keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + sig[:, i::rows_per_band] + np.arange(BANDS, dtype=np.uint64))
            some = n >= smallest
            band_bounds = slices_by(np.where(some, BANDS, 0))
            flat = keys[some].astype(np.uint64).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(band_bounds.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)), pa.array((more[bounds[1:]] - more[bounds[:-1]]).view(np.int64)), lists], names=["doc_id", "n", "f1", "f2", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _sliced(batches):
            values, bounds = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([rows.column(0), binaries(values, bounds)], names=["doc_id", "members"])

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, na, nb, members) sorted by a, part and b: the centre's set has no b and comes first in each part."""
    now, centres = None, []
    for batch in batches:
        a, part, b, na, nb = (batch.column(i).to_pylist() for i in range(5))
        out, shared = [], []
        for i, members in enumerate(batch.column(5)):
            if (a[i], part[i]) != now:
                now, centres = (a[i], part[i]), []
            mine = np.frombuffer(members.as_buffer(), np.uint64)
            if b[i] is None:
                centres.append(mine)
                continue
            for other in centres:
                p, q = (mine, other) if len(mine) < len(other) else (other, mine)
                at = np.searchsorted(q, p)
                out.append(i)
                shared.append(int((q[np.minimum(at, len(q) - 1)] == p).sum()))
        yield pa.RecordBatch.from_pydict({**{c: pa.array([x[i] for i in out], pa.int64()) for c, x in (("a", a), ("b", b), ("na", na), ("nb", nb))}, "shared": pa.array(shared, pa.int64())})


def semi(docs: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` with (or without) one of ``ids``: broadcast if they are few by count, else joined by a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def confirmed(docs: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """``edges`` (a, b, na, nb) with ``shared``, the size of the intersection of the full sets.

    A centre ``a`` of many edges is dealt out in parts of about ``MEMBERS``
    edges: each edge carries the set of ``b``, each part one copy of that of ``a``.
    """
    edges = written(edges.select("a", "b", "na", "nb"))
    ends = written(edges.select(F.col("a").alias("doc_id")).union(edges.select("b")).distinct())
    sets = written(map_arrow(semi(docs.select("doc_id", "text"), ends), _sets(k), "doc_id long, members binary"))
    parts = edges.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    dealt = edges.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = dealt.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "na", "nb", "members")
    none = F.lit(None).cast("long")
    centres = parts.join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none.alias("b"), none.alias("na"), none.alias("nb"), "members")
    both = members.unionAll(centres).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = written(map_arrow(both, _confirm, "a long, b long, na long, nb long, shared long").groupBy("a", "b", "na", "nb").agg(F.max("shared").alias("shared")))
    discard(edges, ends, sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component) of every end of ``edges`` (a, b): the least id that can be reached.

    Each round takes the least label among neighbours and then the label of
    the label, so rounds grow with the logarithm of the longest path.
    """
    pairs = written(edges.select(F.col("a").alias("s"), F.col("b").alias("t")).union(edges.select("b", "a")).distinct())
    labels = written(pairs.groupBy(F.col("s").alias("doc_id")).agg(F.least(F.min("s"), F.min("t")).alias("c")))
    labels_at = labels
    while True:
        near = pairs.join(labels.select(F.col("doc_id").alias("t"), "c"), "t").groupBy(F.col("s").alias("doc_id")).agg(F.min("c").alias("m"))
        least = labels.join(near, "doc_id").select("doc_id", F.least("c", "m").alias("m"), F.col("c").alias("old"))
        top = labels.select(F.col("doc_id").alias("m"), F.col("c").alias("up"))
        new = written(least.join(top, "m", "left").select("doc_id", F.least("m", F.coalesce("up", "m")).alias("c"), "old"))
        discard(labels_at)
        labels_at, labels = new, new.select("doc_id", "c")
        if not new.where("c <> old").head(1):
            discard(pairs)
            return labels.withColumnRenamed("c", "component")


def _bitmaps(k: int):
    """A bit for each shingle, in the least power of two of bits that is 8 per shingle or more; halves can be folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _sliced(batches):
            values, bounds = shingle_sets(data, offsets, k)
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                size = 1 << max(6, (8 * (b - a) - 1).bit_length())
                bits = np.zeros(size, bool)
                bits[(values[a:b] & np.uint64(size - 1)).astype(np.int64)] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.binary())], names=["doc_id", "bits"])

    return run


def _fold(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


def _rest(percent: int):
    """Pairs of a block that may still be links: of different components, and not ruled out by their bitmaps.

    Rows (bucket, block, doc, n, component, outside, home, bits) come sorted
    by bucket and block.  Each row outside the bucket's main component is
    compared with the rows at home in the block.  A bit that only one set has
    proves an element that the other lacks, which bounds the intersection from
    above; so no link is lost.
    """

    def one(doc: np.ndarray, n: np.ndarray, comp: np.ndarray, out: np.ndarray, home: np.ndarray, bits: list[bytes]):
        outside = np.flatnonzero(out)
        length = np.array([len(b) for b in bits])
        classes = {}
        for size in np.unique(length).tolist():
            at = np.flatnonzero(length == size)
            classes[size] = at, np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)
        done = ~home
        for u in outside.tolist():
            done[u] = True  # its pairs with the rows at home are all looked at now
            mine = np.frombuffer(bits[u], np.uint64)
            for size in (len(bits[u]) // 2, len(bits[u]), len(bits[u]) * 2):
                if size not in classes:
                    continue
                at, table = classes[size]
                use = (comp[at] != comp[u]) & ~done[at] & (100 * np.minimum(n[at], n[u]) >= percent * np.maximum(n[at], n[u]))
                if not use.any():
                    continue
                at = at[use]
                a, b = (_fold(mine) if size < len(bits[u]) else mine), table[use]
                if size > len(bits[u]):
                    b = _fold(b)
                most = np.minimum(n[u] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n[at] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
                for x in at[100 * most >= percent * (n[u] + n[at] - most)].tolist():
                    p, q = (u, x) if doc[u] < doc[x] else (x, u)
                    yield doc[p], doc[q], n[p], n[q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def flush():
            if len(held) > 1:
                doc, n, comp, apart, home, bits = zip(*held, strict=True)
                out.extend(one(*(np.array(c) for c in (doc, n, comp, apart, home)), list(bits)))
            held.clear()

        def batch_of():
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "na", "nb"])
            out.clear()
            return done

        for batch in batches:
            for bucket, block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, block) != now:
                    flush()
                    now = bucket, block
                held.append(row)
            if len(out) > 50_000:
                yield batch_of()
        flush()
        if out:
            yield batch_of()

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their shingle sets; a component is named by its least doc_id, which is
    kept.  Null texts and texts without words have no shingles and no links.
    Rows with equal sets, repeated rows too, are one class; other columns of
    ``docs`` are not read.
    """
    # Sets of fewer than this many shingles are linked with equal sets only.
    smallest = next((n for n in range(1, 1000) if 100 * n >= percent * (n + 1)), 1000)
    sketches = written(map_arrow(docs.select("doc_id", "text"), _sketch(shingle, smallest), "doc_id long, n long, f1 long, f2 long, bands array<long>"))
    classes = written(sketches.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    heads = classes.select(F.col("rep").alias("doc_id"), F.col("n").alias("head_n"))
    members = sketches.where(F.size("bands") > 0).join(heads, "doc_id", "left_semi").select("doc_id", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.min(F.struct("doc_id", "n")).alias("z"), F.count("*").alias("m")).where("m > 1")
    buckets = written(members.join(shared, "bucket").select("band", "bucket", "doc_id", "n", F.col("z.doc_id").alias("centre"), F.col("z.n").alias("centre_n")))
    # Stars over the first bands link most of what is alike; what they leave apart is compared in all bands.
    edges = buckets.where(F.col("band") < STAR_BANDS).where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"), F.col("centre_n").alias("na"), F.col("n").alias("nb"))
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    holds = f"100 * shared >= {percent} * (na + nb - shared)"
    compared = confirmed(docs, edges.where(fits).distinct(), shingle)
    links = compared.where(holds).select("a", "b")
    labels = components(links)
    coloured = written(buckets.select("bucket", "doc_id", "n").join(labels, "doc_id", "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("c")))
    sizes = coloured.groupBy("bucket", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.max_by("c", F.struct("m", "c")).alias("main")).where("k > 1")
    # A bitmap has one to two bytes for a shingle.
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, 2 * F.col("n") / BLOCK_BYTES)).cast("int").alias("blocks")
    waiting = written(coloured.join(mixed.select("bucket", "main", blocks), "bucket"))
    bitmaps = map_arrow(semi(docs.select("doc_id", "text"), written(waiting.select("doc_id").distinct())), _bitmaps(shingle), "doc_id long, bits binary")
    # A large bucket is dealt out in blocks: each row is at home in one, rows outside the main component visit all.
    outside = F.col("c") != F.col("main")
    dealt = waiting.join(bitmaps, "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("bucket", "own", "doc_id", "n", "c", outside.alias("outside"), "bits", F.explode(F.when(outside, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))).alias("block"))
    open_ = dealt.select("bucket", "block", "doc_id", "n", "c", "outside", (F.col("own") == F.col("block")).alias("home"), "bits").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "doc_id")
    rest = map_arrow(open_, _rest(percent), "a long, b long, na long, nb long").distinct().join(compared.select("a", "b"), ["a", "b"], "left_anti")
    more = written(confirmed(docs, rest, shingle).where(holds).select("a", "b"))
    if more.head(1):
        labels = components(links.union(more))
    rows = sketches.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left").select("doc_id", "n", "rep")
    rows = rows.join(labels.select(F.col("doc_id").alias("rep"), "component"), "rep", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def clean(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, the one of least doc_id."""
    extra = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    return semi(docs, written(extra), "doc_id", "left_anti").select(docs.columns)
