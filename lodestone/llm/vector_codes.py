"""Compression of vectors to one code a part, by Hamerly's form of Lloyd's algorithm.

Components become integers and vectors are cut into equal parts; every part
position has a codebook of its own.  A part keeps an upper bound of the
distance to its entry and one lower bound of the distance to the second
nearest entry, in a table that is written after each round.  When the entries
have moved, the bounds move with them; only a part whose upper bound is not
strictly below its lower bound is measured again, and only if its exact
distance does not settle it, against all entries in whole numbers.  A strict
difference leaves no tie, so that ties keep going to the lower index.

Bounds are kept as 32-bit floats, rounded outwards.  A codebook has a few
hundred integers and is all that passes through the driver; sums of the parts
of an entry are added up in each task first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._arrow import map_arrow
from lodestone.llm._shared import discard, written
from lodestone.llm.whitening import finite, floored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Sums of at most so many labels are broadcast; of more, those of labels that hold a thousandth of the rows each are.
LABELS = 10_000
#: Rounding of the few operations between two bounds stays far below this share.
SLACK = 1e-12


def _outwards(bound: np.ndarray, up: bool) -> np.ndarray:
    return np.nextafter(bound.astype(np.float32), np.float32(np.inf if up else -np.inf))


def _root(square: np.ndarray, up: bool) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + SLACK if up else 1 - SLACK)


def whole(x: np.ndarray, *books: np.ndarray) -> bool:
    """Whether squared distances fit 64 bits; else they are taken in Python's integers."""
    most = max((max(int(a.max()), -int(a.min())) for a in (x, *books) if a.size), default=0)
    return 4 * most * most * max(1, x.shape[-1]) < 2**62


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, w) to entries (k, w), as exact integers."""
    return ((x[:, None, :] - book[None, :, :]) ** 2).sum(-1)


@dataclass
class Bounds:
    """A part position's entry, upper and lower bound for each row."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scans: int = 0


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its squared distance, bound to the second nearest) by measuring all entries; ties take the lower index."""
    d = distances(x, book)
    at = np.arange(len(x))
    code = d.argmin(1)
    best = d[at, code]
    if len(book) == 1:
        return code, best, np.full(len(x), np.inf)
    others = np.arange(len(book) - 1)[None, :]
    rest = d[at[:, None], others + (others >= code[:, None])]
    return code, best, _root(rest.min(1), up=False)


def assign(x: np.ndarray, book: np.ndarray, before: np.ndarray | None = None, held: Bounds | None = None) -> Bounds:
    """Assignment of one part position to ``book``, which was ``before`` when the bounds ``held`` were true."""
    n = len(x)
    if held is None:
        code, best, lower = scan(x, book)
        return Bounds(code, _root(best, up=True), lower, n)
    moved = _root(((book - before) ** 2).sum(-1), up=True)
    order = np.argsort(moved)
    farthest, second = order[-1], order[-2] if len(order) > 1 else order[-1]
    code = held.code.copy()
    upper = held.upper + moved[code]
    lower = held.lower - np.where(code == farthest, moved[second], moved[farthest])
    open_ = np.flatnonzero(~(upper < lower))
    if len(open_):
        exact = ((x[open_] - book[code[open_]]) ** 2).sum(-1)
        upper[open_] = _root(exact, up=True)
        open_ = open_[~(upper[open_] < lower[open_])]
    if len(open_):
        code[open_], best, lower[open_] = scan(x[open_], book)
        upper[open_] = _root(best, up=True)
    return Bounds(code, upper, lower, len(open_))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(dtype, copy=False)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, w = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w, dtype=np.int32) if w else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(values).ravel(), kind))


STATE = "code array<tinyint>, upper array<float>, lower array<float>"
#: Rows of sums lie beside the rows of vectors in the table of a round; ``cell`` is null for vectors, -1 for the number of full scans.
SUMS = "cell int, cnt long, total array<decimal(38,0)>"


def _round(books: list[np.ndarray], before: list[np.ndarray] | None):
    """A round as a function of Arrow batches: vectors with their new bounds, then the task's sums by part and entry."""
    parts, (k, w) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, w), object)
        count, scans, fresh, kind = np.zeros((parts, k), np.int64), 0, before is None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            x, kind = _matrix(get("x"), np.int64).reshape(n, parts, w), get("label").type
            exact = whole(x, *books, *(before or []))
            held = [None] * parts if fresh else [Bounds(c, u, lo) for c, u, lo in zip(_matrix(get("code"), np.int64).T, _matrix(get("upper"), float).T, _matrix(get("lower"), float).T, strict=True)]
            out = []
            for p in range(parts):
                y, book, old = x[:, p], books[p], before[p] if before else None
                if not exact:
                    y, book, old = y.astype(object), book.astype(object), None if old is None else old.astype(object)
                b = assign(y, book, old, held[p])
                scans += b.scans
                out.append(b)
                sums = np.zeros((k, w), np.int64 if exact else object)
                np.add.at(sums, b.code, y)
                total[p] += sums
                count[p] += np.bincount(b.code, minlength=k)
            code, upper, lower = (np.stack([getattr(b, f) for b in out], 1) for f in ("code", "upper", "lower"))
            none = lambda t: pa.nulls(n, t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [get("vec_id"), get("label"), get("x"), _lists(code.astype(np.int8), pa.int8()), _lists(_outwards(upper, True), pa.float32()), _lists(_outwards(lower, False), pa.float32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.decimal128(38, 0)))],
                names=["vec_id", "label", "x", "code", "upper", "lower", "cell", "cnt", "total"],
            )
        if kind is None:  # nothing in this task
            return
        used = np.flatnonzero(count.ravel())
        cells = [-1, *used.tolist()]
        sums = [[], *([Decimal(int(v)) for v in total.reshape(parts * k, w)[c]] for c in used)]
        m = len(cells)
        no = [pa.nulls(m, t) for t in (pa.int64(), kind, pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.float32()), pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([*no, pa.array(cells, pa.int32()), pa.array([scans, *count.ravel()[used].tolist()], pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], names=["vec_id", "label", "x", "code", "upper", "lower", "cell", "cnt", "total"])

    return run


def _last(books: list[np.ndarray]):
    """Codes as hex digits and exact squared errors, after the last assignment."""
    parts, (_, w) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            x = _matrix(get("x"), np.int64).reshape(n, parts, w)
            code = _matrix(get("code"), np.int64)
            near = np.stack([books[p][code[:, p]] for p in range(parts)], 1)
            kind = np.int64 if whole(x, *books) and parts * w * 4 * max(int(np.abs(x).max()), 1) ** 2 < 2**62 else object
            error = ((x.astype(kind) - near.astype(kind)) ** 2).reshape(n, -1).sum(1)
            digits = code.astype(np.uint8).tobytes().hex()
            hexed = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([get("vec_id"), get("label"), pa.array(hexed, pa.string()), pa.array([Decimal(int(e)) for e in error], pa.decimal128(38, 0))], names=["vec_id", "label", "code", "error"])

    return run


@dataclass
class Codes:
    """``rows`` (vec_id, label, code, error) and the codebooks (entries, components) by part; ``scans``: full scans of each assignment, of ``n`` times parts."""

    rows: DataFrame
    books: list[np.ndarray]
    n: int
    scans: list[int] = field(default_factory=list)

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel()).encode()).hexdigest()


def _moved(books: list[np.ndarray], table: DataFrame) -> tuple[list[np.ndarray], int]:
    """The entries after a round, each the floor of its parts' mean, and the full scans of the round."""
    w, k = books[0].shape[1], len(books[0])
    rows = table.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("cnt").alias("cnt"), *(F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(w))).collect()
    out, scans = [b.copy() for b in books], 0
    for r in rows:
        if r.cell < 0:
            scans = r.cnt
        else:
            out[r.cell // k][r.cell % k] = [int(r[f"t{i}"]) // r.cnt for i in range(w)]
    return out, scans


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes | None:
    """Codes of ``vectors`` (vec_id, label, x array<long>, all of one length that ``parts`` divides); None of an empty table."""
    spark = vectors.sparkSession
    first = vectors.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return None
    start = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1)
    books = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, x array<long>, {STATE}, {SUMS}"
    state, table, before, scans = vectors, None, None, []
    for _ in range(rounds + 1):
        last, table = table, written(map_arrow(state, _round(books, before), schema))
        if last is not None:
            discard(last)
        before, (books, n) = books, _moved(books, table)
        scans.append(n)
        state = table.where("cell IS NULL").select("vec_id", "label", "x", "code", "upper", "lower")
    # The last round only assigns: the entries that it was measured against are the final ones.
    rows = map_arrow(state.select("vec_id", "label", "x", "code"), _last(before), f"vec_id long, label {label}, code string, error decimal(38,0)")
    out = written(rows)
    discard(table)
    return Codes(out, before, out.count(), scans)


def _with_label_sums(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error.  The sums of labels that hold many rows are broadcast, a bounded number; those of the others are joined by a shuffle."""
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")).withColumnRenamed("label", "_label"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= LABELS:
        return rows.join(F.broadcast(sums), same)
    total = rows.count()
    hot = F.broadcast(sums.where(F.col("rows") * 1000 >= total))  # a thousand at most
    rare = rows.join(hot.select("_label"), same, "left_anti").join(sums.where(F.col("rows") * 1000 < total), same)
    return rows.join(hot, same).unionByName(rare)


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row.

    Rows whose vector is null, empty, or holds a null or non-finite component
    are dropped, as are vectors of another length than most rows have (of
    equally many, the longer).  If eight does not divide the length, zeros
    follow the components.  A null vec_id comes after all others among the
    first entries, equal ids in the order of their vectors; with fewer than 16
    rows the codebooks have so many entries; repeated rows count each; null
    labels are one label; sums beyond a long are null.  Other columns are not
    read.
    """
    rows = embeddings.select("vec_id", "label", F.when(finite(F.col("embedding")), floored(F.col("embedding"), SCALE)).alias("x")).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else PARTS
    padded = rows.where(F.size("x") == d)
    if d % PARTS:
        padded = padded.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), PARTS - d % PARTS)))
    done = compress(padded) if lengths else None
    if done is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    long = lambda c: F.expr(f"try_cast({c} AS LONG)").alias(c)
    return _with_label_sums(done.rows).select("vec_id", "code", long("error"), long("label_error"), F.lit(done.digest).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    near = "SELECT v.vec_id, v.label, v.p, v.x, arg_min(c.k, (d.d, c.k)) AS k, min(d.d) AS d FROM v JOIN {c} c USING (p), LATERAL (SELECT list_sum(list_transform(list_zip(v.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d) d GROUP BY ALL"
    steps = [
        "e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"v AS MATERIALIZED (SELECT vec_id, label, p, list_slice(x, p * len(x) // {parts} + 1, (p + 1) * len(x) // {parts}) AS x FROM e, range({parts}) r(p))",
        f"c0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS k, x AS y FROM v QUALIFY k < {entries})",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        steps.append(f"m{r} AS (SELECT p, k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, k, i)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(n.y, o.y) AS y FROM c{r} o LEFT JOIN (SELECT p, k, list(y ORDER BY i) AS y FROM m{r} GROUP BY p, k) n USING (p, k))")
    steps.append(f"z AS ({near.format(c=f'c{rounds}')})")
    steps.append("o AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id, label)")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(t AS VARCHAR), ',' ORDER BY p, k, i)) AS digest FROM (SELECT p, k, unnest(y) AS t, unnest(range(len(y))) AS i FROM c{rounds}))")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM o, h"


#: DuckDB SQL, of tables whose ids do not repeat.
ORACLE = _oracle()
