"""Exact nearest vectors by cells around pivots.

Every vector lies in the cell of its nearest pivot, and a cell keeps the
greatest distance of a vector from the pivot, its radius.  By the triangle
inequality no vector x of a cell with pivot c and radius r has an inner
product with a query q above q.c + |q| r, whatever their lengths.  A search
reads the cells of greatest bounds first; its kth best score so far is a
threshold, and all cells whose bound reaches it are read then.  Both times
rows meet queries by an equal cell, never all with all, and what is left out
cannot be among the k best.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.arxiv import month_ok
from lodestone.functions.vectors import dot
from lodestone.operators.bounds import ROUNDING, small
from lodestone.plans.storage import folder, removed_at_end, stored

#: Pivots at most: their matrix goes to every task.  Fewer rows than its square have as many as the root of their number.
PIVOTS = 1024
#: Cells are read first until they hold so many times k rows.
FIRST = 20
#: The cell of rows without a usable vector, which every search reads.
NOWHERE = -1
#: Roundings of distances and products stay below this share of their terms.
SLACK = 1e-9
ROWS = "paper_id", "ord", "date", "arxiv_id", "embedding"


@dataclass
class VectorCells:
    """``rows`` (ROWS and cell) in a folder for each cell at ``path``, and of each cell the pivot, radius and number of rows."""

    path: str
    rows: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    nowhere: int = 0


def _usable(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors of length d without null, NaN or infinite elements."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(flat.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    at = np.flatnonzero(sizes == d)
    values = flat.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), d)
    good = np.isfinite(values).all(1)
    return at[good], values[good]


def _placed(pivots: np.ndarray):
    """Adds cell and distance from its pivot to batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, NOWHERE, np.int32), np.zeros(batch.num_rows)
            if len(pivots):
                at, x = _usable(batch.column(batch.schema.get_field_index("embedding")), pivots.shape[1])
                near = ((pivots**2).sum(1)[None, :] - 2 * x @ pivots.T).argmin(1)
                cell[at], far[at] = near, np.sqrt(((x - pivots[near]) ** 2).sum(1)) * (1 + SLACK)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def build_cells(vectors: DataFrame, most: int = PIVOTS, path: str | None = None) -> VectorCells:
    """Cells of ``vectors`` (ROWS).  Pivots are the rows of least hash, at most ``most``: a bounded, fixed sample; every row is placed.

    The length of vectors is that of most pivots; rows of another length, and
    with null or non-finite elements, are in the cell that all searches read.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    wanted = max(1, min(most, math.isqrt(n)))
    sample = [r[0] for r in vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("paper_id"), "paper_id").limit(wanted).select("embedding").collect()]
    sample = [v for v in sample if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for v in sample]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k)) if lengths else 0
    pivots = np.unique(np.array([v for v in sample if len(v) == d], float), axis=0) if d else np.zeros((0, 0))
    kept = vectors.select(*ROWS)
    placed = kept.mapInArrow(_placed(pivots), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", cell int, far double")
    at = path or f"{folder(spark)}/cells-{uuid.uuid4().hex}"
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{at}/rows")
    if path is None:
        removed_at_end(spark, at)
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kept.schema)}, far double, cell int").parquet(f"{at}/rows")
    sizes, radii, nowhere = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), 0
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each pivot at most
        if r.cell == NOWHERE:
            nowhere = r.n
        else:
            sizes[r.cell], radii[r.cell] = r.n, r.far
    if path is not None:
        spark.createDataFrame([(i, p.tolist(), float(radii[i]), int(sizes[i])) for i, p in enumerate(pivots)] + [(NOWHERE, None, None, nowhere)], "cell int, pivot array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{at}/cells")
    return VectorCells(at, rows, pivots, radii, sizes, nowhere)


def load_cells(spark: SparkSession, path: str) -> VectorCells:
    """Cells that ``build_cells`` wrote to ``path``."""
    known = {r.cell: r for r in spark.read.parquet(f"{path}/cells").collect()}
    n = len(known) - 1
    pivots = np.array([known[i].pivot for i in range(n)], float).reshape(n, -1)
    return VectorCells(path, spark.read.parquet(f"{path}/rows"), pivots, np.array([known[i].radius for i in range(n)]), np.array([known[i].n for i in range(n)], np.int64), known[NOWHERE].n)


def _bounds(cells: VectorCells):
    """Batches of queries (qid, q) as rows (qid, cell, bound, before): cells by falling bound, and the rows that come before each; of a query without a usable vector, all cells."""
    pivots, radii, all_sizes, order = cells.pivots, cells.radii, cells.sizes, np.flatnonzero(cells.sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bound = np.full((n, len(order)), np.inf)
            if len(order):
                at, q = _usable(batch.column(1), pivots.shape[1])
                length = np.sqrt((q**2).sum(1))[:, None]
                near = np.sqrt((pivots[order] ** 2).sum(1))[None, :]
                bound[at] = q @ pivots[order].T + length * radii[order][None, :] + SLACK * length * near
            by = np.argsort(-bound, axis=1, kind="stable")
            sizes = all_sizes[order][by]
            extra = np.full((n, 1), NOWHERE)
            cell = np.concatenate((extra, order[by]), 1)
            sorted_bound = np.concatenate((np.full((n, 1), np.inf), np.take_along_axis(bound, by, 1)), 1)
            before = np.concatenate((np.zeros((n, 1), np.int64), np.cumsum(sizes, 1) - sizes), 1)
            who = pa.array(np.repeat(np.arange(n), cell.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), pa.array(cell.ravel().astype(np.int32)), pa.array(sorted_bound.ravel()), pa.array(before.ravel())], names=["qid", "cell", "bound", "before"])

    return run


def best_vectors(cells: VectorCells, queries: DataFrame, k: int, keep_missing: bool = True, without: Callable[[DataFrame], DataFrame] = lambda scores: scores, counts: dict[str, int] | None = None) -> DataFrame:
    """Rows (qid, paper_id, ord, date, arxiv_id, score) that hold the ``k`` best of each query (qid, embedding, before_date), inside its cutoff and as ``without`` leaves them.

    ``counts`` gets the number of inner products that were taken.
    """
    q = stored(queries.select("qid", F.col("before_date").cast("string").alias("before_date"), F.col("embedding").alias("q")))
    kind = q.schema["qid"].dataType.simpleString()
    bounds = stored(q.select("qid", "q").mapInArrow(_bounds(cells), f"qid {kind}, cell int, bound double, before long"))
    watched: list[Observation] = []

    def scores(chosen: DataFrame) -> DataFrame:
        asked = small(stored(chosen.join(q, "qid").select("qid", "before_date", "q", "cell")))
        near = cells.rows.join(asked, "cell").where(month_ok(F.col("date"), F.col("before_date"), keep_missing))
        if counts is not None:
            watched.append(Observation())
            near = near.observe(watched[-1], F.count("*").alias("products"))
        return without(near.select("qid", "paper_id", "ord", "date", "arxiv_id", dot(F.col("embedding"), F.col("q")).alias("score")))

    first = stored(scores(bounds.where(F.col("before") < k * FIRST).select("qid", "cell")))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc()))
    least = first.where("score IS NOT NULL").select("qid", "score", place.alias("rn")).where(F.col("rn") == k).select("qid", F.col("score").alias("least"))
    rest = bounds.where(F.col("before") >= k * FIRST).join(least, "qid", "left")
    rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - ROUNDING)).select("qid", "cell")
    more = scores(rest)
    if counts is not None:
        more = stored(more)
        counts["products"] = sum(o.get["products"] for o in watched)
    return first.unionByName(more)
