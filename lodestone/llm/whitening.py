"""Whitening of embeddings from upper-triangle column aggregates.

Entries become integers, and the covariance is taken over the distinct integer
vectors: one aggregation has a generated SQL expression for every pair of
dimensions, which sums products of centred columns.  The matrix (its size is
the square of the dimension, whatever the table's) is decomposed by LAPACK in
the driver, and the projection goes back to the rows as generated expressions.

Centring is exact: of each dimension the integer part of the mean is taken off
as an integer before anything becomes a double, so that a large common offset
costs no precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import written

SCALE, COMPONENTS = 256, 4
#: Dimensions of a block: pairs of blocks are rows of the one aggregation if a vector has more, so that its code compiles.
BLOCK = 8
#: Scaled entries beyond this stand for it; differences of two then fit a long.
LARGEST = float(1 << 62)


def finite(vector: Column) -> Column:
    """Whether a vector is there, has an entry, and no entry that is null, NaN or infinite."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """Each entry, as double, times ``scale``, rounded down to a long."""
    inside = lambda c: F.greatest(F.least(c.cast("double") * F.lit(float(scale)), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: F.floor(inside(c)))


@dataclass
class Whitening:
    """``n`` fitted vectors with sums ``sums`` by dimension, the components' ``vectors`` (rows), their eigenvalues and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> list[bool]:
        """Whether a component has a spread: an eigenvalue of 0 but for rounding has no scale to divide by."""
        least = len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        return [bool(e > least) for e in self.values]


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def _sum(terms: list[str], add: str = "({} + {})") -> str:
    """One expression that adds up the terms, as a balanced tree: its depth is the logarithm of their number."""
    while len(terms) > 1:
        terms = [add.format(*terms[i : i + 2]) if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def _centred(n: int, sums: list[int]) -> list[str]:
    """x - S / n of each dimension as a double: the whole part of the mean is taken off as a long."""
    return [f"(CAST(get(x, {i}) - ({s // n}L) AS DOUBLE) - {_number((s % n) / n)})" for i, s in enumerate(sums)]


def _covariance(fit: DataFrame, n: int, sums: list[int], block: int) -> np.ndarray:
    """Covariance with divisor n in one aggregation, an expression for each pair of dimensions of the upper triangle."""
    d = len(sums)
    starts = list(range(0, d, block))
    columns = fit.selectExpr("array(" + ", ".join(_centred(n, sums)) + ") AS c")
    if len(starts) == 1:
        named = [(i, j) for i in range(d) for j in range(i, d)]
        row = columns.selectExpr(*(f"c[{i}] AS c{i}" for i in range(d))).agg(*(F.expr(f"sum(c{i} * c{j})") for i, j in named)).first()
        cells = {(i, j): v for (i, j), v in zip(named, row, strict=True)}
    else:
        pairs = [(a, b) for a in starts for b in starts if a <= b]
        dealt = ", ".join(f"named_struct('p', {p}, 'u', slice(c, {a + 1}, {block}), 'v', slice(c, {b + 1}, {block}))" for p, (a, b) in enumerate(pairs))
        named = [(i, j) for i in range(block) for j in range(block)]
        rows = columns.selectExpr(f"inline(array({dealt}))").groupBy("p").agg(*(F.expr(f"sum(get(u, {i}) * get(v, {j}))") for i, j in named)).collect()
        cells = {(pairs[r[0]][0] + i, pairs[r[0]][1] + j): v for r in rows for (i, j), v in zip(named, r[1:], strict=True) if v is not None}
    out = np.zeros((d, d))
    for (i, j), v in cells.items():
        out[i, j] = out[j, i] = v
    return out / n


def fit(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """The whitening of distinct integer vectors (x array<long>, all of one length); None of an empty table."""
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    row = vectors.agg(F.count("*"), *(F.expr(f"sum(CAST(get(x, {i}) AS DECIMAL(20, 0)))") for i in range(first.d))).first()
    n, sums = row[0], [int(s) for s in row[1:]]
    covariance = _covariance(vectors, n, sums, block)
    values, columns = np.linalg.eigh(covariance)
    values, rows = values[::-1][:components], columns.T[::-1][:components]
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return Whitening(n, sums, values, rows * signs[:, None], float(np.trace(covariance)))


def _projections(model: Whitening) -> list[str]:
    """Each component's expression over x: the centred vector on it, over the root of its eigenvalue."""
    terms = _centred(model.n, model.sums)
    out = []
    for value, vector, usable in zip(model.values, model.vectors, model.usable, strict=True):
        out.append(f"({_sum([f'{t} * {_number(w)}' for t, w in zip(terms, vector, strict=True)])}) / {_number(math.sqrt(value))}" if usable else "CAST(NULL AS DOUBLE)")
    return out


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured over ``vectors``; components without spread are not in it."""
    names = [f"w{k}" for k, u in enumerate(model.usable) if u]
    if not names:
        return 0.0
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    white = vectors.selectExpr(*(f"{e} AS w{k}" for k, e in enumerate(_projections(model)) if model.usable[k]))
    row = white.agg(*(F.covar_pop(a, b) for a, b in pairs)).first()  # centred by their own means, updated row by row
    return float(max(abs(v - (a == b)) for (a, b), v in zip(pairs, row, strict=True)))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``rows`` (with x) with deviation, and a row for each component: component, whitened, explained."""
    n = model.n
    off = [f"try_subtract(try_multiply({n}L, get(x, {i}) - ({s // n}L)), {s % n}L)" for i, s in enumerate(model.sums)]
    deviation = _sum([f"try_multiply({t}, {t})" for t in off], "try_add({}, {})")
    share = lambda e: _number(e / model.trace) if model.trace > 0 else "CAST(NULL AS DOUBLE)"
    each = ", ".join(f"{k}, {w}, {share(e)}" for k, (w, e) in enumerate(zip(_projections(model), model.values, strict=True), 1))
    others = [f"`{c}`" for c in rows.columns if c != "x"]
    return rows.selectExpr(*others, f"{deviation} AS deviation", f"stack({len(model.values)}, {each}) AS (component, whitened, explained)")


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row and component.

    Rows whose vector is null, empty, or holds a null or non-finite entry are
    dropped, as are vectors of another length than most distinct ones have (of
    equally many, the longer).  Repeated rows and null ids stay and are
    answered; a repeated vector counts once in the fit.  Vectors of fewer
    dimensions than ``components`` have as many components; one without spread
    has a null ``whitened`` and is not in ``identity_error``; ``explained`` is
    null if nothing varies; ``deviation`` is null where it exceeds a long.
    Other columns are not read.
    """
    rows = embeddings.select("vec_id", F.when(finite(F.col("embedding")), floored(F.col("embedding"), SCALE)).alias("x")).where("x IS NOT NULL")
    # Copies are dropped before the shuffle; the list is read three times.
    distinct = written(rows.select("x").distinct().withColumn("d", F.size("x")))
    lengths = distinct.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 1
    vectors = distinct.where(F.col("d") == d).select("x")
    model = fit(vectors, components)
    if model is None:
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], empty)
    out = whiten(rows.where(F.size("x") == d), model)
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(identity_error(vectors, model)).alias("identity_error"))
