import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import whitening

TABLE = "vec_id long, embedding array<float>, label int"


def usable(v, d):
    return v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, d, components=4):
    """{vec_id: [(deviation, whitened)]}, n and explained by plain integers and LAPACK."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, _ in rows if usable(v, d)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    out = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        out.setdefault(i, []).append((deviation, (vectors @ (np.array(x) - np.array(sums) / n)) / np.sqrt(np.maximum(values, 1e-300))))
    return out, n, values / np.trace(centred.T @ centred / n)


def sample(n=300, d=9, seed=3):
    rng = np.random.default_rng(seed)
    spread = rng.normal(size=(n, d)) * np.linspace(2, 0.2, d) + 40.0
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(spread)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(n // 2)]  # a hot vector, a third of all rows
    return rows + [(1, rows[5][1], None), (None, rows[6][1], 2), (7, None, 0), (8, [], 0), (9, [1.0] * (d - 1), 0), (10, [None, *rows[0][1][1:]], 0), (11, [math.nan, *rows[0][1][1:]], 0), (12, [-math.inf, *rows[0][1][1:]], 0)]


def test_report_against_plain(spark):
    rows = sample()
    df = spark.createDataFrame(rows, TABLE).selectExpr("*", "1 AS x", "2 AS n", "3 AS component", "4 AS d", "5 AS parts").repartition(5)
    got = whitening.report(df).collect()
    want, n, explained = brute(rows, 9)
    assert {r.n for r in got} == {n} and len(got) == 4 * sum(map(len, want.values()))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs: dict = {}
    for r in got:
        mine = want[r.vec_id][0] if r.vec_id != 1 else next(w for w in want[1] if w[0] == r.deviation)
        assert r.deviation == mine[0] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        w = mine[1][r.component - 1]
        if abs(w) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * w > 0)
        assert abs(abs(r.whitened) - abs(w)) < 1e-7
    assert all(len(s) == 1 for s in signs.values()) and len(signs) == 4


def test_blocks_give_one_covariance(spark):
    """Vectors of several blocks of dimensions have the covariance that one block gives."""
    rng = np.random.default_rng(0)
    x = rng.integers(-500, 500, (200, 11))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>")
    sums = [int(s) for s in x.sum(0)]
    plain = np.cov(x.T, bias=True)
    for block in (3, 4, 11, 64):
        assert np.allclose(whitening._covariance(df, len(x), sums, block), plain, rtol=1e-12, atol=1e-9)


def test_a_large_offset_costs_no_precision(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-20, 20, (400, 5)) * np.array([5, 4, 3, 2, 1])
    fitted = [whitening.fit(spark.createDataFrame([((v + offset).tolist(),) for v in x], "x array<long>")) for offset in (0, 10**16)]
    assert np.allclose(fitted[0].values, fitted[1].values, rtol=1e-12) and np.allclose(fitted[0].vectors, fitted[1].vectors, atol=1e-10)


@pytest.mark.parametrize(("rows", "count"), [([], 0), ([(1, None, 0), (2, [math.nan], 0)], 0), ([(1, [1.0, 2.0], 0)], 2), ([(1, [1.0, 2.0], 0), (2, [1.0, 3.0], 0)], 4)])
def test_edges(spark, rows, count):
    """Empty, unusable, one vector (nothing varies), and a dimension without spread."""
    got = whitening.report(spark.createDataFrame(rows, TABLE)).orderBy("vec_id", "component").collect()
    assert len(got) == count
    if count == 2:
        assert all(r.deviation == 0 and r.whitened is None and r.explained is None for r in got)
    if count == 4:
        assert [abs(r.whitened) if r.whitened is not None else None for r in got] == [1.0, None, 1.0, None]
        assert [r.explained for r in got][:2] == [1.0, 0.0] and got[0].identity_error == 0.0


def test_huge_entries(spark):
    """A deviation beyond a long is null; nothing fails."""
    got = whitening.report(spark.createDataFrame([(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 1.0], 0)], TABLE)).collect()
    assert len(got) == 6 and {r.deviation for r in got if r.vec_id == 1} == {None}


def test_query_over_the_table(spark):
    from lodestone.llm.queries import QUERIES

    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = got.agg(F.count("*"), F.max("identity_error"), F.countDistinct("vec_id")).first()
    assert one[0] == 2000 and one[1] < 1e-4 and one[2] == 500
