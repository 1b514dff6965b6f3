import hashlib
import math
import random
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from lodestone.llm import vector_codes

TABLE = "vec_id long, embedding array<float>, label int"


def brute(rows, d, parts=8, entries=16, rounds=6):
    """Rows (vec_id, code, error, label_error, digest) by measuring every part against every entry in each round."""
    kept = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], lab) for i, v, lab in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, x + [0] * (-d % parts), lab) for i, x, lab in kept]
    w = -(-d // parts)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]
    square = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    nearest = lambda x, p: min(range(len(first)), key=lambda k: (square(x, books[p][k]), k))
    codes = []
    for r in range(rounds + 1):
        codes = [[nearest(x[p * w : p * w + w], p) for p in range(parts)] for _, x, _ in kept]
        if r < rounds:
            for p in range(parts):
                for k in range(len(first)):
                    mine = [x[p * w : p * w + w] for (_, x, _), c in zip(kept, codes, strict=True) if c[p] == k]
                    if mine:
                        books[p][k] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    errors = [sum(square(x[p * w : p * w + w], books[p][k]) for p, k in enumerate(c)) for (_, x, _), c in zip(kept, codes, strict=True)]
    by_label: Counter = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for k in c), e, by_label[lab], digest) for (i, _, lab), c, e in zip(kept, codes, errors, strict=True))


def got(df):
    return Counter(tuple(r) for r in vector_codes.report(df).collect())


def sample(n, d, seed, grid=False):
    rng = random.Random(seed)
    value = (lambda: rng.randrange(-2, 3) / 4096) if grid else (lambda: rng.gauss(0, 0.1))
    rows = [(i, [value() for _ in range(d)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(5000 + i, rows[3][1], 1) for i in range(n // 2)]
    return rows + [(2, rows[9][1], 1), (2, rows[9][1], 1), (None, rows[4][1], None), (90, None, 0), (91, [], 0), (92, [math.nan] * d, 0), (93, [None] * d, 1), (94, [math.inf] * d, 1), (95, [0.5] * (d - 1), 1)]


@pytest.mark.parametrize(("n", "d", "grid"), [(250, 16, False), (200, 16, True), (120, 11, False), (10, 24, False)])
def test_against_plain(spark, n, d, grid):
    """Ordinary vectors, a grid full of ties, a length that eight does not divide, and fewer rows than entries; with clashing columns."""
    rows = sample(n, d, seed=n, grid=grid)
    df = spark.createDataFrame(rows, TABLE).selectExpr("*", "1 AS x", "2 AS code", "3 AS cell", "4 AS d", "5 AS _label", "6 AS error").repartition(4)
    out = vector_codes.report(df)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == brute(rows, d)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5] * 8, None)], [(1, [0.0] * 8, 1)] * 40])
def test_edges(spark, rows):
    assert got(spark.createDataFrame(rows, TABLE)) == brute(rows, 8)


def test_huge_components(spark):
    """Beyond 64 bits squares are taken exactly, and what exceeds a long is null."""
    rows = [(i, [4e6 + 16.0 * v * v for v in range(i, i + 8)], 0) for i in range(40)]
    assert got(spark.createDataFrame(rows, TABLE)) == brute(rows, 8)
    out = vector_codes.report(spark.createDataFrame([(i, [(-1.0) ** i * 1e12 * (i + 1) ** 2] * 8, 0) for i in range(40)], TABLE)).collect()
    assert len(out) == 40 and any(r.label_error is None for r in out)


def test_bounds_hold_and_save_scans():
    """After every move the bounds enclose the true distances, the codes are those of a full scan, and few parts are scanned."""
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (3000, 4)) + 2000 * rng.integers(0, 8, (3000, 1))
    book = x[:8].copy()
    held, before, scans = None, None, []
    for _ in range(8):
        held = vector_codes.assign(x, book, before, held)
        scans.append(held.scans)
        d = vector_codes.distances(x, book)
        assert np.array_equal(held.code, d.argmin(1))
        d = np.sqrt(d)
        best = d[np.arange(len(x)), held.code]
        d[np.arange(len(x)), held.code] = np.inf
        assert (held.upper >= best).all() and (held.lower <= d.min(1)).all()
        held = vector_codes.Bounds(held.code, vector_codes._outwards(held.upper, True).astype(float), vector_codes._outwards(held.lower, False).astype(float))
        before, book = book, book.copy()
        for k in range(len(book)):
            if (held.code == k).any():
                book[k] = x[held.code == k].sum(0) // (held.code == k).sum()
    assert scans[0] == 3000 and scans[-1] < 300


def test_label_sums_beyond_a_broadcast(spark, monkeypatch):
    """With many labels the hot ones are broadcast and the others joined by a shuffle; the sums are the same."""
    monkeypatch.setattr(vector_codes, "LABELS", 3)
    rows = [(i, "00", i % 5, None if i % 3 == 0 else i if i % 3 == 1 else -1) for i in range(3000)]
    df = spark.createDataFrame([(i, c, Decimal(e), lab) for i, c, e, lab in rows], "vec_id long, code string, error decimal(38,0), label int")
    sums: Counter = Counter()
    for _, _, e, lab in rows:
        sums[lab] += e
    assert {r.vec_id: int(r.label_error) for r in vector_codes._with_label_sums(df).collect()} == {i: sums[lab] for i, _, _, lab in rows}


def test_query_equals_its_sql(spark):
    from lodestone.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES["op13_vector_codes"](spark, "/root/testdata/sf0.001").toPandas()
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(ORACLE_SQL["op13_vector_codes"]).df()[list(got.columns)]
    assert got.sort_values("vec_id").reset_index(drop=True).equals(want.sort_values("vec_id").reset_index(drop=True))
