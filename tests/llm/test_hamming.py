import numpy as np
import pytest

from lodestone.llm import hamming_topk


def brute(rows, k):
    out = {}
    for i, c in rows:
        if i is not None and i % 50 == 0:
            best = sorted((bin((c ^ d) & (2**64 - 1)).count("1"), j) for j, d in rows if j is not None)[:k]
            out[i] = [(j, d) for d, j in best]
    return out


@pytest.mark.parametrize("n", [0, 3, 700])
def test_top_k(spark, n):
    rng = np.random.default_rng(n)
    codes = rng.integers(-(2**63), 2**63 - 1, n)
    codes[: n // 3] = codes[:1]  # one very common code
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(None, 5)] * (n > 3)
    df = spark.createDataFrame(rows, "id long, code long")
    got: dict = {}
    for r in hamming_topk.top_k(df, df.where("id % 50 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.neighbor_id, r.distance))
    assert got == brute(rows, 10)


def test_sign_code_and_nulls(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0, 0.5] + [0.0] * 60 + [1.0]), (1, [None, 2.0]), (2, None)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.c for r in df.select("vec_id", hamming_topk.sign_code(df.embedding).alias("c")).collect()}
    assert got == {0: 5 - 2**63, 1: 2, 2: None}
    assert hamming_topk.report(df).count() == 2


def test_edges_of_the_query(spark):
    """Clashing columns, an empty table, null and short vectors, repeated rows, and probes at every radius."""
    rows = [(i, [float((i * 7 + k) % 5 - 2) for k in range(64)], 0) for i in range(120)] + [(50, [1.0] * 3, 1), (100, None, 1), (None, [1.0] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS code", "3 AS q", "4 AS bound")
    got = hamming_topk.report(df).collect()
    assert {r.query_id for r in got} == {0, 50, 100} and all(r.distance == 0 for r in got if r["rank"] == 1)
    assert hamming_topk.report(df.limit(0)).count() == 0
    pending = spark.createDataFrame([(5, 64)], "q long, bound int")
    for radius in range(7):
        values = [r.pvalue for r in hamming_topk._probes(pending, 0, 0, 6, radius).collect()]
        assert sorted(values) == [v for v in range(64) if (v ^ 5).bit_count() == radius]
