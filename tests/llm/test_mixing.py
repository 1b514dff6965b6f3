import hashlib
import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing

TABLE = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(1, 2, 3), epochs=3):
    """{source: exact target} by sharing again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped: set = set()
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in stopped)
        free = sum(weight[s] for s in order if s not in stopped)
        share = {s: Fraction(epochs * sizes[s]) if s in stopped else Fraction(left * weight[s], free) for s in order}
        more = {s for s in order if share[s] > epochs * sizes[s]}
        if not more:
            return share
        stopped |= more


def brute(rows):
    sized = [(i, t, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    sizes: Counter = Counter()
    for _, _, s, n in sized:
        sizes[s] += n
    share, out = targets(dict(sizes)), []
    for s in sizes:
        budget = int(share[s] + Fraction(1, 2))
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        mine = sorted((hashlib.md5(":".join(str(x) for x in ("mix", i, t) if x is not None).encode()).hexdigest()[:16], -1 if i is None else i, n) for i, t, s2, n in sized if s2 == s)
        for _, i, n in mine:
            part = max(0, min(n, rest))
            rest -= n
            out.append((None if i == -1 else i, n, sizes[s], float(share[s]), epochs * n + part))
    return Counter(out)


def sample(docs):
    return [(i, t, f"s{i % 7}" if i % 3 else "hot") for i, (t,) in enumerate(docs)] + [(900, "lone word", "small"), (901, "x y z", None), (902, None, None), (None, "no id here", "s1"), (None, "no id here", "s1"), (903, "  \t\n ", "blank"), (904, "a b c d", ""), (904, "a b c d", ""), (905, "é ü", "Ω"), (906, "one", "\U0001f600")]


def test_against_plain(spark, texts):
    rows = sample([(t,) for t in texts])
    df = spark.createDataFrame(rows, TABLE).selectExpr("*", "1 AS size", "2 AS _rank", "3 AS taken", "4 AS _row", "5 AS target").repartition(5)
    got = mixing.report(df)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    first = Counter(tuple(r) for r in got.collect())
    assert first == brute(rows)
    assert Counter(tuple(r) for r in mixing.report(df.repartition(2)).collect()) == first  # reruns agree, however the rows lie


def test_targets(spark):
    """Small sources stop at three times their size one round after the other, and all targets add up."""
    sizes = {"a": 1, "b": 5, "c": 400, "d": 10, "e": 0, "f": 3000, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, _size long")
    got = {r.source: r for r in mixing.source_targets(df).collect()}
    want = targets(sizes)
    assert {s: r.target for s, r in got.items()} == {s: float(t) for s, t in want.items()}
    assert abs(sum(r.target for r in got.values()) - sum(sizes.values())) < 1e-9 and got["e"].budget == 0


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)], [(1, "only one source here", "a")]])
def test_edges(spark, rows):
    got = mixing.report(spark.createDataFrame(rows, TABLE)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_equal_rows_lie_in_several_ranges(spark):
    """A third of all rows are one row: no range holds them all, and their sum is right."""
    rows = [(7, "same text here", "hot")] * 400 + [(i, "other words", "cold") for i in range(800)]
    df = spark.createDataFrame(rows, TABLE).repartition(6)
    assert Counter(tuple(r) for r in mixing.report(df).collect()) == brute(rows)
    sized = df.select(F.lit(0).cast("long").alias("_rank"), F.lit(3).cast("long").alias("_size"), F.lit("k").alias("_key"), F.monotonically_increasing_id().alias("_at"))
    placed = mixing.with_prefix_sums(sized, ["_key", "_at"])
    assert sorted(r._before for r in placed.collect()) == [3 * i for i in range(1200)]


def test_mixture_has_the_words_taken(spark, texts):
    rows = sample([(t,) for t in texts])
    df = spark.createDataFrame(rows, TABLE).selectExpr("*", "0 AS epoch", "1 AS size")
    out = mixing.mixture(df)
    assert out.columns == ["doc_id", "text", "source", "epoch", "size", "epoch"]
    words: Counter = Counter()
    for r in out.collect():
        words[r[2]] += len(WORD.findall(r[1]))
        assert 1 <= r[5] <= 3
    want: Counter = Counter()
    for r in brute(rows).elements():
        want[r[3], r[2]] += r[4]
    share = targets({s: sum(len(WORD.findall(t or "")) for _, t, s2 in rows if s2 == s) for s in {r[2] for r in rows}})
    assert {s: n for s, n in words.items()} == {s: int(t + Fraction(1, 2)) for s, t in share.items() if t}
    assert sum(words.values()) == sum(want.values())


def test_query_equals_its_sql(spark):
    from lodestone.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES["op12_source_mixing"](spark, "/root/testdata/sf0.001").toPandas()
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(ORACLE_SQL["op12_source_mixing"]).df()[list(got.columns)]
    assert got.sort_values("doc_id").reset_index(drop=True).equals(want.sort_values("doc_id").reset_index(drop=True))
