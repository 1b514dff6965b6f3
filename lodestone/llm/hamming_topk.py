"""Exact top-k search on binary codes by incremental multi-index hashing.

A code is cut into m segments, each the key of an index.  A query probes the
segment values at growing radii, one segment after the other: when radius s is
done in segments 0 to j, every code within distance m * s + j has been met (one
at that distance or less agrees within s in one of those segments, or within
s - 1 in another).  A query ends when its kth verified distance is within
that bound, so the result is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm._shared import written

BITS = 64
#: Segment values that a query probes in one step, if it is more than one segment at one radius.
PROBES = 512


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set where element i is above 0; missing and null elements give 0."""
    parts = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    placed = F.transform(parts, lambda x, i: F.call_function("shiftleft", x, i))
    return F.aggregate(placed, F.expr("0L"), lambda a, x: a.bitwiseOR(x))


def _segments(n: int, bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments, none wider than log2 of the number of codes, or 8."""
    m = max(1, math.ceil(bits / max(8.0, math.log2(max(2, n)))))
    cuts = [round(j * bits / m) for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _value(code: Column, offset: int, width: int) -> Column:
    return F.call_function("shiftrightunsigned", code, F.lit(offset)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _probes(pending: DataFrame, segment: int, offset: int, width: int, radius: int) -> DataFrame:
    """The values at exactly ``radius`` from each query's segment: the executors flip one bit after another, each above the last."""
    out = pending.select("q", "bound", F.lit(segment).alias("pseg"), _value(F.col("q"), offset, width).alias("pvalue"), F.lit(-1).alias("last"))
    for r in range(radius):
        out = out.select("q", "bound", "pseg", "pvalue", F.explode(F.sequence(F.col("last") + 1, F.lit(width - radius + r))).alias("last"))
        out = out.withColumn("pvalue", F.col("pvalue").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("last"))))
    return out.drop("last")


def _steps(segments: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """(radius, segment) in order of growing radius, as many of one radius in a step as PROBES allows, one at least."""
    out: list[list[tuple[int, int]]] = []
    for s in range(max(w for _, w in segments) + 1):
        room = 0  # what a radius finds bounds what the next one looks at
        for j, (_, w) in enumerate(segments):
            if s <= w:
                if room < math.comb(w, s):
                    out.append([])
                    room = PROBES
                out[-1].append((s, j))
                room -= math.comb(w, s)
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS) -> DataFrame:
    """The k nearest rows of each query by Hamming distance, ties by smaller id.

    ``rows`` has id and code, ``queries`` the same columns; all are searched
    exactly, a query among the rows is its own first neighbour.  Returns
    query_id, rank (from 1), neighbor_id and distance.  Rows without id or
    code are in no index and give no query; fewer rows than k give them all;
    equal rows are ranked each; other columns are not read.
    """
    rows = rows.select("id", "code").where("id is not null and code is not null")
    # Rows of one code differ by id only: the k smallest ids stand for it, whatever its size.
    order = Window.partitionBy("code").orderBy("id")
    table = written(rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    n = table.count()
    segments = _segments(n, bits)
    m = len(segments)
    index = written(table.select("code", F.posexplode(F.array(*(_value(F.col("code"), o, w) for o, w in segments))).alias("seg", "value")))
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).where("query_id is not null and q is not null")
    pending = written(asked.select("q").distinct().withColumn("bound", F.lit(bits).cast("int")))
    best = pending.select("q", F.lit(None).cast("long").alias("code"), F.lit(0).alias("d")).where("code is not null")
    done = None
    steps = _steps(segments)
    for step in steps:
        probes = None
        for s, j in step:
            p = _probes(pending, j, *segments[j], s)
            probes = p if probes is None else probes.unionAll(p)
        # A code is taken where it is met first: at its least segment distance, in the first segment that has it.
        x = F.col("code").bitwiseXOR(F.col("q"))
        first = F.lit(False)
        for s, j in step:
            here = (F.col("seg") == j) & (F.bit_count(_value(x, *segments[j])) == s)
            for i, (o, w) in enumerate(segments):
                if i != j:
                    here = here & ((F.bit_count(_value(x, o, w)) > s) if i < j else (F.bit_count(_value(x, o, w)) >= s))
            first = first | here
        # A few bytes of queries become many probes, which no estimate of sizes sees: they meet the index by a shuffle, never as a broadcast.
        met = probes.hint("merge").join(index.hint("merge"), (F.col("seg") == F.col("pseg")) & (F.col("value") == F.col("pvalue")) & (F.bit_count(x) <= F.col("bound")) & first)
        found = best.unionAll(met.select("q", "code", F.bit_count(x).alias("d")))
        # k codes of least distance are enough, with all that tie with the last.
        near = found.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy("d"))).where(F.col("r") <= k).drop("r")
        best = written(near)
        got = best.join(table.select("code", F.size("ids").alias("n")), "code").groupBy("q", "d").agg(F.sum("n").alias("n"))
        got = got.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") >= k).groupBy("q").agg(F.min("d").cast("int").alias("kth"))
        last_s, last_j = step[-1]
        covered = m * last_s + last_j
        over = step is steps[-1] or covered >= bits
        state = pending.join(got, "q", "left").select("q", F.least("bound", "kth").alias("bound"), (F.coalesce(F.col("kth") <= covered, F.lit(False)) | F.lit(over)).alias("over"))
        state = written(state)
        ended = written(best.join(state.where("over").select("q"), "q", "left_semi"))  # so that the last plan only reads what each step found
        done = ended if done is None else done.unionAll(ended)
        pending = state.where("not over").select("q", "bound")
        best = best.join(pending.select("q"), "q", "left_semi")
        if not pending.head(1):
            break
    every = done.join(table, "code").select("q", "d", F.explode("ids").alias("neighbor_id"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "neighbor_id"))).where(F.col("rank") <= k)
    return asked.join(ranked, "q").select("query_id", F.col("rank").cast("long"), "neighbor_id", F.col("d").cast("long").alias("distance"))


def report(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, against all rows."""
    codes = written(embeddings.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")))
    return top_k(codes, codes.where("id % 50 = 0"), k)


ORACLE = """
WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
d AS (
  SELECT query_id, vec_id AS neighbor_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((coalesce(a[i], 0) > 0) <> (coalesce(embedding[i], 0) > 0) AS INT))) AS BIGINT) AS distance
  FROM q, embeddings WHERE embedding IS NOT NULL AND a IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""
