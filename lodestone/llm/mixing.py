"""Mixing sources to target weights.

Every document gets a hash-random key; the keys are sorted by range within
each source, and distributed prefix sums of the documents' sizes (a running
sum in each range, and the sums of the ranges before it) give each document
the words that lie before it in its source.  A source's budget is as many
whole epochs as fit, and then the documents from the beginning until the
budget is met exactly: the last of them is cut.

Targets are exact: shares are fractions of whole numbers, and what a source
cannot take, since it stops at a multiple of its size, is shared again by
weight among the others until none is above its limit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm._arrow import map_arrow
from lodestone.llm._shared import written

WEIGHTS, EPOCHS = (1, 2, 3), 3
#: Ranges for each shuffle partition of the session: a range is what one task sorts.
RANGES = 2


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but space and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(seed: str, *columns: Column) -> Column:
    """Sixteen hex digits that depend on the values alone, so that reruns agree."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(c.cast("string") for c in columns)).cast("binary")), 1, 16)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row of a sorted partition the sizes of its source's rows up to it; what is held is one batch and one sum."""
    last, total = None, 0
    for batch in batches:
        rank, size = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_rank", "_size"))
        if not len(rank):
            continue
        sums = np.cumsum(size)
        first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        start = np.concatenate(([0], sums[:-1]))[first]
        if rank[0] == last:
            start[0] -= total
        upto = sums - np.repeat(start, np.diff(np.append(first, len(rank))))
        last, total = rank[-1], int(upto[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, pa.int64())], names=[*batch.schema.names, "_upto"])


def with_prefix_sums(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with _rank, the number of their group, and _size) with _before: the sizes of the group's rows that come before in ``order``.

    Rows are sorted by ranges of (_rank, order); a group of any size lies in as
    many ranges as it fills.  Only each range's sums by group go further.
    """
    ranges = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, "_rank", *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_rank", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", _upto long"
    ordered = written(map_arrow(dealt, _running, schema))  # the ranges are fixed from here on
    sums = ordered.groupBy("_rank", "_range").agg(F.max("_upto").alias("_sum"))
    # One row for each range of a group, in the order of the ranges.
    earlier = F.sum("_sum").over(Window.partitionBy("_rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(sums.select("_rank", "_range", F.coalesce(earlier, F.lit(0)).alias("_start")))
    return ordered.join(starts, ["_rank", "_range"]).withColumn("_before", F.col("_start") + F.col("_upto") - F.col("_size")).drop("_start", "_upto", "_range")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, _rank, source_size, target, budget) of each source of ``sizes`` (source, _size).

    Sources count by code point, null last; weights go round.  A target is the
    source's share of all sizes by weight; those above ``epochs`` times their
    size stop there, and the rest is shared anew until none is above.  Each
    round is one sum over the sources: one fraction is all that is kept.
    """
    totals = written(sizes.groupBy("source").agg(F.sum("_size").alias("source_size")))
    numbered = totals.withColumns({"_size": F.lit(1).cast("long"), "_rank": F.lit(0).cast("long"), "_last": F.col("source").isNull().cast("int")})
    places = with_prefix_sums(numbered, ["_last", "source"])
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("_before") % len(weights) + 1).cast("int"))
    sources = written(places.select("source", "source_size", F.col("_before").alias("_rank"), weight.alias("weight"), (F.col("source_size") * epochs).alias("most")))
    whole = sources.agg(F.sum(F.col("source_size").cast("decimal(30,0)")).alias("total"), F.sum("weight").alias("weight")).first()
    total, part, capped = int(whole.total or 0), Fraction(int(whole.total or 0), int(whole.weight or 1)), None
    exact = lambda n, digits: F.lit(str(n)).cast(f"decimal({digits},0)")
    above = lambda: F.col("most").cast("decimal(19,0)") * exact(part.denominator, 19) < F.col("weight").cast("decimal(10,0)") * exact(part.numerator, 28)
    while True:
        stopped = sources.select(above().alias("above"), F.col("most").cast("decimal(30,0)").alias("most"), "weight")
        row = stopped.agg(F.count_if("above").alias("n"), F.sum(F.when(F.col("above"), F.col("most"))).alias("most"), F.sum(F.when(~F.col("above"), F.col("weight"))).alias("open")).first()
        if row.n == capped or not row.open:
            break
        capped, part = row.n, Fraction(total - int(row.most or 0), int(row.open))
    share = (F.col("weight").cast("decimal(10,0)") * exact(part.numerator, 28)).cast("double") / F.lit(float(part.denominator))
    target = F.when(above(), F.col("most").cast("double")).otherwise(share)
    return sources.select("source", "_rank", "source_size", target.alias("target"), F.floor(target + 0.5).alias("budget"))


def plan(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """The columns ``keep`` of every document with size, source_size, target and taken (words of it in the mix, repeats counted).

    A source's ``taken`` add up to its target, rounded to whole words: no
    document exceeds ``epochs`` times its size, and two documents of a source
    differ by one epoch at most, but for the one that is cut.
    """
    text, source = F.col("text"), F.col("source").cast("string")
    fields = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    # The last column only tells equal rows apart, which are interchangeable.
    sized = written(docs.select(fields.alias("_row"), source.alias("source"), size_of(text).alias("_size"), random_key(seed, F.col("doc_id"), text).alias("_key"), F.col("doc_id").alias("_id"), F.monotonically_increasing_id().alias("_at")))
    targets = written(source_targets(sized, weights, epochs))
    known = targets.withColumnRenamed("source", "_source")
    ranked = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    placed = with_prefix_sums(ranked, ["_key", "_id", "_size", "_at"])
    full = F.expr("coalesce(budget div nullif(source_size, 0), 0)")
    rest = F.col("budget") - full * F.col("source_size") - F.col("_before")
    taken = full * F.col("_size") + F.greatest(F.lit(0), F.least(rest, F.col("_size")))
    mixed = placed.withColumn("_taken", taken.cast("long"))
    return mixed.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(keep)), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """The mixed texts: a row of ``docs`` for each epoch that takes it, with the number of the epoch (from 1) as ``epoch`` in the last column.

    The document at a source's cut has only its first words in its last
    epoch, as many as the budget asks for, with single spaces between.  Documents without words are in no
    mix.  A column of ``docs`` called ``epoch`` keeps its name beside it.
    """
    names = {c: f"c{i}_{uuid.uuid4().hex[:8]}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), *(F.col(c) for c in ("doc_id", "text", "source")))
    planned = plan(inner, list(names.values()), weights, epochs, seed).where("taken > 0")
    each = planned.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    text = names["text"]
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), words.cast("int")), " ")
    whole = F.when(words < F.col("size"), cut).otherwise(F.col(text))
    return each.withColumn(text, whole).select(*(F.col(n).alias(c) for c, n in names.items()), "epoch")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``documents``.

    A null text has size 0, a null source is the last one, a null doc_id is a
    value of its own; repeated rows count each, an empty table gives no rows,
    and a source without words has target 0.  Other columns are not read.
    """
    return plan(documents.select("doc_id", "text", "source"), ["doc_id"])


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, substr(md5(concat_ws(':', 'mix', doc_id, text)), 1, 16) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST({EPOCHS} * sum(size) AS BIGINT) AS most FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most::DOUBLE / weight, source) AS i FROM w),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
f AS (SELECT arg_min(room, i) AS room, arg_min(open, i) AS open FROM l WHERE most * open >= room * weight),
t AS (SELECT source, source_size, CASE WHEN most * f.open < f.room * weight THEN most::DOUBLE ELSE (weight * f.room)::DOUBLE / f.open::DOUBLE END AS target FROM l, f),
b AS (SELECT source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget, CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM p
"""
