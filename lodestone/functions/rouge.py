"""Title similarity by longest common subsequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words of a title that one number stands for: their bits and a carry fit a long.
WIDTH = 62
FULL = (1 << WIDTH) - 1


def word_masks(a: Column) -> Column:
    """(words, masks): the distinct words of an array, and of each the bits of its places, in numbers of WIDTH places."""
    distinct = F.array_distinct(a)
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / WIDTH).cast("int"))
    bit = lambda x, i, w: F.when(x == w, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    number = lambda w, k: F.aggregate(F.transform(F.slice(a, k * WIDTH + 1, F.lit(WIDTH)), lambda x, i: bit(x, i, w)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.struct(distinct.alias("words"), F.transform(distinct, lambda w: F.transform(blocks, lambda k: number(w, k))).alias("masks"))


def lcs_of(masks: Column, b: Column) -> Column:
    """Length of the longest common subsequence of the array that ``masks`` came from and ``b``, by bits.

    A row of the usual table is one bit a place: 0 where the length grows.  A
    word of ``b`` takes an addition and three bit operations for every WIDTH
    places; the carry goes on to the next number.  Zeros count the length.
    """
    known = F.filter(F.transform(b, lambda w: F.array_position(masks["words"], w)), lambda p: p > 0)
    steps = F.transform(known, lambda p: F.get(masks["masks"], (p - 1).cast("int")))
    full = F.lit(FULL).cast("long")

    def added(v: Column, m: Column, carry: Column) -> Column:
        return v + v.bitwiseAND(m) + carry

    def one(v: Column, m: Column) -> Column:
        """A row of one number: what the addition carries out of it is lost."""
        return added(v, m, F.lit(0).cast("long")).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)

    def several(row: Column, mask: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"))

        def number(s: Column, x: Column) -> Column:
            total = added(x["v"], x["m"], s["carry"])
            return F.struct(F.concat(s["out"], F.array(total.bitwiseOR(x["v"].bitwiseAND(F.bitwise_not(x["m"]))).bitwiseAND(full))).alias("out"), F.shiftright(total, WIDTH).alias("carry"))

        return F.aggregate(F.zip_with(row, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), start, number, lambda s: s["out"])

    short = F.bit_count(F.aggregate(F.transform(steps, lambda m: m[0]), full, one))
    n = F.size(F.get(masks["masks"], 0))
    long = F.aggregate(F.aggregate(steps, F.array_repeat(full, n), several), F.lit(0), lambda s, v: s + F.bit_count(v))
    return F.when(F.size(steps) == 0, 0).when(n == 1, WIDTH - short).otherwise(n * WIDTH - long).cast("int")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""
    return lcs_of(word_masks(a), b)


def words(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")


def rouge_of(n: Column, size_a: Column, size_b: Column) -> Column:
    """F measure of ``n`` common words in order, of titles of these sizes; 0 if a side has none."""
    p, r = F.try_divide(n, size_a), F.try_divide(n, size_b)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def rouge_l(a: Column, b: Column) -> Column:
    """F measure of the longest common subsequence of words; 0 if a side has none."""
    x, y = words(a), words(b)
    return rouge_of(lcs_length(x, y), F.size(x), F.size(y))
