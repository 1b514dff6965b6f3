"""Retrieval-quality metrics over tables of ids.

``truth`` is (qid, paper_id); ``retrieved`` and ``selected`` are (qid, iter,
sq_id, paper_id).  Ids count once; an empty denominator gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.search import NOT_FOUND


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def distance(rank: Column, cutoff: int) -> Column:
    return F.greatest(1 - rank / cutoff, F.lit(0.0))


def _flags(truth: DataFrame, retrieved: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each id of a group: retrieved, selected, ground truth."""
    ids = [*keys, "paper_id"]
    both = retrieved.select(*ids, F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(selected.select(*ids, F.lit(0).alias("r"), F.lit(1).alias("s")))
    one = both.groupBy(*ids).agg(F.max("r").alias("r"), F.max("s").alias("s"))
    return one.join(truth.select("qid", "paper_id").distinct().withColumn("g", F.lit(1)), ["qid", "paper_id"], "left").fillna(0, ["g"])


def set_metrics(truth: DataFrame, retrieved: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall before and after selection, counts, and the discard ratios of each group of ``keys``.

    ``discarded_ratio`` is discarded ground truth over all discarded,
    ``missed_gt_ratio`` over all retrieved, ``discarded_gt_share`` over
    retrieved ground truth.
    """
    n = truth.select("qid", "paper_id").distinct().groupBy("qid").agg(F.count("*").alias("total_gt"))
    count = lambda c: F.count_if(F.expr(c))
    got = _flags(truth, retrieved, selected, keys).groupBy(*keys).agg(count("r = 1").alias("retrieved_count"), count("s = 1").alias("selected_count"), count("r = 1 AND g = 1").alias("retrieval_matches"), count("s = 1 AND g = 1").alias("matches"), count("r = 1 AND s = 0").alias("discarded_count"), count("r = 1 AND s = 0 AND g = 1").alias("discarded_gt_count"))
    c = F.col
    return got.join(n, "qid", "left").fillna(0, ["total_gt"]).withColumns(
        {
            "recall": ratio(c("matches"), c("total_gt")), "precision": ratio(c("matches"), c("selected_count")), "retrieval_recall": ratio(c("retrieval_matches"), c("total_gt")), "retrieval_precision": ratio(c("retrieval_matches"), c("retrieved_count")),
            "discarded_ratio": ratio(c("discarded_gt_count"), c("discarded_count")), "missed_gt_ratio": ratio(c("discarded_gt_count"), c("retrieved_count")), "discarded_gt_share": ratio(c("discarded_gt_count"), c("retrieval_matches")),
        }
    )


def subquery_metrics(truth: DataFrame, retrieved: DataFrame, selected: DataFrame) -> DataFrame:
    return set_metrics(truth, retrieved, selected, ["qid", "iter", "sq_id"])


def iteration_metrics(truth: DataFrame, retrieved: DataFrame, selected: DataFrame) -> DataFrame:
    return set_metrics(truth, retrieved, selected, ["qid", "iter"])


def cumulative_metrics(truth: DataFrame, retrieved: DataFrame, selected: DataFrame) -> DataFrame:
    """Metrics of the union of all iterations so far: each id counts from the first iteration that has it.

    ``total_discarded_gt_count`` is a running sum, in which a paper discarded
    twice counts twice.
    """
    first = lambda t, name: t.groupBy("qid", "paper_id").agg(F.min("iter").alias("iter")).join(truth.select("qid", "paper_id").distinct().withColumn("g", F.lit(1)), ["qid", "paper_id"], "left").groupBy("qid", "iter").agg(F.count("*").alias(name), F.count("g").alias(f"{name}_gt"))
    iters = iteration_metrics(truth, retrieved, selected).select("qid", "iter", "total_gt", "discarded_gt_count", "missed_gt_ratio")
    joined = iters.join(first(retrieved, "r"), ["qid", "iter"], "left").join(first(selected, "s"), ["qid", "iter"], "left").fillna(0, ["r", "r_gt", "s", "s_gt"])
    upto = Window.partitionBy("qid").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    run = joined.select("qid", "iter", "total_gt", "missed_gt_ratio", F.sum("r").over(upto).alias("retrieved_count"), F.sum("s").over(upto).alias("selected_count"), F.sum("r_gt").over(upto).alias("retrieval_matches"), F.sum("s_gt").over(upto).alias("matches"), F.sum("discarded_gt_count").over(upto).alias("total_discarded_gt_count"))
    c = F.col
    return run.withColumns({"recall": ratio(c("matches"), c("total_gt")), "precision": ratio(c("matches"), c("selected_count")), "retrieval_recall": ratio(c("retrieval_matches"), c("total_gt")), "retrieval_precision": ratio(c("retrieval_matches"), c("retrieved_count"))})


def at_k(truth: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Recall and precision of the first k ranks (0-based ``rank``); precision is over the distinct ids there, not over k."""
    cut = ranked.select("qid", "paper_id", "rank", F.explode(F.lit(list(ks))).alias("k")).where("rank < k").select("qid", "k", "paper_id").distinct()
    t = truth.select("qid", "paper_id").distinct()
    n = t.groupBy("qid").agg(F.count("*").alias("total_gt"))
    got = cut.join(t.withColumn("g", F.lit(1)), ["qid", "paper_id"], "left").groupBy("qid", "k").agg(F.count("*").alias("found"), F.count("g").alias("matches"))
    grid = n.select("qid", "total_gt", F.explode(F.lit(list(ks))).alias("k"))
    full = grid.join(got, ["qid", "k"], "left").fillna(0, ["found", "matches"])
    return full.select("qid", "k", "matches", "total_gt", ratio(F.col("matches"), F.col("total_gt")).alias("recall"), ratio(F.col("matches"), F.col("found")).alias("precision"))


def simple_distance(truth: DataFrame, ranks: DataFrame, cutoff: int = 100) -> DataFrame:
    """Mean distance over all ground truth by its least rank (qid, paper_id, rank); what has none counts 0."""
    least = ranks.groupBy("qid", "paper_id").agg(F.min("rank").alias("rank"))
    return truth.select("qid", "paper_id").distinct().join(least, ["qid", "paper_id"], "left").groupBy("qid").agg(F.avg(F.coalesce(distance(F.col("rank"), cutoff), F.lit(0.0))).alias("avg_distance"))


def rank_history(gt_ranks: DataFrame, selected: DataFrame, cutoff: int = 100, missing: int = NOT_FOUND) -> DataFrame:
    """Least rank and distance of each ground-truth paper by iteration (``gt_ranks``: qid, iter, sq_id, paper_id, rank).

    From the iteration that first selects a paper on, its least rank so far
    counts, because later searches leave selected papers out.
    """
    now = gt_ranks.groupBy("qid", "iter", "paper_id").agg(F.min(F.coalesce("rank", F.lit(missing))).alias("now"))
    first = selected.groupBy("qid", "paper_id").agg(F.min("iter").alias("selected_at"))
    upto = Window.partitionBy("qid", "paper_id").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    least = now.join(first, ["qid", "paper_id"], "left").withColumn("best", F.min("now").over(upto))
    rank = F.when(F.col("selected_at") <= F.col("iter"), F.col("best")).otherwise(F.col("now"))
    return least.select("qid", "iter", "paper_id", rank.alias("rank")).withColumn("distance", distance(F.col("rank"), cutoff))


def average_distance(history: DataFrame) -> DataFrame:
    """Mean of a query's distances by iteration; no row without ground truth."""
    return history.groupBy("qid", "iter").agg(F.avg("distance").alias("avg_distance"))


def carry_forward(values: DataFrame, max_iterations: int, columns: list[str]) -> DataFrame:
    """(qid, iter 1 to max_iterations): a query's last values stand for the iterations that it did not reach."""
    grid = values.select("qid").distinct().select("qid", F.explode(F.sequence(F.lit(1), F.lit(max_iterations))).alias("iter"))
    upto = Window.partitionBy("qid").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(values, ["qid", "iter"], "left").select("qid", "iter", *(F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns))


def macro_means(values: DataFrame, columns: list[str]) -> DataFrame:
    return values.groupBy("iter").agg(*(F.avg(c).alias(f"avg_{c}") for c in columns))


def non_negative_means(values: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over values of 0 or more; -1 marks what was not measured."""
    return values.groupBy(*(by or [])).agg(*(F.avg(F.when(F.col(c) >= 0, F.col(c))).alias(f"avg_{c}") for c in columns))


def success_counts(values: DataFrame, success: Column, by: list[str] | None = None) -> DataFrame:
    """All rows and those of them that succeeded."""
    return values.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(success).alias("successful"))


def final_papers(selected: DataFrame) -> DataFrame:
    """Distinct selected papers (qid, seq, paper_id, payload): first place, last payload."""
    return selected.groupBy("qid", "paper_id").agg(F.min("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def timings(rows: DataFrame) -> DataFrame:
    """Phase seconds to three decimals, and what the total has beyond them."""
    phases = ["planner", "retrieval", "selector", "browser"]
    rest = F.col("total") - sum((F.col(p) for p in phases), F.lit(0.0))
    return rows.withColumn("overhead", F.round(rest, 3)).withColumns({c: F.round(c, 3) for c in [*phases, "total"]})
