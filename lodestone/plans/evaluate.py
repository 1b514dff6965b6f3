"""Benchmark evaluation: from a workflow's tables to the summary record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.metrics import average_distance, carry_forward, cumulative_metrics, f1, macro_means, non_negative_means, rank_history
from lodestone.plans.storage import stored
from lodestone.plans.workflow import DeepRun

CARRIED = ["recall", "precision", "retrieval_recall", "retrieval_precision", "missed_gt_ratio"]


def query_iterations(run: DeepRun, truth: DataFrame, cutoff: int = 100) -> DataFrame:
    """(qid, iter) with cumulative metrics and the average distance, -1 where there is none."""
    metrics = cumulative_metrics(truth, run.retrieved, run.selected)
    distance = average_distance(rank_history(run.gt_ranks, run.selected, cutoff))
    return metrics.join(distance, ["qid", "iter"], "left").fillna(-1.0, ["avg_distance"])


def summary(iterations: DataFrame, max_iterations: int = 5) -> DataFrame:
    """One row of each iteration: macro means with last values carried forward, distances of the iterations reached, and F1 of the means."""
    carried = macro_means(carry_forward(iterations, max_iterations, CARRIED), CARRIED)
    reached = non_negative_means(iterations, ["avg_distance"], ["iter"])
    out = carried.join(reached, "iter", "left")
    return out.withColumn("f1", f1(F.col("avg_precision"), F.col("avg_recall"))).withColumn("retrieval_f1", f1(F.col("avg_retrieval_precision"), F.col("avg_retrieval_recall")))


def macro_missed(by_iteration: DataFrame) -> DataFrame:
    """The mean over iterations of the mean missed ratio."""
    return by_iteration.agg(F.avg("avg_missed_gt_ratio").alias("macro_missed_gt_ratio"))


def summary_metrics(by_iteration: DataFrame) -> DataFrame:
    """(name, value) of each metric and iteration, as a record's fields are called."""
    names = [c for c in by_iteration.columns if c != "iter"]
    return by_iteration.select("iter", F.explode(F.create_map(*(x for c in names for x in (F.lit(c), F.col(c).cast("double"))))).alias("n", "value")).select(F.concat("n", F.lit("_iter_"), F.col("iter").cast("string")).alias("name"), "value")


def evaluate(rows: DataFrame, done: DataFrame | None, run_queries, truth: DataFrame, max_iterations: int = 5) -> tuple[DataFrame, DataFrame]:
    """Evaluates the queries (idx, qid, query, before_date) that ``done`` (per-query iteration rows with idx) lacks; (per-query rows, summary).

    Queries without ground truth are left out.  The summary is made from old
    and new rows alike, so that a resumed run loses nothing.
    """
    asked = rows.join(truth.select("qid").distinct(), "qid", "left_semi")
    if done is not None:
        asked = asked.join(done.select("idx").distinct(), "idx", "left_anti")
    asked = stored(asked)
    new = query_iterations(run_queries(asked), truth).join(asked.select("idx", "qid"), "qid")
    every = stored(new if done is None else new.unionByName(done.select(*new.columns)))
    return every, summary(every, max_iterations)
