"""Top-k retrieval that leaves out postings which cannot matter, with exact results.

A term's postings lie in blocks by impact (the part of a score that does not
depend on the query); the index holds each block's size and greatest impact, a
bounded number of rows for each term.  A search knows before it reads any
posting what a block can add to a score at most:

1. The scores of a fixed sample of the papers give a first threshold: the kth
   best score of the sample is not above the kth best of all.
2. From each term's weakest blocks on, as many are skipped as can together not
   reach a share of the threshold, the most postings for the least contribution first.  A
   paper that is only in skipped blocks is not among the k best.
3. What the other blocks add up to is a lower bound of a paper's score, and
   with what the skipped ones could add an upper one.  The full scores of the
   papers of greatest lower bounds raise the threshold; the papers whose upper
   bounds reach it are candidates, and their scores are completed.

A term in nearly every paper of a tiny corpus may take from a score: it counts
in full scores, and as nothing in what a paper can reach at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.arxiv import month_ok
from lodestone.functions.text import tokens
from lodestone.operators.index import TermIndex, impact, level
from lodestone.plans.storage import discard, stored

#: Rows up to which asked terms, cuts and candidates are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Scores are ranked at nine decimals; a bound must be missed by more than their rounding to count as missed.
ROUNDING = 1e-7
#: One paper in so many is scored in full for the first threshold; so many times k papers for the second.
SAMPLE, SCORED = 64, 3
#: Share of the threshold that skipped blocks may take; the rest tells the papers of the other blocks apart.
SPENT = 0.5


def asked_terms(index: TermIndex, queries: DataFrame) -> DataFrame:
    """(qid, before_date, term, weight, df): weight times impact is what a posting adds to a query's score; repeated tokens count each time."""
    asked = queries.select("qid", "before_date", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "before_date", "term").agg(F.count("*").alias("qtf"))
    return asked.join(index.terms.select("term", "idf", "df"), "term").select("qid", "before_date", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "df")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table, marked for a broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _parts(index: TermIndex, terms: DataFrame, within: Column) -> DataFrame:
    """A row for each posting of the terms at the levels ``within`` and inside the cutoff: the terms' columns, the paper and its ``part`` of the score."""
    weighed = index.postings.crossJoin(F.broadcast(index.stats.select("avgdl"))).withColumn("impact", impact(F.col("tf"), F.col("dl"), F.col("avgdl"))).withColumn("level", level(F.col("impact")))  # one row
    hits = weighed.join(terms.withColumnRenamed("term", "_term"), (F.col("term") == F.col("_term")) & within)
    return hits.where(month_ok(F.col("date"), F.col("before_date"), keep_missing=False)).withColumn("part", F.col("weight") * F.col("impact"))


PAPER = ["qid", "paper_id", "ord", "date", "arxiv_id"]


def _full(index: TermIndex, terms: DataFrame, pairs: DataFrame, watch: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Scores of the pairs (qid, paper_id) over all their postings; few pairs and terms come to the postings, so that none of those is moved."""
    mine = index.postings.crossJoin(F.broadcast(index.stats.select("avgdl"))).join(small(pairs.select("qid", "paper_id")), "paper_id")
    hits = mine.join(small(terms.select("qid", "term", "weight")), ["qid", "term"])
    hits = watch(hits.withColumn("part", F.col("weight") * impact(F.col("tf"), F.col("dl"), F.col("avgdl"))), "scored")
    return hits.groupBy(*PAPER).agg(F.sum("part").alias("score")).where("score > 0")


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(qid, least): the kth best score of each query that has so many."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc()))
    return scores.select("qid", "score", place.alias("rn")).where(F.col("rn") <= k).groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select("qid", "least")


def _cuts(terms: DataFrame, blocks: DataFrame, least: DataFrame) -> DataFrame:
    """``terms`` with ``upto``, the level up to which a query skips the term's blocks (-1 for none), and ``lost``, what they add at most."""
    steps = Window.partitionBy("qid", "term").orderBy("level")
    upto = steps.rowsBetween(Window.unboundedPreceding, 0)
    rising = blocks.where("weight > 0").join(small(least), "qid").withColumn("step", F.col("most") - F.coalesce(F.lag("most").over(steps), F.lit(0.0)))
    # A block's price is what a skipped posting costs.  Up to the level at which a term's postings are cheapest on the whole, that
    # is their price; later blocks have their own, and none is skipped before those below it.
    rising = rising.withColumn("mean", F.col("most") / F.sum("n").over(upto))
    rising = rising.withColumn("cheapest", F.min(F.struct("mean", (-F.col("level")).alias("at"))).over(Window.partitionBy("qid", "term")))
    own = F.when(F.col("level") <= -F.col("cheapest.at"), F.col("cheapest.mean")).otherwise(F.greatest("cheapest.mean", F.col("step") / F.col("n")))
    rising = rising.withColumn("own", own).withColumn("price", F.max("own").over(upto))
    spent = F.sum("step").over(Window.partitionBy("qid").orderBy("price", "term", "level").rowsBetween(Window.unboundedPreceding, 0))
    skipped = rising.withColumn("spent", spent).where(F.col("spent") < F.col("least") * SPENT - ROUNDING).groupBy("qid", "term").agg(F.max("level").alias("upto"), F.max("most").alias("lost"))
    cuts = terms.join(skipped, ["qid", "term"], "left").withColumns({"upto": F.coalesce("upto", F.lit(-1)), "lost": F.coalesce("lost", F.lit(0.0))})
    return cuts.select("qid", "before_date", "term", "weight", "upto", "lost")


def best(index: TermIndex, queries: DataFrame, k: int, without: Callable[[DataFrame], DataFrame] = lambda scores: scores, counts: dict[str, int] | None = None) -> DataFrame:
    """Rows as of ``bm25_scores`` that hold the ``k`` best papers of each query, and few others, with their exact scores.

    ``without`` takes rows with qid, paper_id and arxiv_id and leaves out those
    that no page may have; it is applied before any paper counts.  ``counts``
    gets the number of postings that took part in a sum.
    """
    watched: list[Observation] = []

    def watch(hits: DataFrame, name: str) -> DataFrame:
        if counts is None:
            return hits
        watched.append(Observation())
        return hits.observe(watched[-1], F.count("*").alias(name))

    terms = stored(asked_terms(index, queries).drop("df"))
    blocks = index.blocks.join(small(terms), "term").withColumn("most", F.greatest(F.col("weight"), F.lit(0.0)) * F.col("most"))
    blocks = stored(blocks.select("qid", "before_date", "term", "weight", "level", "n", "most"))

    # 1. The sample's threshold.
    sampled = F.pmod(F.xxhash64("paper_id"), F.lit(SAMPLE)) == 0
    some = watch(_parts(index, small(terms), sampled), "sampled")
    least = stored(_kth(without(some.groupBy("qid", "paper_id", "arxiv_id").agg(F.sum("part").alias("score"))), k))

    # 2. What is skipped.
    cuts = stored(_cuts(terms, blocks, least))
    lost = stored(cuts.groupBy("qid").agg(F.sum("lost").alias("all_lost")).join(least, "qid", "left"))

    # 3. Bounds, the second threshold, candidates and their full scores.
    read = watch(_parts(index, small(cuts), (F.col("level") > F.col("upto")) & (F.col("weight") > 0)), "read")
    held = without(read.groupBy(*PAPER).agg(F.sum("part").alias("score"), F.sum(F.col("part") - F.col("lost")).alias("over")))
    reach = F.col("over") + F.col("all_lost")
    held = stored(held.join(small(lost), "qid").withColumn("reach", reach).where(F.col("least").isNull() | (F.col("reach") >= F.col("least") - ROUNDING)).select(*PAPER, "score", "reach"))
    top = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "paper_id"))
    first = stored(held.withColumn("rn", top).where(F.col("rn") <= k * SCORED).select("qid", "paper_id"))
    raised = stored(_kth(_full(index, terms, first, watch), k))
    wanted = stored(held.join(small(raised), "qid", "left").where(F.col("least").isNull() | (F.col("reach") >= F.col("least") - ROUNDING)).select(*PAPER, "score"))
    rest = _parts(index, small(cuts), (F.col("level") <= F.col("upto")) | (F.col("weight") < 0)).select("qid", "paper_id", "part")
    rest = watch(rest.join(small(wanted.select("qid", "paper_id")), ["qid", "paper_id"]), "completed")
    parts = wanted.select(*PAPER, "score").unionByName(wanted.select(*PAPER).join(rest.groupBy("qid", "paper_id").agg(F.sum("part").alias("score")), ["qid", "paper_id"]))
    out = parts.groupBy(*PAPER).agg(F.sum("score").alias("score")).where("score > 0")
    if counts is not None:
        out = stored(out)
        counts.update({"postings": sum(sum(o.get.values()) for o in watched), "candidates": wanted.count()})
    discard(blocks, least, lost, held, first, raised)
    return out
