"""The retrieval workflows: all queries advance together, one iteration at a time.

``SimpleWorkflow`` searches generated keys once.  ``deep_research`` repeats
plan, retrieve, select: its state is a few tables, of which each iteration
writes what it adds, so that a plan never grows with the number of iterations.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.index import TermIndex
from lodestone.operators.metrics import at_k, set_metrics, simple_distance
from lodestone.operators.search import MAX_PAGES, MAX_RESULTS, NOT_FOUND, combine, ground_truth_ranks, page
from lodestone.operators.slices import Meeting, bm25_meeting
from lodestone.plans.agents import Planner, Selector, browsed
from lodestone.plans.runlog import RunLog, fingerprint
from lodestone.plans.storage import discard, stored

STATE = "qid long, iter int, sq_id int, source int, text string, target_k int, link_type string"
HITS = "qid long, iter int, sq_id int, paper_id long, rank long, score double"
#: What a run's log holds, by iteration.
TABLES = {"states": STATE, "retrieved": HITS, "selected": HITS, "ranks": "qid long, iter int, sq_id int, paper_id long, rank long, total long", "ended": "qid long, status string"}


def resolve_plan(plan: DataFrame, states: DataFrame, iteration: int) -> DataFrame:
    """Plan items (qid, item, link_type, source_id, text, target_k) as subqueries of this iteration.

    ``states`` has one row for each earlier page (STATE).  derive and expand
    with a text get the next free ids in item order; continue takes over the
    text and source of a known subquery with fewer than three pages; of several
    items of one subquery the last counts; all others go.
    """
    latest = states.groupBy("qid", "sq_id").agg(F.count("*").alias("pages"), F.max_by(F.struct("source", "text"), "iter").alias("last"))
    top = states.groupBy("qid").agg(F.max("sq_id").alias("top"))
    fresh = plan.where("link_type IN ('derive', 'expand') AND coalesce(text, '') <> ''").join(top, "qid", "left")
    number = F.row_number().over(Window.partitionBy("qid").orderBy("item"))
    new = fresh.select("qid", "item", (F.coalesce("top", F.lit(0)) + number).cast("int").alias("sq_id"), F.coalesce("source_id", F.lit(0)).alias("source"), "text", "target_k", "link_type")
    again = plan.where("link_type = 'continue'").withColumnRenamed("text", "_").join(latest.withColumnRenamed("sq_id", "source_id"), ["qid", "source_id"]).where(F.col("pages") < MAX_PAGES)
    old = again.select("qid", "item", F.col("source_id").alias("sq_id"), F.col("last.source").alias("source"), F.col("last.text").alias("text"), "target_k", "link_type")
    both = new.unionByName(old).groupBy("qid", "sq_id").agg(F.max_by(F.struct("source", "text", "target_k", "link_type"), "item").alias("s"))
    return both.select("qid", F.lit(iteration).alias("iter"), "sq_id", "s.source", "s.text", F.least(F.coalesce("s.target_k", F.lit(MAX_RESULTS)), F.lit(MAX_RESULTS)).alias("target_k"), "s.link_type")


def subquery_paths(states: DataFrame) -> DataFrame:
    """(qid, sq_id, level, path) of the subquery tree by parent pointers; 0 is the root.

    Each step doubles the length of what a subquery knows of its path: to what
    it has it adds what the node at its upper end has.  So a tree of any depth
    takes the logarithm of it in steps, and one table is kept.  Subqueries
    that no root leads to are left out, circles among them.
    """
    nodes = states.groupBy("qid", "sq_id").agg(F.max_by("source", "iter").alias("up"))
    # ``path`` leads from below ``up`` to the subquery itself; of a whole one ``up`` is the root.
    held = stored(nodes.select("qid", "sq_id", "up", F.lit(1).alias("level"), F.col("sq_id").cast("string").alias("path")))
    most, reach = held.groupBy("qid").count().agg(F.max("count")).first()[0] or 0, 1
    while reach < most and held.where("up <> 0").head(1):
        above = held.select("qid", F.col("sq_id").alias("up"), F.col("up").alias("over"), F.col("level").alias("levels"), F.col("path").alias("head"))
        done = held.where("up = 0")
        longer = held.where("up <> 0").join(above, ["qid", "up"]).select("qid", "sq_id", F.col("over").alias("up"), (F.col("level") + F.col("levels")).alias("level"), F.concat("head", F.lit("/"), "path").alias("path"))
        last, held = held, stored(done.unionByName(longer))
        discard(last)
        reach *= 2
    return held.where("up = 0").select("qid", "sq_id", "level", F.concat(F.lit("0/"), "path").alias("path"))


def iteration_texts(states: DataFrame, iteration: int) -> DataFrame:
    """(qid, last, previous): lines of the iteration before and of earlier ones, 'none' where there are none."""
    # Fixed value: the line format that planners read.
    line = F.format_string('id=%d | iteration=%d | text="%s" | target_k=%d | retrieved=%d | selected=%d | selector_overview="%s"', "sq_id", "iter", "text", "target_k", "retrieved", "selected", F.trim(F.replace(F.coalesce("overview", F.lit("")), F.lit("\n"), F.lit(" "))))
    rows = states.withColumn("line", F.struct("sq_id", "iter", line.alias("line")))
    joined = lambda when: F.coalesce(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.col("line")))), lambda x: x["line"]), "\n"), F.lit("")), F.lit("none"))
    return rows.groupBy("qid").agg(joined(F.col("iter") == iteration - 1).alias("last"), joined(F.col("iter") < iteration - 1).alias("previous"))


def page_at(scores: DataFrame, asked: DataFrame) -> DataFrame:
    """The page of each subquery from its own offset, in one ranking."""
    top = MAX_PAGES * MAX_RESULTS
    ranked = page(scores, top).join(asked.select("qid", "offset", "target_k"), "qid")
    return ranked.where((F.col("rank") >= F.col("offset")) & (F.col("rank") < F.col("offset") + F.col("target_k")))


@dataclass
class DeepRun:
    """``states`` (STATE), ``retrieved`` and ``selected`` (qid, iter, sq_id, paper_id, rank, score), ``gt_ranks`` (qid, iter, sq_id, paper_id, rank, total), ``status`` (qid, status), ``phases`` (iter, phase, rows, seconds)."""

    states: DataFrame
    retrieved: DataFrame
    selected: DataFrame
    gt_ranks: DataFrame
    status: DataFrame
    phases: DataFrame | None = None


Scorer = Callable[[DataFrame], DataFrame | Meeting]
Finished = Callable[[int, DataFrame], DataFrame]


@dataclass
class Browsing:
    """How contents (paper_id, browsing_content) come into the selection: a mode of ``browsed``, and which candidates the selector wants read (qid, sq_id, paper_id)."""

    mode: str
    contents: DataFrame
    wanted: Selector | None = None


def selection(found: DataFrame, selector: Selector, browsing: Browsing | None = None) -> DataFrame:
    """What the selector keeps of the candidates (qid, iter, sq_id, paper_id, rank, score).

    PRE_ENRICH reads all candidates before.  The other modes read the wanted
    ones after a first selection and select again: REFRESH among all
    candidates of the subqueries that wanted any, whose first selection is
    dropped, INCREMENTAL among the wanted ones, which adds to the first.
    """
    keep = lambda c: selector(c).select(*found.columns)
    if browsing is None or browsing.mode == "NONE":
        return keep(browsed(found, found, found, "NONE")) if browsing else keep(found)
    if browsing.mode == "PRE_ENRICH":
        return keep(browsed(found, found, browsing.contents, "PRE_ENRICH"))
    first = keep(browsed(found, found, found, "NONE"))
    wanted = browsing.wanted(found).select("qid", "sq_id", "paper_id").distinct()
    some = found.join(wanted, ["qid", "sq_id", "paper_id"], "left_semi")
    if browsing.mode == "INCREMENTAL":
        return first.unionByName(keep(browsed(some, some, browsing.contents, "REFRESH"))).distinct()
    asked = wanted.select("qid", "sq_id").distinct()
    read = some.join(browsing.contents, "paper_id").select("qid", "sq_id", "paper_id", "browsing_content")
    again = found.join(asked, ["qid", "sq_id"], "left_semi").join(read, ["qid", "sq_id", "paper_id"], "left")
    return first.join(asked, ["qid", "sq_id"], "left_anti").unionByName(keep(again))


def _best_and_ranks(scores: DataFrame | Meeting, most: int, truth: DataFrame, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that hold the ``most`` best papers of each query, and ranks of ``truth``, without the papers that are ``gone`` (qid, paper_id)."""
    if isinstance(scores, Meeting):
        return scores.best_and_ranks(most, truth, NOT_FOUND, gone)
    left = scores if gone is None else scores.join(gone, ["qid", "paper_id"], "left_anti")
    return left, ground_truth_ranks(left, truth)


def deep_research(index: TermIndex | None, queries: DataFrame, truth: DataFrame, planner: Planner, selector: Selector, iterations: int = 5, stable_paging: bool = False, scorer: Scorer | None = None, finished: Finished | None = None, browsing: Browsing | None = None, log: str | None = None) -> DeepRun:
    """Runs all queries (qid, query, before_date) for up to ``iterations``.

    ``scorer`` gives the scores of subqueries (qid, query, before_date) by any
    method, as rows or as a meeting of slices, BM25 of ``index`` unless given.  Papers that a query has selected
    are left out of its later searches.  The offset of a subquery is the
    number of papers that it has retrieved, which skips unseen papers once
    some are left out; ``stable_paging`` subtracts those.

    A query ends where ``finished`` (iteration, states) names its qid:
    'complete' if it has selected a paper, else 'failed'; and where it has no
    subqueries, 'failed'.  Ended queries take no part in what follows; the
    others are 'finished' after the last iteration.

    With a folder ``log`` a run that broke off goes on, when called again with
    the same queries, after the last iteration that ended: neither its planner
    nor its searches are asked for again.
    """
    spark = queries.sparkSession
    kept = RunLog(spark, TABLES, fingerprint(queries.select("qid", "query", "before_date")), log)
    scorer = scorer or (lambda asked: bm25_meeting(index, asked))
    for i in range(kept.last + 1, iterations + 1):
        if kept.over:
            break
        states, retrieved, selected, ended = (kept.table(t, i - 1) for t in ("states", "retrieved", "selected", "ended"))
        live = queries.select("qid").join(ended, "qid", "left_anti")
        over = live.limit(0)
        if finished is not None:
            over = live.join(finished(i, states).select("qid").distinct(), "qid", "left_semi")
        some = selected.select("qid").distinct().withColumn("any", F.lit(True))
        out = over.join(some, "qid", "left").select("qid", F.when(F.col("any"), "complete").otherwise("failed").alias("status"))
        live = live.join(over, "qid", "left_anti")
        now = kept.add("states", i, resolve_plan(planner(i, states).join(live, "qid", "left_semi"), states, i), "planner")
        idle = live.join(now.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit("failed").alias("status"))
        kept.add("ended", i, out.unionByName(idle))
        if not now.head(1):
            for t in ("retrieved", "selected", "ranks"):
                kept.add(t, i, spark.createDataFrame([], TABLES[t]))
            kept.end(i, over=True)
            break
        seen = retrieved.groupBy("qid", "sq_id").agg(F.count("*").alias("seen"))
        if stable_paging:
            gone = retrieved.join(selected.select("qid", "paper_id").distinct(), ["qid", "paper_id"]).groupBy("qid", "sq_id").agg(F.count("*").alias("gone"))
            seen = seen.join(gone, ["qid", "sq_id"], "left").select("qid", "sq_id", (F.col("seen") - F.coalesce("gone", F.lit(0))).alias("seen"))
        key = F.struct("qid", "sq_id")
        asked = now.join(queries.select("qid", "before_date"), "qid").join(seen, ["qid", "sq_id"], "left").select(key.alias("qid"), F.col("text").alias("query"), "before_date", "target_k", F.coalesce("seen", F.lit(0)).alias("offset"))
        banned = selected.select("qid", "paper_id").distinct()
        scores = scorer(asked.select("qid", "query", "before_date"))
        pairs = now.select("qid", "sq_id").join(truth, "qid").select(key.alias("qid"), "paper_id")
        gone = now.select("qid", "sq_id").join(banned, "qid").select(key.alias("qid"), "paper_id")
        begin = time.monotonic()
        best, places = _best_and_ranks(scores, MAX_PAGES * MAX_RESULTS, pairs, gone)
        pages = page_at(best, asked).select("qid", "paper_id", "rank", "score", F.lit(None).cast("long").alias("total"))
        places = places.select("qid", "paper_id", "rank", F.lit(None).cast("double").alias("score"), "total")
        both = stored(pages.unionByName(places))
        at = ["qid.qid", F.lit(i).alias("iter"), "qid.sq_id", "paper_id", "rank"]
        kept.add("ranks", i, both.where("total IS NOT NULL").select(*at, "total"))
        found = kept.add("retrieved", i, both.where("total IS NULL").select(*at, "score"), "retrieval", begin)
        kept.add("selected", i, selection(found, selector, browsing), "selector")
        kept.end(i)
        discard(both)
    states, retrieved, selected, ranks, ended = (kept.table(t, min(kept.last, iterations)) for t in TABLES)
    status = queries.select("qid").join(ended, "qid", "left").select("qid", F.coalesce("status", F.lit("finished")).alias("status"))
    return DeepRun(states, retrieved, selected, ranks, status, kept.phases())


def simple_workflow(index: TermIndex | None, keys: DataFrame, truth: DataFrame, top_k: int = MAX_RESULTS, ks: tuple[int, ...] = (5, 10, 20), cutoff: int = 100, dates: DataFrame | None = None, scorer: Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """Searches every key (qid, sq_id, text) once, merges by greatest score, and measures: (results, metrics by query).

    No date cutoff is applied unless ``dates`` (qid, before_date) is given;
    ``scorer`` searches by another method than BM25.
    """
    key = F.struct("qid", "sq_id")
    asked = keys.withColumn("before_date", F.lit(None).cast("string")) if dates is None else keys.join(dates, "qid")
    scores = (scorer or (lambda a: bm25_meeting(index, a)))(asked.select(key.alias("qid"), F.col("text").alias("query"), "before_date"))
    scores = scores if isinstance(scores, Meeting) else stored(scores)
    best, place = _best_and_ranks(scores, top_k, keys.select("qid", "sq_id").join(truth, "qid").select(key.alias("qid"), "paper_id"))
    results = combine(page(best, top_k).select("qid.qid", "qid.sq_id", "rank", "paper_id", "score"))
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "sq_id", "rank")) - 1)
    ranked = stored(ranked)
    place = place.select("qid.qid", "paper_id", "rank")
    flat = ranked.select("qid", F.lit(1).alias("iter"), "sq_id", "paper_id")
    metrics = set_metrics(truth, flat, flat, ["qid"]).select("qid", "recall", "precision", "matches", "total_gt")
    wide = at_k(truth, ranked, ks).groupBy("qid").pivot("k", list(ks)).agg(F.first("recall").alias("recall"), F.first("precision").alias("precision"))
    return ranked, metrics.join(wide, "qid", "left").join(simple_distance(truth, place, cutoff), "qid", "left")
