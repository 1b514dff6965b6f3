"""Decisions that language models take elsewhere, as tables in and out.

Each plug-in is a function of DataFrames; those here are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.parse import json_record
from lodestone.functions.text import tokens
from lodestone.plans.storage import stored

PLAN = "STRUCT<subqueries:ARRAY<STRUCT<link_type:STRING,source_id:INT,text:STRING,target_k:INT>>,checklist:STRING,experience_replay:STRING,is_complete:BOOLEAN,complete:BOOLEAN>"
SELECTION = "STRUCT<selected:ARRAY<STRING>,discarded:ARRAY<STRING>,to_browse:MAP<STRING,STRING>,reasons:MAP<STRING,STRING>,overview:STRING>"
DECISION = "STRUCT<needs_browsing:BOOLEAN,browsing_task:STRING,reasoning:STRING>"
EXTRACTION = "STRUCT<rational:STRING,evidence:STRING,summary:STRING>"
Planner = Callable[[int, DataFrame], DataFrame]
Selector = Callable[[DataFrame], DataFrame]


def call_model(prompts: DataFrame, ask: Callable[[str], str], schema: str = "qid long, response string") -> DataFrame:
    """(qid, prompt) answered by an injected callable on the executors, in Arrow batches; failures answer null."""

    def run(batches):
        for pdf in batches:
            answers = []
            for p in pdf["prompt"]:
                try:
                    answers.append(ask(p))
                except Exception:
                    answers.append(None)
            yield pdf.assign(response=answers)[["qid", "response"]]

    return prompts.mapInPandas(run, schema)


def planned(answers: DataFrame) -> DataFrame:
    """(qid, item, link_type, source_id, text, target_k) of planner answers (qid, response)."""
    rows = answers.select("qid", json_record(F.col("response"), "planner_output", PLAN).alias("p"))
    return rows.select("qid", F.posexplode("p.subqueries").alias("item", "s")).select("qid", "item", "s.*")


def plan_notes(answers: DataFrame) -> DataFrame:
    """(qid, is_complete, checklist, experience_replay) of planner answers (qid, response); what is no record is not complete."""
    rows = answers.select("qid", json_record(F.col("response"), "planner_output", PLAN).alias("p"))
    empty = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c)
    return rows.select("qid", F.coalesce("p.is_complete", "p.complete", F.lit(False)).alias("is_complete"), empty("checklist"), empty("experience_replay"))


def answering_planner(ask: Planner) -> tuple[Planner, Callable[[int, DataFrame], DataFrame]]:
    """(planner, finished) for a research run, from a model's answers: ``ask`` (iteration, states) gives (qid, response), once an iteration.

    A query ends where its own plan says that it is complete.
    """
    held: dict[int, DataFrame] = {}

    def answers(iteration: int, states: DataFrame) -> DataFrame:
        if iteration not in held:
            held[iteration] = stored(ask(iteration, states).select("qid", "response"))
        return held[iteration]

    return (lambda i, states: planned(answers(i, states))), (lambda i, states: plan_notes(answers(i, states)).where("is_complete").select("qid"))


def browsing_decisions(answers: DataFrame) -> DataFrame:
    """(qid, sq_id, paper_id, needs_browsing, browsing_task, reasoning) of decision answers (qid, sq_id, paper_id, response).

    Without a task nothing is browsed, whatever the answer says.
    """
    rows = answers.select("qid", "sq_id", "paper_id", json_record(F.col("response"), "decision_output", DECISION).alias("d"))
    task = F.nullif(F.col("d.browsing_task"), F.lit(""))
    needs = F.coalesce("d.needs_browsing", F.lit(False)) & task.isNotNull()
    return rows.select("qid", "sq_id", "paper_id", needs.alias("needs_browsing"), task.alias("browsing_task"), F.coalesce("d.reasoning", F.lit("")).alias("reasoning"))


def extractions(answers: DataFrame) -> DataFrame:
    """(qid, sq_id, paper_id, rational, evidence, summary) of extraction answers; what is no record goes."""
    rows = answers.select("qid", "sq_id", "paper_id", json_record(F.col("response"), "extractor_output", EXTRACTION).alias("e")).where("e IS NOT NULL")
    return rows.select("qid", "sq_id", "paper_id", *(F.coalesce(f"e.{c}", F.lit("")).alias(c) for c in ("rational", "evidence", "summary")))


#: Fixed value: what stands before the abstract of a paper whose text gave nothing.
UNREAD = "Browsing exception. Here is abstract: "


def browsing_contents(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, sq_id, paper_id, browsing_content) of the candidates ``asked`` for (with abstract): the summary of ``extractions``, else the abstract behind a remark."""
    keys = ["qid", "sq_id", "paper_id"]
    both = asked.select(*keys, "abstract").join(found.select(*keys, "summary"), keys, "left")
    return both.select(*keys, F.coalesce(F.nullif("summary", F.lit("")), F.concat(F.lit(UNREAD), F.coalesce("abstract", F.lit("")))).alias("browsing_content"))


def chosen(answers: DataFrame) -> DataFrame:
    """(qid, sq_id, paper_id) of selector answers (qid, sq_id, response)."""
    rows = answers.select("qid", "sq_id", json_record(F.col("response"), "selector_output", SELECTION).alias("s"))
    return rows.select("qid", "sq_id", F.explode("s.selected").alias("paper_id")).distinct()


def window_keys(queries: DataFrame, size: int = 8) -> DataFrame:
    """(qid, sq_id, text): all stretches of a query's tokens stand for generated search keys."""
    t = queries.select("qid", tokens(F.col("query")).alias("t"))
    n = F.ceil(F.size("t") / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice("t", i * size + 1, F.lit(size)), " "))
    return t.where(F.size("t") > 0).select("qid", F.posexplode(parts).alias("sq_id", "text"))


def labelled_selector(labels: DataFrame) -> Selector:
    """Keeps the papers that a table of (paper_id, quality) calls good."""
    good = labels.where("quality = 1").select("paper_id")
    return lambda candidates: candidates.join(good, "paper_id", "left_semi")


def keep_all(candidates: DataFrame) -> DataFrame:
    return candidates


def summarised(papers: DataFrame, cache: DataFrame, model: str, summarise: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All summaries (paper_id, summary), and the new cache rows for those that the cache lacked."""
    have = cache.where(F.col("model") == model).select("paper_id", "summary")
    new = summarise(papers.join(have, "paper_id", "left_anti")).select("paper_id", F.lit(model).alias("model"), "summary")
    return have.join(papers, "paper_id", "left_semi").unionByName(new.select("paper_id", "summary")), new


def browsed(candidates: DataFrame, wanted: DataFrame, contents: DataFrame, mode: str, before: DataFrame | None = None) -> DataFrame:
    """Candidates with browsing_content by mode.

    NONE leaves them bare; PRE_ENRICH reads every candidate's content; REFRESH
    reads the wanted ones (paper_id) and forgets the others' content;
    INCREMENTAL adds the wanted ones to what was read ``before``.
    """
    bare = candidates.drop("browsing_content")
    if mode == "NONE":
        return bare.withColumn("browsing_content", F.lit(None).cast("string"))
    if mode == "PRE_ENRICH":
        return bare.join(contents, "paper_id", "left")
    new = contents.join(wanted.select("paper_id").distinct(), "paper_id", "left_semi")
    if mode == "INCREMENTAL" and before is not None:
        new = new.unionByName(before.join(new, "paper_id", "left_anti"))
    return bare.join(new, "paper_id", "left")
