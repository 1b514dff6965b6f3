"""Queries of runs that break off and go on, of model calls and of an index kept in segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.more_queries import place
from lodestone.operators import search, segments
from lodestone.plans import agents, answers, workflow
from lodestone.plans.storage import stored
from lodestone.queries import DEEP, SQL, _planner, _quality, _shown, containing, papers, query, questions, rounded, table, term_index


class Broken(Exception):
    """Stands for the loss of a driver."""


def _resumed_run(spark: SparkSession, sf_dir: str) -> workflow.DeepRun:
    """The run of ``deep_research``, broken off in its third iteration and called again."""
    q, truth, log = questions(spark, sf_dir), containing(spark, sf_dir), place(spark, "research")
    plan, asked = _planner(q, stored(agents.window_keys(q))), []

    def planner(i: int, states: DataFrame) -> DataFrame:
        asked.append(i)
        if asked == [1, 2, 3]:
            raise Broken
        return plan(i, states)

    run = lambda: workflow.deep_research(term_index(spark, sf_dir), q, truth, planner, agents.labelled_selector(_quality(spark, sf_dir)), 3, log=log)
    try:
        run()
    except Broken:
        out = run()
    assert asked == [1, 2, 3, 3], asked
    return out


@query(SQL["deep_research"])
def deep_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _resumed_run(spark, sf_dir)
    chosen = run.selected.select("qid", "iter", "sq_id", "paper_id", F.lit(True).alias("selected"))
    return run.retrieved.join(chosen, ["qid", "iter", "sq_id", "paper_id"], "left").select("qid", "iter", "sq_id", "rank", "paper_id", F.coalesce("selected", F.lit(False)).alias("selected"))


_PLANNED = ("odd = 0", "odd = 1 OR qid % 100 = 1", "qid % 100 IN (1, 2)")


@query(f"WITH {DEEP} " + " UNION ALL ".join(f"SELECT {i} AS iter, 'planner' AS phase, count(*) AS rows FROM dkeys WHERE {when} UNION ALL SELECT {i}, 'retrieval', count(*) FROM r{i} UNION ALL SELECT {i}, 'selector', count(*) FROM s{i}" for i, when in enumerate(_PLANNED, 1)))
def deep_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each phase made, as the observers of a real run counted them; their seconds are in the log beside them."""
    return _resumed_run(spark, sf_dir).phases.where("seconds > 0").select("iter", "phase", "rows")


# Model calls.


def _flaky(prompt: str) -> str:
    """Stands for a model: a prompt of odd length fails at its first try, one without any letter always."""
    if not any(c.isalpha() for c in prompt):
        raise ValueError("no words")
    if len(prompt) % 2 and prompt not in _TRIED:
        _TRIED.add(prompt)
        raise TimeoutError
    _TRIED.discard(prompt)
    return prompt[::-1]


_TRIED: set = set()


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\p{L}') THEN md5(reverse(text)) END AS response, CASE WHEN text IS NULL THEN NULL WHEN NOT regexp_matches(text, '\\p{L}') THEN 3 WHEN length(text) % 2 = 1 THEN 2 ELSE 1 END AS tries FROM conversations")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a prompt: equal ones are asked once, failures again, and what is kept is not asked a second time."""
    path = place(spark, "answers")
    prompts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers.answered(prompts.where("conv_id % 2 = 0"), _flaky, path, wait=0.0)
    out = answers.answered(prompts, _flaky, path, wait=0.0)
    return out.select("conv_id", "turn", F.md5("response").alias("response"), "tries")


# An index in segments.


def _segmented(spark: SparkSession, sf_dir: str) -> str:
    """The corpus in four changes: most papers, some of them with other texts, the rest with the right texts, and what never belonged to it taken away."""
    path, p = place(spark, "segments"), papers(spark, sf_dir)
    other = p.withColumn("abstract", F.concat(F.lit("superseded words "), F.reverse("abstract")))
    strange = p.where("paper_id % 50 = 0").withColumn("paper_id", -1 - F.col("paper_id"))
    segments.change(path, p.where("paper_id % 10 > 2").unionByName(other.where("paper_id % 10 = 2")).unionByName(strange))
    segments.change(path, p.where("paper_id % 10 = 2").unionByName(other.where("paper_id % 10 = 0")))
    segments.change(path, p.where("paper_id % 10 < 2"))
    segments.change(path, p.limit(0), gone=strange)
    return path


@query(SQL["bm25_topk"])
def segmented_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As from an index built at once, from one that came about by additions, replacements and removals."""
    return _shown(search.search(questions(spark, sf_dir), "bm25", segments.load(spark, _segmented(spark, sf_dir))))


@query(SQL["index_terms"])
def segmented_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged counts and weights, after the small segments have become one."""
    path = _segmented(spark, sf_dir)
    segments.merge(spark, path, 0.5)
    return rounded(segments.load(spark, path).terms.select("term", "df", "idf"), ["idf"])
