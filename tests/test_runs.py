"""Runs that break off and go on."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from lodestone.operators import index
from lodestone.plans import agents, runlog, storage, workflow

ROOT = str(Path(__file__).resolve().parents[1])
PAPERS = [(i, i, f"t{'abcdef'[i % 6]}", f"w{'abcdefg'[i % 7]} w{'xyz'[i % 3]} common", f"2015-0{1 + i % 9}-01", f"id{i}") for i in range(40)]
KEYS = ["wa common", "wx wb", "common wz"]


def research(spark, log, asked, kill_at=None):
    """Two queries, three iterations, a page and a new key each."""
    papers = spark.createDataFrame(PAPERS, "paper_id long, ord long, title string, abstract string, date string, arxiv_id string")
    q = spark.createDataFrame([(1, "a", None), (2, "b", "2015-06")], "qid long, query string, before_date string")
    truth = spark.createDataFrame([(1, 5), (1, 7), (2, 9)], "qid long, paper_id long")

    def planner(i, states):
        if i == kill_at:
            os._exit(9)
        asked.append(i)
        rows = [(n, 0, "derive", 0, KEYS[i - 1], 3) for n in (1, 2)] + ([(1, 1, "continue", 1, "", 3)] if i > 1 else [])
        return spark.createDataFrame(rows, "qid long, item int, link_type string, source_id int, text string, target_k int")

    return workflow.deep_research(index.build_term_index(papers), q, truth, planner, lambda c: c.where("rank % 2 = 0"), 3, log=log)


def rows(run):
    """All rows; the last digits of a score depend on the order of its sum."""
    return [sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in t.collect()) for t in (run.states, run.retrieved, run.selected, run.gt_ranks, run.status)]


def test_killed_driver_goes_on(spark, tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from lodestone.session import session
from tests.test_runs import research
s = session("killed", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "1g", "spark.checkpoint.dir": "file://{tmp_path}/shared"}})
research(s, "file://{tmp_path}/log", [], kill_at=3)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=300)
    assert done.returncode == 9, done.stderr.decode()[-2000:]
    asked, whole = [], []
    run = research(spark, f"file://{tmp_path}/log", asked)
    assert asked == [3]
    want = research(spark, None, whole)
    assert whole == [1, 2, 3] and rows(run) == rows(want)
    # An ended run is not asked again; phases of both drivers are there.
    again = research(spark, f"file://{tmp_path}/log", asked)
    assert asked == [3] and rows(again) == rows(want)
    phases = {(r.iter, r.phase): r for r in again.phases.collect()}
    assert set(phases) == {(i, p) for i in (1, 2, 3) for p in ("planner", "retrieval", "selector")}
    for p, t in (("planner", want.states), ("retrieval", want.retrieved), ("selector", want.selected)):
        assert [phases[i, p].rows for i in (1, 2, 3)] == [t.where(f"iter = {i}").count() for i in (1, 2, 3)]
    assert all(r.seconds > 0 for r in phases.values())


def test_half_an_iteration_is_written_anew(spark, tmp_path):
    log = lambda: runlog.RunLog(spark, {"t": "a long"}, "x", f"file://{tmp_path}/log")
    first = log()
    first.add("t", 1, spark.range(3).withColumnRenamed("id", "a"))
    first.end(1)
    first.add("t", 2, spark.range(9).withColumnRenamed("id", "a"))
    second = log()
    assert second.last == 1 and second.table("t").count() == 3 and not second.over
    second.add("t", 2, spark.range(1).withColumnRenamed("id", "a"), "p")
    second.end(2, over=True)
    third = log()
    assert third.last == 2 and third.over and third.table("t").count() == 4
    assert [(r.iter, r.phase, r.rows) for r in third.phases().collect()] == [(2, "p", 1)]
    with pytest.raises(ValueError):
        runlog.RunLog(spark, {"t": "a long"}, "y", f"file://{tmp_path}/log")


def test_run_without_plan_ends_once(spark, tmp_path):
    papers = spark.createDataFrame(PAPERS, "paper_id long, ord long, title string, abstract string, date string, arxiv_id string")
    q = spark.createDataFrame([(1, "a", None)], "qid long, query string, before_date string")
    asked = []

    def planner(i, states):
        asked.append(i)
        return spark.createDataFrame([], "qid long, item int, link_type string, source_id int, text string, target_k int")

    for _ in range(2):
        run = workflow.deep_research(index.build_term_index(papers), q, q.selectExpr("qid", "7L AS paper_id"), planner, agents.keep_all, 3, log=f"file://{tmp_path}/log")
        assert [tuple(r) for r in run.status.collect()] == [(1, "failed")] and run.retrieved.count() == 0
    assert asked == [1]


def test_commit_is_whole(spark, tmp_path):
    at = f"file://{tmp_path}/m"
    assert storage.committed(spark, at) == {}
    storage.commit(spark, f"{at}/1", '{"ä": 1}')
    (tmp_path / "m" / "2.new").write_text("half")
    assert storage.committed(spark, at) == {"1": '{"ä": 1}'}
