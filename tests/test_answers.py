"""Model calls that fail, are lost and are kept."""

import threading
import time

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from lodestone.plans import answers


class Lost(BaseException):
    """A worker that goes in the middle of a call."""


def logged(log, lost=None, failing=()):
    def ask(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == lost:
            raise Lost
        if prompt in failing:
            raise ValueError("no")
        return prompt.upper()

    return ask


def test_waits_double_and_errors_are_told(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(time, "sleep", waits.append)

    def third(p):
        calls.append(p)
        if len(calls) < 3:
            raise TimeoutError("slow")
        return "yes"

    assert answers.ask_one(third, "a", 3, 0.5) == ("yes", 3, None) and waits == [0.5, 1.0]
    calls.clear()
    assert answers.ask_one(third, "a", 2, 0.5) == (None, 2, "TimeoutError: slow")


def test_calls_under_way_are_bounded_and_a_chunk_is_asked_once(tmp_path):
    lock, now, most, asked = threading.Lock(), [0], [0], []

    def ask(p):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            asked.append(p)
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return p

    rows = pd.DataFrame({"key": [str(i) for i in range(20)], "prompt": [f"p{i}" for i in range(20)], "chunk": 7})
    run = answers._chunk(ask, f"file://{tmp_path}", 1, 0.0, 4)
    first, second = run(rows), run(rows)
    assert 1 < most[0] <= 4 and len(asked) == 20
    assert first.equals(second) and list(first["response"]) == list(rows["prompt"])


def test_lost_run_is_taken_up_and_failures_are_asked_again(spark, tmp_path):
    rows = [(i, f"prompt {i % 12}") for i in range(24)] + [(24, None), (25, "")]
    prompts = spark.createDataFrame(rows, "id long, prompt string").withColumnRenamed("id", "key")  # a name that the store uses too
    path, log = f"file://{tmp_path}/store", tmp_path / "log"
    with pytest.raises(PySparkException):
        answers.answered(prompts, logged(log, lost="prompt 5"), path, chunk=3, at_once=1)
    before = log.read_text().splitlines()
    kept = sorted(f.name for f in (tmp_path / "store" / "chunks" / "0").iterdir() if f.name.endswith(".json"))
    out = answers.answered(prompts, logged(log, failing=("prompt 7",)), path, tries=2, wait=0.0, chunk=3, at_once=1)
    got = {r.key: (r.response, r.tries, r.error) for r in out.collect()}
    want = {i: (None, None, None) if p is None else (p.upper(), 1, None) for i, p in rows if p != "prompt 7"}
    # A failed prompt is staged work that a later call of the same run asks for again.
    assert {i: g for i, g in got.items() if dict(rows)[i] != "prompt 7"} == want
    assert {got[i] for i, p in rows if p == "prompt 7"} in ({(None, 2, "ValueError: no")}, {("PROMPT 7", 1, None)})
    every = log.read_text().splitlines()
    twice = {p for p in every if every.count(p) > 1} - {"prompt 7"}
    assert "prompt 5" in twice and len(twice) <= 6 and set(before) <= set(every)  # the chunks under way when the run was lost
    assert len(set(every)) == 13 and len(kept) * 3 >= len(set(before)) - 12
    # A third run has all but what failed; nothing kept is asked again.
    last = answers.answered(prompts, logged(log), path, chunk=3)
    assert {r.key: r.response for r in last.collect()} == {i: p and p.upper() for i, p in rows} | {25: ""}
    assert set(log.read_text().splitlines()[len(every) :]) <= {"prompt 7"}
    assert answers.kept_answers(spark, path).count() == 13


def test_nothing_to_ask(spark, tmp_path):
    none = spark.createDataFrame([], "id long, prompt string")
    assert answers.answered(none, str.upper, f"file://{tmp_path}/s").collect() == []
