"""Calls to a model from tasks: several at once, repeated on failure, and kept by key.

A prompt is known by the SHA-256 of its text, so equal prompts are asked once.
Those without a kept answer are dealt to chunks and staged; a chunk is one call
of a task, which puts its answers into a file of its own before it hands them
on.  A task that is run again finds the file of every chunk that it had ended
and asks only for the one that it was in.  Answers are appended to the store
when all chunks are in; prompts whose every try failed are not, so that a later
run asks for them again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.storage import commit, committed, exists, made_folder, remove

ANSWERS = "key string, response string, tries int, error string"
#: Prompts of a chunk: what a lost task may ask twice.
CHUNK = 64


def ask_one(ask: Callable[[str], str], prompt: str, tries: int, wait: float) -> tuple[str | None, int, str | None]:
    """(answer, tries, error): after the nth failure the wait is ``wait`` times 2 to the n - 1."""
    for n in range(1, tries + 1):
        try:
            return ask(prompt), n, None
        except Exception as failed:
            error = f"{type(failed).__name__}: {failed}"
            if n < tries:
                time.sleep(wait * 2 ** (n - 1))
    return None, tries, error


def _chunk(ask: Callable[[str], str], at: str, tries: int, wait: float, at_once: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        files, base = pafs.FileSystem.from_uri(at)
        path = f"{base}/{rows['chunk'].iloc[0]}.json"
        if files.get_file_info(path).type == pafs.FileType.NotFound:
            with ThreadPoolExecutor(at_once) as pool:
                got = list(pool.map(lambda p: ask_one(ask, p, tries, wait), rows["prompt"]))
            made = [(k, *g) for k, g in zip(rows["key"], got, strict=True)]
            new = f"{path}.{time.monotonic_ns()}.new"
            with files.open_output_stream(new) as out:
                out.write(json.dumps(made).encode())
            files.move(new, path)
        with files.open_input_stream(path) as kept:
            return pd.DataFrame(json.loads(kept.read()), columns=["key", "response", "tries", "error"]).astype({"tries": "int32"})

    return run


def kept_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, response, tries, error) of all committed runs; ``error`` is null."""
    runs = sorted(committed(spark, f"{path}/runs"), key=int)
    return spark.read.schema(ANSWERS).parquet(*(f"{path}/answers/{r}" for r in runs)) if runs else spark.createDataFrame([], ANSWERS)


def answered(prompts: DataFrame, ask: Callable[[str], str], path: str, tries: int = 3, wait: float = 1.0, at_once: int = 8, chunk: int = CHUNK) -> DataFrame:
    """``prompts`` (with a column prompt, any others) with response, tries and error, by ``ask``, a function of a prompt that can be sent to tasks.

    ``path`` is the store, in a folder that driver and executors share.  A null
    prompt has a null answer and is not asked.  A run that broke off is taken
    up by calling again: its staged prompts come first.  At most ``at_once``
    calls of a task are under way.  Where Spark runs two attempts of a task at
    one time (speculation), both may ask for a chunk; one of them is kept.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("_key", F.sha2("prompt", 256))
    done = len(committed(spark, f"{path}/runs"))
    if exists(spark, f"{path}/staged/{done}/_SUCCESS"):  # what a broken run had staged
        _ask_staged(spark, ask, path, done, tries, wait, at_once)
        done += 1
    new = keyed.where("prompt IS NOT NULL").groupBy(F.col("_key").alias("key")).agg(F.first("prompt").alias("prompt")).join(kept_answers(spark, path).select("key"), "key", "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/new/{done}")
    new = spark.read.schema("key string, prompt string").parquet(f"{path}/new/{done}")
    n = new.count()
    failed = spark.createDataFrame([], ANSWERS)
    if n:
        new.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(-(-n // chunk)))).write.mode("overwrite").parquet(f"{path}/staged/{done}")
        failed = _ask_staged(spark, ask, path, done, tries, wait, at_once)
    remove(spark, f"{path}/new/{done}")
    every = kept_answers(spark, path).unionByName(failed).withColumnRenamed("key", "_key")
    return keyed.join(every, "_key", "left").drop("_key")


def _ask_staged(spark: SparkSession, ask, path: str, run: int, tries: int, wait: float, at_once: int) -> DataFrame:
    """Asks for a run's staged prompts, commits the answers, and returns the failures."""
    staged = spark.read.schema("key string, prompt string, chunk long").parquet(f"{path}/staged/{run}")
    chunks = made_folder(spark, f"{path}/chunks/{run}")
    got = staged.groupBy("chunk").applyInPandas(_chunk(ask, chunks, tries, wait, at_once), ANSWERS)
    got.write.mode("overwrite").parquet(f"{path}/asked/{run}")
    asked = spark.read.schema(ANSWERS).parquet(f"{path}/asked/{run}")
    asked.where("error IS NULL").write.mode("overwrite").parquet(f"{path}/answers/{run}")
    commit(spark, f"{path}/runs/{run}", "")
    for gone in (f"{path}/staged/{run}", f"{path}/chunks/{run}"):
        remove(spark, gone)
    return asked.where("error IS NOT NULL")
