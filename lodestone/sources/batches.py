"""Upserts in bounded batches, with a checkpoint after each.

The rows of a run are staged once, dealt to numbered batches by the hash of
their key; each batch is then prepared (embedded, say), written to a folder of
its own and marked as done.  A few batches are written side by side, as one is
too small to fill the executors; they are prepared one after the other.  A run
that broke off goes on with the batches without a mark, reads none that has
one, and writes a half-written one anew, so that a repeated batch changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a batch.
BATCH_ROWS = 1_000_000

#: Batches that are written at a time.
AT_ONCE = 16


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def batch_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The last row of each key over all runs, those of batches that are done; None before the first."""
    done = _done(spark, path)
    if not done:
        return None
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/run={run}/batch={n}" for run, n in done))
    return rows.drop("batch")


def _done(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    at, files = _files(spark, f"{path}/done")
    if not files.exists(at):
        return []
    return sorted(tuple(map(int, f.getPath().getName().split("-"))) for f in files.listStatus(at))


def current(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The table as readers see it: of a key in several runs the last run's row."""
    rows = batch_table(spark, path)
    if rows is None:
        return None
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col("run").desc()))
    return rows.withColumn("_k", last).where("_k = 1").drop("_k", "run")


def upsert(rows: DataFrame, path: str, key: str, run: int, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch, batch_rows: int = BATCH_ROWS) -> int:
    """Upserts ``rows`` (one of each ``key``) as run number ``run``; returns how many batches this call wrote.

    A run is called again with the same number until it has ended; only its
    first call reads ``rows``.  Runs of greater numbers win.  After a failure
    no other batch is begun, and those under way are completed and marked.
    """
    spark = rows.sparkSession
    staged = f"{path}/staged/run={run}"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        n = max(1, -(-rows.count() // batch_rows))
        dealt = rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
        tasks = min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))  # each writes the files of its batches one by one
        dealt.repartition(tasks, "batch").write.mode("overwrite").partitionBy("batch").parquet(staged)
    done = {n for r, n in _done(spark, path) if r == run}
    at, files = _files(spark, staged)
    batches = sorted(int(f.getPath().getName().removeprefix("batch=")) for f in files.listStatus(at) if f.getPath().getName().startswith("batch="))
    left = [n for n in batches if n not in done]
    if not left:
        return 0
    schema = spark.read.parquet(f"{staged}/batch={left[0]}").schema

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/run={run}/batch={n}")
        mark, store = _files(spark, f"{path}/done/{run}-{n}")
        store.create(mark, True).close()

    under_way: set[Future] = set()
    with ThreadPoolExecutor(AT_ONCE) as pool:  # waits for those under way, also after an error
        for n in left:
            if len(under_way) == AT_ONCE:
                ended, under_way = wait(under_way, return_when=FIRST_COMPLETED)
                for batch in ended:
                    batch.result()
            prepared = prepare(spark.read.schema(schema).parquet(f"{staged}/batch={n}"))
            under_way.add(pool.submit(inheritable_thread_target(spark)(write), prepared, n))  # each with local properties of its own
    for batch in under_way:
        batch.result()
    return len(left)
