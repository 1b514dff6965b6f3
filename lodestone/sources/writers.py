"""Sinks: records as JSON lines or Parquet, appended by Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.parse import summary_key


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def benchmark(queries: DataFrame, papers: DataFrame, folder: str) -> None:
    queries.write.mode("overwrite").json(f"{folder}/bench")
    papers.write.mode("overwrite").parquet(f"{folder}/papers")


def timestamped(df: DataFrame, folder: str, stem: str, when: str) -> str:
    """A full result set of its own: ``<folder>/<stem>_<when>``; returns the path."""
    path = f"{folder}/{stem}_{when}"
    df.write.mode("errorifexists").json(path)
    return path


def citation_map(entries: DataFrame, path: str) -> None:
    """Entries (stem, key, and the fields of a citation) as one JSON object by key for each stem, a line each, in files by stem.

    A stem is one survey, whose references are gathered in one row.
    """
    fields = F.struct(*(c for c in entries.columns if c not in ("stem", "key")))
    maps = entries.groupBy("stem").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", fields.alias("e"))))).alias("m"))
    maps.select("stem", F.to_json("m").alias("value")).write.partitionBy("stem").text(path)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table does not have yet; a run that broke off is taken up by running again."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)


def traces(stages: DataFrame) -> DataFrame:
    """One row of each sample (sample_idx, seq, agent, iteration, prompt, response, reasoning) with its stages in order."""
    s = F.struct("seq", "agent", "iteration", "prompt", "response", "reasoning")
    ordered = stages.groupBy("sample_idx").agg(F.array_sort(F.collect_list(s)).alias("s"))
    return ordered.select("sample_idx", F.transform("s", lambda x: x.dropFields("seq")).alias("stages"))


def printed(record: DataFrame) -> DataFrame:
    """The record's rows (key, value) as lines, sorted by key."""
    return record.orderBy("key").select(F.format_string("%s: %.4f", "key", F.col("value").cast("double")).alias("line"))


def summary_record(metrics: DataFrame) -> DataFrame:
    """(name, value) with cleaned names; of names that meet, the one that came with 'avg_' most often counts."""
    long = metrics.withColumn("key", summary_key(F.col("name"))).withColumn("cut", F.length("name") - F.length("key"))
    return long.groupBy("key").agg(F.max_by("value", "cut").alias("value"))
