"""A term index that is kept up in segments.

A change writes a segment: the postings of the papers that came, the papers
that went, and by how much the counts of terms and papers changed.  Segments
are never written again; a manifest of a change names those that count, and a
change without one never happened.  What is searched is the postings of the
living papers under the merged statistics, so scores are those of an index
built anew from the corpus as it is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.bounds import small
from lodestone.operators.index import LABEL, TermIndex, merged_index, paper_postings
from lodestone.plans.storage import commit, committed

POSTINGS = "term string, paper_id long, ord long, date string, arxiv_id string, dl int, tf long, seg int"
#: ``n`` counts postings of a term, ``dl`` adds up the lengths of the papers behind a term's postings.
COUNTS, GONE = "term string, n long, dl long", "paper_id long, seg int"
#: Segments of fewer postings than this share of all are merged by ``merge``.
SMALL = 0.1


def _manifest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last change and the names of its segments."""
    made = {int(n): json.loads(t) for n, t in committed(spark, f"{path}/manifest").items()}
    return (max(made), made[max(made)]) if made else (0, [])


def _read(spark: SparkSession, path: str, names: list[str], part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{path}/{n}/{part}" for n in names)) if names else spark.createDataFrame([], schema)


def live_postings(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Postings of the papers that no later change took away."""
    names = _manifest(spark, path)[1] if names is None else names
    gone = _read(spark, path, names, "gone", GONE).groupBy("paper_id").agg(F.max("seg").alias("until"))
    both = _read(spark, path, names, "postings", POSTINGS).join(small(gone), "paper_id", "left")
    return both.where("until IS NULL OR seg >= until").drop("until")


def change(path: str, papers: DataFrame, gone: DataFrame | None = None) -> int:
    """Adds ``papers`` (paper_id, ord, title, abstract, date, arxiv_id; one row each), which replace those of the same id, and takes ``gone`` (paper_id) away; returns the number of the change.

    A paper both new and gone is new.  One writer at a time.
    """
    spark = papers.sparkSession
    last, names = _manifest(spark, path)
    number = last + 1
    at = f"{path}/{number}"
    paper_postings(papers).withColumn("seg", F.lit(number)).write.mode("overwrite").parquet(f"{at}/postings")
    came = _read(spark, path, [str(number)], "postings", POSTINGS)
    ids = papers.select("paper_id")
    ids = (ids if gone is None else ids.unionByName(gone.select("paper_id"))).distinct()
    before = live_postings(spark, path, names)
    # Only papers that the index has can go: of each it has one posting of the label.
    before.where(F.col("term") == LABEL).select("paper_id").join(ids, "paper_id", "left_semi").select("paper_id", F.lit(number).alias("seg")).write.mode("overwrite").parquet(f"{at}/gone")
    away = _read(spark, path, [str(number)], "gone", GONE).select("paper_id")
    went = before.join(small(away), "paper_id", "left_semi")
    counts = came.select("term", "dl", F.lit(1).alias("s")).unionByName(went.select("term", "dl", F.lit(-1).alias("s")))
    counts.groupBy("term").agg(F.sum("s").cast("long").alias("n"), F.sum(F.col("dl").cast("long") * F.col("s")).alias("dl")).where("n <> 0 OR dl <> 0").write.mode("overwrite").parquet(f"{at}/counts")
    commit(spark, f"{path}/manifest/{number}", json.dumps([*names, str(number)]))
    return number


def load(spark: SparkSession, path: str) -> TermIndex:
    """The index as it is now, for any search.  Its blocks, which only a search by bounds reads, are made when they are read."""
    _, names = _manifest(spark, path)
    counts = _read(spark, path, names, "counts", COUNTS).groupBy("term").agg(F.sum("n").alias("df"), F.sum("dl").alias("dl")).where("df > 0")
    return merged_index(live_postings(spark, path, names).drop("seg"), counts)


def merge(spark: SparkSession, path: str, share: float = SMALL) -> int:
    """Writes the living postings of small segments as one, which takes their place; returns how many went into it.

    Postings keep the number of their change, and so does what went, for the
    segments that stay.  Files of merged segments are left to those who still
    read them.
    """
    last, names = _manifest(spark, path)
    sizes = {n: _read(spark, path, [n], "postings", POSTINGS).count() for n in names}
    some = [n for n in names if sizes[n] < share * sum(sizes.values())]
    if len(some) < 2:
        return 0
    number, at = last + 1, f"{path}/{last + 1}"
    live = live_postings(spark, path, names).join(F.broadcast(_numbers(spark, path, some)), "seg", "left_semi")  # a row a change
    live.select(*spark.createDataFrame([], POSTINGS).columns).write.mode("overwrite").parquet(f"{at}/postings")
    _read(spark, path, some, "gone", GONE).groupBy("paper_id").agg(F.max("seg").alias("seg")).write.mode("overwrite").parquet(f"{at}/gone")
    _read(spark, path, some, "counts", COUNTS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).write.mode("overwrite").parquet(f"{at}/counts")
    commit(spark, f"{path}/manifest/{number}", json.dumps([n for n in names if n not in some] + [str(number)]))
    return len(some)


def _numbers(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The numbers of the changes that lie in the named segments."""
    return _read(spark, path, names, "postings", POSTINGS).select("seg").distinct()
