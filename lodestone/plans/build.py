"""The corpus build: from two sources to a benchmark, papers and an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.corpus import enrich, evaluation_queries, merge_papers, with_order
from lodestone.operators.index import TermIndex, build_term_index
from lodestone.plans.storage import stored


def enrich_passes(papers: DataFrame, tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Each table of found records is asked for what the ones before lacked; returns papers and the ids never found."""
    missing = papers.select("arxiv_id")
    for found in tables:
        asked = found.join(missing, "arxiv_id", "left_semi")
        papers, _ = enrich(papers, asked)
        missing = missing.join(found, "arxiv_id", "left_anti")
        papers, missing = stored(papers), stored(missing)
    return papers, missing


def build_corpus(queries: list[DataFrame], first: DataFrame, second: DataFrame, found: list[DataFrame]) -> tuple[DataFrame, DataFrame, TermIndex]:
    """(benchmark, papers, index): queries (qid, query, gt, source) together, papers merged and enriched, and a term index over them."""
    asked = queries[0]
    for more in queries[1:]:
        asked = asked.unionByName(more)
    papers, missing = enrich_passes(merge_papers(first, second), found)
    papers = stored(with_order(papers, "arxiv_id").withColumn("paper_id", F.col("ord")))
    return evaluation_queries(asked, papers, missing), papers, build_term_index(papers)


def first_successes(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Rows in order up to the one that makes ``most`` successes (column ok); failures before it are kept and do not count.

    Successes are counted within partitions of the order first, so that no single task sees all rows.
    """
    parts = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("_part").agg(F.count_if("ok").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a partition
    before = F.coalesce(F.sum(F.col("ok").cast("int")).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = parts.withColumn("_before", before).join(F.broadcast(base), "_part")
    return counted.where(F.col("_before") + F.col("_base") < most).drop("_part", "_before", "_base")


def memory(rows: DataFrame) -> DataFrame:
    """(qid, iter, experience, checklist): the last non-empty value of each up to an iteration."""
    upto = Window.partitionBy("qid").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(upto).alias(c)
    return rows.select("qid", "iter", last("experience"), last("checklist"))
