"""The term index as plain tables, and accessors of the corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import index_text, tokens
from lodestone.plans.storage import stored
from lodestone.sources.writers import append_new

VECTORS = "paper_id long, ord long, date string, arxiv_id string, embedding array<float>"
K1, B, EPSILON = 1.5, 0.75, 0.25
#: The token of the title's label, which every indexed paper has.
LABEL = "title"
#: Impact levels, and so blocks, of a term at most.
LEVELS = 64
#: Rows of a bucket of saved postings; a term with more fills several files.
BUCKET_ROWS = 4_000_000


@dataclass
class TermIndex:
    """``postings`` (term, paper_id, ord, date, arxiv_id, tf, dl), ``terms`` (term, df, idf), ``stats`` (n, avgdl, mean_idf), ``blocks`` (term, level, n, most): postings of a term by impact, and their greatest impact."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    blocks: DataFrame


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a posting adds to a score for each unit of its term's weight; below K1 + 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def level(of: Column) -> Column:
    return F.floor(of * (LEVELS / (K1 + 1))).cast("int")


def paper_postings(papers: DataFrame) -> DataFrame:
    """(term, paper_id, ord, date, arxiv_id, dl, tf) of papers (paper_id, ord, title, abstract, date, arxiv_id) with a title or an abstract and a token."""
    some = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("abstract", F.lit("")) != "")
    rows = papers.where(some).select("paper_id", "ord", F.coalesce("date", F.lit("")).alias("date"), "arxiv_id", "title", "abstract")
    if len(papers.inputFiles()) < papers.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition("paper_id")  # else the input is dealt out already, and nothing is moved
    counts = _counts(tokens(index_text(F.col("title"), F.col("abstract"))))
    return rows.select("paper_id", "ord", "date", "arxiv_id", F.inline(counts)).select("term", "paper_id", "ord", "date", "arxiv_id", "dl", "tf")


def _counts(toks: Column) -> Column:
    """An array of (term, dl, tf) from the tokens of one paper, of which there are some: they are sorted, and the lengths of their runs are the counts.

    A paper's counts are made in its own row, so that a task holds one paper.
    """
    one = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  (the value is worked out once)
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, b: F.transform(b, lambda i, j: F.struct(F.get(s, i).alias("term"), F.size(s).alias("dl"), (F.coalesce(F.get(b, j + 1), F.size(s)) - i).cast("long").alias("tf")))
    return one(F.sort_array(toks), lambda s: one(begins(s), lambda b: runs(s, b)))


def _blocks(postings: DataFrame, sizes: DataFrame) -> DataFrame:
    weighed = postings.crossJoin(F.broadcast(sizes)).select("term", impact(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("impact"))  # one row of sizes
    return weighed.groupBy("term", level(F.col("impact")).alias("level")).agg(F.count("*").alias("n"), F.max("impact").alias("most"))


def _weights(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``terms`` and ``stats`` of (term, df, n, avgdl)."""
    raw = stored(counted.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).select("term", "df", "n", "avgdl", "raw"))
    mean = raw.agg(F.first("n", ignorenulls=True).alias("n"), F.first("avgdl", ignorenulls=True).alias("avgdl"), F.avg("raw").alias("mean_idf"))
    terms = raw.crossJoin(F.broadcast(mean.select("mean_idf"))).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return terms, mean


def build_term_index(papers: DataFrame) -> TermIndex:
    """Index of papers (paper_id, ord, title, abstract, date, arxiv_id) with a title or an abstract and a token.

    Statistics are over indexed papers.  A term in more than half of them has
    a negative weight, which a quarter of the mean weight replaces.
    """
    # Tokenised, counted and written once; what follows reads columns of the written table.
    postings = stored(paper_postings(papers))
    # Every indexed paper has the label's token once as a row, so its postings are the papers.
    sizes = stored(postings.where(F.col("term") == LABEL).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    counted = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(sizes))
    return TermIndex(postings, *_weights(counted), _blocks(postings, sizes))  # blocks are made when a search by bounds reads them


def merged_index(postings: DataFrame, counts: DataFrame) -> TermIndex:
    """An index of postings whose counts (term, df, and dl, the added lengths of the papers with the term) are known; nothing is read of the postings before a search."""
    counts = stored(counts.select("term", "df", "dl"))
    sizes = counts.where(F.col("term") == LABEL).select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    return TermIndex(postings, *_weights(counts.crossJoin(F.broadcast(sizes))), _blocks(postings, sizes))


def save_term_index(index: TermIndex, path: str, buckets: int | None = None) -> None:
    """Postings lie in folders by hash of the term, as many as their number asks for; one that a frequent term swells is cut into several files."""
    buckets = buckets or max(1, -(-index.postings.count() // BUCKET_ROWS))
    dealt = index.postings.withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets))).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    for name in ("terms", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    # A term lies in few of the files, so that its blocks are nearly whole before they are moved.
    saved = index.postings.sparkSession.read.parquet(f"{path}/postings")
    _blocks(saved, index.stats.select("n", "avgdl")).write.mode("overwrite").parquet(f"{path}/blocks")


def load_term_index(spark: SparkSession, path: str) -> TermIndex:
    return TermIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats", "blocks")))


def build_vector_index(papers: DataFrame, embeddings: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Rows (paper_id, ord, date, arxiv_id, embedding) of papers whose key is not ``done`` yet."""
    rows = papers.join(embeddings, "paper_id").select("paper_id", "ord", F.coalesce("date", F.lit("")).alias("date"), "arxiv_id", "embedding")
    return rows if done is None else rows.join(done.select("paper_id"), "paper_id", "left_anti")


def save_vector_index(rows: DataFrame, path: str, append: bool = False) -> None:
    """The vectors in corpus order within files; with ``append`` only papers that the table does not have yet are added, so a run that broke off goes on."""
    if append:
        append_new(rows, path, "paper_id")
    else:
        rows.sortWithinPartitions("ord").write.mode("overwrite").parquet(path)


def load_vector_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def paper_by_id(papers: DataFrame, paper_id) -> DataFrame:
    return papers.where(F.col("paper_id") == F.lit(paper_id))


def total_papers(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("*").alias("total"))


def available_methods(term_index: TermIndex | None, vectors: DataFrame | None) -> list[str]:
    return (["bm25"] if term_index else []) + (["vector"] if vectors is not None else []) + (["hybrid"] if term_index and vectors is not None else [])
