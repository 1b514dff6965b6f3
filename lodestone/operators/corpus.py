"""Building the corpus and the benchmark from their sources.

Papers are (arxiv_id, title, abstract, date, authors, category, url, source);
queries are (qid, query, gt array<string>, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.arxiv import mapped_id, month_start, year_month
from lodestone.functions.rouge import lcs_of, rouge_of, word_masks, words
from lodestone.functions.text import clean_title, letters_key
from lodestone.operators.bounds import small
from lodestone.plans.storage import stored

PAPER = {"title": "string", "abstract": "string", "date": "string", "authors": "array<string>", "category": "array<string>", "url": "string"}
#: A title counts as found from this similarity on.
SIMILAR = 0.85


def id_map(rows: DataFrame) -> DataFrame:
    """(corpusid, arxiv_id) from (corpusid, external, urls); rows that give no id go."""
    return rows.select("corpusid", mapped_id(F.col("external"), F.col("urls")).alias("arxiv_id")).where("arxiv_id IS NOT NULL")


def mapped_queries(queries: DataFrame, ids: DataFrame) -> DataFrame:
    """(qid, query, corpusids) with ``gt`` in their order; a query of which an id is not mapped goes, one without ids stays."""
    pairs = queries.select("qid", F.posexplode("corpusids").alias("pos", "corpusid")).join(ids, "corpusid", "left")
    got = pairs.groupBy("qid").agg(F.bool_and(F.col("arxiv_id").isNotNull()).alias("all"), F.array_sort(F.collect_list(F.struct("pos", "arxiv_id"))).alias("g"))
    joined = queries.join(got, "qid", "left").where(F.coalesce("all", F.lit(True)))
    return joined.select("qid", "query", F.coalesce(F.transform("g", lambda x: x["arxiv_id"]), F.array().cast("array<string>")).alias("gt"))


def titled_papers(titles: DataFrame, members: DataFrame) -> DataFrame:
    """(arxiv_id, title) with the stored paper of the same letters, where one is stored."""
    m = members.select(letters_key(F.col("title")).alias("key"), F.col("title").alias("stored_title"), "abstract")
    return titles.withColumn("key", letters_key(F.col("title"))).join(m, "key", "left").select("arxiv_id", F.coalesce("stored_title", "title").alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), month_start(F.col("arxiv_id")).alias("date"))


def mapped_papers(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """(corpusid, title, abstract) by arxiv_id; of several rows of an id the last by ``corpusid`` counts."""
    rows = papers.join(ids, "corpusid")
    return rows.groupBy("arxiv_id").agg(F.max_by(F.struct("title", "abstract"), "corpusid").alias("p")).select("arxiv_id", "p.title", "p.abstract")


def _filled(name: str, kind: str) -> Column:
    a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
    if kind.startswith("array"):
        return F.when(F.size(F.coalesce(b, F.array().cast(kind))) > 0, b).otherwise(a)
    return F.coalesce(F.nullif(b, F.lit("")), a, b)


def merge_papers(first: DataFrame, second: DataFrame) -> DataFrame:
    """All papers of both; a field of the second wins unless it is null or empty, and its source stays."""
    columns = [_filled(c, k).alias(c) for c, k in PAPER.items()]
    return first.alias("a").join(second.alias("b"), F.col("a.arxiv_id") == F.col("b.arxiv_id"), "full_outer").select(F.coalesce("b.arxiv_id", "a.arxiv_id").alias("arxiv_id"), *columns, F.coalesce("b.source", "a.source").alias("source"))


def enrich(papers: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers with the fields of ``found`` by arxiv_id, which override even when empty; and the ids not found."""
    columns = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in PAPER]
    both = papers.alias("a").join(found.alias("b"), F.col("a.arxiv_id") == F.col("b.arxiv_id"), "left").select("a.arxiv_id", *columns, "a.source")
    return both, papers.join(found, "arxiv_id", "left_anti").select("arxiv_id")


def _prefixes(titles: DataFrame, frequency: DataFrame) -> DataFrame:
    """(t, n, word, nth, k) of the rarest words of each title (t, w): enough that two titles with F over SIMILAR share one.

    F over s needs a common subsequence of over s / (2 - s) of each title's
    words, so of its n words all but so many, less one, can be left out.
    """
    rows = titles.select("t", F.size("w").alias("n"), F.explode("w").alias("word"))
    # Equal words of a title are numbered, so that a title is a set.
    rows = rows.groupBy("t", "n", "word").agg(F.count("*").cast("int").alias("times")).select("t", "n", "word", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    common = F.floor(F.col("n") * (SIMILAR / (2 - SIMILAR)) + 1e-9) + 1
    ranked = rows.join(frequency, "word", "left").withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy(F.coalesce("df", F.lit(0)), "word", "nth")))
    return ranked.where(F.col("k") <= F.col("n") - common + 1).select("t", "n", "word", "nth", "k")


def similar_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(t, u, sim) of all pairs of different texts t of ``left`` and u of ``right`` (columns t, distinct) with a similarity over SIMILAR.

    Pairs that share one of their rarest words and fit in length are compared;
    the bounds follow from the measure, so that no pair is lost.
    """
    x, y = (d.select("t", words(F.col("t")).alias("w")).where(F.size("w") > 0) for d in (left, right))
    frequency = y.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    a, b = _prefixes(x, frequency), _prefixes(y, frequency).withColumnsRenamed({"t": "u", "n": "m", "k": "l"})
    fits = 2 * F.least("n", "m") > SIMILAR * (F.col("n") + F.col("m"))
    # Of the first word that two titles share, all that they can share lies behind it in both.
    reach = 2 * (1 + F.least(F.col("n") - F.col("k"), F.col("m") - F.col("l"))) > SIMILAR * (F.col("n") + F.col("m")) - 1e-9
    pairs = stored(a.join(b, ["word", "nth"]).where(fits & reach).select("t", "u").distinct())
    # The bits of a title are worked out once, not for each pair.
    masks = stored(x.join(pairs.select("t").distinct(), "t", "left_semi").select("t", F.size("w").alias("n"), word_masks(F.col("w")).alias("masks")))
    both = pairs.join(masks, "t").withColumn("w", words(F.col("u")))
    near = both.select("t", "u", rouge_of(lcs_of(F.col("masks"), F.col("w")), F.col("n"), F.size("w")).alias("sim"))
    return near.where(F.col("sim") > SIMILAR)


def references_by_id(references: DataFrame, meta: DataFrame) -> DataFrame:
    """(ref_id, m_id, m_title, how): the references that ``reference_lookup`` finds by id; no title is compared."""
    both = references.join(meta.select(F.col("arxiv_id").alias("m_id"), F.col("title").alias("m_title")), F.col("arxiv_id") == F.col("m_id"))
    return both.groupBy("ref_id").agg(F.min(F.struct("m_id", "m_title")).alias("m")).select("ref_id", "m.m_id", "m.m_title", F.lit("id").alias("how"))


def reference_lookup(references: DataFrame, meta: DataFrame) -> DataFrame:
    """Each reference (ref_id, arxiv_id, title) by id, else by its most similar title of over 0.85 (the least id of equals), else an empty record.

    Titles are compared cleaned and once for each text.  The empty record has
    the reference's id and cleaned title; its other fields are empty.
    """
    by_id = references_by_id(references, meta)
    key = F.lower(clean_title(F.col("title"))).alias("t")
    rest = references.join(by_id, "ref_id", "left_anti").select("ref_id", key)
    titles = meta.groupBy(key).agg(F.min(F.struct(F.col("arxiv_id").alias("m_id"), F.col("title").alias("m_title"))).alias("m"))
    near = similar_titles(rest.select("t").distinct(), titles.select("t")).join(titles.withColumnRenamed("t", "u"), "u").groupBy("t").agg(F.min(F.struct((-F.col("sim")).alias("s"), "m.m_id", "m.m_title")).alias("m"))
    by_title = rest.join(near, "t").select("ref_id", "m.m_id", "m.m_title", F.lit("title").alias("how"))
    found = by_id.unionByName(by_title)
    out = references.join(found, "ref_id", "left").select("ref_id", F.coalesce("m_id", "arxiv_id").alias("arxiv_id"), F.coalesce("m_title", clean_title(F.col("title"))).alias("title"), F.coalesce("how", F.lit("empty")).alias("how"))
    rest_of = meta.select(F.col("arxiv_id"), F.col("title"), *(F.col(c) for c in ("abstract", "date", "url", "authors", "category") if c in meta.columns))
    if len(rest_of.columns) == 2:
        return out
    both = out.join(rest_of.dropDuplicates(["arxiv_id", "title"]), ["arxiv_id", "title"], "left")
    empty = {c: F.array().cast(PAPER[c]) if PAPER[c].startswith("array") else F.lit("") for c in rest_of.columns[2:]}
    return both.select("ref_id", "arxiv_id", "title", "how", *(F.coalesce(c, e).alias(c) for c, e in empty.items()))


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, paper_id): documents (doc_id, text) whose text holds the passage (item_id, text).

    Words within a passage stand whole in a text that holds it, so a text that
    lacks the passage's second to fourth word in a row cannot hold it; what has
    them is compared.  Passages of fewer than five words are compared with all.
    """
    three = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    parts = passages.where("text IS NOT NULL").select("item_id", F.col("text").alias("passage"), F.split("text", r"\s+").alias("w"))
    asked = parts.where(F.size("w") >= 5).select("item_id", three(F.col("w"), F.lit(1)).alias("key"))
    words_of = docs.select("doc_id", F.split("text", r"\s+").alias("w")).where(F.size("w") > 2)
    keys = words_of.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: three(F.col("w"), i)))).alias("key"))
    maybe = keys.join(small(stored(asked)), "key").select("doc_id", "item_id").distinct()
    maybe = small(stored(maybe))  # few pairs come to the texts
    long = maybe.join(docs.select("doc_id", "text"), "doc_id").join(parts.select("item_id", "passage"), "item_id").where(F.contains("text", "passage"))
    short = docs.select("doc_id", "text").join(parts.where(F.size("w") < 5).select("item_id", "passage"), F.contains("text", "passage"))
    return long.select("item_id", "doc_id").unionAll(short.select("item_id", "doc_id")).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("paper_id")).distinct()


def survey_references(surveys: DataFrame) -> DataFrame:
    """(survey_id, key, arxiv_id, title): references of surveys with an id, numbered from '1'."""
    return surveys.where(F.coalesce("arxiv_id", F.lit("")) != "").select(F.col("arxiv_id").alias("survey_id"), F.posexplode("references").alias("pos", "r")).select("survey_id", (F.col("pos") + 1).cast("string").alias("key"), "r.arxiv_id", "r.title")


def labelled_truth(papers: Column, labels: Column) -> Column:
    """Distinct non-empty arxiv ids with label 1; the longer array is cut to the shorter."""
    n = F.least(F.size(papers), F.size(labels))
    pairs = F.arrays_zip(F.slice(papers, F.lit(1), n).alias("p"), F.slice(labels, F.lit(1), n).alias("l"))
    ids = F.transform(F.filter(pairs, lambda x: x["l"] == 1), lambda x: x["p"]["arxiv_id"])
    return F.array_distinct(F.filter(ids, lambda x: F.coalesce(x, F.lit("")) != ""))


def labelled_titles(papers: Column, labels: Column) -> Column:
    n = F.least(F.size(papers), F.size(labels))
    pairs = F.arrays_zip(F.slice(papers, F.lit(1), n).alias("p"), F.slice(labels, F.lit(1), n).alias("l"))
    titles = F.transform(F.filter(pairs, lambda x: x["l"] == 1), lambda x: x["p"]["title"])
    return F.array_distinct(F.filter(titles, lambda x: ~F.coalesce(x, F.lit("")).isin("", "Unknown")))


def latest_month(ids: Column) -> Column:
    """The greatest 'YYYY-MM' of the ids, or null."""
    return F.array_max(F.transform(ids, lambda x: F.when(year_month(x).isNotNull(), F.format_string("%04d-%02d", year_month(x)["year"], year_month(x)["month"]))))


def evaluation_queries(queries: DataFrame, papers: DataFrame, not_found: DataFrame) -> DataFrame:
    """Queries in evaluation form: ground truth within the corpus with titles and years, labels of 1, the latest month, and validity."""
    gt = queries.select("qid", F.posexplode("gt").alias("pos", "arxiv_id"))
    known = gt.join(papers.select("arxiv_id", "title"), "arxiv_id").select("qid", "pos", "arxiv_id", "title", year_month(F.col("arxiv_id"))["year"].alias("year"))
    cited = known.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "arxiv_id", "title", "year"))).alias("c"))
    bad = gt.join(not_found, "arxiv_id", "left_semi").groupBy("qid").agg(F.lit(True).alias("bad"))
    joined = queries.join(cited, "qid", "left").join(bad, "qid", "left")
    papers_of = F.transform("c", lambda x: F.struct(x["arxiv_id"].alias("arxiv_id"), x["title"].alias("title"), x["year"].alias("year")))
    empty = F.array().cast("array<struct<arxiv_id:string,title:string,year:int>>")
    out = joined.withColumn("cited_paper", F.coalesce(papers_of, empty))
    return out.select("qid", "query", "cited_paper", F.array_repeat(F.lit(1), F.size("cited_paper")).alias("gt_label"), latest_month(F.col("gt")).alias("date"), "source", ((F.size("gt") > 0) & F.col("bad").isNull()).alias("valid"))


def first_papers(papers: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` papers of the corpus, all if None or 0: a smaller corpus for trials."""
    return papers.orderBy("ord").limit(most) if most else papers


def with_order(papers: DataFrame, *keys: str) -> DataFrame:
    """``ord``, the place in the corpus, from a total order of ``keys``: ranks within range partitions plus the partitions' sizes before."""
    parts = papers.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    w = Window.partitionBy("_part").orderBy(*keys)
    return parts.withColumn("_rn", F.row_number().over(w) - 1).join(F.broadcast(base.select("_part", "_base")), "_part").withColumn("ord", F.col("_rn") + F.col("_base")).drop("_part", "_rn", "_base")
