"""Readers of the engine's inputs, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.parse import normalised_entry
from lodestone.sources.members import json_members

PAPER = "arxiv_id STRING, title STRING, abstract STRING, date STRING, url STRING, authors ARRAY<STRING>, category ARRAY<STRING>"
BENCH = "query STRING, cited_paper ARRAY<STRUCT<arxiv_id STRING,title STRING,year INT>>, gt_label ARRAY<INT>, date STRING, source STRING, qid STRING, valid BOOLEAN"
PUBLISHED_BENCH = "query_id STRING, query STRING, gt_arxiv_ids ARRAY<STRING>, date_constraint STRING, source STRING, split STRING"
PUBLISHED_PAPER = "arxiv_id STRING, title STRING, abstract STRING, authors ARRAY<STRING>, published STRING, categories ARRAY<STRING>, url STRING"
RAW = "id STRING, title STRING, abstract STRING, authors STRING, authors_parsed ARRAY<ARRAY<STRING>>"
CITATION = "id STRING, title STRING, url STRING, date STRING, abstract STRING, category ARRAY<STRING>, authors ARRAY<STRING>"
SURVEY = "arxiv_id STRING, title STRING, references ARRAY<STRUCT<arxiv_id STRING,title STRING>>"
SUMMARY = "paper_id STRING, model STRING, summary STRING"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def paper_db(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """A JSON object of papers by id, in a file or in part files in order; ``ord`` is the place in the object.  Byte ranges are read by several tasks.

    A missing file is an error, or no papers where none is ``required``.
    """
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], f"paper_id STRING, ord BIGINT, {PAPER}")
    return json_members(spark, path, _struct(PAPER)).select(F.col("key").alias("paper_id"), "ord", "value.*")


def _struct(ddl: str) -> str:
    out = []
    depth, word = 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += ch
    return ",".join(":".join(w.strip().split(" ", 1)) for w in [*out, word])


def published_papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers in the published form, one a line, as engine papers."""
    rows = spark.read.schema(PUBLISHED_PAPER).json(path)
    return rows.select(F.col("arxiv_id").alias("paper_id"), "arxiv_id", "title", "abstract", F.col("published").alias("date"), "url", "authors", F.col("categories").alias("category"))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value) of the lines of JSONL files in the order in which they were written: by the files' times and names, byte ranges, and lines.

    What Spark packs into one task, and in which order, does not matter.
    """
    at = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(at.alias("at"), "value").where("value <> ''")


def bench(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark lines with ``idx``, their place: the lines of each byte range are numbered, and the ranges before it added; no text is moved to one task."""
    rows = placed_lines(spark, path).withColumn("_part", F.struct("at.time", "at.file", "at.block"))
    base = rows.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    placed = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy("at.line")) - 1).join(F.broadcast(base.select("_part", "_base")), "_part")
    return placed.select((F.col("_rn") + F.col("_base")).alias("idx"), F.from_json("value", BENCH).alias("b")).select("idx", "b.*")


def published_bench(spark: SparkSession, path: str) -> DataFrame:
    """Published queries as engine queries; every listed paper is ground truth."""
    rows = spark.read.schema(PUBLISHED_BENCH).json(path)
    cited = F.transform("gt_arxiv_ids", lambda x: F.struct(x.alias("arxiv_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year")))
    return rows.select("query", cited.alias("cited_paper"), F.array_repeat(F.lit(1), F.size("gt_arxiv_ids")).alias("gt_label"), F.substring("date_constraint", 1, 7).alias("date"), "source", F.col("query_id").alias("qid"), F.lit(True).alias("valid"))


def academic_queries(spark: SparkSession, paths: list[str], source: str) -> DataFrame:
    """(qid, query, gt, source) of several JSONL files; missing ones are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)]
    schema = "qid STRING, question STRING, answer_arxiv_id ARRAY<STRING>"
    rows = spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)
    return rows.select("qid", F.col("question").alias("query"), F.coalesce("answer_arxiv_id", F.array().cast("array<string>")).alias("gt"), F.lit(source).alias("source"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(name, title, abstract) of the JSON members of zip files, unpacked on the executors."""
    return unzipped(spark.read.format("binaryFile").load(path).select("content"))


def unzipped(zips: DataFrame, rows: int = 1000) -> DataFrame:
    """(name, title, abstract) of the JSON members of archives (content); other members go.  A task holds one archive and so many rows."""

    def unpack(batches):
        import io
        import json
        import zipfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = []
                    for name in z.namelist():
                        try:
                            d = json.loads(z.read(name))
                        except ValueError:
                            continue
                        if isinstance(d, dict):
                            found.append((name, d.get("title"), d.get("abstract")))
                        if len(found) >= rows:
                            yield pd.DataFrame(found, columns=["name", "title", "abstract"])
                            found = []
                    yield pd.DataFrame(found, columns=["name", "title", "abstract"])

    return zips.mapInPandas(unpack, "name string, title string, abstract string")


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """Metadata lines, cleaned; lines that are no JSON or have no id go."""
    rows = spark.read.schema(RAW + ", _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL AND id IS NOT NULL").select("id", *normalised_entry(F.col("title"), F.col("abstract"), F.col("authors"), F.coalesce("authors_parsed", F.array().cast("array<array<string>>")), F.col("id")))


def citation_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Entries of citation files by '<file>-<key>'; of equal keys the last file's counts."""
    rows = spark.read.text(pattern, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("stem"), F.col("_metadata.file_path").alias("file"), "value")
    return _citations(rows)


def citation_maps(spark: SparkSession, folder: str) -> DataFrame:
    """The same of maps written in folders by stem."""
    rows = spark.read.text(folder, wholetext=True).select("stem", F.col("_metadata.file_path").alias("file"), "value")
    return _citations(rows)


def _citations(rows: DataFrame) -> DataFrame:
    rows = rows.select("stem", "file", F.explode(F.from_json("value", f"MAP<STRING,STRUCT<{_struct(CITATION)}>>")).alias("k", "e"))
    return rows.groupBy(F.concat_ws("-", "stem", "k").alias("key")).agg(F.max_by("e", "file").alias("e")).select("key", "e.*")


def surveys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SURVEY).json(path)


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, abstract, date, authors, category) of Atom files; an old-style id keeps its archive, versions go."""
    schema = "id STRING, title STRING, summary STRING, published STRING, author ARRAY<STRUCT<name STRING>>, category ARRAY<STRUCT<_term STRING>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return rows.select(F.regexp_replace(F.regexp_replace("id", r"^.*/abs/", ""), r"v\d+$", "").alias("id"), tidy("title").alias("title"), tidy("summary").alias("abstract"), F.substring("published", 1, 10).alias("date"), F.transform("author", lambda a: a["name"]).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("category"))


def summary_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last summary of each paper and model, over all appended files; lines that are no record go."""
    rows = placed_lines(spark, path).select("at", F.from_json("value", SUMMARY).alias("s")).where("s.paper_id IS NOT NULL")
    return rows.groupBy("s.paper_id", "s.model").agg(F.max_by("s.summary", "at").alias("summary"))


def checkpoint_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path).where("idx >= 0")


def uncached(papers: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Papers without a summary of this model."""
    return papers.join(cache.where(F.col("model") == model).select("paper_id"), "paper_id", "left_anti")


def unprocessed(rows: DataFrame, done: DataFrame) -> DataFrame:
    return rows.join(done.where("idx >= 0").select("idx").distinct(), "idx", "left_anti")


def cached_pair(spark: SparkSession, folder: str, build) -> tuple[DataFrame, DataFrame]:
    """Queries and papers kept as two tables, used only if both are there, else built and written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [f"{folder}/{n}" for n in ("queries", "papers")]
    if not all((at := jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")).getFileSystem(conf).exists(at) for p in paths):
        for frame, p in zip(build(), paths, strict=True):
            frame.write.mode("overwrite").parquet(p)
    return tuple(spark.read.parquet(p) for p in paths)
