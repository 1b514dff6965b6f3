"""Tables between the steps of a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    made = tempfile.mkdtemp(prefix="plan-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def made_folder(spark: SparkSession, path: str) -> str:
    at, files = _files(spark, path)
    files.mkdirs(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


def commit(spark: SparkSession, path: str, text: str) -> None:
    """A small file at ``path``, there as a whole or not at all."""
    new, files = _files(spark, f"{path}.new")
    out = files.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(new, _files(spark, path)[0]):
        raise FileExistsError(path)


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and texts of the files that ``commit`` left in the folder."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return {}
    out = {}
    for f in files.listStatus(at):
        name = f.getPath().getName()
        if not name.endswith(".new"):
            stream = files.open(f.getPath())
            out[name] = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
    return out


def removed_at_end(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.deleteOnExit(at)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again; its lineage ends there.  The files go when the driver ends, or by ``discard``."""
    spark = df.sparkSession
    path = f"{folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of ``stored`` tables that no later step reads."""
    for df in tables:
        at, files = _files(df.sparkSession, df._stored_at)
        files.delete(at, True)
