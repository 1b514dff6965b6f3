"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a temporary one only where none is set and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def removed_at_end(spark: SparkSession, path: str) -> None:
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, so a lost executor costs no earlier work.

    The files go when the driver ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    removed_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of ``written`` tables that no later step reads."""
    for df in tables:
        at, files = _file_system(df.sparkSession, df._written_at)
        files.delete(at, True)


def set_aside(df: DataFrame, names: set[str]) -> tuple[DataFrame, list]:
    """``df`` with those of its columns renamed that are called as in ``names``, and the columns that give the old names back."""
    new = {c: c if c not in names else f"_aside_{i}_{uuid.uuid4().hex[:8]}" for i, c in enumerate(df.columns)}
    return df.withColumnsRenamed(new), [F.col(f"`{n}`").alias(c) for c, n in new.items()]
