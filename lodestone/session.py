"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestone", master: str | None = None, **settings: str) -> SparkSession:
    """AQE with skew-join handling and UTC; partition counts are left to the cluster's settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**fixed, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
