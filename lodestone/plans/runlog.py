"""The log of an iterative run: what each iteration added, and a manifest of the iterations that ended.

An iteration writes its own rows of each table into a folder of its own and
then commits a manifest of them, with the rows and seconds of its phases.  A
driver that starts again at the same folder goes on after the last committed
iteration; what a broken one left is written anew.  No table is ever written
twice, so an iteration costs what it adds.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.storage import commit, committed, folder, removed_at_end

PHASES = "iter int, phase string, rows long, seconds double"


class RunLog:
    """Tables ``name`` of fixed ``schemas`` under ``path``; without one, in a folder that goes with the driver."""

    def __init__(self, spark: SparkSession, schemas: dict[str, str], inputs: str, path: str | None = None):
        self.spark, self.schemas, self.inputs = spark, schemas, inputs
        self.path = path or f"{folder(spark)}/run-{uuid.uuid4().hex}"
        if path is None:
            removed_at_end(spark, self.path)
        self.manifests = {int(n): json.loads(t) for n, t in committed(spark, f"{self.path}/manifest").items()}
        for m in self.manifests.values():
            if m["inputs"] != inputs:
                raise ValueError(f"{self.path} holds a run over other queries")
        self.started: dict[str, list] = {}

    @property
    def last(self) -> int:
        """The last iteration that ended, 0 before the first."""
        return max(self.manifests, default=0)

    @property
    def over(self) -> bool:
        """Whether the run ended before its last iteration."""
        return any(m["over"] for m in self.manifests.values())

    def add(self, name: str, iteration: int, rows: DataFrame, phase: str | None = None, begin: float | None = None) -> DataFrame:
        """Writes an iteration's rows of a table and returns them as written; their number, and the time (since ``begin`` of time.monotonic), count for ``phase``."""
        at, seen, begin = f"{self.path}/{name}/{iteration}", Observation(), begin or time.monotonic()
        shaped = rows.select(*self.spark.createDataFrame([], self.schemas[name]).columns)
        shaped.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(at)
        if phase is not None:
            spent = self.started.setdefault(phase, [0, 0.0])
            spent[0] += seen.get["rows"]
            spent[1] += time.monotonic() - begin
        return self.spark.read.schema(self.schemas[name]).parquet(at)

    def table(self, name: str, upto: int | None = None) -> DataFrame:
        """All rows of a table in the iterations up to ``upto``, the last committed one unless given."""
        paths = [f"{self.path}/{name}/{i}" for i in range(1, (self.last if upto is None else upto) + 1)]
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def end(self, iteration: int, over: bool = False) -> None:
        """Commits the iteration, whose tables must all be written."""
        made = {"inputs": self.inputs, "over": over, "phases": [[p, n, s] for p, (n, s) in self.started.items()]}
        commit(self.spark, f"{self.path}/manifest/{iteration}", json.dumps(made))
        self.manifests[iteration], self.started = made, {}

    def phases(self) -> DataFrame:
        """(iter, phase, rows, seconds) of the committed iterations, of earlier drivers too."""
        return self.spark.createDataFrame([(i, p, n, s) for i, m in sorted(self.manifests.items()) for p, n, s in m["phases"]], PHASES)


def fingerprint(rows: DataFrame) -> str:
    """Tells tables of other rows apart, whatever their order."""
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)"))).first()
    return f"{n}:{total or 0}"
