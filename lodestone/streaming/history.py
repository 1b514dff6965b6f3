"""Running state of an evaluation over a stream of events.

Events are (qid, paper_id, iter, rank, selected); a null rank stands for a
paper that was not found.  Both queries keep one state for each
(qid, paper_id) and may be run with checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from lodestone.operators.search import NOT_FOUND

HISTORY = "qid long, paper_id long, iter int, rank long, version long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RankHistory(StatefulProcessor):
    """Of a paper: the least rank in each iteration, and the iteration that first selected it.

    The state has as many entries as there are iterations, whatever the number
    of events.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranks = handle.getMapState("ranks", "iter int", "rank long")
        self.chosen = handle.getValueState("chosen", "iter int, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.ranks.iterator()}
        chosen, version = self.chosen.get() if self.chosen.exists() else (None, 0)
        for frame in rows:
            for i, rank, selected in zip(frame["iter"], frame["rank"], frame["selected"], strict=True):
                i, rank = int(i), NOT_FOUND if pd.isna(rank) else int(rank)
                if rank < held.get(i, rank + 1):
                    held[i] = rank
                    self.ranks.updateValue((i,), (rank,))
                if selected and (chosen is None or i < chosen):
                    chosen = i
        self.chosen.update((chosen, version + 1))
        out, least = [], None
        for i in sorted(held):
            least = held[i] if least is None else min(least, held[i])
            # Selected papers are left out of later searches: from there on the least rank so far counts.
            out.append((*key, i, least if chosen is not None and i >= chosen else held[i], version + 1))
        yield pd.DataFrame(out, columns=["qid", "paper_id", "iter", "rank", "version"])

    def close(self) -> None:
        pass


def rank_history(events: DataFrame) -> DataFrame:
    """An update query: ranks of a paper by iteration as ``metrics.rank_history`` has them for the events so far, each time it has new ones.

    Of a (qid, paper_id, iter) the row of the greatest ``version`` counts, see
    ``latest``.  Events may come late and in any order.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    keyed = events.select("qid", "paper_id", F.col("iter").cast("int").alias("iter"), F.col("rank").cast("long").alias("rank"), F.coalesce("selected", F.lit(False)).alias("selected"))
    return keyed.groupBy("qid", "paper_id").transformWithStateInPandas(RankHistory(), HISTORY, "Update", "None")


def latest(updates: DataFrame) -> DataFrame:
    """(qid, paper_id, iter, rank): the last update of each."""
    last = F.row_number().over(Window.partitionBy("qid", "paper_id", "iter").orderBy(F.col("version").desc()))
    return updates.withColumn("k", last).where("k = 1").select("qid", "paper_id", "iter", "rank")


def exclusions(events: DataFrame) -> DataFrame:
    """Papers that a query has selected so far: what later searches leave out."""
    return events.where("selected").dropDuplicates(["qid", "paper_id"]).select("qid", "paper_id", "iter")


def run_once(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """All that the source has now, through a streaming query into a table at ``path``.

    Each batch is a folder of its own, written anew if the batch is repeated;
    a complete query's last batch is its result, the batches of others are
    added up.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    table = stream.sparkSession.read.parquet(path)
    if mode == "complete":
        table = table.where(F.col("batch") == table.agg(F.max("batch")).first()[0])
    return table.drop("batch")
