"""Change streams to state, and windowed counts.

Two forms of replay.  :func:`merge_stream` folds every micro-batch into a versioned state table: a batch's effect is one
merge, a repeated batch is skipped by its id, and the same operators as in batch decide.  :func:`keyed_state` keeps state
in Spark's state store instead and suits low latency.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import changes
from ..sources.files import Files


class MergedState:
    """State tables ``v=N`` below a folder; version N holds batches 0..N."""

    def __init__(self, spark: SparkSession, path: str, key: str, value: str):
        self.spark, self.path, self.key, self.value = spark, path.rstrip("/"), key, value
        self.files = Files(spark, self.path)

    def latest(self) -> int:
        done = [int(n.removeprefix("v=")) for n in self.files.names("") if n.startswith("v=") and self.files.exists(f"{n}/_SUCCESS")]
        return max(done, default=-1)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.latest()}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of requests (lsn, op, key, value): gate, replay, write the next version."""
        last = self.latest()
        if batch_id <= last:
            return
        known = None
        if last >= 0:
            # the state re-enters as inserts older than any request
            known = self.read().select(F.col("lsn"), F.lit("insert").alias("op"), self.key, self.value)
        gated = changes.outcomes(batch, known, column=self.key).where("accepted").select("lsn", "op", self.key, self.value)
        log = gated if known is None else known.unionByName(gated)
        changes.replay(log, self.value, column=self.key).write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        if last > 0:
            self.files.delete(f"v={last - 1}")


def merge_stream(requests: DataFrame, state: MergedState, checkpoint: str) -> None:
    """Run all available input of a streaming DataFrame of requests into ``state``."""
    query = requests.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class LatestValue(StatefulProcessor):
    """Existence gate and newest value of one key; rows of a batch are taken in lsn order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "lsn long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        for r in pd.concat(list(rows)).sort_values("lsn").itertuples():
            if (r.op == "insert") == (held is None):
                held = None if r.op == "delete" else (int(r.lsn), float(r.value))
        if held is None:
            self.held.clear()
            yield pd.DataFrame({"key": [key[0]], "lsn": [None], "value": [None], "live": [False]})
        else:
            self.held.update(held)
            yield pd.DataFrame({"key": [key[0]], "lsn": [held[0]], "value": [held[1]], "live": [True]})

    def close(self) -> None:
        pass


def keyed_state(requests: DataFrame) -> DataFrame:
    """(key, lsn, value, live) of each key a batch touches, for requests (lsn, op, key, value double).

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return requests.groupBy("key").transformWithStateInPandas(statefulProcessor=LatestValue(), outputStructType="key long, lsn long, value double, live boolean", outputMode="Update", timeMode="None")


def to_files(changed: DataFrame, path: str, mode: str = "Update") -> None:
    """Run all available input; each batch's rows go to ``path/b=N``, with the batch's number, so a batch that comes again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/b={number}")

    changed.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Live (key, lsn, value) of the rows that :func:`to_files` wrote: the last batch of a key counts."""
    rows = spark.read.parquet(f"{path}/rows").groupBy("key").agg(F.max_by(F.struct("lsn", "value", "live"), "b").alias("r"))
    return rows.where("r.live").select("key", "r.lsn", "r.value")


def tumbling(events: DataFrame, ts: str, duration: str, *by: str, late: str | None = None) -> DataFrame:
    """Counts by tumbling window; ``late``: how long a window stays open for late rows in append mode."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", duration).alias("w"), *by).agg(F.count("*").alias("n"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregate over all available input and read its result, which is held by the driver: for small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
