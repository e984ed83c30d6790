"""Structured Streaming around the machines: keyed state, windows, sessions, sinks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def keyed(stream: DataFrame, key: str, order: str, schema: str, step: Callable, item: Callable[[pd.Series], object], flush: Callable | None = None, timeout_ms: int | None = None) -> DataFrame:
    """Runs a machine per key over a stream; ``schema`` is that of its outputs, put after the key.

    Rows of one batch are taken in order of ``order``.  With ``timeout_ms`` a key without news is ended:
    ``flush(state) -> outputs`` gives what it still holds.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kind = dict(stream.dtypes)[key]

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            out = flush(held) if flush else []
            state.remove()
        else:
            out = []
            for _, row in pd.concat(list(pdfs)).sort_values(order, kind="stable").iterrows():
                held, new = step(held, item(row))
                out += new
            state.update((pickle.dumps(held),))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(k[0], *o) for o in out], columns=[key, *names])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {schema}", "state binary", "append", timeout)


def sliding(stream: DataFrame, time: str, size: str, slide: str, late: str, *keys: str) -> DataFrame:
    """Counts per sliding window; rows later than the watermark are dropped (the machines' own buffers overwrite instead)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts per session of at most ``gap`` between rows."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes all that is there now to Parquet and ends."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_whole(stream: DataFrame, path: str, checkpoint: str):
    """Writes the aggregates over all that is there now, with those the watermark hasn't closed, and ends."""
    q = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str):
    """Binds a callback to every micro-batch."""
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


class Progress(StreamingQueryListener):
    """Collects rows per batch as a stream goes on."""

    def __init__(self):
        self.rows: list[int] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows.append(event.progress.numInputRows)

    def onQueryTerminated(self, event):
        pass


def files(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
