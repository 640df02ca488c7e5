"""Structured Streaming twins: change feed, rate limits, quotas, idempotent replay, late orphans. Each has a batch twin in operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chunklake.functions.expr import invalidations
from chunklake.operators.policy import bucket_step, lease_step


def tail(spark: SparkSession, path: str, schema, after: int = 0) -> DataFrame:
    """Entries of an append-only log folder with lsn > after, as they arrive."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("lsn") > after)


def publish(changes: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "250 milliseconds"):
    """Hands each micro-batch to the handler; offsets are in the checkpoint, so a restart goes on where it ended."""
    return changes.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def fan_out(changes: DataFrame) -> DataFrame:
    """One row for each thing that a change makes stale."""
    return changes.select("lsn", F.explode(invalidations(F.col("ino"), F.col("op"), F.col("payload"))).alias("i")).select("lsn", "i.kind", "i.ino", "i.name")


def replayed_once(records: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Records without those seen before; state is kept as long as the watermark allows repeats."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def final_orphans(stored: DataFrame, live: DataFrame, key: list[str], time: str, window: str) -> DataFrame:
    """Arrivals per event-time window that no live row names, given out once the safety window has passed the watermark."""
    lost = stored.join(live, key, "left_anti").withWatermark(time, window)
    return lost.groupBy(F.window(time, window), *key).agg(F.count(F.lit(1)).alias("n"))


class _Fold(StatefulProcessor):
    """A fold over a key's rows, in order within a micro-batch; state is one row of longs and strings."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for row in data.itertuples(index=False):
            state, value = self.step(state, row)
            out.append(value)
        self.state.update(state)
        yield data.assign(**{self.result: out})[[*self.columns, self.result]]

    def close(self) -> None:
        pass


class TokenBucket(_Fold):
    schema, result, columns = "tokens long, ms long", "allowed", ["bucket_key", "event_id", "ms"]

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = int(rate * 1000), int(burst * 1000)

    def step(self, state, row):
        return bucket_step(state, int(row.ms), self.rate, self.burst)


class Quota(_Fold):
    """Running bytes of a key, clamped at 0 event by event."""

    schema, result, columns = "bytes long, ms long", "bytes", ["bucket_key", "event_id", "ms"]

    def step(self, state, row):
        now = max(0, (state[0] if state else 0) + int(row.delta))
        return (now, int(row.ms)), now


class Leases(_Fold):
    schema, result, columns = "generation long, node string, expires long", "outcome", ["bucket_key", "event_id", "ms"]

    def __init__(self, ttl: int):
        self.ttl = ttl

    def step(self, state, row):
        return lease_step(state, row.node, int(row.ms), self.ttl)


class SequentialReads(_Fold):
    """Bytes of the run of reads that each begin where the one before ended."""

    schema, result, columns = "end_at long, run long", "run_bytes", ["bucket_key", "event_id", "ms"]

    def step(self, state, row):
        run = (state[1] if state and state[0] == row.offset else 0) + int(row.length)
        return (int(row.offset + row.length), run), run


def fold(requests: DataFrame, processor: _Fold, kind: str) -> DataFrame:
    """requests (bucket_key, event_id, ms, ...) with the processor's result. Needs the RocksDB state store."""
    out = f"bucket_key long, event_id long, ms long, {processor.result} {kind}"
    return requests.groupBy("bucket_key").transformWithStateInPandas(processor, out, "append", "none")


def backlog_age(stream: DataFrame, time: str, now) -> DataFrame:
    """Seconds since the oldest staged row."""
    return stream.agg((F.unix_timestamp(now) - F.min(F.unix_timestamp(time))).alias("age_s"))
