"""The event log as a stream: the latest state of each key in a state store, right under late and repeated events, with expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGED, EXPIRED = "changed", "expired"


class LatestState(StatefulProcessor):
    """Holds a key's newest (time in microseconds, event_id) with its state. Says so when it changes, and when it has been silent for too long.

    An event that isn't newer than what is held changes nothing, so that late and repeated events are harmless.
    """

    def __init__(self, key: Sequence[str], expiry_ms: int):
        self.key, self.expiry_ms = list(key), expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, micros long, event_id long")

    def _row(self, key: tuple, value: tuple, kind: str) -> Row:
        return Row(*[*self.key, "state", "micros", "event_id", "kind"])(*key, *value, kind)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.held.get() if self.held.exists() else None
        best = old = tuple(old) if old is not None else None
        for r in rows:
            if best is None or (r["micros"], r["event_id"]) > best[1:]:
                best = (r["state"], r["micros"], r["event_id"])
        if best is not None and best != old:
            self.held.update(best)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(best[1] // 1000 + self.expiry_ms)
            yield self._row(key, best, CHANGED)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            value = tuple(self.held.get())
            self.held.clear()
            yield self._row(key, value, EXPIRED)

    def close(self) -> None:
        pass


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with timers and keyed state, so that the store is set for no one else. Its zone is UTC: times without a zone go in and out by their own clock."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def stream_latest_states(events: DataFrame, key: Sequence[str], expiry_ms: int | None = None) -> DataFrame:
    """key, state, timestamp, event_id, kind: a row whenever a key's latest state changes, or expires.

    With an expiry, events need a watermark: a key is given up once the watermark has passed its last event by so much, and rows
    behind the watermark are dropped. Without one nothing is dropped, and state is a row a key, which needs no timer, so that Spark's
    own aggregate holds it and no row goes to Python; a key is said again, unchanged, where a batch has only late or repeated events of it.
    """
    if expiry_ms is None:
        rows = events.filter("timestamp is not null").select(*key, F.struct(F.unix_micros("timestamp").alias("micros"), F.coalesce(F.col("event_id"), F.lit(0)).cast("long").alias("event_id"), "state").alias("_held"))
        held = rows.groupBy(*key).agg(F.max("_held").alias("_held"))
        return held.select(*key, "_held.state", F.timestamp_micros("_held.micros").alias("timestamp"), "_held.event_id", F.lit(CHANGED).alias("kind"))
    schema = StructType([*(events.schema[c] for c in key), StructField("state", StringType()), StructField("micros", LongType()), StructField("event_id", LongType()), StructField("kind", StringType())])
    rows = events.filter("timestamp is not null").select(*key, "state", "timestamp", F.unix_micros("timestamp").alias("micros"), F.coalesce(F.col("event_id"), F.lit(0)).cast("long").alias("event_id"))
    changes = rows.groupBy(*key).transformWithState(LatestState(key, expiry_ms), schema, "Update", "EventTime")
    return changes.select(*key, "state", F.timestamp_micros("micros").alias("timestamp"), "event_id", "kind")


def append_changes(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps each batch's rows in a folder of its own; running a batch twice changes nothing."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={epoch}")

    return run


def current_states(spark: SparkSession, folder: str, key: Sequence[str]) -> DataFrame:
    """The latest state of each key by the changes in folder; a key that has expired since isn't there."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy(*key).agg(F.max(F.struct("batch", "timestamp", "event_id", "state", "kind")).alias("last"))
    return last.select(*key, "last.state", "last.timestamp", "last.event_id", "last.kind").filter(F.col("kind") == CHANGED).drop("kind")


def start(rows: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Takes up where the checkpoint ends, and stops when all that is there has been read."""
    return rows.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
