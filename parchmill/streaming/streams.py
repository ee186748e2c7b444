"""Streams over job events and segments."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files as a stream, so many a batch; event times as timestamps, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def once(rows: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def activity(rows: DataFrame, at: str, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Extension: counts by event-time windows with late rows up to the watermark."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(rows: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Extension: activity sessions of a key."""
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Quota(StatefulProcessor):
    """So many uploads of a key in a fixed window from its first one.

    A timer on event time drops the state of a window that is over: what comes later opens a new one,
    as if the key had never been seen.
    """

    def __init__(self, seconds: int = 3600, most: int = 20):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "opened long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, used = self.state.get() if self.state.exists() else (None, 0)
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        allowed = []
        for t in frame["at"].tolist():
            if opened is None or t >= opened + self.seconds:
                opened, used = t, 0
            allowed.append(used < self.most)
            used += allowed[-1]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((int(opened), int(used)))
        self.handle.registerTimer(1000 * (int(opened) + self.seconds))
        yield frame.assign(allowed=allowed)[["owner", "event_id", "at", "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"owner": pd.Series([], dtype="int64"), "event_id": pd.Series([], dtype="int64"), "at": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


class Watchdog(StatefulProcessor):
    """A stall for each time that a key is silent for ``seconds``: told by a timer on event time, whether or not it goes on later.

    Each beat puts the key's timer anew; when the watermark passes it, the stall is told.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = sorted(int(t.value // 1_000_000) for frame in rows for t in frame["ts"])
        before = self.last.get()[0] if self.last.exists() else None
        stalled = []
        for at in beats:
            if before is not None and at - before >= 1000 * self.seconds:
                stalled.append(before)
            before = at if before is None else max(before, at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((before,))
        self.handle.registerTimer(before + 1000 * self.seconds)
        yield pd.DataFrame({"owner": [key[0]] * len(stalled), "stalled_at": stalled, "resumed": [True] * len(stalled)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"owner": [key[0]], "stalled_at": [before], "resumed": [False]})

    def close(self) -> None:
        pass


class SharedLimit(StatefulProcessor):
    """Slots and cooldowns of a provider that all workers share, kept by key.

    A call waits for the slot after the last one and for the end of a cooldown; a refusal opens or
    doubles the cooldown, a success ends the doubling.  Times are milliseconds.
    """

    def __init__(self, interval: int, base: int, most: int):
        self.interval, self.base, self.most = interval, base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("limit", "slot long, gate long, refusals long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slot, gate, refusals = self.state.get() if self.state.exists() else (None, 0, 0)
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        slots = []
        for at, outcome in zip(frame["at"].tolist(), frame["outcome"].tolist()):
            slot = max(at, gate) if slot is None else max(at, gate, slot + self.interval)
            slots.append(slot)
            if outcome == "refused":
                refusals = min(refusals + 1, 40)
                gate = max(gate, slot + min(self.base * 2 ** (refusals - 1), self.most))
            elif outcome == "success":
                refusals = 0
        self.state.update((int(slot), int(gate), int(refusals)))
        yield frame.assign(slot=slots)[["owner", "event_id", "at", "slot"]]

    def close(self) -> None:
        pass


class Snapshot:
    """A table that is read once and kept for ``seconds``, or until something is written.

    ``read`` makes the frame; the driver keeps its plan over files, not its rows.
    """

    def __init__(self, read: Callable[[], DataFrame], seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.read, self.seconds, self.clock = read, seconds, clock
        self._held: tuple[float, DataFrame] | None = None

    def get(self) -> DataFrame:
        now = self.clock()
        if self._held is None or now - self._held[0] >= self.seconds:
            self._held = (now, self.read())
        return self._held[1]

    def invalidate(self) -> None:
        self._held = None


class Changes(StatefulProcessor):
    """Rows of a key whose payload differs from the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else None
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        keep = []
        for payload in frame["payload"].tolist():
            keep.append(payload != last)
            last = payload
        self.state.update((last,))
        yield frame[keep][["owner", "event_id", "at", "payload"]]

    def close(self) -> None:
        pass


def quota(uploads: DataFrame, seconds: int = 3600, most: int = 20, late: str = "1 hour") -> DataFrame:
    """Uploads (owner, event_id, at in seconds) plus ``allowed``; rows later than ``late`` are dropped."""
    timed = uploads.select("owner", "event_id", "at", F.timestamp_seconds("at").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("owner").transformWithStateInPandas(Quota(seconds, most), "owner long, event_id long, at long, allowed boolean", "append", "eventTime")


def watchdog(beats: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """Beats (owner, ts) -> (owner, stalled_at, resumed): a row for each silence of ``seconds``; ``stalled_at`` in milliseconds."""
    return beats.select("owner", "ts").withWatermark("ts", late).groupBy("owner").transformWithStateInPandas(Watchdog(seconds), "owner long, stalled_at long, resumed boolean", "append", "eventTime")


def shared_limit(calls: DataFrame, interval: int, base: int = 15_000, most: int = 120_000) -> DataFrame:
    """Calls (owner, event_id, at, outcome) -> the time at which each may go out."""
    return calls.groupBy("owner").transformWithStateInPandas(SharedLimit(interval, base, most), "owner long, event_id long, at long, slot long", "append", "none")


def change_feed(rows: DataFrame) -> DataFrame:
    """Rows (owner, event_id, at, payload) that differ from the one before of their owner."""
    return rows.groupBy("owner").transformWithStateInPandas(Changes(), "owner long, event_id long, at long, payload string", "append", "none")


def write_batches(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces its own folder, so a batch that runs again counts once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there; a later call goes on from the checkpoint."""
    rows.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Progress(StreamingQueryListener):
    """Calls back with (batch, rows) after each batch."""

    def __init__(self, tell: Callable[[int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
