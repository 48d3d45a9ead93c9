"""Streaming state: latest reports, alerts, failure detection, limits, windows.

State lives in the state store by key; each operator here equals its batch
twin on the same rows. Streams of state need RocksDB:
spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinetra import constants as K

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ordered(rows, *order: str) -> Iterator:
    """The rows of a key in order, whatever Arrow batches they came in; first the columns that order them, then the rest."""
    batches = [*rows]
    return pd.concat(batches).sort_values([*order], kind="stable").itertuples(index=False) if batches else iter(())


class Latest(StatefulProcessor):
    """The newest report of each vehicle by time, or by arrival."""

    def __init__(self, by_arrival: bool = False):
        self.by_arrival = by_arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.report = handle.getValueState("report", "ts double, seq long, x double, y double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = self.report.get()
        for batch in rows:
            for row in batch.sort_values("seq").itertuples(index=False):
                if best is None or self.by_arrival or (row.ts, row.seq) > (best[0], best[1]):
                    best = (float(row.ts), int(row.seq), float(row.x), float(row.y))
        self.report.update(best)
        yield pd.DataFrame([(key[0], *best)], columns=["id", "ts", "seq", "x", "y"])

    def close(self) -> None:
        pass


def latest(reports: DataFrame, by_arrival: bool = False) -> DataFrame:
    """Updates of the newest report (id, ts, seq, x, y)."""
    return reports.groupBy("id").transformWithStateInPandas(Latest(by_arrival), "id long, ts double, seq long, x double, y double", "update", "none")


class Trajectory(StatefulProcessor):
    """The last cap reports of each vehicle by their number seq; emits how many are held and the oldest of them."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "seq long, x double, y double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # whatever Arrow batches the rows came in, no more than the last cap reports of each are held
        held = [*self.points.get()] if self.points.exists() else []
        for batch in rows:
            held += [(int(r.seq), float(r.x), float(r.y)) for r in batch.nlargest(self.cap, "seq").itertuples(index=False)]
            held = sorted(held)[-self.cap :]
        self.points.put(held)
        yield pd.DataFrame([(key[0], len(held), held[0][0])], columns=["id", "points", "oldest"])

    def close(self) -> None:
        pass


def trajectories(reports: DataFrame, cap: int = K.HISTORY_CAP) -> DataFrame:
    return reports.groupBy("id").transformWithStateInPandas(Trajectory(cap), "id long, points int, oldest long", "update", "none")


class Alerts(StatefulProcessor):
    """One alert for each pair: raised by its first risk, updated by later ones, closed by acknowledgement or, ALERT_EXPIRY seconds after its last risk, by expiry, which also drops its state."""

    columns = ["vehicle_id", "other_vehicle_id", "event", "priority", "ts"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", "priority int, ts double, acknowledged boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.alert.get(), []
        for row in ordered(rows, "ts", "kind"):
            if held is not None and row.ts - held[1] > K.ALERT_EXPIRY:
                if not held[2]:
                    out.append((*key, "expired", held[0], held[1] + K.ALERT_EXPIRY))
                held = None
            if row.kind == "ack":
                if held is not None:
                    held = (held[0], held[1], True)
                    out.append((*key, "acknowledged", held[0], row.ts))
                continue
            out.append((*key, "raised" if held is None or held[2] else "updated", int(row.priority), row.ts))
            held = (int(row.priority), float(row.ts), False)
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if held is None:
            self.alert.clear()
        else:
            self.alert.update(held)
            self.handle.registerTimer(int(1000 * (held[1] + K.ALERT_EXPIRY)) + 1)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.alert.get()
        self.alert.clear()
        gone = [] if held is None or held[2] else [(*key, "expired", held[0], held[1] + K.ALERT_EXPIRY)]
        yield pd.DataFrame(gone, columns=self.columns)

    def close(self) -> None:
        pass


def alert_updates(risks: DataFrame, acknowledged: DataFrame | None = None, watermark: str = "30 seconds") -> DataFrame:
    """Alert events from risks (vehicle_id, other_vehicle_id, priority, ts) and, as a second stream, acknowledgements; ts is event time in seconds."""
    rows = risks.select("vehicle_id", "other_vehicle_id", "priority", "ts", F.lit("risk").alias("kind"))
    if acknowledged is not None:
        rows = rows.unionByName(acknowledged.select("vehicle_id", "other_vehicle_id", F.lit(0).alias("priority"), "ts", F.lit("ack").alias("kind")))
    schema = "vehicle_id long, other_vehicle_id long, event string, priority int, ts double"
    timed = rows.withColumn("time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("time", watermark)
    return timed.groupBy("vehicle_id", "other_vehicle_id").transformWithStateInPandas(Alerts(), schema, "append", "eventTime")


class Heartbeats(StatefulProcessor):
    """Failed and recovered events of a node; a timer fires when enough intervals pass without a beat."""

    def __init__(self, interval: float, misses: int):
        self.limit = int(1000 * interval * misses)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.node = handle.getValueState("node", "last long, failed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t.value // 1_000_000 for batch in rows for t in batch["time"])
        held, out = self.node.get(), []
        last, failed = (held[0], held[1]) if held is not None else (times[0], False)
        for t in times:
            if failed or t - last >= self.limit:
                if not failed:
                    out.append((key[0], "failed", last + self.limit))
                out.append((key[0], "recovered", t))
            last, failed = max(last, t), False
        self.node.update((last, False))
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.limit)
        yield pd.DataFrame(out, columns=["node_id", "event", "ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.node.get()
        if held is None or held[1]:
            yield pd.DataFrame([], columns=["node_id", "event", "ms"])
            return
        self.node.update((held[0], True))
        yield pd.DataFrame([(key[0], "failed", held[0] + self.limit)], columns=["node_id", "event", "ms"])

    def close(self) -> None:
        pass


def node_failures(beats: DataFrame, interval: float = K.HEARTBEAT_INTERVAL, misses: int = K.HEARTBEAT_MISSES, watermark: str = "30 seconds") -> DataFrame:
    """Failure and recovery events of beats (node_id, time) in event time."""
    return beats.withWatermark("time", watermark).groupBy("node_id").transformWithStateInPandas(Heartbeats(interval, misses), "node_id long, event string, ms long", "append", "eventTime")


class Bucket(StatefulProcessor):
    """A token bucket for each key."""

    def __init__(self, rate: float, capacity: float):
        self.rate, self.capacity = rate, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.bucket.get(), []
        tokens, at = (held[0], held[1]) if held is not None else (self.capacity, None)
        for row in ordered(rows, "ts", "seq"):
            tokens = min(self.capacity, tokens + (0.0 if at is None else (row.ts - at) * self.rate))
            ok = tokens >= 1.0
            tokens, at = tokens - ok, float(row.ts)
            out.append((key[0], row.seq, bool(ok)))
        self.bucket.update((tokens, at))
        yield pd.DataFrame(out, columns=["client", "seq", "allowed"])

    def close(self) -> None:
        pass


def token_bucket(requests: DataFrame, rate: float, capacity: float) -> DataFrame:
    return requests.groupBy("client").transformWithStateInPandas(Bucket(rate, capacity), "client long, seq long, allowed boolean", "append", "none")


def windowed_counts(events: DataFrame, seconds: int, watermark: str = "30 seconds") -> DataFrame:
    """Events and mean value by tumbling window and type; windows close when the watermark passes."""
    return events.withWatermark("time", watermark).groupBy(F.window("time", f"{seconds} seconds").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.unix_seconds("w.start").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


def session_counts(events: DataFrame, gap: str = "10 seconds", watermark: str = "30 seconds") -> DataFrame:
    """Activity sessions of each user."""
    return events.withWatermark("time", watermark).groupBy(F.session_window("time", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.unix_seconds("w.start").alias("start"), "events")
