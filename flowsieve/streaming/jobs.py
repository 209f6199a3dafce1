"""Streaming jobs: sources, windowed counts, stateful processors, alert log."""

from __future__ import annotations

import hashlib
import math
import uuid
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from flowsieve.session import work_dir
from flowsieve.sources import alert_log

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_json_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """One JSON object per line from a folder that new files arrive in."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, for queries started inside; the setting is put back after."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available, into a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{work_dir(spark)}/flowsieve/{label}-{uuid.uuid4().hex}"
    with state_store(spark):
        run = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed_counts(events: DataFrame, keys: list[str], time_col: str, window: str, delay: str) -> DataFrame:
    """Rows per key and event-time window; rows behind the watermark are dropped."""
    return (
        events.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, window).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "rows")
    )


class WindowClock:
    """One event-time timer for each key, at the earliest moment asked for."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "millis long")

    def arm(self, millis: int) -> None:
        if self.armed.exists():
            old = self.armed.get()[0]
            if old <= millis:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(millis)
        self.armed.update((millis,))

    def fired(self) -> None:
        self.armed.clear()


class SortedWindow:
    """The last ``size`` scores, in order of arrival and in order of value.

    A score is placed and found by bisection; the quantile is read off its position.
    """

    def __init__(self, size: int, scores: Iterable[float]) -> None:
        self.size = size
        self.arrived = deque(scores)
        self.ordered = sorted(self.arrived)

    def add(self, score: float) -> None:
        self.arrived.append(score)
        insort(self.ordered, score)
        if len(self.arrived) > self.size:
            del self.ordered[bisect_left(self.ordered, self.arrived.popleft())]

    def quantile(self, share: float) -> float | None:
        """Linear interpolation between neighbours."""
        if not self.ordered:
            return None
        spot = (len(self.ordered) - 1) * share
        low = int(spot)
        high = min(low + 1, len(self.ordered) - 1)
        return self.ordered[low] + (self.ordered[high] - self.ordered[low]) * (spot - low)


class AdaptiveThreshold(StatefulProcessor):
    """Per entity: judge each row by its last benign scores, then remember it if benign.

    Rows wait until the watermark has passed them and are judged in order of event time,
    so what a row is compared with does not depend on the batch it came in. The window
    of scores is stored in numbered blocks: a batch writes the blocks it adds to and
    removes those that have left the window. An entity that is silent for longer than
    ``ttl`` is forgotten, and begins anew with the seed.
    """

    BLOCK = 128  # scores

    def __init__(self, window: int, target_fpr: float, seed: list[float], ttl_micros: int | None) -> None:
        self.window, self.quantile, self.seed, self.ttl = window, 1.0 - target_fpr, seed[-window:], ttl_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = WindowClock(handle)
        self.waiting = handle.getListState("waiting", "t long, row_id long, score double, benign boolean")
        self.blocks = handle.getMapState("blocks", "number long", "scores array<double>")
        self.known = handle.getValueState("known", "count long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            t = some["event_ts"].astype("datetime64[us]").astype("int64")
            columns = (t.tolist(), some["row_id"].tolist(), some["score"].tolist(), some["benign"].tolist())
            self.waiting.appendList([(a, b, None if c != c else c, d) for a, b, c, d in zip(*columns, strict=True)])
            self.clock.arm(int(t.min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.clock.fired()
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] // 1000 < now]
        if len(due) < len(waiting):
            self.waiting.put(waiting[len(due) :])
        elif waiting:
            self.waiting.clear()
        out = self._judged(due)
        self._next(waiting[len(due) :], now)
        if out:
            yield pd.DataFrame(
                {"entity": key[0], "row_id": [r[0] for r in out], "threshold": [r[1] for r in out], "exceeds": [r[2] for r in out]}
            )

    def _judged(self, due: list[tuple]) -> list[tuple]:
        if not due:
            return []
        count, last = self.known.get() if self.known.exists() else (0, due[0][0])
        stored = {k[0]: list(v[0]) for k, v in self.blocks.iterator()} if count else {}
        # scores of this batch and of the first block that is still needed are held by their number
        scores = {b * self.BLOCK + i: x for b, block in stored.items() for i, x in enumerate(block)}
        first = max(0, count - self.window)
        kept = SortedWindow(self.window, [*self.seed, *[scores[k] for k in range(first, count)]][-self.window :])
        changed: set[int] = set()
        out = []
        for t, row_id, score, benign in due:
            if self.ttl is not None and t - last > self.ttl:
                stored, changed, count = self._forget(stored), set(), 0
                scores, kept = {}, SortedWindow(self.window, self.seed)
            last = t
            limit = kept.quantile(self.quantile)
            out.append((row_id, limit, limit is not None and score is not None and score > limit))
            if benign and score is not None and math.isfinite(score):
                kept.add(score)
                scores[count] = score
                changed.add(count // self.BLOCK)
                count += 1
        oldest = max(0, count - self.window) // self.BLOCK
        for number in sorted(changed):
            if number >= oldest:
                begin = number * self.BLOCK
                self.blocks.updateValue((number,), ([scores[k] for k in range(begin, min(begin + self.BLOCK, count))],))
        for number in stored:
            if number < oldest:
                self.blocks.removeKey((number,))
        self.known.update((count, last))
        return out

    def _forget(self, stored: dict) -> dict:
        for number in stored:
            self.blocks.removeKey((number,))
        return {}

    def _next(self, waiting: list[tuple], now: int) -> None:
        """The next row that waits, or else the moment from which the entity is forgotten."""
        if waiting:
            self.clock.arm(waiting[0][0] // 1000 + 1)
        elif self.ttl is not None and self.known.exists():
            end = (self.known.get()[1] + self.ttl) // 1000 + 1
            if end > now:
                self.clock.arm(end)
            else:
                self.known.clear()
                self.blocks.clear()

    def close(self) -> None:
        pass


def adaptive_thresholds(
    events: DataFrame,
    window: int = 1000,
    target_fpr: float = 0.05,
    seed: tuple[float, ...] = (),
    delay: str = "10 minutes",
    ttl_minutes: float | None = 7 * 24 * 60.0,
) -> DataFrame:
    """Stream of (entity, row_id, threshold, exceeds) from (entity, event_ts, row_id, score, benign).

    Rows may arrive in any order within ``delay``; later ones are dropped.
    """
    ttl = None if ttl_minutes is None else int(ttl_minutes * 60_000_000)
    return events.withWatermark("event_ts", delay).groupBy("entity").transformWithStateInPandas(
        AdaptiveThreshold(window, target_fpr, list(seed), ttl),
        StructType.fromDDL("entity string, row_id long, threshold double, exceeds boolean"),
        "append",
        "EventTime",
    )


class WindowsWithLateRows(StatefulProcessor):
    """Rows per window: one row when the watermark closes it, and rows for what comes after.

    ``kind`` is ``closed`` or ``late``; late rows are counted per batch, so their sum for
    a window is what the closed count lacks.
    """

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "start long", "rows long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, counts = timerValues.getCurrentWatermarkInMs(), Counter()
        for some in rows:
            t = some["event_ts"].astype("datetime64[us]").astype("int64")
            counts.update((t // self.micros * self.micros).tolist())
        late = []
        for start, n in sorted(counts.items()):
            end = (start + self.micros) // 1000
            if end <= now:
                late.append((start, n))
            elif self.rows.containsKey((start,)):
                self.rows.updateValue((start,), (self.rows.getValue((start,))[0] + n,))
            else:
                self.rows.updateValue((start,), (n,))
                self.handle.registerTimer(end)
        if late:
            yield self._out(key, "late", late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.micros
        if self.rows.containsKey((start,)):
            n = self.rows.getValue((start,))[0]
            self.rows.removeKey((start,))
            yield self._out(key, "closed", [(start, n)])

    def _out(self, key, kind: str, some: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "kind": kind, "window_start": [s for s, _ in some], "rows": [n for _, n in some]})

    def close(self) -> None:
        pass


def windows_with_late_rows(events: DataFrame, key: str, time_col: str, minutes: int, delay: str) -> DataFrame:
    """Stream of (key, kind, window_start in microseconds, rows): closed windows, and what came too late for them.

    Spark drops late rows before a stateful operator if it sees the column the watermark
    runs on, so the watermark gets a copy of it that goes no further.
    """
    marked = events.select(F.col(key).cast("string").alias("key"), F.col(time_col).alias("event_ts"), F.col(time_col).alias("mark"))
    return marked.withWatermark("mark", delay).drop("mark").groupBy("key").transformWithStateInPandas(
        WindowsWithLateRows(minutes * 60_000_000),
        StructType.fromDDL("key string, kind string, window_start long, rows long"),
        "append",
        "EventTime",
    )


class AnchoredIncidents(StatefulProcessor):
    """Clusters per key, walked in time order behind the watermark.

    Rows wait in state until the watermark has passed them, so a row that is late, but
    not too late, joins the cluster it belongs to. A cluster is closed by a later row
    or once the watermark is a window beyond its start; one timer per key is armed for
    whichever comes first, the next waiting row or the end of the open cluster.
    """

    STATE = "start long, last long, alerts long, ood long, risk int"

    def __init__(self, window_micros: int, min_alerts: int) -> None:
        self.window, self.min_alerts = window_micros, min_alerts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", self.STATE)
        self.waiting = handle.getListState("waiting", "t long, ood int, risk int")
        self.clock = WindowClock(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            self.waiting.appendList([(int(t), int(o), int(r)) for t, o, r in zip(some["t"], some["ood"], some["risk"], strict=True)])
            self.clock.arm(int(some["t"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.clock.fired()
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] // 1000 < now]
        rest = waiting[len(due):]
        cluster = tuple(self.open.get()) if self.open.exists() else None
        closed: list[tuple] = []
        for t, ood, risk in due:
            if cluster is not None and t - cluster[0] > self.window:
                closed.append(cluster)
                cluster = None
            start, _, alerts, seen_ood, seen_risk = cluster or (t, t, 0, 0, 0)
            cluster = (start, t, alerts + 1, seen_ood + ood, max(seen_risk, risk))
        if cluster is not None and (cluster[0] + self.window) // 1000 < now:
            closed.append(cluster)
            cluster = None
        if rest:
            self.waiting.put(rest)
            self.clock.arm(rest[0][0] // 1000 + 1)
        elif self.waiting.exists():
            self.waiting.clear()
        if cluster is not None:
            self.open.update(cluster)
            self.clock.arm((cluster[0] + self.window) // 1000 + 1)
        elif self.open.exists():
            self.open.clear()
        out = [(key[0], key[1], *c) for c in closed if c[2] >= self.min_alerts]
        if out:
            yield pd.DataFrame(out, columns=["group_type", "key", "start", "last", "alert_count", "ood_count", "max_risk"])

    def close(self) -> None:
        pass


def anchored_incidents(
    pairs: DataFrame, time_col: str = "event_ts", delay: str = "10 minutes", window_minutes: int = 15, min_alerts: int = 2
) -> DataFrame:
    """Stream of closed clusters from (group_type, key, event_ts, t, ood, risk) rows.

    Rows may arrive in any order within ``delay``; later ones are dropped.
    """
    return (
        pairs.withWatermark(time_col, delay)
        .groupBy("group_type", "key")
        .transformWithStateInPandas(
            AnchoredIncidents(int(window_minutes * 60_000_000), min_alerts),
            StructType.fromDDL(
                "group_type string, key string, start long, last long, alert_count long, ood_count long, max_risk long"
            ),
            "append",
            "EventTime",
        )
    )


def append_alert_log(events: DataFrame, path: str, checkpoint: str):
    """Stream alert events into the append-only log, idempotent per micro-batch.

    The log is the one ``alert_log.append_events`` writes to. Every stream (that is,
    every checkpoint) is a writer of its own, so a second stream adds to what the first
    one logged; a replayed batch overwrites what it wrote itself, so a retry adds
    nothing twice.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        alert_log.write_batch(batch, path, stream, batch_id)

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
