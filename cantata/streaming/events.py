"""Stream operators: pairing with state, look-ahead windows, late notes, telemetry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from cantata.sources.shared import shared_path


def normalize_name(name: Column) -> Column:
    """Trimmed, other characters than letters, digits and _ as _, no leading _, 40 characters; else ``event``."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "[^A-Za-z0-9_]", "_"), "^_+", ""), 1, 40)
    return F.when(clean == "", "event").otherwise(clean)


def normalize_events(events: DataFrame) -> DataFrame:
    """Normalises name and params (a map of strings): nulls dropped, values of at most 100 characters. Batch and streaming."""
    params = F.transform_values(F.map_filter("params", lambda k, x: x.isNotNull()), lambda k, x: F.substring(x, 1, 100))
    return events.withColumns({"name": normalize_name(F.col("name")), "params": params})


def keep_last_events(events: DataFrame, k: int = 100) -> DataFrame:
    """The latest k events of each session."""
    order = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def stream_event_counts(events: DataFrame, width: str = "10 minutes", watermark: str = "30 minutes") -> DataFrame:
    """(window_start, name, n) in tumbling windows."""
    counts = events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "name").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "name", "n")


def stream_late_clamp(notes: DataFrame, now: Column, lead: float = 0.05) -> DataFrame:
    """Notes (ts, lead in seconds) that are due before now + lead are moved there, not dropped."""
    earliest = now + F.make_dt_interval(secs=F.lit(lead))
    return notes.withColumn("ts", F.greatest("ts", earliest))


class _Waiting(StatefulProcessor):
    """Notes of a score that wait for their look-ahead window, and those let out that may still come again."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.notes = handle.getValueState("notes", "ids array<bigint>, ts array<bigint>, due array<bigint>, out array<boolean>")

    def _next(self, rows: dict[int, list], now: int) -> Iterator[pd.DataFrame]:
        """Lets out what is due, forgets what can no longer repeat, and sets the timer to the next of either."""
        ready = [(i, ts, due) for i, (ts, due, out) in rows.items() if not out and due <= now]
        for i, _, _ in ready:
            rows[i][2] = True
        rows = {i: r for i, r in rows.items() if not r[2] or r[1] + self.keep_ms > now}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows:
            self.notes.update((list(rows), *map(list, zip(*rows.values(), strict=True))))
            self.handle.registerTimer(min(due + self.keep_ms if out else due for _, due, out in rows.values()))
        else:
            self.notes.clear()
        yield pd.DataFrame(sorted(ready, key=lambda r: (r[2], r[0])), columns=["id", "ts_ms", "due_ms"])

    def _known(self) -> dict[int, list]:
        if not self.notes.exists():
            return {}
        ids, ts, due, out = self.notes.get()
        return {i: list(r) for i, *r in zip(ids, ts, due, out, strict=True)}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, now = self._known(), timerValues.getCurrentWatermarkInMs()
        for df in rows:
            for i, ts, due in zip(df["id"].tolist(), df["ts_ms"].tolist(), df["due_ms"].tolist(), strict=True):
                known.setdefault(i, [ts, due, False])
        yield from self._next(known, now)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._next(self._known(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_lookahead(notes: DataFrame, ahead_ms: int = 1600, every_ms: int = 80, watermark: str = "10 seconds", keep_ms: int = 60_000) -> DataFrame:
    """(id, ts_ms, due_ms): each note once, when the first look-ahead window that holds it opens; notes: score_id, id, ts.

    A note waits in its score's state until the watermark passes due, the begin of that window: ``ahead_ms`` before
    the end of the note's slot of ``every_ms``. Timers let notes out, and forget them ``keep_ms`` later; until then a repeated id is
    dropped. Notes later than the watermark are dropped by it; those in time whose window is open already come out at once.
    """
    ms = F.unix_millis("ts")
    timed = notes.withWatermark("ts", watermark).select("score_id", "id", "ts", ms.alias("ts_ms"), ((F.floor(ms / every_ms) + 1) * every_ms - ahead_ms).cast("long").alias("due_ms"))
    return with_state(timed.groupBy("score_id"), _Waiting(keep_ms), "id bigint, ts_ms bigint, due_ms bigint", "append")


class _Queue(StatefulProcessor):
    """The latest k events of a session, as a bounded list."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "ts_ms bigint, event_id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        for df in rows:
            held = sorted({*held, *zip(df["ts_ms"].tolist(), df["event_id"].tolist(), strict=True)})[-self.k :]
        self.last.put(held)
        yield pd.DataFrame([(key[0], *r) for r in held], columns=["session", "ts_ms", "event_id"])

    def close(self) -> None:
        pass


def stream_last_events(events: DataFrame, k: int = 100) -> DataFrame:
    """(session, ts_ms, event_id), update mode: the queue of every session that a batch touches, at most k events, after it; read it with run_latest."""
    timed = events.select("session", F.unix_millis("ts").alias("ts_ms"), "event_id")
    return with_state(timed.groupBy("session"), _Queue(k), "session bigint, ts_ms bigint, event_id bigint", "update", "None")


def with_state(groups: GroupedData, processor: StatefulProcessor, schema: str, mode: str, time: str = "eventTime") -> DataFrame:
    """transformWithState; its state store must hold several states, as that of RocksDB does."""
    spark = SparkSession.active()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return groups.transformWithStateInPandas(processor, schema, mode, time)


PAIRED = "score_id bigint, track int, channel int, midi int, start_tick bigint, end_tick bigint, velocity int"


def stream_pair_notes(messages: DataFrame, watermark: str = "1 day", idle_ms: int = 86_400_000) -> DataFrame:
    """FIFO pairing of note-ons and offs with the open notes of a key as state; unmatched ons end with end_tick null at the timeout.

    messages: ts, score_id, track, channel, d1, d2, cmd, seq, tick. When the watermark has passed a key's last message
    by ``idle_ms``, its open notes come out, and its state is dropped.
    """
    columns = [c.split()[0] for c in PAIRED.split(", ")]

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ticks, loud = (list(map(list, state.get)) if state.exists else ([], []))
        if state.hasTimedOut:
            state.remove()
            if ticks:
                yield pd.DataFrame([(*key, t, None, v) for t, v in zip(ticks, loud, strict=True)], columns=columns)
            return
        rows = []
        # Most keys have few messages: plain lists, and a frame only where there are pairs, cost a key least.
        messages_ = [m for df in batches for m in zip(*(df[c].tolist() for c in ("seq", "on", "tick", "d2", "ms")), strict=True)]
        messages_.sort(key=lambda m: m[0])
        done = 0
        for _, on, tick, velocity, _ in messages_:
            if on:
                ticks.append(tick)
                loud.append(velocity)
            elif done < len(ticks):
                if tick > ticks[done]:
                    rows.append((*key, ticks[done], tick, loud[done]))
                done += 1
        state.update((ticks[done:], loud[done:]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), max(m[4] for m in messages_)) + idle_ms)
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    keyed = messages.where(F.col("cmd").isin("on", "off")).withWatermark("ts", watermark).withColumns({"ms": F.unix_millis("ts"), "on": (F.col("cmd") == "on") & (F.col("d2") > 0)})
    keyed = keyed.select("ts", "score_id", "track", "channel", "d1", "seq", "on", "tick", F.when(F.col("on"), F.col("d2")).otherwise(0).alias("d2"), "ms")
    return keyed.groupBy("score_id", "track", "channel", "d1").applyInPandasWithState(pair, PAIRED, "ticks array<bigint>, loud array<int>", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs a stream over what is there now, into the folder that the cluster shares, and reads the result. With the same ``path`` a later run goes on."""
    spark: SparkSession = stream.sparkSession
    path = path or shared_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_latest(stream: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Runs a stream in update mode over what is there now, and reads the rows of the last batch that told of each key.

    A batch that is run again writes the same folder again. With the same ``path`` a later run goes on where this one ended.
    """
    spark: SparkSession = stream.sparkSession
    path = path or shared_path(spark, "latest")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    told = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    newest = told.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.max("batch").alias("newest"))
    return told.join(newest, [told[k].eqNullSafe(newest[f"k_{k}"]) for k in keys]).where("batch = newest").select(*stream.columns)
