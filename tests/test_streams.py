"""Streams over two runs with a restart between: timers, bounded state, late and repeated rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cantata.streaming import events as streams

BEGIN = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
BEGIN_MS = 1_704_067_200_000


def _write(spark, folder, rows, schema):
    """Appends a file; rows begin with seconds after BEGIN."""
    df = spark.createDataFrame(rows, f"sec double, {schema}")
    df.withColumn("ts", F.timestamp_millis((F.lit(BEGIN_MS) + F.col("sec") * 1000).cast("long"))).drop("sec").coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def _read(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def test_lookahead_waits_lets_out_once_and_forgets(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "run")
    run = lambda: sorted((r["id"], r["due_ms"] - BEGIN_MS) for r in streams.run_available(streams.stream_lookahead(_read(spark, folder), keep_ms=30_000), "append", path).collect())
    # The first run's watermark ends at 10 s: what is due by then is let out, 3 waits.
    _write(spark, folder, [(1.0, 7, 1), (1.0, 7, 1), (5.0, 7, 2), (20.0, 7, 3), (2.0, 8, 4)], "score_id bigint, id bigint")
    assert run() == [(1, -560), (2, 3440), (4, 480)]
    # After a restart: 1 again (a repeat in time), 5 late but in time, 6 later than the watermark, and the watermark goes on to 50 s.
    _write(spark, folder, [(12.0, 7, 1), (11.0, 8, 5), (3.0, 8, 6), (60.0, 8, 9)], "score_id bigint, id bigint")
    assert run() == [(1, -560), (2, 3440), (3, 18480), (4, 480), (5, 9440)]
    # Forgotten by now, an id may come again; and 9 comes out when its window opens.
    _write(spark, folder, [(70.0, 7, 1), (100.0, 8, 10)], "score_id bigint, id bigint")
    assert run() == sorted([(1, -560), (2, 3440), (3, 18480), (4, 480), (5, 9440), (9, 58480), (1, 68480)])


def test_queue_over_runs_equals_the_batch(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "run")
    rows = [(float((i * 37) % 100), i % 3, i) for i in range(60)]
    latest = lambda: {(r["session"], r["event_id"]) for r in streams.run_latest(streams.stream_last_events(_read(spark, folder), 5), ["session"], path).collect()}
    for part in (rows[:25], rows[25:26], rows[26:]):
        _write(spark, folder, part, "session bigint, event_id bigint")
        got = latest()
        assert got == {(r["session"], r["event_id"]) for r in streams.keep_last_events(spark.read.parquet(folder), 5).collect()}
        assert max(sum(s == k for s, _ in got) for k in range(3)) <= 5


def test_open_notes_come_out_at_their_timeout(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "run")
    schema = "score_id bigint, track int, channel int, d1 int, d2 int, cmd string, seq bigint, tick bigint"
    run = lambda: sorted(((r["midi"], r["start_tick"], r["end_tick"]) for r in streams.run_available(streams.stream_pair_notes(_read(spark, folder), "10 seconds", 5_000), "append", path).collect()), key=str)
    on = lambda t, d1, v=9: (float(t), 1, 0, 0, d1, v, "on", t, t)
    off = lambda t, d1: (float(t), 1, 0, 0, d1, 0, "off", t, t)
    _write(spark, folder, [on(1, 60), on(2, 60), off(4, 60), on(3, 61), on(30, 62)], schema)
    assert run() == [(60, 1, 4), (60, 2, None), (61, 3, None)]  # idle for 5 s at the watermark of 20 s
    _write(spark, folder, [off(33, 62), off(34, 60), on(60, 63)], schema)
    assert run() == [(60, 1, 4), (60, 2, None), (61, 3, None), (62, 30, 33)]
