"""One score of most rows: sweeps and look-ups are dealt over buckets of time, with the same results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cantata.operators import buckets, intervals, stats, tempo


def _notes(seed, n=400):
    r = random.Random(seed)
    rows = [(1, r.randint(0, 3), "note", s := r.randint(0, 4000), r.choice([0, 1, 5, 16, 100, 900]), s) for _ in range(n)]
    return rows + [(2, 0, "note", 64, 64, 0), (2, 1, "note", 128, 64, 0), (3, 0, "rest", 0, 10, 0)]


SCHEMA = "score_id bigint, part int, type string, start bigint, duration bigint, k bigint"


@pytest.mark.parametrize("bucket", [16, 64, 1000, 1 << 16])
def test_sweeps_against_brute_force(spark, bucket):
    rows = _notes(bucket)
    df = spark.createDataFrame(rows, SCHEMA)
    sounding = {k: [(s, s + d) for i, _, t, s, d, _ in rows if i == k and t == "note" and d > 0] for k in (1, 2, 3)}
    peak = {r["score_id"]: r["peak"] for r in stats.peak_polyphony(df.where("type = 'note' AND duration > 0").withColumn("end", F.col("start") + F.col("duration")), bucket=bucket).collect()}
    assert peak == {k: max(sum(a <= x < z for a, z in own) for x, _ in own) for k, own in sounding.items() if own}
    lo, hi = {1: 0, 2: 10, 3: 0}, {1: 5200, 2: 400, 3: 100}
    ranges = spark.createDataFrame([(k, lo[k], hi[k]) for k in lo], "score_id bigint, lo bigint, hi bigint")
    gaps = []
    for k, own in sounding.items():
        quiet = [not any(a <= x < z for a, z in own) for x in range(lo[k], hi[k])] + [False]
        begin = None
        for x, q in enumerate(quiet, lo[k]):
            if q and begin is None:
                begin = x
            elif not q and begin is not None:
                gaps.append((k, begin, x))
                begin = None
    assert sorted(map(tuple, intervals.common_silence(df, ranges, bucket).collect())) == gaps
    points = [(k, x) for k in lo for x in range(0, 5200, 8)]
    safe = {(r["score_id"], r["pos"]): r["safe"] for r in intervals.safe_channels(df, spark.createDataFrame(points, "score_id bigint, pos bigint"), 6, bucket).collect()}
    assert safe == {(k, x): 6 - sum(a < x < z for a, z in sounding[k]) for k, x in points}


@pytest.mark.parametrize(("bucket", "strict"), [(7, False), (7, True), (100, False), (1 << 16, True), (0.5, False)])
def test_as_of_against_brute_force(spark, bucket, strict):
    r = random.Random(int(bucket * 10) + strict)
    right = [(k, p, r.randint(1, 99)) for k in (1, 2) for p in r.sample(range(0, 500), 30)] + [(4, 10**14, 5), (4, 0, 6), (None, 3, 1)]
    left = [(i, r.choice([1, 1, 1, 2, 3]), r.randint(-5, 900)) for i in range(600)] + [(900, 4, 10**14), (901, 4, 7), (902, None, 3), (903, 1, None), (904, 4, 10**15)]
    want = {}
    for i, k, p in left:
        fit = [(q, v) for s, q, v in right if p is not None and k is not None and s == k and (q < p or (q == p and not strict))]
        want[i] = max(fit)[1] if fit else None
    df = spark.createDataFrame(left, "i int, score_id bigint, at bigint")
    got = {x["i"]: x["bpm"] for x in tempo.as_of(df, spark.createDataFrame(right, "score_id bigint, pos bigint, bpm int"), "at", bucket=bucket, strict=strict).collect()}
    assert got == want


def test_no_task_holds_a_giant_score(spark):
    """Rows of the largest bucket of a score with 95 of 100 rows, against the median bucket."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 20 == 0, F.col("id") % 400 + 2).otherwise(1).alias("score_id"), (F.col("id") * 97).alias("s"), (F.col("id") * 97 + 160).alias("e"))
    sizes = sorted(r["count"] for r in buckets.cut_at_buckets(rows, "s", "e").where("score_id = 1").groupBy("bucket").count().collect())
    assert len(sizes) == 60 and sizes[-1] < 2 * sizes[30]
