"""Paging against the rules walked page by page, on scores with silences, held notes, single parts and none."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from cantata.operators import pages


def slow_pages(df, max_chars, slack, min_silence, max_pages):
    """The rules of paging, one page after the other, with a measure for every probe."""
    notes = df[df["type"] == "note"].sort_values(["start", "part"])
    score = df["score_id"].iloc[0]
    if notes.empty:
        return pd.DataFrame([(score, 0, 0, 0, 0, "empty")], columns=["score_id", "page", "start", "end", "next_start", "reason"])
    s, e = notes["start"].to_numpy(), (notes["start"] + notes["duration"]).to_numpy()
    part = notes["part"].to_numpy()
    total = int(e.max())
    reach = np.maximum.accumulate(e)
    gap_from = np.concatenate(([0], reach[:-1]))
    silent = [(int(a), int(b)) for a, b in zip(gap_from, s, strict=True) if b > a]
    points = np.unique(np.concatenate((s, e, [total])))
    parts = [(s[part == p], e[part == p]) for p in np.unique(part)]

    def measure(a: int, b: int) -> float:
        most = 0.0
        for ps, pe in parts:
            at = (ps >= a) & (ps < b) & (pe > a)
            if at.any():
                ends = np.maximum.accumulate(np.minimum(pe[at], b) - a)
                gaps = ((ps[at] - a) > np.concatenate(([0], ends[:-1]))).sum()
                most = max(most, 10 + at.sum() * 1.35 + gaps * 2.4)
        return most

    def safe(x: int) -> int:
        return sum(not ((ps < x) & (pe > x)).any() for ps, pe in parts)

    rows, at = [], 0
    while at < total and len(rows) < max_pages:
        if measure(at, total) <= max_chars:
            rows.append((score, len(rows), at, total, total, "last"))
            break
        later = points[points > at]
        lo, hi = 0, len(later) - 1  # the measure grows with the end
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if measure(at, int(later[mid])) <= max_chars else (lo, mid - 1)
        best, floor = int(later[lo]), max_chars - slack
        fits, low = measure(at, best) <= max_chars, 0
        if measure(at, best) >= floor:
            a, b = 0, lo
            while a < b:
                mid = (a + b) // 2
                a, b = (a, mid) if measure(at, int(later[mid])) >= floor else (mid + 1, b)
            low = a
        search = [int(x) for x in later[low : lo + 1]]
        sized = [(measure(at, a), b - a, a, b) for a, b in silent if search[0] <= a <= best and a > at]
        quiet = [q for q in sized if q[0] <= max_chars]
        long = [q for q in quiet if q[1] >= min_silence]
        clean = [x for x in search if safe(x) == len(parts)]
        some = max(((safe(x), x) for x in search), default=(0, best))
        if long or quiet:
            _, _, end, nxt = max(long or quiet)  # the fullest page, then the longest silence, then the latest
            reason = "common-silence" if long else "longest-silence"
        elif clean:
            end = nxt = best if best in clean else clean[-1]
            reason = "clean-boundary"
        elif fits:
            end, nxt, reason = best, best, "partial-boundary"
        elif some[0] > 0:
            end, nxt, reason = some[1], some[1], "partial-boundary"
        else:
            end, nxt, reason = best, best, "char-limit"
        if nxt <= at:
            end, nxt, reason = at + 256, at + 256, "forced"
        rows.append((score, len(rows), at, end, nxt, reason))
        at = nxt
    if at < total and rows[-1][-1] != "last":
        rows.append((score, len(rows), at, total, total, "truncated"))
    return pd.DataFrame(rows, columns=["score_id", "page", "start", "end", "next_start", "reason"])


SCHEMA = "score_id bigint, part int, type string, start bigint, duration bigint, midi int, volume int"


def _scores(seed):
    r, rows = random.Random(seed), []
    for score in range(24):
        for part in range(r.randint(1, 4)):
            t = r.choice([0, 0, 16, 300])
            for _ in range(r.randint(0, 50)):
                d = r.choice([16, 32, 64, 200])
                rows.append((score, part, "note", t, d, 60, 8))
                t += d + r.choice([0, 0, 0, 0, 16, 32, 100, 600 if part == 0 else 0])
        rows.append((score, 5, "rest", 0, 16, None, None))
    for score in range(24, 34):  # silences of all parts
        t = 0
        for _ in range(12):
            for part in range(3):
                u = t
                for _ in range(r.randint(1, 8)):
                    rows.append((score, part, "note", u, 32, 60, 8))
                    u += 32
            t += 256 + r.choice([16, 100, 512, 700])
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, (40, 20, 512, 120)), (2, (25, 12, 100, 120)), (3, (60, 10, 64, 120)), (4, (30, 30, 512, 3)), (5, (11, 5, 512, 120))])
def test_pages_against_the_walk(spark, seed, options):
    rows = _scores(seed)
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    want = sorted(tuple(x) for _, group in df.groupby("score_id") for x in slow_pages(group, *options).itertuples(index=False))
    got = sorted(map(tuple, pages.split_pages(spark.createDataFrame(rows, SCHEMA), *options).collect()))
    assert got == want


def test_events_of_pages(spark):
    df = spark.createDataFrame([(1, 0, "note", 0, 100, 60, 8), (1, 1, "note", 150, 100, 62, 7), (1, 0, "rest", 100, 50, None, None)], SCHEMA)
    cut = spark.createDataFrame([(1, 0, 0, 200, 200, "x"), (1, 1, 200, 250, 250, "last")], "score_id bigint, page int, start bigint, end bigint, next_start bigint, reason string")
    assert sorted(map(tuple, pages.page_events(df, cut).collect())) == [(1, 0, 0, 0, 100, 60, 8), (1, 0, 1, 150, 50, 62, 7)]
