"""What grows with the input stays out of the driver, and off the disk where one pass is enough."""

from __future__ import annotations

import random

import __spark_entry__
from cantata.operators import imports, pages, playback

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_of(plan: str, what: str) -> int:
    """Exchanges that carry what a node ``what`` below them has made."""
    lines, n = plan.splitlines(), 0
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line) or "Exchange" in below:
                    break
                n += what in below
    return n


def test_zones_are_not_broadcast(spark):
    assert "Broadcast" not in plan_of(__spark_entry__.queries()["expand_preset_zones"](spark, SMALL))


def test_ranges_are_not_broadcast_and_equal_ones_meet_once(spark):
    rows = [(0, 1, i, 10, 21, 0, 31 + 32 * (i % 2), i, 0, 0, 60) for i in range(500)]
    regions = spark.createDataFrame(rows, "bank int, preset int, region_idx int, key_lo int, key_hi int, vel_lo int, vel_hi int, attenuation int, coarse_tune int, fine_tune int, root_key int")
    bands = playback.velocity_bands(regions)
    assert "Broadcast" not in plan_of(bands)
    joined = bands._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in joined  # what bands meet was cut down and written first
    assert {(x["key"], x["from"], x["below"], x["region_idx"]) for x in bands.collect()} == {(k, *b) for k in range(10, 22) for b in ((0, 32, 0), (32, 64, 1))}


def test_lengths_are_spelled_within_their_row(spark):
    rows = [(1, 0, "l12cL2147483648d"), (1, 1, "L4c"), (2, 0, "r12L6R"), (2, 1, ""), (3, 0, None)]
    got = imports.legacy_lengths(spark.createDataFrame(rows, "score_id bigint, part int, part_text string"))
    assert "Exchange" not in plan_of(got)
    assert {(x["score_id"], x["part"]): x["part_text"] for x in got.collect()} == {(1, 0): "c16&c64L2147483648d16&d64", (1, 1): "L4c", (2, 0): "r16r64R8R32R64"}


def test_texts_are_shuffled_and_not_their_codes(spark):
    for name in ("parse_errors", "looks_like_part", "invalid_code_spans"):
        plan = plan_of(__spark_entry__.queries()[name](spark, SMALL))
        assert "Generate posexplode(regexp_extract_all" in plan and shuffles_of(plan, "Generate posexplode(regexp_extract_all") == 0, name


def test_bounds_of_pages_are_looked_up_once_a_note(spark):
    """Each note knows what a page that begins with it holds, so positions carry no look-ups: a row for each note, against a scan."""
    r, rows, at = random.Random(4), [], 0
    for _ in range(60):
        at += r.choice([0, 0, 40])
        rows.append((1, 0, "note", at, 10))
        at += 10
    got = pages._rows(spark.createDataFrame(rows, "score_id bigint, part int, type string, start bigint, duration bigint"), 4000, 2000).orderBy("w").collect()
    assert len(got) == len(rows)
    for i, x in enumerate(got):
        for gap in (0, 1):
            def first(passes, i=i, gap=gap):
                return next((n["s"] for n in got[i:] if passes(1000 + n["w"] - got[i]["w"] + 135 + 240 * gap)), None)

            assert x["over"][gap] == first(lambda h: h > 4000) and x["full"][gap] == first(lambda h: h >= 2000)
