"""Hand goldens of the score operators, and properties of the sequential helpers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cantata.functions import music
from cantata.operators import edits, events, imports, intervals, messages, pages, playback, render, stats, tempo, text, voices

SAMPLE = "MML@T120V12O5L8ccggaag4ffeeddc4,O4L4cgrcgrc,O3L2cgcg;"


def parts_of(spark, *scores):
    return text.split_parts(spark.createDataFrame(list(enumerate(scores)), "score_id bigint, text string"))


def test_sample_score(spark):
    rows = events.merge_ties(text.tokenize_parts(parts_of(spark, SAMPLE))).collect()
    by = {p: sorted((r for r in rows if r["part"] == p), key=lambda r: r["idx"]) for p in range(3)}
    assert [len([r for r in by[p] if r["type"] == "note"]) for p in range(3)] == [14, 5, 4]
    assert by[0][0]["midi"] == 72 and by[0][0]["volume"] == 12 and by[1][0]["volume"] == 8
    assert {r["midi"] for r in by[1] if r["midi"]} == {60, 67} and {r["midi"] for r in by[2]} == {48, 55}
    assert max(r["start"] + r["duration"] for r in by[0]) == 8 * 256


def test_ties_and_octaves(spark):
    rows = events.merge_ties(text.tokenize_parts(parts_of(spark, "MML@c4&V3c8>c<c;"))).orderBy("idx").collect()
    assert [(r["midi"], r["duration"], r["volume"]) for r in rows] == [(60, 384, 8), (72, 256, 3), (60, 256, 3)]


def test_parse_errors(spark):
    cases = {"c3": "bad_length", "t": "missing_number", "O10": "bad_octave", "V16": "bad_volume", "&c": "tie_without_target", "c&d": "tie_to_other_pitch", "c&&c": "double_tie", "c&": "dangling_tie", "x": "unknown_character", "T20": "bad_tempo", "c&V3c": None, "c4.d+8r": None}
    df = spark.createDataFrame([(i, 0, p) for i, p in enumerate(cases)], "score_id bigint, part int, part_text string")
    got = {r["score_id"]: r["code"] for r in events.parse_errors(text.tokenize_parts(df)).collect()}
    assert {p: got.get(i) for i, p in enumerate(cases)} == cases


def test_legacy_lengths(spark):
    df = spark.createDataFrame([(0, 0, "c6r12"), (1, 0, "c24"), (2, 0, "c48"), (3, 0, "L6cL4c")], "score_id bigint, part int, part_text string")
    got = {r["score_id"]: r["part_text"] for r in imports.legacy_lengths(df).collect()}
    assert got == {0: "c8&c32&c64r16r64", 1: "c32&c64", 2: "c64", 3: "c8&c32&c64L4c"}


def test_fifo_pairing(spark):
    cmds = [("on", 5), ("off", 0), ("off", 0), ("on", 6), ("on", 7), ("off", 0), ("on", 0), ("on", 9)]
    df = spark.createDataFrame([(1, 0, 0, 60, i, i, c, v) for i, (c, v) in enumerate(cmds)], "score_id bigint, track int, channel int, d1 int, seq bigint, tick bigint, cmd string, d2 int")
    pairs = sorted((r["start_tick"], r["end_tick"], r["velocity"]) for r in messages.pair_notes(df).collect())
    assert pairs == [(0, 1, 5), (3, 5, 6), (4, 6, 7)]
    assert messages.hanging_notes(df).first()["n"] == 1


def test_duplicates_are_louder(spark):
    df = spark.createDataFrame([(1, "g", 60, 0, 4, 100, "a"), (1, "g", 60, 0, 4, 100, "b")], "score_id bigint, group_id string, midi int, start_grid bigint, end_grid bigint, midi_velocity int, note_key string")
    row = messages.merge_duplicates(df).first()
    assert row["midi_velocity"] == 112 and row["source_count"] == 2 and row["merged_ids"] == ["a", "b"]


def test_gain_and_times(spark):
    peaks = spark.createDataFrame([(1, 12), (2, 3)], "score_id bigint, peak bigint")
    assert {r["score_id"]: r["gain_scale"] for r in stats.auto_gain(peaks).collect()} == {1: 0.5, 2: 1.0}
    row = spark.range(1).select(music.format_time(F.lit(61.0015)).alias("t"), music.format_beats(F.lit(384)).alias("b"), music.pitch_name(F.lit(61)).alias("p")).first()
    assert tuple(row) == ("01:01.002", "1.5", "C#4")


def test_seconds(spark):
    t = spark.createDataFrame([(1, 512, 60, 0, 0)], "score_id bigint, pos bigint, bpm int, part int, ord bigint")
    p = spark.createDataFrame([(1, 256), (1, 512), (1, 768)], "score_id bigint, pos bigint")
    assert sorted(r["sec"] for r in tempo.position_to_seconds(p, tempo.tempo_map(t)).collect()) == [0.5, 1.0, 2.0]


EVENTS = "score_id bigint, part int, idx bigint, type string, start bigint, duration bigint, midi int, volume int"


def test_absorb_keeps_length(spark):
    rows = [(1, 0, 1, "rest", 0, 16, None, None), (1, 0, 2, "note", 16, 64, 60, 8), (1, 0, 3, "rest", 80, 16, None, None), (1, 0, 4, "rest", 96, 512, None, None), (1, 0, 5, "rest", 608, 16, None, None)]
    out = edits.absorb_short_rests(spark.createDataFrame(rows, EVENTS)).orderBy("idx").collect()
    assert [(r["type"], r["duration"]) for r in out] == [("rest", 16), ("note", 80), ("rest", 512), ("rest", 16)]


def test_render_round_trip(spark):
    parts = parts_of(spark, SAMPLE)
    e = events.merge_ties(text.tokenize_parts(parts))
    e = e.select("score_id", "part", "idx", "type", F.col("start").cast("long").alias("start"), F.col("duration").cast("long").alias("duration"), "midi", "volume")
    table = render.shortest_duration_table(e.select(F.col("duration").alias("units")))
    t = spark.createDataFrame([(0, 0, 120)], "score_id bigint, pos bigint, bpm int")
    again = events.merge_ties(text.tokenize_parts(render.render_parts(e, t, table)))
    key = lambda df: sorted((r["part"], r["start"], r["type"], r["duration"], r["midi"]) for r in df.collect())
    assert key(again) == key(e)


def test_voices_never_overlap(spark):
    rows = [(1, f"n{i}", (i * 3) % 50, (i * 3) % 50 + 1 + i % 9, 1 + i % 9, 40 + i % 40, 1 + i % 15, i % 7 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "score_id bigint, note_key string, start_grid bigint, end_grid bigint, dur_grid bigint, midi int, velocity int, is_beat boolean")
    out = voices.assign_voices(df.withColumn("choice_id", F.lit("c"))).collect()
    assert len(out) == 120
    for v in range(6):
        mine = sorted((r["start_grid"], r["end_grid"]) for r in out if r["voice"] == v)
        assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:], strict=False))


def test_pages_cover_the_score(spark):
    rows = [(1, p, i, "note", i * 128, 64, 60, 8) for p in range(2) for i in range(400)]
    df = spark.createDataFrame(rows, EVENTS)
    cut = sorted(pages.split_pages(df, 300).collect(), key=lambda r: r["page"])
    assert cut[-1]["reason"] == "last" and len(cut) > 2
    assert all(a["next_start"] == b["start"] and a["end"] <= a["next_start"] for a, b in zip(cut, cut[1:], strict=False))


def test_silence(spark):
    df = spark.createDataFrame([(1, 0, 1, "note", 10, 10, 60, 8), (1, 1, 1, "note", 15, 10, 60, 8)], EVENTS)
    r = spark.createDataFrame([(1, 0, 40)], "score_id bigint, lo bigint, hi bigint")
    assert sorted((x["start"], x["end"]) for x in intervals.common_silence(df, r).collect()) == [(0, 10), (25, 40)]


def _slow_voices(notes, channels):
    """The rules of voice assignment, one candidate at a time; notes: (key, start, end, midi, velocity, beat, choice)."""
    held = [None] * len(channels)  # (start, end, key)
    ends, out = {n[0]: n[2] for n in notes}, {n[0]: (-1, "skipped") for n in notes}
    notes = sorted(notes, key=lambda n: (n[1], -n[3], -n[4], n[0]))
    drum = {p: k for k, ps in voices.DRUM_PRIORITY.items() for p in ps}

    def score(n, c, merging):
        role, mode, chosen = channels[c]
        if (role == "beat") != n[5] or (chosen and n[6] not in chosen):
            return None
        if role == "beat":
            fit, pitch = 400, drum.get(n[3], 60 if 35 <= n[3] <= 81 else 0)
        elif role == "auto":
            fit, pitch = 170, n[3]
        else:
            fit, pitch = (320 if (role == "high") == (n[3] >= 60) else 30), (n[3] if role == "high" else -n[3])
        loss = 0
        if merging:
            if mode == "none" or held[c] is None or not held[c][0] < n[1] < ends[held[c][2]]:
                return None
            if mode == "half" and n[1] < held[c][0] + (ends[held[c][2]] - held[c][0]) / 2:
                return None
            loss = ends[held[c][2]] - n[1]
        elif held[c] is not None and ends[held[c][2]] > n[1]:
            return None
        return fit, -35 if merging else 0, pitch, n[4], n[2] - n[1], -c, -loss

    for onset in sorted({n[1] for n in notes}):
        waiting, used = [n for n in notes if n[1] == onset], set()
        for merging in (False, True):
            while True:
                options = [(s, -i, n, c) for i, n in enumerate(waiting) for c in range(len(channels)) if c not in used and (s := score(n, c, merging))]
                if not options:
                    break
                _, _, n, c = max(options, key=lambda o: (o[0], o[1], -o[3]))
                if merging:
                    ends[held[c][2]] = onset
                held[c], out[n[0]] = (onset, n[2], n[0]), (c, "merged" if merging else "placed")
                used.add(c)
                waiting.remove(n)
    return {k: (*out[k], ends[k]) for k in out}


def test_voices_against_slow_rules(spark):
    r = random.Random(3)
    config, rows, want = [], [], {}
    for score in range(12):
        channels = [(r.choice(["high", "low", "auto", "beat"]), r.choice(["all", "half", "none"]), r.sample(["a", "b", "c"], r.randint(0, 2))) for _ in range(4)]
        config += [(score, i, *c) for i, c in enumerate(channels)]
        notes = [(f"{score}-{i:03d}", s := r.randint(0, 60), s + r.randint(1, 20), r.randint(30, 90), r.randint(1, 15), r.random() < 0.3, r.choice("abc")) for i in range(80)]
        rows += [(score, *n[:3], n[2] - n[1], *n[3:]) for n in notes]
        want |= _slow_voices(notes, channels)
    df = spark.createDataFrame(rows, "score_id bigint, note_key string, start_grid bigint, end_grid bigint, dur_grid bigint, midi int, velocity int, is_beat boolean, choice_id string")
    c = spark.createDataFrame(config, "score_id bigint, channel_index int, role string, overlap string, selected array<string>")
    for width in (8192, 16, 3):
        got = {x["note_key"]: (x["voice"], x["status"], x["end_grid"]) for x in voices.assign_voices(df, c, width).collect()}
        assert got == want and {s for _, s, _ in got.values()} == {"placed", "merged", "skipped"}


def test_a_giant_score_is_dealt_over_blocks(spark):
    """One score of nearly all notes: its blocks are of about one size, and end where nothing sounds."""
    r = random.Random(4)
    rows, t = [], 0
    for i in range(20_000):
        t += r.choice([0, 1, 2, 3])
        rows.append((1, f"n{i:05d}", t, t + r.randint(1, 3), 2, 60, 8, False, "c"))
    rows += [(2, f"m{i}", i, i + 2, 2, 60, 8, False, "c") for i in range(30)]
    df = spark.createDataFrame(rows, "score_id bigint, note_key string, start_grid bigint, end_grid bigint, dur_grid bigint, midi int, velocity int, is_beat boolean, choice_id string")
    blocks = voices.silence_cut_blocks(df, 512).where("score_id = 1").groupBy("block").agg(F.count("*").alias("n"), F.min("start_grid").alias("a"), F.max("end_grid").alias("z")).orderBy("a").collect()
    sizes = sorted(b["n"] for b in blocks)
    assert sum(sizes) == 20_000 and len(sizes) > 40 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert all(x["z"] <= y["a"] for x, y in zip(blocks, blocks[1:], strict=False))


def test_categories(spark):
    df = spark.createDataFrame([(0, "x", False), (22, "x", False), (47, "x", False), (60, "x", True), (99, "Slap Bass", False), (99, "Bassoon", False), (99, "Bag Pipe", False), (99, "Music-Box", False), (99, "Pad", False), (200, "Honky Piano", False)], "p int, n string, b boolean")
    got = [x["c"] for x in df.select(stats.category(F.col("p"), F.col("n"), F.col("b")).alias("c")).collect()]
    assert got == ["keyboard", "winds", "percussion", "beat", "strings", "winds", "winds", "percussion", "other", "keyboard"]


ZONE = "bank int, preset int, region_idx int, key_lo int, key_hi int, vel_lo int, vel_hi int, attenuation int, coarse_tune int, fine_tune int, root_key int"


def test_categories_of_odd_programs(spark):
    df = spark.createDataFrame([(None, "Solo"), (-5, "Violin"), (200, "Violin"), (127, "Gun")], "p int, n string")
    assert [x["c"] for x in df.select(stats.category(F.col("p"), F.col("n"), F.lit(False)).alias("c")).collect()] == ["keyboard", "keyboard", "strings", "other"]


def test_repeated_notes_keep_their_regions(spark):
    notes = spark.createDataFrame([("a", 0, 1, 60, 80), ("a", 0, 1, 60, 80), ("b", 0, 1, 60, 127), ("c", 0, 2, 60, 80), ("d", 1, 1, 60, 80)], "note_key string, bank int, preset int, midi int, velocity int")
    rows = [(0, 127, 0, 127), (58, 62, 0, 100), (58, 62, 70, 90), (9, 5, 0, 127), (0, 127, 5, 4)]
    regions = spark.createDataFrame([(0, 1, i, *r, 0, 0, 0, 60) for i, r in enumerate(rows)] + [(1, 1, 7, 0, 127, 0, 127, 0, 0, 0, 60)], ZONE)
    assert sorted((x["note_key"], x["region_idx"]) for x in playback.match_region(notes, regions).collect()) == [("a", 2), ("a", 2), ("b", 0), ("d", 7)]


def test_regions_against_a_scan(spark):
    r = random.Random(6)
    zones = [(r.randint(0, 1), r.randint(0, 2), i, k := r.randint(0, 100), k + r.randint(-2, 27), v := r.randint(0, 110), v + r.randint(-1, 60), 0, 0, 0, 60) for i in range(60)]
    notes = [(str(i), r.randint(0, 2), r.randint(0, 3), r.randint(0, 127), r.randint(0, 127)) for i in range(800)]
    want = {}
    for key, bank, preset, midi, velocity in notes:
        fit = [(-(2 * (z[4] - z[3] <= 12) + (z[6] - z[5] <= 32)), z[2]) for z in zones if z[:2] == (bank, preset) and z[3] <= midi <= z[4] and z[5] <= velocity <= z[6]]
        if fit:
            want[key] = min(fit)[1]
    got = playback.match_region(spark.createDataFrame(notes, "note_key string, bank int, preset int, midi int, velocity int"), spark.createDataFrame(zones, ZONE)).collect()
    assert {x["note_key"]: x["region_idx"] for x in got} == want and len(got) == len(want) > 60


def test_rests_end_at_tempo_changes(spark):
    events_ = spark.createDataFrame([(1, 0, i, "rest", i * 10, 10, None, None) for i in range(6)], "score_id int, part int, idx bigint, type string, start bigint, duration bigint, midi int, volume int")
    at = spark.createDataFrame([(1, 0, 20), (1, 1, 40)], "score_id int, part int, pos bigint")
    rows = [(x["start"], x["duration"]) for x in edits.merge_rests(events_, at).orderBy("start").collect()]
    assert rows == [(0, 20), (20, 10), (30, 30)]
    assert edits.merge_rests(events_).count() == 1


def test_pages_beyond_the_limit_are_told(spark):
    df = spark.createDataFrame([(1, 0, "note", i * 64, 60) for i in range(400)], "score_id int, part int, type string, start bigint, duration bigint")
    cut = sorted(pages.split_pages(df, 200, max_pages=2).collect(), key=lambda r: r["page"])
    assert [p["reason"] for p in cut][-1] == "truncated" and len(cut) == 3 and cut[-1]["end"] == 399 * 64 + 60


def test_windows_and_channel_names(spark):
    notes = spark.createDataFrame([("a", 1, 0.5, 2.0), ("b", 1, 1.59, 0.02), ("c", 1, 9.0, 1.0), ("d", 1, -1.0, 0.5)], "k string, score_id int, start_sec double, duration_sec double")
    windows = spark.createDataFrame([(1, w, 1.6 * w, 1.6 * w + 1.6) for w in range(3)], "score_id int, w int, t0 double, t1 double")
    assert {x["k"]: x["w"] for x in playback.window_batch(notes, windows, ["k"]).collect()} == {"a": 0, "b": 0}
    lines = spark.createDataFrame([(1, "[Channel1]\n// init\n// #x\n// using_extension\n// initial theme\n// later")], "score_id int, text string")
    assert imports.section_channel_name(imports.section_blocks(lines)).first()["name"] == "initial theme"


def test_silences_and_boundaries_by_page_length(spark):
    notes = [(1, 0, "note", 0, 16, 60, 8), (1, 0, "note", 64, 16, 60, 8), (1, 1, "note", 160, 16, 60, 8), (1, 0, "note", 192, 16, 60, 8)]
    df = spark.createDataFrame(notes, "score_id bigint, part int, type string, start bigint, duration bigint, midi int, volume int")
    ranges = spark.createDataFrame([(1, 0, 300)], "score_id bigint, lo bigint, hi bigint")
    silences = intervals.common_silence(df, ranges)
    sizes = intervals.page_lengths(df, ranges, silences.select("score_id", F.col("start").alias("pos")))
    assert {r["pos"]: r["hundredths"] for r in sizes.collect()} == {16: 1135, 80: 1510, 176: 1510, 208: 1885}
    best = lambda most: intervals.longest_silence(silences, 16, sizes, most).first()
    assert (best(2400)["start"], best(2400)["end"]) == (208, 300)  # the longest page
    assert (best(16)["start"], best(16)["end"]) == (80, 160)  # of two pages of 15.1 the longer silence
    assert best(11) is None
    points = spark.createDataFrame([(1, 16, 6), (1, 80, 6), (1, 170, 5), (1, 176, 6)], "score_id bigint, pos bigint, safe bigint")
    ends = intervals.page_lengths(df, ranges, points)
    assert intervals.boundary_rank(points, ends, 2400).first()["pos"] == 176 and intervals.boundary_rank(points, ends, 12).first()["pos"] == 16


def test_voice_grid_with_tempos(spark):
    notes = [(1, 0, 0, 512, 60, 8), (1, 0, 768, 256, 72, 5), (1, 1, 0, 2048, 48, 8)]
    df = spark.createDataFrame(notes, "score_id bigint, part int, start bigint, duration bigint, midi int, volume int")
    tempos = spark.createDataFrame([(1, 0, 100), (1, 250, 130), (1, 640, 90), (1, 1200, 77), (1, 9000, 66)], "score_id bigint, pos bigint, bpm int")
    got = {r["part"]: r["part_text"] for r in render.render_voice_grid(df, tempos).collect()}
    assert got == {0: "T100c4&T130c4r8T90r8V5O5c4r8r32.T77r2.r16r64", 1: "O3c1&c1"}
    assert {r["part"]: r["part_text"] for r in render.render_voice_grid(df).collect()} == {0: "c2r4V5O5c4", 1: "O3c1&c1"}
