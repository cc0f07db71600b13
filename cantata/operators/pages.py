"""Paging of scores: a successor table of every position at which a page may begin, and the walk along it by doubling.

A page's length is the estimate of page_length_estimate. Notes of a part carry the running sum of what they
add to it (135 hundredths, 240 more after a gap), so the first note that a page cannot hold is the first whose sum
passes a threshold: an as-of look-up on the sums. What silences and boundaries lie before a position is carried to it by one sort of
notes and positions. A page's end then is a fixed number of equi-joins away, for all positions at once; which pages a score
has is found by doubling the table of next pages, in as many rounds as the binary digits of the most pages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.tempo import as_of
from cantata.sources.shared import staged

NOTE, GAP, BASE = 135, 240, 1000


def _rows(events: DataFrame, most: int, floor: int) -> DataFrame:
    """Sounding notes with start s, end e, w, the running sum of their part in hundredths, and what pages that begin with them hold.

    over: starts of the first note that such a page cannot hold, without and with a gap before it; full: of that with which
    it reaches ``floor``. They depend on the note alone, so they are looked up once a note and not for each position in front of it.
    """
    part = Window.partitionBy("score_id", "part")
    order = part.orderBy("s")
    notes = events.where("type = 'note' AND duration > 0").select("score_id", F.col("part").cast("int").alias("part"), F.col("start").alias("s"), (F.col("start") + F.col("duration")).alias("e"))
    gap = F.coalesce((F.col("s") > F.lag("e").over(order)).cast("int"), F.lit(0))
    summed = notes.withColumn("g", gap).withColumn("w", F.sum(NOTE + GAP * F.col("g")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("g")
    # A sum is asked for as many times as a note has thresholds: rows of one sort of the part, gathered by note again.
    thresholds = [(most, 0), (most, 1), (floor - 1, 0), (floor - 1, 1)]
    asked = [F.struct(F.lit(k).alias("k"), F.greatest(F.col("w") - 1, F.col("w") - NOTE - GAP * gapped + t - BASE).alias("v")) for k, (t, gapped) in enumerate(thresholds)]
    rows = summed.withColumn("at", F.explode(F.array(F.struct(F.lit(-1).alias("k"), F.col("w").alias("v")), *asked))).select("score_id", "part", "s", "e", "w", "at.*")
    falling = part.orderBy(F.desc("v"), F.desc(F.col("k") >= 0)).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("to", F.last(F.when(F.col("k") < 0, F.col("s")), ignorenulls=True).over(falling))
    of = lambda *ks: F.array(*[F.max(F.when(F.col("k") == k, F.col("to"))) for k in ks])
    return found.groupBy("score_id", "part", "w").agg(F.max("s").alias("s"), F.max("e").alias("e"), of(0, 1).alias("over"), of(2, 3).alias("full"))


def page_positions(notes: DataFrame, part_count: int, min_silence: int) -> DataFrame:
    """Every start and end of a note, and 0, with what lies around: one sort of a score's notes and positions.

    before, after: arrays by part of the last note that starts before the position, and the first from it on;
    then: the next position; clean: whether no note is sounding across; safe: parts without such a note; silence:
    whether a common silence begins here, until b; n0, n1: silences (n1: of min_silence) so far; s0, s1: the last of them;
    cut: the last clean position so far; over, full: of the page from here, the least of its parts'.
    """
    points = notes.select("score_id", F.explode(F.array("s", "e", F.lit(0).cast("long"))).alias("pos")).distinct()
    none = F.lit(None)
    rows = notes.select("score_id", F.col("s").alias("pos"), F.lit(1).alias("o"), "part", F.struct("s", "e", "w").alias("note"), F.struct("s", "w", "over", "full").alias("next"))
    asked = points.select("score_id", "pos", F.lit(0).alias("o"), none.cast("int").alias("part"), none.cast(rows.schema["note"].dataType).alias("note"), none.cast(rows.schema["next"].dataType).alias("next"))
    both = rows.unionByName(asked)
    so_far = Window.partitionBy("score_id").rowsBetween(Window.unboundedPreceding, 0)
    by_part = lambda of, window: F.array(*[F.last(F.when(F.col("part") == p, F.col(of)), ignorenulls=True).over(window) for p in range(part_count)])
    seen = both.withColumns({"before": by_part("note", so_far.orderBy("pos", "o")), "after": by_part("next", so_far.orderBy(F.desc("pos"), F.desc("o")))}).where("o = 0").drop("o", "part", "note", "next")
    bound = lambda of: F.expr(f"array_min(transform(after, x -> get(x.{of}, int(x.s > pos))))")
    seen = seen.withColumns({"over": bound("over"), "full": bound("full")})
    reach, b = F.expr("array_max(transform(before, x -> x.e))"), F.expr("array_min(transform(after, x -> x.s))")
    parts = F.expr("size(filter(arrays_zip(before, after), x -> x.before IS NOT NULL OR x.after IS NOT NULL))")
    crossed = F.expr("size(filter(before, x -> x.e > pos))")
    order = Window.partitionBy("score_id").orderBy("pos")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    known = seen.withColumns({"then": F.lead("pos").over(order), "b": b, "safe": parts - crossed, "clean": crossed == 0, "silence": F.coalesce((reach == F.col("pos")) & (b > F.col("pos")), F.lit(False)), "after": F.expr("transform(after, x -> CASE WHEN x IS NOT NULL THEN named_struct('s', x.s, 'w', x.w) END)")})
    long = F.col("silence") & (F.col("b") - F.col("pos") >= min_silence)
    what = F.struct("pos", "b")
    return known.withColumns({
        "n0": F.count_if("silence").over(until), "n1": F.count_if(long).over(until), "s0": F.last(F.when(F.col("silence"), what), ignorenulls=True).over(until),
        "s1": F.last(F.when(long, what), ignorenulls=True).over(until), "cut": F.last(F.when(F.col("clean"), F.col("pos")), ignorenulls=True).over(until),
    })


def _best_silences(positions: DataFrame, levels: int) -> DataFrame:
    """(score_id, c, i, best): silences of class c (0: all, 1: long ones) numbered from 1; best[k] the longest, then latest, of 2 ** k from i on."""
    each = positions.where("silence").select("score_id", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"n{c}").alias("i"), F.col(f"s{c}.pos").alias("at")) for c in (0, 1)])).alias("x"), "pos", "b")
    own = each.where("x.at = pos").select("score_id", "x.c", "x.i", F.struct((F.col("b") - F.col("pos")).alias("d"), "pos", "b").alias("v0"))
    order = Window.partitionBy("score_id", "c").orderBy("i")
    for k in range(levels):
        own = own.withColumn(f"v{k + 1}", F.greatest(f"v{k}", F.lead(f"v{k}", 1 << k).over(order)))
    return own.select("score_id", "c", "i", F.array(*[f"v{k}" for k in range(levels + 1)]).alias("best"))


def _at(positions: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Columns of the position that a row names, to be joined by score and ``name``."""
    return positions.select("score_id", F.col("pos").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def successors(positions: DataFrame, floor: int) -> DataFrame:
    """(score_id, pos, end, next, reason) of a page that begins at pos, for every position but a score's last.

    The notes around a position are wide, so they are joined only where a page ends in a silence, and let go at once.
    """
    begin = positions.where("then IS NOT NULL").select("score_id", "pos", "then", "over", "full")
    ends = positions.groupBy("score_id").agg(F.max("pos").alias("total"))
    fits = F.col("over") > F.col("pos")
    rows = begin.join(ends, "score_id").withColumns({"fits": fits, "best": F.when(fits, F.col("over")).otherwise(F.col("then"))})
    last = rows.where("over IS NULL").select("score_id", "pos", F.col("total").alias("end"), F.col("total").alias("next"), F.lit("last").alias("reason"))
    rows = rows.where("over IS NOT NULL").withColumn("full", F.when((F.col("full") < F.col("best")) & F.lit(floor > 0), F.col("full")).otherwise(F.col("pos")))
    rows = rows.join(_at(positions, "best", ["n0", "n1", "s0", "s1", "cut", "safe"]), ["score_id", "best"]).join(_at(positions, "full", ["then", "n0", "n1"]), ["score_id", "full"])
    # Silences from the first position of the search to the best; the fullest page is that to the last of them.
    c = F.when(F.col("best_n1") > F.col("full_n1"), 1).when(F.col("best_n0") > F.col("full_n0"), 0)
    of = lambda x: F.when(F.col("c") == 1, F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    rows = rows.withColumn("c", F.when(F.col("fits"), c)).withColumns({"hi": of("best_n"), "lo": of("full_n") + 1, "quiet": of("best_s")})
    rows = rows.select("score_id", "pos", F.col("quiet.pos").alias("calm"), "c", "hi", "lo", "fits", "best", "best_cut", "best_safe", "full_then")
    ends_so = rows.where("calm IS NOT NULL").select("score_id", "pos", "calm").join(_at(positions.where("silence"), "calm", ["before"]), ["score_id", "calm"])
    ends_so = ends_so.select("score_id", "pos", F.expr("transform(calm_before, x -> CASE WHEN x.s >= pos THEN struct(x.s AS s, x.w AS w) END)").alias("calm_before")).join(positions.select("score_id", "pos", "after"), ["score_id", "pos"])
    # Parts whose sum up to that silence is the page's; silences after the last note of one of them are as full.
    sums = F.expr(f"filter(transform(after, (n, p) -> named_struct('m', CASE WHEN get(calm_before, p).s >= pos THEN {BASE} + get(calm_before, p).w - n.w + {NOTE} + {GAP} * int(n.s > pos) END, 's', get(calm_before, p).s)), x -> x.m IS NOT NULL)")
    since = ends_so.withColumn("sums", sums).select("score_id", "pos", F.expr("array_min(transform(filter(sums, x -> x.m = array_max(transform(sums, y -> y.m))), x -> x.s))").alias("since"))
    rows = rows.join(since, ["score_id", "pos"], "left").withColumn("since", F.coalesce("since", "pos")).drop("calm")
    rows = rows.join(_at(positions, "since", ["n0", "n1"]), ["score_id", "since"])
    rows = rows.withColumn("lo", F.greatest("lo", of("since_n") + 1)).withColumn("k", F.floor(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int"))
    levels = max(0, int(math.log2(max(1, positions.agg(F.max("n0")).first()[0] or 1))))
    table = _best_silences(positions, levels)
    left = table.select("score_id", F.col("c").alias("c"), F.col("i").alias("lo"), F.col("best").alias("from_lo"))
    right = table.select("score_id", F.col("c").alias("c"), F.col("i").alias("to"), F.col("best").alias("from_to"))
    rows = rows.withColumn("to", F.col("hi") - F.pow(F.lit(2), F.col("k")).cast("long") + 1)
    rows = rows.join(left, ["score_id", "c", "lo"], "left").join(right, ["score_id", "c", "to"], "left")
    quiet = F.greatest(F.get("from_lo", F.col("k")), F.get("from_to", F.col("k")))
    rows = rows.withColumn("quiet", quiet).withColumn("clean", F.col("best_cut") >= F.col("full_then"))
    # A page that cannot hold its first position has no choice.
    reason = F.when(F.col("c") == 1, "common-silence").when(F.col("c") == 0, "longest-silence").when(F.col("clean"), "clean-boundary").when(F.col("fits") | (F.col("best_safe") > 0), "partial-boundary").otherwise("char-limit")
    end = F.when(F.col("c").isNotNull(), F.col("quiet.pos")).when(F.col("clean"), F.col("best_cut")).otherwise(F.col("best"))
    cut = rows.select("score_id", "pos", end.alias("end"), F.when(F.col("c").isNotNull(), F.col("quiet.b")).otherwise(end).alias("next"), reason.alias("reason"))
    return cut.unionByName(last)


def _walk(step: DataFrame, max_pages: int) -> DataFrame:
    """(score_id, pos, page) of the pages that begin at 0 and go on along step (score_id, pos, next); pages 0 to max_pages."""
    at = step.where("pos = 0").select("score_id", "pos", F.lit(0).alias("page"))
    hop, done = step.select("score_id", "pos", "next"), 1
    while done <= max_pages:
        more = at.join(hop, ["score_id", "pos"]).select("score_id", F.col("next").alias("pos"), (F.col("page") + done).alias("page")).where(F.col("page") <= max_pages)
        more = staged(more.join(step.select("score_id", "pos"), ["score_id", "pos"], "left_semi"), "pages")
        if more.isEmpty():
            break
        at, done = at.unionByName(more), 2 * done
        if done <= max_pages:
            after = hop.select("score_id", F.col("pos").alias("next"), F.col("next").alias("far"))
            hop = staged(hop.join(after, ["score_id", "next"]).select("score_id", "pos", F.col("far").alias("next")), "hops")
    return at


def split_pages(events: DataFrame, max_chars: int = 2400, slack: int | None = None, min_silence: int = 512, max_pages: int = 120, part_count: int = 6) -> DataFrame:
    """(score_id, page, start, end, next_start, reason) by greedy paging. Parts (0 to part_count - 1) have one note at a time, as their text has.

    In order: all that is left; a common silence of min_silence in the second half of the page (slack); any
    silence; a boundary that no part sounds across; the fullest page; the character limit. Of silences the
    fullest page wins, then the longest, then the latest. What is left after max_pages is one more page, with the reason
    truncated; a score without notes is one empty page.
    """
    slack = max_chars // 2 if slack is None else slack
    most, floor = 100 * max_chars, 100 * (max_chars - slack)
    notes = staged(_rows(events, most, floor), "notes")
    positions = staged(page_positions(notes, part_count, min_silence), "positions")
    step = staged(successors(positions, floor), "steps")
    pages = _walk(step, max_pages).join(step, ["score_id", "pos"])
    over = F.col("page") >= max_pages
    total = positions.groupBy("score_id").agg(F.max("pos").alias("total"))
    stop: Column = F.when(over, F.col("total"))
    cut = pages.join(total, "score_id").select("score_id", "page", F.col("pos").alias("start"), F.coalesce(stop, "end").alias("end"), F.coalesce(stop, "next").alias("next_start"), F.when(over, "truncated").otherwise(F.col("reason")).alias("reason"))
    zero = F.lit(0).cast("long")
    empty = events.select("score_id").distinct().join(notes.select("score_id").distinct(), "score_id", "left_anti").select("score_id", F.lit(0).alias("page"), zero.alias("start"), zero.alias("end"), zero.alias("next_start"), F.lit("empty").alias("reason"))
    return cut.unionByName(empty)


def page_events(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Notes of each page, cut at its end and relative to its start: (score_id, page, part, start, duration, midi, volume).

    A note is on the page that it starts on; notes in a skipped silence's place cannot be.
    """
    notes = events.where("type = 'note' AND duration > 0")
    found = as_of(notes, pages.select("score_id", F.col("start").alias("pos"), "page", F.col("start").alias("page_start"), F.col("end").alias("page_end")), "start", ("page", "page_start", "page_end"))
    long = F.least(F.col("start") + F.col("duration"), F.col("page_end")) - F.col("start")
    return found.where("start < page_end").select("score_id", "page", "part", (F.col("start") - F.col("page_start")).alias("start"), long.alias("duration"), "midi", "volume")
