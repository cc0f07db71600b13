"""Repeated windows of tokens, found by anchors; shared by byte and word substring dedup.

Every window of W tokens names an anchor: the least-hashed k-gram in it. Equal windows name
the same anchor at the same offset, and neighbouring windows mostly share theirs, so a text
of n tokens has about 2n / (W - k + 2) anchors. An anchor's windows together are a segment.

1. A k-gram that names windows of one document only cannot repeat: anchors' hashes are
   counted by document and the others drop out.
2. The segments of the remaining anchors are named by anchor and content (64 bits each) and
   aggregated to the least doc_id, so thousands of copies are one row. Where an anchor has one segment
   only, that doc_id is the answer for all its windows, and no text moves.
3. Of other anchors, the text of each distinct segment is cut once, dealt to tasks by ranges of an
   order in which an anchor's segments are neighbours, and sorted. A task resolves its sorted segments
   in buckets of bounded size: for every window, the least doc_id that has it. An anchor of more
   segments than a bucket holds (a notice between different neighbours, say) is dealt by what follows
   it and may begin and end anywhere: the windows of such anchors at a bucket's two ends, with their least
   doc_id so far, are compared across all boundaries by an aggregation. No task holds such an anchor whole.
4. Documents learn which of their windows a smaller doc_id has, and drop the tokens.

Whether windows are equal is decided on contents inside a bucket, and on 128 bits elsewhere: across
boundaries (windows), and of a segment's name (anchor and content).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import arrow_records, discard, groups_in_memory, python_batches, staged

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Windows that are worked on at once, within a core's cache; positions fit the low bits of a code.
_CHUNK, _LOW = 1 << 15, np.uint64((1 << 16) - 1)
#: Bytes of texts that are taken together; segments in an Arrow batch of theirs.
_TEXTS = 1 << 20
_SEGMENTS = 1 << 14
#: Bytes of segments that are resolved at once.
BUCKET_BYTES = 1 << 21


@dataclass(frozen=True)
class Shape:
    """Windows of ``window`` tokens, anchored by ``gram`` of them; tokens are bytes or words between white space.

    leading: SQL of what segments (key, content, lead) are dealt and sorted by; an anchor's must be equal.
    further: SQL of what those of a large anchor are dealt by in addition. segment_bytes: about the size of a segment.
    """

    window: int
    gram: int
    words: bool
    leading: str = "key"
    further: str = "content"
    segment_bytes: int = 256


class Texts:
    """The tokens of a batch's texts, one after the other: their values, where each text begins, and the bytes of any run of them."""

    def __init__(self, column: pa.Array, shape: Shape) -> None:
        column = column.cast(pa.large_binary())
        at, buffers = column.offset, column.buffers()
        bounds = np.frombuffer(buffers[1], np.int64)[at : at + len(column) + 1]
        data = buffers[2]
        raw = data.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes() if data is not None else b""
        self.bounds, self.starts = bounds - bounds[0], None
        if shape.words:
            texts = [raw[i:j].split() for i, j in pairwise(self.bounds.tolist())]
            parts = [word for words in texts for word in words]
            raw = b" ".join(parts)
            self.bounds = np.cumsum([0, *map(len, texts)])
            self.ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
            self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(parts) else self.ends
            self.tokens = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
        else:
            self.tokens = np.frombuffer(raw, np.uint8)
        self.raw = raw

    def runs(self, first: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The bytes of the runs of ``size`` tokens from ``first`` on."""
        a, z = (first, first + size) if self.starts is None else (self.starts[first], self.ends[first + size - 1])
        raw = self.raw
        return [raw[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]


def _slices(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of _TEXTS bytes of texts, a longer text by itself; texts: their column."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(texts)), 0).to_numpy(), dtype=np.int64)
        first = 0
        while first < len(b):
            done = int(upto[first - 1]) if first else 0
            end = max(first + 1, int(np.searchsorted(upto, done + _TEXTS, "right")))
            yield b.slice(first, end - first)
            first = end


_UP, _DOWN = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_CHUNK + 255, x, np.uint64)))) for x in (_BASE, _INVERSE))


def _grams(tokens: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of k tokens, of a chunk at most."""
    n = len(tokens)
    if tokens.dtype == np.uint8:  # 8 bytes at once, from each position on
        eight = np.ndarray(n - 7, "<u8", tokens, strides=(1,)).copy()
        g = np.zeros(n - k + 1, np.uint64)
        for j in (*range(0, k - 8, 8), k - 8):
            g ^= g >> np.uint64(31)
            g += eight[j : j + len(g)]
            g *= np.uint64(_BASE)
    else:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * _UP[:n], out=total[1:])
        g = (total[k:] - total[:-k]) * _DOWN[: n - k + 1]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    return g


def segments(tokens: np.ndarray, bounds: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By segment: its text's number, its first window, its number of windows, its anchor's position, its anchor's hash.

    tokens are those of all texts, which begin at bounds; a window lies in one text.
    """
    w, k = shape.window, shape.gram
    n_windows = len(tokens) - w + 1
    if n_windows <= 0:
        return (np.zeros(0, np.int64),) * 5
    out, last = [], -1
    for begin in range(0, n_windows, _CHUNK):
        part = tokens[begin : begin + _CHUNK + w - 1]
        g = _grams(part, k)
        code = g & ~_LOW | np.arange(len(g), dtype=np.uint64)
        span, width, m = w - k + 1, 1, len(part) - w + 1
        while 2 * width <= span:
            code, width = np.minimum(code[:-width], code[width:]), 2 * width
        at = (np.minimum(code[:m], code[span - width : span - width + m]) & _LOW).view(np.int64)
        text = int(np.searchsorted(bounds, begin, "right")) - 1
        for a, z in pairwise(bounds[text : int(np.searchsorted(bounds, begin + m + w)) + 1].tolist()):
            at[max(a, z - w + 1, begin) - begin : max(z - begin, 0)] = -1 - begin  # windows that leave their text
        step = np.concatenate(([at[0] + begin != last], at[1:] != at[:-1]))
        first = np.flatnonzero(step)
        anchor = at[first]
        last = int(at[-1]) + begin
        out.append((first + begin, anchor + begin, g[np.maximum(anchor, 0)].view(np.int64)))
    first, at, key = (np.concatenate(x) for x in zip(*out, strict=True))
    n = np.diff(np.concatenate((first, [n_windows])))
    inside = at >= 0
    first, n, at, key = first[inside], n[inside], at[inside], key[inside]
    return np.searchsorted(bounds, first, "right") - 1, first, n, at, key


def _mixed(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of a batch's pairs of key and text."""
    return key.view(np.uint64) + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)


def _keys_of(shape: Shape) -> Callable:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            t = Texts(b.column(1), shape)
            text, _, _, _, key = segments(t.tokens, t.bounds, shape)
            order = np.argsort(_mixed(key, text))
            k, x = key[order], text[order]
            once = np.sort(order[np.concatenate((np.ones(min(len(k), 1), bool), (k[1:] != k[:-1]) | (x[1:] != x[:-1])))])
            yield pa.RecordBatch.from_arrays([pa.array(key[once]), b.column(0).take(pa.array(text[once]))], names=["key", "doc_id"])

    return keys


#: place: a segment's first window, its number of windows and its anchor's place in it, as 40, 12 and 12 bits.
_PLACE = "key bigint, h bigint, doc_id bigint, tag bigint, place bigint"


def _places_of(shape: Shape) -> Callable:
    """The segments of the anchors that a document was asked for: names and places, no text."""
    names = [x.split()[0] for x in _PLACE.split(", ")]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 2):
            t = Texts(b.column(2), shape)
            text, first, n, at, key = segments(t.tokens, t.bounds, shape)
            asked = b.column(3)
            asked = np.sort(_mixed(asked.flatten().to_numpy(), np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())))
            mixed = _mixed(key, text)
            chosen = np.flatnonzero(asked[np.minimum(np.searchsorted(asked, mixed), len(asked) - 1)] == mixed) if len(asked) else np.zeros(0, np.int64)
            text, first, n, at, key = text[chosen], first[chosen], n[chosen], at[chosen], key[chosen]
            h = np.fromiter(map(xxhash.xxh64_intdigest, t.runs(first, n + shape.window - 1)), np.uint64, len(chosen))
            place = (first - t.bounds[text]) << 24 | n << 12 | at - first
            of = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h.view(np.int64)), b.column(0).take(of), b.column(1).take(of), pa.array(place)], names=names)

    return places


_SEGMENT = "key bigint, h bigint, content binary, lead int, least bigint, large boolean"


def _segments_of(shape: Shape) -> Callable:
    """The texts of the segments that a document stands for."""
    names = [x.split()[0] for x in _SEGMENT.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            t = Texts(b.column(1), shape)
            wanted = b.column(2)
            text = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
            wanted = wanted.flatten()
            key, h, place, large = (wanted.field(x) for x in ("key", "h", "place", "large"))
            place = place.to_numpy()
            first, n, lead = (place >> 24) + t.bounds[text], place >> 12 & 4095, pa.array((place & 4095).astype(np.int32))
            for i in range(0, len(text), _SEGMENTS):
                part = slice(i, i + _SEGMENTS)
                content = pa.array(t.runs(first[part], n[part] + shape.window - 1), pa.binary())
                of = b.column(0).take(pa.array(text[part]))
                yield pa.RecordBatch.from_arrays([key[part], h[part], content, lead[part], of, large[part]], names=names)

    return cut


@dataclass(frozen=True)
class Segments:
    """Neighbours in the order of segments: keys of anchors, contents, and the anchors' places in them, in tokens."""

    keys: np.ndarray
    contents: list[bytes]
    leads: np.ndarray

    def __len__(self) -> int:
        return len(self.contents)


#: Takes segments in order, with their least doc_ids, and gives their windows' least doc_ids, one after the other.
Resolve = Callable[[Segments, np.ndarray], np.ndarray]


def window_marks(content: bytes, shape: Shape) -> np.ndarray:
    """128-bit hashes of a segment's windows, in order, as two columns."""
    if shape.words:
        spaces = np.flatnonzero(np.frombuffer(content, np.uint8) == 32)
        starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(content)]))
        spans = zip(starts[: len(starts) - shape.window + 1].tolist(), ends[shape.window - 1 :].tolist(), strict=True)
    else:
        spans = ((i, i + shape.window) for i in range(len(content) - shape.window + 1))
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(content[a:z]) for a, z in spans), np.int64).reshape(-1, 2)


#: One row for each run of a segment's windows that have the same least doc_id, or with the marks of a segment at a bucket's end.
_SOLVED = "key bigint, h bigint, a int, z int, least bigint, edge array<bigint>, w1 array<bigint>, w2 array<bigint>"


def _resolved(resolve: Resolve, shape: Shape, bucket_bytes: int) -> Callable:
    """Answers sorted segments bucket by bucket; those of large anchors at a bucket's ends also bring their windows' marks and answers."""
    names = [x.split()[0] for x in _SOLVED.split(", ")]
    types = [*[pa.int64()] * 2, *[pa.int32()] * 2, pa.int64(), *[pa.list_(pa.int64())] * 3]

    def bucket(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        keys, hashes, leads, own, large = (rows.column(x).to_numpy() for x in ("key", "h", "lead", "least", "large"))
        contents = rows.column("content").to_pylist()
        counts = np.array([c.count(b" ") + 2 - shape.window for c in contents] if shape.words else [len(c) - shape.window + 1 for c in contents])
        same_as_next = np.concatenate((keys[1:] == keys[:-1], [False]))
        several = same_as_next | np.concatenate(([False], same_as_next[:-1]))
        best = np.repeat(own, counts)
        if several.any():
            at = np.flatnonzero(several)
            best[np.repeat(several, counts)] = resolve(Segments(keys[at], [contents[i] for i in at.tolist()], leads[at]), own[at])
        ends = np.cumsum(counts)
        turn = np.concatenate((best[1:] != best[:-1], [True]))
        turn[ends - 1] = True
        last = np.flatnonzero(turn)
        segment = np.repeat(np.arange(len(keys)), counts)[last]
        start = (ends - counts)[segment]
        z = last + 1 - start
        a = np.concatenate(([0], (last + 1)[:-1]))
        a = np.maximum(a - start, 0)
        told = [keys[segment], hashes[segment], a, z, best[last]]
        nothing = [pa.nulls(len(last), types[-1])] * 3
        yield pa.RecordBatch.from_arrays([*(pa.array(c, y, safe=False) for c, y in zip(told, types, strict=False)), *nothing], names=names)
        edges = np.flatnonzero(np.isin(keys, keys[[0, -1]]) & large)
        if len(edges):
            marks = [window_marks(contents[i], shape) for i in edges.tolist()]
            lists = [best[ends[i] - counts[i] : ends[i]] for i in edges.tolist()], [m[:, 0] for m in marks], [m[:, 1] for m in marks]
            nothing = [pa.nulls(len(edges), y) for y in types[2:5]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[edges]), pa.array(hashes[edges]), *nothing, *(pa.array(x, types[-1]) for x in lists)], names=names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            key, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            new_key = np.concatenate(([last is None or key[0] != last[0]], key[1:] != key[:-1]))
            fresh = new_key | np.concatenate(([last is None or h[0] != last[1]], h[1:] != h[:-1]))  # others: of a row of the table that is there several times
            last = key[-1], h[-1]
            if not fresh.all():
                b, new_key = b.filter(pa.array(fresh)), new_key[fresh]
            length = pc.binary_length(b.column(2)).to_numpy().astype(np.int64)
            before = size + np.cumsum(length) - length
            may_begin = new_key | b.column(5).to_numpy(zero_copy_only=False)
            begin = 0
            while len(i := np.flatnonzero(may_begin & (before > bucket_bytes))):
                held.append(b.slice(begin, i[0] - begin))
                yield from bucket(held)
                held, begin, before = [], i[0], before - before[i[0]]
            held.append(b.slice(begin))
            size = int(before[-1] + length[-1]) if len(length) else size
        if held and any(len(b) for b in held):
            yield from bucket(held)

    return solve


def dealt(cut: DataFrame, shape: Shape) -> DataFrame:
    """Segments in ranges of an order, and sorted; those of a large anchor may begin and end in any task."""
    order = [F.expr(shape.leading).alias("leading"), F.when(F.col("large"), F.expr(shape.further)).alias("further")]
    return cut.select("*", *order).repartitionByRange("leading", "further").sortWithinPartitions("leading", "key", "further", "content")


def _across_boundaries(solved: DataFrame) -> DataFrame:
    """Answers (key, h, a, z, least) for windows at the ends of buckets that another bucket has with a smaller doc_id."""
    windows = solved.where("edge IS NOT NULL").select("key", "h", F.posexplode(F.arrays_zip("edge", "w1", "w2")).alias("a", "w")).select("key", "h", "a", "w.edge", "w.w1", "w.w2")
    shared = staged(windows.groupBy("w1", "w2").agg(F.min("edge").alias("least"), F.max("edge").alias("most")).where("least < most").select("w1", "w2", "least"))
    return windows.join(shared, ["w1", "w2"]).where("least < edge").select("key", "h", "a", F.expr("a + 1").alias("z"), "least")


def repeated_windows(docs: DataFrame, shape: Shape, resolve: Resolve, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, tag, runs): runs of window starts that a smaller doc_id has too, each as its start << 24 | its length.

    docs: doc_id bigint, not null, and text. tag tells apart rows that repeat a doc_id.
    """
    spark = docs.sparkSession
    python_batches(spark)
    keys = staged(docs.mapInArrow(_keys_of(shape), "key bigint, doc_id bigint"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    shared = staged(shared)
    # Repeated keys are few and distinct, so even: hashed, they spare a sort of all keys.
    asked = keys.join(shared.hint("shuffle_hash"), "key").repartition("doc_id")
    with groups_in_memory(spark):  # documents of a partition
        asked = staged(asked.groupBy("doc_id").agg(F.collect_list("key").alias("keys")))  # of one document
    for used in (keys, shared):
        discard(used)
    tagged = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    places = staged(tagged.join(asked, "doc_id").select("doc_id", "tag", "text", "keys").mapInArrow(_places_of(shape), _PLACE))
    discard(asked)

    # min_by keeps the first row of the least doc_id in each column, so tag and place are of one row.
    named = staged(places.groupBy("key", "h").agg(F.min("doc_id").alias("doc_id"), F.min_by("tag", "doc_id").alias("tag"), F.min_by("place", "doc_id").alias("place")))
    several = named.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = staged(several.select("key", (F.col("kinds") > bucket_bytes // shape.segment_bytes).alias("large")))
    alone = named.join(several, "key", "left_anti").select("key", "h", F.lit(0).alias("a"), F.expr("int(place >> 12 & 4095)").alias("z"), F.col("doc_id").alias("least"))
    alone = staged(alone)
    owned = named.join(several, "key").select(F.col("doc_id").alias("o_doc"), F.col("tag").alias("o_tag"), F.struct("key", "h", "place", "large").alias("of")).repartition("o_doc", "o_tag")
    with groups_in_memory(spark):
        owned = staged(owned.groupBy("o_doc", "o_tag").agg(F.collect_list("of").alias("wanted")))  # of one document
    for used in (named, several):
        discard(used)
    cut = tagged.join(owned, (F.col("doc_id") == F.col("o_doc")) & (F.col("tag") == F.col("o_tag"))).select("doc_id", "text", "wanted").mapInArrow(_segments_of(shape), _SEGMENT)
    cut = staged(cut)
    discard(owned)
    with arrow_records(spark, 4096):  # segments are short
        solved = staged(dealt(cut, shape).select("key", "h", "content", "lead", "least", "large").mapInArrow(_resolved(resolve, shape, bucket_bytes), _SOLVED))
    discard(cut)
    answers = solved.where("edge IS NULL").select("key", "h", "a", "z", "least").unionByName(staged(_across_boundaries(solved))).unionByName(alone)
    told = places.join(answers, ["key", "h"]).where("least < doc_id").select("doc_id", "tag", F.expr("(place >> 24) + a << 24 | z - a").alias("run")).repartition("doc_id", "tag")
    with groups_in_memory(spark):
        found = staged(told.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list("run")).alias("runs")))  # of one document
    for used in (places, alone, solved):
        discard(used)
    return found


def removed_tokens(runs: list[int] | None, window: int) -> list[tuple[int, int]]:
    """Disjoint sorted runs of tokens that windows starting in runs cover."""
    if not runs:
        return []
    packed = np.array(runs, np.int64)
    first = packed >> 24
    end = np.maximum.accumulate(first + (packed & (1 << 24) - 1) + window - 1)
    begins = np.concatenate(([True], first[1:] > end[:-1]))
    return list(zip(first[begins].tolist(), end[np.concatenate((begins[1:], [True]))].tolist(), strict=True))


def with_runs(docs: DataFrame, shape: Shape, resolve: Resolve, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, runs) of every row of docs; rows whose id is null or no integer have no runs and are no reference."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).try_cast("long").alias("number"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = repeated_windows(base.where("number IS NOT NULL").select(F.col("number").alias("doc_id"), "text"), shape, resolve, bucket_bytes)
    found = found.select(F.col("doc_id").alias("r_doc"), F.col("tag").alias("r_tag"), "runs")
    return base.join(found, (F.col("number") == F.col("r_doc")) & (F.xxhash64("text") == F.col("r_tag")), "left").select("doc_id", "text", "runs")
