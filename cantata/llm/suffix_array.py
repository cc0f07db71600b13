"""Suffix-array dedup of byte strings.

Suffixes are sparse: those that begin at a repeated anchor, and those at the starts of its windows (see
repeats). Sampled splitters range-partition them by their leading bytes (the anchor; for anchors of many
segments also the bytes that follow it); a task sorts its range and cuts it into buckets of bounded
size. In a bucket, the suffixes at the anchors and the reversed prefixes before them are sorted, each with
the length that neighbours share. All windows that begin o bytes before an anchor are equal where their
prefixes share o bytes and their suffixes the rest of the window: runs of neighbours, found by the shared
lengths. The least doc_id of a group of equal windows keeps the bytes. Windows of large anchors at a
bucket's ends are compared across the boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cantata.llm.common import python_batches
from cantata.llm.repeats import BUCKET_BYTES, Segments, Shape, removed_tokens, with_runs

#: Anchors of 16 bytes: fewer and longer segments than with longer anchors, and still rarely equal by chance. Those of a large
#: anchor are dealt by what follows it, then by what precedes it: at either edge of a notice only one of the two differs.
BYTES = Shape(window=50, gram=16, words=False, leading="substr(content, lead + 1, 16)", further="concat(substr(content, lead + 17, 34), substr(content, 1, lead))", segment_bytes=128)


def _sorted(keys: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each text in the order of (key, text), and by place the length that it shares with the one before; -1 at a new key."""
    rows = np.frombuffer(b"".join([t.ljust(width, b"\0") for t in texts]), np.uint8).reshape(-1, width)
    order = np.lexsort((*(rows.view(">u8").astype(np.uint64).T[::-1]), keys))
    rows, keys = rows[order], keys[order]
    differ = np.ones((len(rows) - 1, width + 1), bool)
    np.not_equal(rows[1:], rows[:-1], out=differ[:, :width])
    shared = np.concatenate(([-1], np.where(keys[1:] == keys[:-1], differ.argmax(1), -1)))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return place, shared


def resolve(segments: Segments, least: np.ndarray, window: int = BYTES.window) -> np.ndarray:
    """The least doc_id of each window of a bucket's segments."""
    keys, leads = segments.keys, segments.leads.astype(np.int64)
    width = -(-window // 8) * 8
    after, after_shared = _sorted(keys, [c[a : a + window] for c, a in zip(segments.contents, leads.tolist(), strict=True)], width)
    before, before_shared = _sorted(keys, [c[a - 1 :: -1] if a else b"" for c, a in zip(segments.contents, leads.tolist(), strict=True)], width)
    counts = np.array([len(c) for c in segments.contents]) - window + 1
    first = np.cumsum(counts) - counts
    best = np.empty(counts.sum(), np.int64)
    for o in range(int((leads - counts + 1).min()), int(leads.max()) + 1):  # windows that begin so many bytes before their anchor
        has = np.flatnonzero((o <= leads) & (leads < o + counts))
        if not len(has):
            continue
        # Windows are equal where neither the suffixes nor the reversed prefixes part within the window.
        same = np.cumsum(after_shared < window - o)[after[has]] * (len(keys) + 1) + np.cumsum(before_shared < o)[before[has]]
        order = np.argsort(same)
        begins = np.flatnonzero(np.concatenate(([True], np.diff(same[order]) != 0)))
        lowest = np.minimum.reduceat(least[has][order], begins)
        best[(first + leads - o)[has][order]] = np.repeat(lowest, np.diff(np.concatenate((begins, [len(has)]))))
    return best


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            gone = removed_tokens(runs, BYTES.window)
            edges = [0, *(x for r in gone for x in r), len(raw)]
            kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
            for column, value in zip(out, (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, y) for c, y in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    A byte goes if a window of 50 bytes that covers it also starts in a smaller doc_id. Null texts
    are empty; very long ones are read in runs; rows that repeat a doc_id are judged each, never
    against each other; rows whose doc_id is null or no integer keep all their bytes and are no
    reference. Other columns are not read. An empty table gives no rows.
    """
    python_batches(docs.sparkSession)
    found = with_runs(docs, BYTES, resolve, id_col, text_col, bucket_bytes)
    return found.mapInArrow(_trimmed, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
