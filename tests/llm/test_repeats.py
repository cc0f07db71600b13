"""Segments of a batch of texts, and the least doc_ids of a bucket's windows, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cantata.llm import repeats, suffix_array, suffix_automata

SHAPES = [suffix_array.BYTES, suffix_automata.WORDS]


def texts_of_all_sizes(r, shape):
    token = (lambda: r.choice("ab\0é ")) if not shape.words else (lambda: r.choice(["x", "yy", "z"]) + r.choice([" ", "\n", "  "]))
    texts = ["".join(token() for _ in range(n)) for n in (0, 1, shape.window - 1, shape.window, 0, 200, 3, 49, 700, 90, 0)]
    return [*texts, "a" * 300, "q " * 300, texts[8]]


def test_short_texts_are_hashed_together(monkeypatch):
    """The work of a batch is that of its bytes: no round of calls for each of its texts."""
    calls = []
    grams = repeats._grams
    monkeypatch.setattr(repeats, "_grams", lambda *x: calls.append(1) or grams(*x))
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(100)) for _ in range(256)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(256), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = pa.Table.from_batches(repeats._keys_of(suffix_array.BYTES)(iter([batch])))
    assert set(out.column("doc_id").to_pylist()) == set(range(256))
    assert len(calls) <= 2


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("chunk", [40, 64, 1 << 15])
def test_segments_cover_the_windows_of_every_text(monkeypatch, shape, chunk):
    monkeypatch.setattr(repeats, "_CHUNK", chunk)
    texts = texts_of_all_sizes(random.Random(2), shape)
    whole = pa.array(["before", *texts, "after"])
    t = repeats.Texts(whole.slice(1, len(texts)), shape)
    tokens = [x.encode().split() if shape.words else list(x.encode()) for x in texts]
    assert np.diff(t.bounds).tolist() == [len(x) for x in tokens]
    seen, anchors, hashes = defaultdict(int), {}, {}
    for text, first, n, at, key in zip(*(c.tolist() for c in repeats.segments(t.tokens, t.bounds, shape)), strict=True):
        begin, anchor = first - int(t.bounds[text]), at - int(t.bounds[text])
        assert hashes.setdefault(tuple(tokens[text][anchor : anchor + shape.gram]), key) == key
        for i in range(begin, begin + n):
            seen[text, i] += 1
            window = tuple(tokens[text][i : i + shape.window])
            assert len(window) == shape.window and i <= anchor <= i + shape.window - shape.gram
            assert anchors.setdefault(window, (key, anchor - i)) == (key, anchor - i)  # equal windows name it alike
    assert seen == {(k, i): 1 for k, x in enumerate(tokens) for i in range(len(x) - shape.window + 1)}


def test_long_texts_of_a_batch_are_taken_by_themselves(monkeypatch):
    monkeypatch.setattr(repeats, "_TEXTS", 100)
    texts = ["a" * 60, "b" * 40, "c", "d" * 1000, "", "e" * 100, None, "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [b.column(0).to_pylist() for b in repeats._slices(iter([batch, batch.slice(0, 0)]), 0)]
    assert [x for p in parts for x in p] == texts
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= 100 for p in parts)


@pytest.mark.parametrize("seed", range(5))
def test_windows_of_a_bucket_against_brute_force(seed):
    r = random.Random(seed)
    anchors = [bytes(r.choice(b"\0ab") for _ in range(16)) for _ in range(3)]
    keys, contents, leads, least = [], [], [], []
    for k, anchor in enumerate(anchors):
        sides = [(bytes(r.choice(b"\0a") for _ in range(34)), bytes(r.choice(b"\0a") for _ in range(34))) for _ in range(3)]
        for _ in range(r.randint(2, 12)):
            n = r.randint(1, 35)
            lead = r.randint(n - 1, 34)
            before, after = r.choice(sides)[0], r.choice(sides)[1]
            content = before[34 - lead :] + anchor + after
            keys.append(k), contents.append(content[: n + 49]), leads.append(lead), least.append(r.randint(1, 99))
    want: dict = {}
    windows = [(keys[s], leads[s] - i, c[i : i + 50]) for s, c in enumerate(contents) for i in range(len(c) - 49)]
    owners = [least[s] for s, c in enumerate(contents) for _ in range(len(c) - 49)]
    for w, d in zip(windows, owners, strict=True):
        want[w] = min(want.get(w, d), d)
    got = suffix_array.resolve(repeats.Segments(np.array(keys), contents, np.array(leads)), np.array(least))
    assert got.tolist() == [want[w] for w in windows]
    assert got.tolist() != owners


def test_covered_tokens_of_runs():
    runs = [3 << 24 | 2, 4 << 24 | 1, 60 << 24 | 1, 109 << 24 | 5, 200 << 24 | 1]
    assert repeats.removed_tokens(runs, 50) == [(3, 54), (60, 163), (200, 250)]
    assert repeats.removed_tokens(None, 50) == repeats.removed_tokens([], 50) == []
