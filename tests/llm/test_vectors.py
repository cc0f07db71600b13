"""Vector codes and hard negatives against plain Python, on ties, repeated rows, nulls and odd numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from cantata.llm import hard_negatives, vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, code string, no string"


def _table(spark, rows):
    """With other columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, v, x, 7, "z", "z") for i, v, x in rows], SCHEMA)


def _ints(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(np.float32(x))) for x in v]


def _rows(seed, n, d, spread):
    r = random.Random(seed)
    rows = [(i, [r.choice(spread) + r.random() / 50 for _ in range(d)] if i % 3 else [r.choice(spread) for _ in range(d)], r.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * d, 1), (n + 2, [float("nan")] * d, 0), (n + 3, [float("inf")] + [0.0] * (d - 1), 0), (n + 4, rows[5][1], 2), (5, rows[5][1], 0), (6, rows[7][1], 1)]
    r.shuffle(rows)
    return rows


def _brute_codes(rows, parts, entries, rounds):
    kept = [(i, _ints(v), x) for i, v, x in rows if _ints(v) is not None]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda x: (x[0], x[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min((dist(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assigned()
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, x), e in zip(kept, error, strict=True):
        total[x] = total.get(x, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, total[x], digest) for (i, _, x), f, e in zip(kept, found, error, strict=True))


@pytest.mark.parametrize(("seed", "spread", "rounds"), [(1, [-1.0, 0.0, 0.5], 2), (2, [0.001 * k for k in range(9)], 5), (3, [0.25], 2)])
def test_codes_against_brute_force(spark, seed, spread, rounds):
    rows = _rows(seed, 90, 8, spread)
    got = vector_codes.code_table(_table(spark, rows), parts=4, entries=12, rounds=rounds)
    assert sorted(tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == _brute_codes(rows, 4, 12, rounds)


def test_bounds_spare_scans_and_change_nothing():
    r = np.random.default_rng(4)
    points = np.concatenate([r.integers(-9, 9, (500, 4)) + 200 * k for k in range(6)])
    book = points[::500].copy()
    none = np.zeros(len(points), np.intp), np.zeros(len(points)), np.zeros(len(points))
    code, upper, lower, _, scanned = vector_codes.assign(points, *none, None, book)
    assert scanned == len(points)
    moved = book + r.integers(-2, 3, book.shape)
    found, upper, lower, error, scanned = vector_codes.assign(points, code, upper, lower, book, moved)
    best, least, second = vector_codes.scan(points, moved)
    assert scanned < 10 and (found == best).all() and (error == least).all()
    assert (upper**2 >= least).all() and (lower**2 <= second + 1e-6).all()


def test_equal_entries_take_the_lower_index():
    points = np.array([[0, 0], [5, 5], [5, 5], [2, 3]])
    book = np.array([[5, 5], [0, 0], [0, 0], [5, 5]])
    assert list(vector_codes.scan(points, book)[0]) == [1, 0, 0, 0]
    code, upper, lower, _, _ = vector_codes.assign(points, np.zeros(4, np.intp), np.zeros(4), np.zeros(4), None, book)
    assert list(vector_codes.assign(points, code, upper, lower, book, book[::-1].copy())[0]) == [1, 0, 0, 0]


def test_codes_of_odd_tables(spark):
    assert vector_codes.code_table(_table(spark, [])).collect() == []
    one = vector_codes.code_table(_table(spark, [(1, [0.5] * 16, None), (None, [0.25] * 16, None)])).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in one) == [(0, "00" * 16, 16 * 32**2, 2 * 16 * 32**2), (1, "00" * 16, 16 * 32**2, 2 * 16 * 32**2)]
    with pytest.raises(ValueError):
        vector_codes.code_table(_table(spark, [(1, [0.5] * 16, 0), (2, [0.5] * 32, 0)]))
    with pytest.raises(ValueError):
        vector_codes.code_table(_table(spark, [(1, [1e30] * 16, 0)]))


def _brute_negatives(rows, anchors_of, k_positive=5, k_negative=5, relabel_of=7):
    kept = [(i, _ints(v), (x + 1) % 10 if i % relabel_of == 0 else x) for i, v, x in rows if i is not None and x is not None and _ints(v) is not None]
    out = []
    for n, (a, v, x) in enumerate(kept):
        if a % anchors_of:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, u, strict=True)), i, y) for m, (i, u, y) in enumerate(kept) if m != n)
        for s, i, _ in [r for r in scored if r[2] == x][:k_positive]:
            found = [(t, j) for t, j, y in scored if y != x and -80 * s <= -100 * t <= -100 * s][:k_negative]
            out += [(a, i, rank, j, -s, -t) for rank, (t, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "spread"), [(5, [-0.5, 0.0, 0.5, 1.0]), (6, [0.125, 0.25]), (7, [0.5])])
def test_negatives_against_brute_force(spark, seed, spread):
    rows = _rows(seed, 120, 6, spread) + [(None, [0.5] * 6, 1)]
    for options in ({}, {"row_block": 7, "anchor_block": 3, "chunk": 4, "wave": 5}):
        got = hard_negatives.hard_negatives(_table(spark, rows), anchors_of=4, **options)
        assert sorted(tuple(r) for r in got.collect()) == _brute_negatives(rows, 4)


def test_negatives_of_odd_tables(spark):
    assert hard_negatives.hard_negatives(_table(spark, [])).collect() == []
    assert hard_negatives.hard_negatives(_table(spark, [(1, [0.5], 0), (2, [0.5], 1)])).collect() == []
    assert hard_negatives.hard_negatives(_table(spark, [(100, [0.5], 0), (2, [0.5], 1)])).collect() == []
    lone = [(100, [1.0], 0), (2, [0.5], 0), (3, [0.5], 1), (4, [0.4], 1), (5, [0.3], 1), (6, [0.6], 1)]
    got = hard_negatives.hard_negatives(_table(spark, lone)).collect()
    assert [(r["positive_id"], r["rank"], r["negative_id"]) for r in got] == [(2, 1, 3)]
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(_table(spark, [(100, [1e9], 0), (2, [1e9], 0)]))


def test_a_label_of_all_rows_is_cut_into_blocks(spark):
    """A hot label: no tile takes more than its block."""
    rows = [(i, [1.0, i / 500], 0) for i in range(1, 400)]
    rows += [(1000 + i, [1.0, i / 10], 1) for i in range(3)]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(_table(spark, rows), anchors_of=50, relabel_of=5000, row_block=16, anchor_block=2).collect())
    assert got == _brute_negatives(rows, 50, relabel_of=5000) and len(got) > 20
