"""Vector code compression: product codes by Hamerly's version of Lloyd's algorithm, on integers.

Vectors are cut into equal consecutive parts; each part position has a codebook. A table of state
holds, for each vector and part, the index of its entry, one upper bound of the distance to it and one lower
bound of the distance to the second-nearest entry. When the entries move, the upper bound grows by the
move of the own entry and the lower bound shrinks by the largest move of the others. Where the upper
bound stays strictly below the lower one (or below half the way to the closest other entry), the entry is
the only nearest and nothing is scanned; else all entries are, in integers, and ties go to the lower index.

Each round is one pass over the state (written to the shared folder, so a lost executor costs tasks of
one round) and one aggregate of integer sums. Only codebooks meet the driver: parts x entries x the
length of a part, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import arrow_records, discard, same, staged
from cantata.llm.vectors import BATCH_ROWS, dimension, finite, matrix, scaled

#: Room that float bounds leave for their own rounding, as a share of the value.
SLACK = 1e-12
STATE = "vec_id {id}, label {label}, v array<bigint>, code binary, upper binary, lower binary, error bigint"


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + SLACK


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK) - SLACK


def scan(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point (n, w): the nearest entry (k, w), lower index first, its squared distance and the second-nearest's square.

    With one entry there is no second: the largest integer.
    """
    d = np.zeros((len(points), len(entries)), np.int64)
    for j in range(points.shape[1]):
        d += np.square(points[:, j, None] - entries[None, :, j])
    best = d.argmin(1)
    rows = np.arange(len(points))
    least = d[rows, best]
    d[rows, best] = np.iinfo(np.int64).max
    return best, least, d.min(1)


def moved_bounds(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one codebook: how far each entry moved at most, how far any other one did, and half the way to the closest other entry."""
    step = _up(np.sqrt(np.square(new - old).sum(1).astype(float)))
    k = len(new)
    if k == 1:
        return step, np.zeros(1), np.full(1, np.inf)
    order = np.argsort(-step, kind="stable")
    others = np.full(k, step[order[0]])
    others[order[0]] = step[order[1]]
    gaps = np.square(new[:, None, :] - new[None, :, :]).sum(2).astype(float)
    np.fill_diagonal(gaps, np.inf)
    return step, others, _down(np.sqrt(gaps.min(1))) / 2


def assign(points: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """One part position: new code, upper, lower, squared error and how many points were scanned. Without ``old``: all."""
    if old is None:
        hard = np.ones(len(points), bool)
        code, upper, lower = code.copy(), upper.copy(), lower.copy()
    else:
        step, others, half = moved_bounds(old, new)
        upper, lower = _up(upper + step[code]), _down(lower - others[code])
        hard = ~(upper < np.maximum(lower, half[code]))
        tight = hard.nonzero()[0]  # the true distance may already do
        upper[tight] = _up(np.sqrt(np.square(points[tight] - new[code[tight]]).sum(1).astype(float)))
        hard[tight] = ~(upper[tight] < np.maximum(lower[tight], half[code[tight]]))
        code = code.copy()
    at = hard.nonzero()[0]
    if len(at):
        code[at], least, second = scan(points[at], new)
        upper[at] = _up(np.sqrt(least.astype(float)))
        lower[at] = _down(np.sqrt(second.astype(float)))
    return code, upper, lower, np.square(points - new[code]).sum(1), len(at)


def _round(old: np.ndarray | None, new: np.ndarray, d: int):
    """The pass of one round over batches of the state; codebooks are (parts, entries, width)."""
    parts, width = len(new), d // len(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = matrix(b.column(2), d).reshape(n, parts, width)
            code, upper, lower, error = np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.zeros((n, parts)), np.zeros(n, np.int64)
            if old is not None:
                code, upper, lower = (np.frombuffer(b"".join(b.column(3 + i).to_pylist()), kind).reshape(n, parts).copy() for i, kind in enumerate((np.uint8, float, float)))
            for p in range(parts):
                found, upper[:, p], lower[:, p], e, _ = assign(v[:, p], code[:, p].astype(np.intp), upper[:, p], lower[:, p], None if old is None else old[p], new[p])
                code[:, p] = found
                error += e
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (code, upper, lower)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *packed, pa.array(error)], names=["vec_id", "label", "v", "code", "upper", "lower", "error"])

    return run


def _sums(parts: int, entries: int, d: int):
    """Of each task: for every used (part, entry) the count and the sums of its parts; at most parts x entries rows."""
    width = d // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            n = b.num_rows
            v = matrix(b.column(0), d).reshape(n, parts, width)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(n, parts)
            for p in range(parts):
                np.add.at(count[p], code[:, p], 1)
                np.add.at(total[p], code[:, p], v[:, p])
        p, e = count.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), *(pa.array(total[p, e, j]) for j in range(width))], names=["part", "entry", "n", *(f"s{j}" for j in range(width))])

    return run


def _means(state: DataFrame, book: np.ndarray, d: int) -> np.ndarray:
    """Entries replaced by floor(sum / count) of their parts; unused ones stay."""
    parts, entries, width = book.shape
    columns = ", ".join(f"s{j} bigint" for j in range(width))
    partial = state.select("v", "code").mapInArrow(_sums(parts, entries, d), f"part int, entry int, n bigint, {columns}")
    out = book.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).collect():  # parts x entries rows at most
        out[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return out


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code binary: an index of a byte for each part; error bigint) of every kept row, and the codebooks (parts, entries, width).

    Kept: vectors that are not null and hold no null or non-finite component. Each codebook starts as that part
    of the ``entries`` (256 at most) smallest ids; rows that repeat an id are rows of their own, ordered by
    their vectors; rows with a null id are coded, but start no entry. With fewer rows there are fewer
    entries; an empty table gives no rows and codebooks without entries. A table of vectors of different
    lengths, of a length that ``parts`` does not divide, or with components beyond 64-bit arithmetic is
    a ValueError. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes are bytes: 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.where(finite(vector_col)).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), scaled(vector_col).alias("v"))
    rows = staged(rows)
    d, most = dimension(rows, "v")
    if d % parts:
        raise ValueError(f"{parts} parts do not divide vectors of {d} components")
    if d * (2 * most + 1) ** 2 >= 2**63:
        raise ValueError("squared distances beyond 64 bits")
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").collect()
    book = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, d // parts).swapaxes(0, 1) if d else np.zeros((parts, len(first), 0), np.int64)
    if not first:
        if not rows.isEmpty():
            raise ValueError("no row has an id: no codebook can start")
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), book
    schema = STATE.format(id=rows.schema["vec_id"].dataType.simpleString(), label=rows.schema["label"].dataType.simpleString())
    none = F.lit(None).cast("binary")
    state, old = rows.select("*", none.alias("code"), none.alias("upper"), none.alias("lower")), None
    last = rows
    with arrow_records(spark, BATCH_ROWS):
        for i in range(rounds + 1):
            state = staged(state.select("vec_id", "label", "v", "code", "upper", "lower").mapInArrow(_round(old, book, d), schema))
            discard(last)
            last = state
            if i < rounds:
                old, book = book, _means(state, book, d)
    return state.select("vec_id", "label", "code", "error"), book


def books_text(book: np.ndarray) -> str:
    """All components in decimal, by part, entry and position within the part, joined by commas."""
    return ",".join(map(str, book.reshape(-1).tolist()))


def code_table(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (error summed over rows of an equal label, nulls together), codebooks_sha256."""
    coded, book = compress(vectors, **options)
    by_label = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    names = by_label.select(F.col("label").alias("l_label"), "label_error")
    digest = hashlib.sha256(books_text(book).encode()).hexdigest()
    return coded.join(names, same(coded["label"], names["l_label"])).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
