"""Quality classifier: a linear-chain CRF labels every line good or bad.

A line's features are shares of character and word kinds, its length, repetition inside it
and the same figures of its neighbours. The chain's transition weights tie adjacent labels.
Forward-backward marginals of "good", weighted by line length, average to the document's
quality. Training takes the document's label for each of its lines and maximises the
chain's likelihood; it uses a bounded sample of labelled documents. Scoring streams whole
texts through Arrow batches; there is no shuffle but the small one of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.llm.common import python_batches, staged

#: Bound of the training sample, in documents, and of the lines that it may hold in all (160 bytes each).
TRAIN_DOCS, TRAIN_LINES = 3000, 200_000
THRESHOLD = 0.7
#: Texts are worked on in runs of about so many characters, so that memory does not follow the batch.
CHUNK_CHARS = 1 << 19
#: Arrays by byte are made for so many bytes at a time, also within a text, a line or a word.
RUN_BYTES = 1 << 20

UPPER, LOWER, DIGIT, SPACE, STOP, MARK, HIGH = range(7)
_KIND = np.full(256, MARK, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = UPPER, LOWER, DIGIT, HIGH
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[[ord(c) for c in ".,;:'\"()-"]] = STOP
OWN = 13
N_FEATURES = 1 + 3 * OWN


class _Lines:
    """Counts by line of a stream of bytes, taken in runs of any length: a word or a line may go on in the next run.

    count: bytes by kind; words; seen: words that repeat the one before them, end in a mark, begin with two capitals.
    """

    def __init__(self, n: int) -> None:
        self.count, self.words, self.seen, self.line = np.zeros((n, 7)), np.zeros(n), np.zeros((n, 3)), 0
        self.word: tuple[int, int, list[int], int] | None = None  # open at the end of a run: name, length, first kinds, last kind
        self.before: tuple[int, int] | None = None  # line and name of the last word

    def add(self, data: np.ndarray) -> None:
        kind = _KIND[data]
        ends = data == 10
        line = np.cumsum(ends) - ends  # from the run's first line on
        n = int(line[-1]) + 1
        self.count[self.line : self.line + n] += np.bincount(line * 7 + kind, minlength=7 * n).reshape(n, 7)
        space = kind == SPACE
        if self.word is not None and space[0]:
            self._end_word()
        begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        finish = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
        if len(begin):
            going = self.word is not None and begin[0] == 0
            shift = np.zeros(len(begin), np.int64)
            if going:
                shift[0] = self.word[1]
            of = np.cumsum(np.bincount(begin, minlength=len(data))) - 1
            at = np.arange(len(data)) - begin[np.maximum(of, 0)] + shift[np.maximum(of, 0)]
            power = np.uint64(0x9E3779B97F4A7C15) * (2 * (at & 0xFFFF).astype(np.uint64) + np.uint64(1))
            value = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(7)) * power)
            value ^= value >> np.uint64(29)
            name = np.add.reduceat(value, begin)
            size = finish - begin + 1 + shift
            first = [kind[begin].tolist(), kind[np.minimum(begin + 1, finish)].tolist()]
            heads = [[a, b] if z > 1 else [a] for a, b, z in zip(*first, (finish - begin + 1).tolist(), strict=True)] if going or finish[-1] == len(data) - 1 else None
            shout = (kind[begin] == UPPER) & (finish > begin) & (kind[np.minimum(begin + 1, finish)] == UPPER)
            if going:
                name[0] = (int(name[0]) + self.word[0]) & (1 << 64) - 1
                heads[0] = (self.word[2] + heads[0])[:2]
                shout[0] = heads[0] == [UPPER, UPPER]
            self.word = None
            if finish[-1] == len(data) - 1:  # it may go on
                self.word = int(name[-1]), int(size[-1]), heads[-1], int(kind[finish[-1]])
                begin, finish, name, shout = begin[:-1], finish[:-1], name[:-1], shout[:-1]
            self._close(line[begin] + self.line, name, kind[finish] == MARK, shout)
        self.line += int(ends.sum())

    def _end_word(self) -> None:
        name, _, heads, last = self.word
        self.word = None
        self._close(np.array([self.line]), np.array([name], np.uint64), np.array([last == MARK]), np.array([heads == [UPPER, UPPER]]))

    def _close(self, line: np.ndarray, name: np.ndarray, tail: np.ndarray, shout: np.ndarray) -> None:
        if not len(line):
            return
        again = np.zeros(len(line), bool)
        again[1:] = (name[1:] == name[:-1]) & (line[1:] == line[:-1])
        again[0] = self.before == (int(line[0]), int(name[0]))
        self.before = int(line[-1]), int(name[-1])
        lo, hi = int(line[0]), int(line[-1]) + 1
        self.words[lo:hi] += np.bincount(line - lo, minlength=hi - lo)
        for j, what in enumerate((again, tail, shout)):
            self.seen[lo:hi, j] += np.bincount(line - lo, what, hi - lo)


def line_features(texts: list[str | None], run: int = RUN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line, bytes by line, and lines by document, of whole texts; an empty text is one empty line.

    Arrays by byte are made for ``run`` bytes at a time; what stays are some figures for each line.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    per_doc = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
    n = int(per_doc.sum())
    found = _Lines(n)
    for at in range(0, len(data), run):
        found.add(data[at : at + run])
    count, words, seen = found.count, found.words, found.seen
    count[:, SPACE] -= 1  # the line's own end
    size = count.sum(axis=1).astype(np.int64)
    length, most = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(count[:, UPPER] + count[:, LOWER] + count[:, HIGH], 1)
    own = np.column_stack([
        np.log1p(size) / 5, np.log1p(words) / 4, count[:, UPPER] / letters, count[:, HIGH] / letters, count[:, DIGIT] / length, count[:, MARK] / length, count[:, STOP] / length,
        np.minimum(size / most, 30) / 10, seen[:, 0] / most, seen[:, 1] / most, seen[:, 2] / most, size == 0, words <= 2,
    ])
    first = np.concatenate(([0], np.cumsum(per_doc)))
    before, after = np.vstack((np.zeros((1, OWN)), own[:-1])), np.vstack((own[1:], np.zeros((1, OWN))))
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    return np.hstack((np.ones((n, 1)), own, before, after)), size, per_doc


def _chains(emission: np.ndarray, per_doc: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z by document, marginals of "good" by line, pair marginals (2 x 2) by line with its predecessor.

    emission: score of good over bad, by line. All chains move together, one line a step; a
    chain of length L is in the first L steps only.
    """
    order = np.argsort(-per_doc, kind="stable")
    first = (np.cumsum(per_doc) - per_doc)[order]
    length, steps = per_doc[order], int(per_doc.max(initial=0))
    live = np.searchsorted(-length, -np.arange(steps), side="left")  # chains longer than the step
    e = np.column_stack((np.zeros_like(emission), emission))
    forward, scale = np.zeros_like(e), np.zeros(len(per_doc))
    for t in range(steps):
        m = live[t]
        at = first[:m] + t
        if t == 0:
            a = e[at]
        else:
            x = forward[at - 1][:, :, None] + trans
            top = x.max(axis=1)
            a = e[at] + top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        forward[at] = a
    last = first + length - 1
    top = forward[last].max(axis=1)
    scale[order] = top + np.log(np.exp(forward[last] - top[:, None]).sum(axis=1))
    backward, pairs = np.zeros_like(e), np.zeros((len(emission), 2, 2))
    z = np.empty(len(per_doc))
    z[:] = scale[order]
    for t in range(steps - 2, -1, -1):
        m = live[t + 1]
        at = first[:m] + t
        x = trans + (e[at + 1] + backward[at + 1])[:, None, :]
        pairs[at + 1] = np.exp(forward[at][:, :, None] + x - z[:m, None, None])
        top = x.max(axis=2)
        backward[at] = top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))
    good = 1 / (1 + np.exp(np.clip((forward + backward)[:, 0] - (forward + backward)[:, 1], -700, 700)))
    return scale, good, pairs


def fit(features: np.ndarray, per_doc: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights by feature and the 2 x 2 transition scores, by gradient ascent (Adam) on the chains' likelihood.

    A document's gradient is divided by its lines, so that long ones do not outweigh the others.
    """
    w, trans = np.zeros(features.shape[1]), np.zeros((2, 2))
    y = np.repeat(labels, per_doc)
    share = np.repeat(1 / per_doc, per_doc) / max(1, len(per_doc))
    first = np.zeros(len(y), bool)
    first[np.cumsum(per_doc) - per_doc] = True
    true = np.zeros((len(y), 2, 2))
    true[np.arange(len(y)), y, y] = 1
    true[first] = 0
    m = v = np.zeros(len(w) + 4)
    for t in range(1, rounds + 1):
        _, good, pairs = _chains(features @ w, per_doc, trans)
        g = np.concatenate((features.T @ ((y - good) * share), ((true - pairs) * share[:, None, None]).sum(axis=0).ravel()))
        g -= decay * np.concatenate((w, trans.ravel() * 10))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, trans = w + step[:-4], trans + step[-4:].reshape(2, 2)
    return w, trans


def quality(texts: list[str | None], w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, by document."""
    if not texts:
        return np.zeros(0)
    out, begin, room = [], 0, CHUNK_CHARS
    for at, text in enumerate(texts):
        room -= len(text or "")
        if room <= 0 or at == len(texts) - 1:
            out.append(_quality(texts[begin : at + 1], w, trans))
            begin, room = at + 1, CHUNK_CHARS
    return np.concatenate(out)


def _quality(texts: list[str | None], w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    features, size, per_doc = line_features(texts)
    good = _chains(features @ w, per_doc, trans)[1]
    first = np.cumsum(per_doc) - per_doc
    weight = size + 1.0
    return np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0, 1)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Fits the CRF on the train_docs labelled documents (not held out) that come first by a hash of the id.

    Their features, not their texts, reach the driver, and of these train_lines lines at most: Spark
    counts each chosen document's lines first; those of over a hundredth of train_lines are passed over,
    and the rest are taken in order while their sum fits. Without labels, or with one label only, zero
    weights or those of that label come out. A null label is none; repeated labels of an id: the largest
    counts; of rows that repeat an id, that with the fewest lines.
    """
    python_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = known.where(~held_out(F.col("l_id"))).orderBy(F.xxhash64("l_id"), "l_id").limit(train_docs)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = base.join(F.broadcast(chosen), base["doc_id"] == chosen["l_id"]).select(F.xxhash64("doc_id").alias("h"), "y", "text")  # train_docs rows at most

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, y, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                lines = (text or "").count("\n") + 1
                if lines <= most:
                    features = line_features([text])[0].astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([y], pa.int32()), pa.array([lines]), pa.array([features.tobytes()], pa.binary())], names=["h", "y", "lines", "f"])

    most = max(train_lines // 100, 1)
    rows = sample.mapInArrow(reduced, "h bigint, y int, lines bigint, f binary").groupBy("h", "y").agg(F.min(F.struct("lines", "f")).alias("r")).select("h", "y", "r.*")
    rows = staged(rows)
    sums = rows.select("h", F.sum("lines").over(Window.orderBy("h")).alias("upto"))  # train_docs numbers at most
    fit_in = staged(sums.where(F.col("upto") <= train_lines).select("h"))
    parts, y = [], []
    for r in sorted(rows.join(fit_in, "h", "left_semi").collect(), key=lambda r: r["h"]):
        parts.append(np.frombuffer(r["f"], np.float32).reshape(-1, N_FEATURES))
        y.append(1 if r["y"] else 0)
    if not parts:
        return np.zeros(N_FEATURES), np.zeros((2, 2))
    return fit(np.vstack(parts).astype(float), np.array([len(p) for p in parts]), np.array(y))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, tag, held_out, score, predicted.

    Null and empty texts are one empty line; very long texts are read in runs of bytes, so that memory follows
    their lines. Rows that repeat are scored each, alike; a score of exactly THRESHOLD is 1. An empty
    table gives no rows; other columns are not read.
    """
    python_batches(docs.sparkSession)
    w, trans = model
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(text_col).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(quality(b.column(2).to_pylist(), w, trans), pa.float64())], names=["doc_id", "tag", "score"])

    out = base.mapInArrow(scored, f"doc_id {kind}, tag bigint, score double")
    return out.select("doc_id", "tag", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least THRESHOLD, with all their columns, in one pass over the texts.

    Null and empty texts are scored like others, as one empty line; rows that repeat stay or go together. No
    name of a column clashes. Of an empty table no row stays.
    """
    w, trans = train(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(quality(b.column(at).to_pylist(), w, trans) >= THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)
