"""Substring dedup of words by suffix automata of reference shards.

A reference shard holds the distinct repeated segments of a range of anchors, each with its
least doc_id (see repeats), in at most ``SHARD_BYTES``: one suffix automaton is built over all of
them, and the segments of the documents are streamed through it for matching statistics. Where the
longest match reaches the window's length, the state of that length knows the least doc_id that
has it. Windows of large anchors at a shard's ends are compared across shards.

Broadcasting automata of all documents would broadcast the corpus, and streaming every document
through every shard would cost the square of it. So shards are not broadcast: what can match a
shard, by its anchors, goes to the task that holds the shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cantata.llm.common import python_batches
from cantata.llm.repeats import Segments, Shape, removed_tokens, with_runs

WORDS = Shape(window=50, gram=25, words=True)
#: Text of a shard; its automaton takes some hundred times as much memory.
SHARD_BYTES = 1 << 18


class Automaton:
    """Generalised suffix automaton of word sequences; least: by state, the least id whose text has its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]
        self.last = 0

    def add(self, words: list[bytes], owner: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            if owner < self.least[last]:
                self.least[last] = owner

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.least.append(1 << 62)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, p: int, word: bytes) -> int:
        if word in self.next[p]:
            q = self.next[p][word]
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        cur = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return cur

    def close(self) -> None:
        """Passes least ids up the suffix links, long states first."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.least[self.link[s]] = min(self.least[self.link[s]], self.least[s])

    def stream(self, words: list[bytes], window: int) -> Iterator[int | None]:
        """For each word, the least id that has the window ending there; None if no text has it."""
        state = match = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                match = self.length[state]
            if word in self.next[state]:
                state, match = self.next[state][word], match + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                match = self.length[state]
            yield self.least[state] if match >= window else None


def resolve(segments: Segments, least: np.ndarray, window: int = WORDS.window) -> np.ndarray:
    """The least doc_id of each window of a shard's segments."""
    automaton, texts = Automaton(), [c.split(b" ") for c in segments.contents]
    for words, owner in zip(texts, least.tolist(), strict=True):
        automaton.add(words, owner)
    automaton.close()
    return np.fromiter((x for words in texts for x in islice(automaton.stream(words, window), window - 1, None)), np.int64)


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], []]
        for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            edges = [0, *(x for r in removed_tokens(runs, WORDS.window) for x in r), len(words)]
            kept = [w for a, z in zip(edges[::2], edges[1::2], strict=True) for w in words[a:z]]
            joined = b" ".join(kept)
            for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace")), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, y) for c, y in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (words joined by spaces).

    A word goes if a window of 50 words that covers it also starts in a smaller doc_id. Null texts
    have no words; very long ones are read in runs; rows that repeat a doc_id are judged each, never
    against each other; rows whose doc_id is null or no integer keep all words and are no
    reference. Other columns are not read. An empty table gives no rows.
    """
    python_batches(docs.sparkSession)
    found = with_runs(docs, WORDS, resolve, id_col, text_col, shard_bytes)
    return found.mapInArrow(_trimmed, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
