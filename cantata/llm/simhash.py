"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints that differ in at most 2 of 64 bits share at least 6 of their 8 positional
bytes: that is the guaranteed minimum of matches. Each fingerprint's positional bytes are put
in order of rarity over all fingerprints; two that share 6 of 8 share at least 4 within
their 6 rarest. So the postings are the 15 sets of 4 among those 6: who meets in none cannot
reach the minimum. Pairs that meet are tallied over all 8 positions, those that reach the
minimum are kept, and these are verified by their differing bits.

Postings of single bytes would each hold a 256th of all fingerprints, so that tallying them would
cost the square of the input. Postings hold distinct fingerprints only. Fingerprints that meet
more than ``SMALL_POSTING`` in one posting are looked up by sets of 6 positional bytes instead;
where these too are large, by 2 masked bits, where at most 4 fingerprints can meet, all linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import python_batches, same, staged, thinned
from cantata.llm.components import components

MAX_BITS, SHINGLE, SMALL_POSTING = 2, 3, 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a text's word shingles (all of the words if they are fewer; none: 0)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends, k = ends.tolist(), min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64, n)
    tally = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        tally += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * tally > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "tag", "fp"])


def _masks() -> list[tuple[int, list[int]]]:
    """For each pair of free bytes: the mask of the other 6, and the masks of 2 bits that it answers for."""
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    out = []
    for p, q in combinations(range(8), 2):
        keep = (1 << 64) - 1 & ~(0xFF << 8 * p) & ~(0xFF << 8 * q)
        bits = [1 << 8 * p + a | 1 << 8 * q + b for a in range(8) for b in range(8)]
        if q == p + 1 or (p, q) == (0, 7):  # two bits of one byte: one of its pairs answers
            own = q if (p, q) == (0, 7) else p
            bits += [1 << 8 * own + a | 1 << 8 * own + b for a, b in combinations(range(8), 2)]
        out.append((signed(keep), [signed(b) for b in bits]))
    return out


_PAIRS = "flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(least(x, y) AS a, greatest(x, y) AS b))))"
#: The guaranteed minimum of matches; how many of them a posting holds; and among how many of the rarest they must be:
#: before the SHARED-th rarest common byte stand at most SHARED - 1 common and 8 - MATCHES other ones.
MATCHES, SHARED = 8 - MAX_BITS, 4
PREFIX = 8 - MATCHES + SHARED


def _rarity(fps: DataFrame) -> np.ndarray:
    """Rank of each (position, byte) by its number of fingerprints: 8 x 256 numbers, at any size of the input."""
    each = fps.select(F.posexplode(F.array(*[F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)])).alias("p", "b"))
    count = np.zeros((8, 256), np.int64)
    for p, b, n in each.groupBy("p", "b").agg(F.count("*")).collect():  # 2048 rows at most
        count[p, b] = n
    rank = np.empty(8 * 256, np.int64)
    rank[np.lexsort((np.arange(8 * 256), count.ravel()))] = np.arange(8 * 256)
    return rank.reshape(8, 256)


def _postings_by(rank: np.ndarray):
    sets = np.array(list(combinations(range(PREFIX), SHARED)))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = fps.view(np.uint8).reshape(-1, 8)
            rare = np.sort(np.argsort(rank[np.arange(8), parts], axis=1, kind="stable")[:, :PREFIX], axis=1)  # positions, in natural order
            at = rare[:, sets]  # fingerprint x set x SHARED
            bits = (1 << at).sum(axis=2)
            value = np.zeros(at.shape[:2], np.int64)
            for j in range(SHARED):
                value = value << 8 | np.take_along_axis(parts, at[:, :, j], axis=1).astype(np.int64)
            key = value | bits.astype(np.int64) << 32
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fps, len(sets))), pa.array(key.ravel())], names=["fp", "posting"])

    return postings


def _verified(pairs: DataFrame) -> DataFrame:
    """Of the pairs, those that share MATCHES positional bytes and differ in at most MAX_BITS bits."""
    tally = " + ".join(f"int(((a ^ b) & {255 << 8 * p if p < 7 else -(1 << 56)}L) = 0)" for p in range(8))
    return pairs.where(F.expr(f"{tally} >= {MATCHES}")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) at 1 or 2 differing bits, a < b."""
    postings = fps.select("fp").mapInArrow(_postings_by(_rarity(fps)), "fp bigint, posting bigint")
    shared = staged(postings.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1"))
    members = staged(postings.join(shared, "posting"))
    few = members.where(F.col("n") <= SMALL_POSTING).groupBy("posting").agg(F.collect_set("fp").alias("s")).select(F.explode(F.expr(_PAIRS)).alias("p")).select("p.*")
    hubs = staged(members.where(F.col("n") > SMALL_POSTING).select("fp").distinct())
    return _verified(few).unionByName(_verified(_links_of_hubs(hubs))).distinct()


def _links_of_hubs(fps: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) among fingerprints of large postings, by sets of 6 bytes, then by masked bits."""
    masks = _masks()
    postings = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m, _ in masks])).alias("c", "bytes"))
    shared = staged(postings.groupBy("c", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    members = postings.join(shared, ["c", "bytes"])
    few = members.where(F.col("n") <= SMALL_POSTING).groupBy("c", "bytes").agg(F.collect_set("fp").alias("s")).select(F.explode(F.expr(_PAIRS)).alias("p")).select("p.*")
    bits = F.array(*[F.array(*map(F.lit, b)) for _, b in masks])
    large = members.where(F.col("n") > SMALL_POSTING).select("fp", F.explode(F.get(bits, F.col("c"))).alias("mask"))
    large = large.select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest")).groupBy("mask", "rest").agg(F.collect_set("fp").alias("s"))  # at most 4 fit
    many = large.where("size(s) > 1").select(F.explode(F.expr(_PAIRS)).alias("p")).select("p.*")
    return few.union(many)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, tag, fp (signed 64 bits), component_id.

    component_id is the smallest doc_id that can be reached over links of at most 2 bits.
    Null and empty texts have fingerprint 0, linked as any other; very long ones are hashed in
    runs. Rows with a null doc_id get the component of the rows they are linked to, null if these
    have none. Repeated rows are linked to each other. Other columns are not read.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", "tag", "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    python_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(text_col).alias("text"))
    marks = staged(base.mapInArrow(_fingerprints, f"doc_id {kind}, tag bigint, fp bigint"))
    distinct = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    near = staged(links(distinct.select("fp")))
    # A fingerprint stands for its documents; nodes are fingerprints, since ids may be null.
    linked = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    of = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = staged(of)
    reach = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(of.join(reach, "component").select("fp", "component", "component_id"))
    return marks.join(named, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id, a null id last; of rows that repeat it, one."""
    rows = staged(_grouped(docs, id_col, text_col).groupBy("component", "doc_id", "tag").agg(F.count("*").alias("n")))
    best = staged(rows.groupBy("component").agg(F.count("*").alias("kinds"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("best"), F.max("n").alias("most")).where("kinds > 1 OR most > 1"))
    best = best.select(F.col("component").alias("b_component"), F.col("best.doc_id").alias("b_doc"), F.col("best.tag").alias("b_tag"))
    judged = rows.join(best, rows["component"] == best["b_component"]).withColumn("stays", same(F.col("doc_id"), F.col("b_doc")) & (F.col("tag") == F.col("b_tag")))
    judged = staged(judged.select("doc_id", "tag", "n", "stays"))
    return thinned(docs, judged.where("NOT stays"), judged.where("stays AND n > 1"), id_col, text_col)
