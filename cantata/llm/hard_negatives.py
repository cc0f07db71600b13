"""Hard negatives: a matrix product in two-dimensional blocks, reduced tile by tile.

Scores of anchors against rows are the product of an (anchors x dimensions) and a (dimensions x rows) matrix. Both are
cut into blocks of rows and into chunks of dimensions and packed as arrays; a block of anchors meets a block of rows
once for each chunk, by an equi-join on the block that it is sent to, and gives a partial tile of int64 scores. Partial
tiles of one place are added after a shuffle; the full tile is reduced at once, and only its best rows go on. So no
score matrix is ever stored, and a task holds one tile.

There are two products: anchors against the rows of their own label (positives), then anchors against all rows, where
each (anchor, positive) has a window of scores and a tile keeps the first few of other labels in it. Blocks are cut by a
row number that is written first, so equal labels, equal ids and equal vectors are spread alike. The second
product runs in waves of anchors: the partial tiles that are shuffled at a time are bounded by a multiple of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.llm.common import arrow_records, discard, staged
from cantata.llm.vectors import BATCH_ROWS, dimension, finite, matrix, scaled

#: Rows and anchors of a block: a tile of 2048 x 256 int64 is 4 MB.
ROW_BLOCK, ANCHOR_BLOCK = 2048, 256
#: Components of a chunk.
CHUNK = 32
#: Anchors of a wave: its partial tiles take 8 bytes for each row, anchor and chunk.
WAVE_ANCHORS = 1024
#: Rows of a record batch where each holds two blocks: about 20 MB.
TILE_RECORDS = 32
BLOCK = "grp string, block int, chunk int, n int, no binary, id binary, label binary, m binary"
PARTIAL = "grp string, a int, b int, a_n int, a_no binary, a_id binary, a_label binary, b_n int, b_no binary, b_id binary, b_label binary, s binary"


def _packed(rows: DataFrame, d: int, chunk: int) -> DataFrame:
    """rows: no, vec_id, label, v, grp, block; for each block and chunk of dimensions one row of arrays.

    Rows of a block arrive in any order; both chunks sort them by their number, so they agree.
    """

    def pack(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("no")
        m = np.array(df["v"].tolist(), np.int64).reshape(len(df), d)
        columns = [df[c].to_numpy(np.int64).tobytes() for c in ("no", "vec_id", "label")]
        return pd.DataFrame([(key[0], key[1], i, len(df), *columns, np.ascontiguousarray(m[:, at : at + chunk]).tobytes()) for i, at in enumerate(range(0, d, chunk))], columns=[c.split()[0] for c in BLOCK.split(", ")])

    return rows.groupBy("grp", "block").applyInPandas(pack, BLOCK)


def _product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """a @ b.T in int64; through floats where every sum stays below 2 ** 53."""
    return a @ b.T if not exact else (a.astype(float) @ b.T.astype(float)).astype(np.int64)


def _partial(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                a = np.frombuffer(r.pop("a_m").as_py(), np.int64).reshape(r["a_n"].as_py(), -1)
                b = np.frombuffer(r.pop("b_m").as_py(), np.int64).reshape(r["b_n"].as_py(), -1)
                columns = [pa.array([x.as_py()], x.type) for x in r.values()]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([_product(a, b, exact).tobytes()], pa.binary())], names=[*r, "s"])

    return run


def _tiles(anchors: DataFrame, rows: DataFrame, exact: bool) -> DataFrame:
    """Partial tiles of every block of anchors with every block of rows of its group; anchors: with blocks, their group's number of blocks of rows."""
    a = anchors.select("grp", F.col("block").alias("a"), "chunk", *[F.col(c).alias(f"a_{c}") for c in ("n", "no", "id", "label", "m")], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    b = rows.select("grp", F.col("block").alias("b"), "chunk", *[F.col(c).alias(f"b_{c}") for c in ("n", "no", "id", "label", "m")])
    met = a.join(b, ["grp", "b", "chunk"]).select("grp", "a", "b", *[f"{x}_{c}" for x in "ab" for c in ("n", "no", "id", "label", "m")])
    return met.mapInArrow(_partial(exact), PARTIAL)


def _added(df: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The whole tile of its partial ones, and the numbers, ids and labels of its anchors and rows; rows sorted by id."""
    first = df.iloc[0]
    ints = lambda c: np.frombuffer(first[c], np.int64)
    s = np.zeros((first["a_n"], first["b_n"]), np.int64)
    for x in df["s"]:
        s += np.frombuffer(x, np.int64).reshape(s.shape)
    order = np.argsort(ints("b_id"), kind="stable")
    return s[:, order], ints("a_no"), ints("a_id"), ints("a_label"), ints("b_no")[order], ints("b_id")[order], ints("b_label")[order]


def _rows_of(columns: dict[str, list[np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({k: np.concatenate(v) if v else np.array([], np.int64) for k, v in columns.items()})


def positives_of_tile(df: pd.DataFrame, k: int) -> pd.DataFrame:
    """(no, anchor_id, positive_id, score): the first k rows of the tile for each anchor, but the anchor itself."""
    s, a_no, a_id, _, b_no, b_id, _ = _added(df)
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("no", "anchor_id", "positive_id", "score")}
    best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
    for i in range(len(s)):
        own = best[i][b_no[best[i]] != a_no[i]][:k]
        for c, x in zip(out, (np.full(len(own), a_no[i]), np.full(len(own), a_id[i]), b_id[own], s[i, own]), strict=True):
            out[c].append(x)
    return _rows_of(out)


def negatives_of_tile(df: pd.DataFrame, wanted: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """(no, p, negative_id, score): for each wanted positive of the tile's anchors the first k rows of other labels within its window.

    wanted: no, p (number of the positive), score. The window is low * positive <= high * negative <= high * positive.
    """
    s, a_no, _, a_label, _, b_id, b_label = _added(df)
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("no", "p", "negative_id", "score")}
    at = {no: i for i, no in enumerate(a_no)}
    for no, group in wanted.groupby("no"):
        i = at[no]
        others = (b_label != a_label[i]).nonzero()[0]
        ranked = others[np.argsort(-s[i, others], kind="stable")]
        falling = -s[i, ranked]
        for p, score in zip(group["p"], group["score"], strict=True):
            found = ranked[(begin := np.searchsorted(falling, -score)) : begin + k]
            found = found[high * s[i, found] >= low * score]
            for c, x in zip(out, (np.full(len(found), no), np.full(len(found), p), b_id[found], s[i, found]), strict=True):
                out[c].append(x)
    return _rows_of(out)


def _first(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark drops the others before the shuffle, too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _blocks(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("int")


def mine(rows: DataFrame, anchor: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK, chunk: int = CHUNK, wave: int = WAVE_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: vec_id, label, v (integers); anchor: which of them are anchors. An anchor's positives are the first
    ``k_positive`` other rows of its label, by inner product, then by id; of each positive the first
    ``k_negative`` rows of other labels with low * positive <= high * negative <= high * positive. Rows
    with a null id, label or vector take no part. Rows that repeat an id are rows of their own, also as
    anchors. An empty table, or one without anchors, gives no rows. Vectors of different lengths or beyond
    64-bit arithmetic are a ValueError.
    """
    spark = rows.sparkSession
    known = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    known = staged(known.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v", anchor.alias("anchor"), F.monotonically_increasing_id().alias("no")))
    d, most = dimension(known, "v")
    if high * max(d, 1) * most**2 >= 2**63:
        raise ValueError("scores beyond 64 bits")
    exact = d * most**2 < 2**53
    counts = staged(known.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("n_anchors")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    spread = lambda blocks: F.pmod(F.xxhash64("no"), blocks).cast("int").alias("block")
    columns = ["no", "vec_id", "label", "v"]
    anchors, one = known.where("anchor"), F.lit("").alias("grp")
    # Positives: groups are labels.
    sized = counts.select(F.col("label").alias("l"), _blocks(F.col("n"), row_block).alias("blocks"), _blocks(F.col("n_anchors"), anchor_block).alias("a_blocks"))
    group = F.col("label").cast("string").alias("grp")
    with arrow_records(spark, BATCH_ROWS):
        a = staged(_packed(anchors.join(sized, anchors["label"] == sized["l"]).select(*columns, group, spread(F.col("a_blocks"))), d, chunk))
        b = staged(_packed(known.join(sized, known["label"] == sized["l"]).select(*columns, group, spread(F.col("blocks"))), d, chunk))
    with arrow_records(spark, TILE_RECORDS):
        tiles = _tiles(a.join(sized.select(F.col("l").cast("string").alias("grp"), "blocks"), "grp"), b, exact)
        near = tiles.groupBy("grp", "a", "b").applyInPandas(lambda df: positives_of_tile(df, k_positive), "no bigint, anchor_id bigint, positive_id bigint, score bigint")
        positives = staged(_first(near, ["no"], [F.desc("score"), F.col("positive_id")], k_positive).withColumnRenamed("rank", "p"))
    discard(a)
    discard(b)
    # Negatives: one group, in waves of anchors.
    asked = positives.select("no").distinct()
    n_anchors = asked.count()
    blocks, a_blocks, waves = (max(1, -(-n // size)) for n, size in ((total, row_block), (n_anchors, anchor_block), (n_anchors, wave)))
    with arrow_records(spark, BATCH_ROWS):
        a = staged(_packed(anchors.join(asked, "no", "left_semi").select(*columns, one, spread(F.lit(a_blocks))), d, chunk))
        b = staged(_packed(known.select(*columns, one, spread(F.lit(blocks))), d, chunk))
    wanted = positives.select(F.pmod(F.xxhash64("no"), F.lit(a_blocks)).cast("int").alias("a"), "no", "p", "score")
    wanted = wanted.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = []
    with arrow_records(spark, TILE_RECORDS):
        for w in range(waves):
            tiles = _tiles(a.where(F.pmod(F.col("block"), F.lit(waves)) == w).withColumn("blocks", F.lit(blocks)), b, exact)
            of_wave = wanted.where(F.pmod(F.col("a"), F.lit(waves)) == w)
            cut = tiles.groupBy("a", "b").cogroup(of_wave.groupBy("a", "b")).applyInPandas(lambda df, want: negatives_of_tile(df, want, k_negative, low, high), "no bigint, p int, negative_id bigint, score bigint")
            found.append(staged(_first(cut, ["no", "p"], [F.desc("score"), F.col("negative_id")], k_negative)))
    discard(a)
    discard(b)
    negatives = found[0]
    for more in found[1:]:
        negatives = negatives.unionByName(more)
    negatives = negatives.withColumnRenamed("score", "negative_score")
    both = positives.withColumnRenamed("score", "positive_score").join(negatives, ["no", "p"])
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame, anchors_of: int = 100, relabel_of: int = 7, labels: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """As mine, of a table of embeddings: components become floor(256 * x), anchors are ids divisible by ``anchors_of``.

    Labels of ids divisible by ``relabel_of`` become (label + 1) % labels first: noise in the labels, so that hard
    negatives are not just other clusters. Rows with a null id, label or vector, or with a component that is null or not
    finite, take no part. Other columns are not read.
    """
    ok = embeddings.where(finite(vector_col) & F.col(label_col).isNotNull())
    label = F.when(F.col(id_col) % relabel_of == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))
    rows = ok.select(F.col(id_col).alias("vec_id"), label.alias("label"), scaled(vector_col).alias("v"))
    return mine(rows, F.col("vec_id") % anchors_of == 0, **options)
