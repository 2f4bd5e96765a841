"""Hard negatives of anchors by Fagin's threshold algorithm.

Rows are dealt into blocks, anchors into chunks, and a task has one chunk and one block. For every dimension the
block's rows are listed in order of their component. An anchor reads a list from its large end where its own
component is positive and from its small end where it is negative, a few rows of every list at a time; a row met
for the first time is scored by its whole vector. No row that was not met can score more than the threshold, the
anchor's product with the components read last, so reading stops once that is below the worst score still needed
in each of the anchor's windows. The best rows of all blocks are merged by a window with a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import partitions, stored

BLOCK_ROWS = 1 << 13
LARGE_BLOCK_ROWS = 1 << 16
CHUNK_ANCHORS = 1 << 13
FIRST_DEPTH = 16
#: Components from here on would let a score leave the range of a long.
LIMIT = 1 << 28


class SortedLists:
    """Rows of a block: for every dimension, their order by its component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray | None = None):
        self.ids, self.vectors, self.labels = ids, vectors, labels
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(vectors, self.order, 0)

    def search(
        self, anchor: np.ndarray, windows: Sequence[tuple[int, int]], k: int, allowed: np.ndarray
    ) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Per window (least and largest score) the first ``k`` allowed rows by score, then id: (rows, scores).

        Also the number of rows scored.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met = ~allowed
        rows, scores = np.zeros(0, np.int64), np.zeros(0, anchor.dtype)
        depth, at = min(FIRST_DEPTH, n), 0
        while True:
            # Once the lists hold more places than there are rows, reading them to the end is no more work.
            if depth * (len(up) + len(down)) >= 2 * n or len(up) + len(down) == 0:
                depth = n
                new = np.flatnonzero(~met)
            else:
                fresh = np.zeros(n, bool)
                fresh[self.order[n - depth : n - at, up].ravel()] = True
                fresh[self.order[at:depth, down].ravel()] = True
                new = np.flatnonzero(fresh & ~met)
            met[new] = True
            rows, scores = np.r_[rows, new], np.r_[scores, self.vectors[new] @ anchor]
            if depth == n:
                break
            threshold = self.values[n - depth, up] @ anchor[up] + self.values[depth - 1, down] @ anchor[down]
            if all(threshold < self._needed(scores, lo, hi, k) for lo, hi in windows):
                break
            at, depth = depth, min(4 * depth, n)
        return [self._first(rows, scores, lo, hi, k) for lo, hi in windows], len(rows)

    @staticmethod
    def _needed(scores: np.ndarray, lo: int, hi: int, k: int) -> int:
        """The score below which no row can enter a window; an empty window needs none."""
        if hi < lo:
            return 1 << 62
        inside = scores[(scores >= lo) & (scores <= hi)]
        return max(lo, np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else lo

    def _first(self, rows, scores, lo, hi, k) -> tuple[np.ndarray, np.ndarray]:
        inside = np.flatnonzero((scores >= lo) & (scores <= hi))
        if len(inside) > k:
            worst = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
            inside = inside[scores[inside] >= worst]
        order = inside[np.lexsort((self.ids[rows[inside]], -scores[inside]))][:k]
        return rows[order], scores[order]


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of one width; what a shorter one lacks is zero."""
    out = np.zeros((len(lists), width), np.int64)
    size = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate([c.flatten().to_numpy() for c in lists.chunks]) if len(lists) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _exact(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where no sum of products can leave their exact integers, else as integers."""
    top = [int(np.abs(x).max(initial=0)) for x in (rows, anchors)]
    if top[0] * top[1] * max(1, rows.shape[1]) < 1 << 53:
        return rows.astype(np.float64), anchors.astype(np.float64)
    return rows, anchors


def _block(anchors: pa.Table, rows: pa.Table) -> tuple:
    """Ids, labels and vectors of the rows of a block (one row an id), and the anchors' vectors."""
    width = max([len(x) for t in (anchors, rows) for x in t.column("vector")], default=0)
    vectors, asking = _matrix(rows.column("vector"), width), _matrix(anchors.column("vector"), width)
    ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    order = np.lexsort((*vectors.T[::-1], labels, ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(order) else order
    vectors, asking = _exact(vectors[order], asking)
    return ids[order], labels[order], vectors, asking


def _positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels, vectors, asking = _block(anchors, rows)
        out = []
        names, of = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        for label in np.unique(of) if len(ids) else []:
            same = np.flatnonzero(labels == label)
            lists = SortedLists(ids[same], vectors[same])
            for j in np.flatnonzero(of == label):
                ((at, scores),), _ = lists.search(
                    asking[j], [(-(1 << 62), 1 << 62)], k, lists.ids != names[j]
                )
                out += [(names[j], i, s) for i, s in zip(lists.ids[at].tolist(), scores.tolist())]
        return _long_table(out, ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels, vectors, asking = _block(anchors, rows)
        out = []
        lists = SortedLists(ids, vectors)
        names, of = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        for j, positives in enumerate(anchors.column("positives").to_pylist() if len(ids) else []):
            # 100 s is to lie between low p and high p: a least and a largest whole score.
            windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
            found, _ = lists.search(asking[j], windows, k, labels != of[j])
            for p, (at, scores) in zip(positives, found):
                out += [(names[j], p["id"], p["score"], i, s) for i, s in zip(ids[at].tolist(), scores.tolist())]
        return _long_table(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _long_table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array([int(v) for v in c], pa.int64()) for n, c in zip(names, columns)})


def integer_rows(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label and vector, floor(scale * x) of every component x, of the rows that take part."""
    whole = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") * scale)
    kept = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), whole.alias("x")
    ).where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    kept = kept.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT)))
    return kept.select("id", "label", F.transform("x", lambda x: F.floor(x)).alias("vector"))


def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, chunks: int):
    """Cogroups of every chunk of anchors and every block of rows."""
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, chunks)]
    # Sides are told apart by names, since they come from one table.
    a = anchors.withColumn("a_chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("a_block", every[0])
    r = rows.withColumn("r_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("r_chunk", every[1])
    return a.groupBy("a_chunk", "a_block").cogroup(r.groupBy("r_chunk", "r_block"))


def hard_negatives(
    rows: DataFrame,
    anchors_where: str,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchors_where`` picks.

    Scores are integer inner products of floor(scale * x). An anchor's positives are the first ``positives`` other
    rows of its label; for each, the first ``negatives`` rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score are returned. Higher scores come first, ties by smaller id.
    ``anchors_where`` is a condition on ``id`` and ``label``.

    Rows take no part with a null id or label, a null vector, or a component that is null, not finite, or 2^28 or
    more once scaled. Of rows that repeat an id the one of least label, then least vector, counts. Vectors that are
    shorter than others count as filled up with zeros. Other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = integer_rows(rows, id_col, label_col, vector_col, scale)
    asking = rows.where(anchors_where).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x"))
    asking = stored(asking.select("id", "x.label", "x.vector"), "anchors")
    n_rows, n_anchors = rows.count(), asking.count()
    blocks = max(1, min(-(-n_rows // BLOCK_ROWS), max(partitions(spark), -(-n_rows // LARGE_BLOCK_ROWS))))
    chunks = max(1, -(-n_anchors // CHUNK_ANCHORS))

    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = _grid(asking, rows, blocks, chunks).applyInArrow(
        _positives(positives), "anchor_id long, positive_id long, positive_score long"
    )
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives)
    pair = F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
    of_anchor = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(pair).alias("positives"))
    asking = stored(asking.join(of_anchor, "id"), "anchors-with-positives")

    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    hard = _grid(asking, rows, blocks, chunks).applyInArrow(
        _negatives(negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    return hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
