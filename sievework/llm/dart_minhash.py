"""Near-duplicates by DartMinHash signatures, banded joins and exact verification.

Every element (a word shingle) owns a plane of weight and rank, cut into regions that double in width
and height. A hash of element and region says how many darts fall there (a Poisson number of the region's
area) and where. A text keeps the darts below its weights and below a rank limit that shrinks with its
total weight, so about ``k ln k + 2k`` darts are thrown whatever its length; each dart has a coordinate,
and the earliest of each coordinate makes the signature. Two signatures agree at a coordinate with the
weighted Jaccard similarity of the texts as probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import byte_buffer, plain, releasing, row_chunks, stored, text_column
from sievework.llm.components import components
from sievework.llm.hashing import distinct, mix, seeded, shingles, word_hashes

_U = np.uint64
_RANK0 = 1 / 8


def _poisson_cdf(area: float) -> np.ndarray:
    """Cumulative Poisson probabilities up to where they reach 1 in double precision."""
    top = int(area + 12 * math.sqrt(area) + 24)
    k = np.arange(top + 1)
    logs = k * math.log(area) - area - np.cumsum(np.r_[0.0, np.log(np.arange(1, top + 1))])
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(float) / float(1 << 53)


class DartSketch:
    """Signatures of ``k`` coordinates for many weighted sets at once."""

    def __init__(self, k: int, seed: int = 7):
        self.k = k
        self.salts = seeded(seed, 2)
        self.by_weight, self.by_rank = seeded(seed + 1, 64), seeded(seed + 2, 128)
        self.darts = k * math.log(k) + 2 * k

    def signatures(self, element: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """An n x k array of ranks; sets without elements have infinite ranks."""
        total = np.bincount(owner, weight, n)
        out = np.full((n, self.k), np.inf)
        todo = np.flatnonzero(total > 0)
        limit = np.zeros(n)
        limit[todo] = self.darts / total[todo]
        while len(todo):
            wanted = np.zeros(n, bool)
            wanted[todo] = True
            use = wanted[owner]
            self._throw(element[use], owner[use], weight[use], limit, out)
            todo = todo[np.isinf(out[todo]).any(axis=1)]
            limit[todo] *= 2
        return out

    def _throw(self, element, owner, weight, limit, out) -> None:
        flat, k = out.reshape(-1), _U(self.k)
        lo_w, width, nu = 0.0, 1.0, 0
        while len(element) and lo_w < weight.max():
            some = weight > lo_w
            e, o, w = element[some], owner[some], weight[some]
            lo_r, height, rho = 0.0, _RANK0, 0
            while len(e):
                region = mix(mix(e ^ self.by_weight[nu]) ^ self.by_rank[rho])
                count = np.searchsorted(_poisson_cdf(width * height), _unit(region), "right")
                total = int(count.sum())
                if total:
                    at = np.repeat(np.arange(len(e)), count)
                    nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                    dart = mix(region[at] + self.salts[:1] * (nth + 1).astype(_U))
                    rank = lo_r + height * _unit(dart)
                    place = mix(dart ^ self.salts[1])
                    hit = rank < limit[o[at]]
                    if nu or w.min() < 1:
                        hit &= lo_w + width * _unit(mix(place ^ self.by_weight[nu])) < w[at]
                    at, rank, place = at[hit], rank[hit], place[hit]
                    np.minimum.at(flat, o[at] * self.k + (place % k).astype(np.int64), rank)
                lo_r, height, rho = lo_r + height, height * 2, rho + 1
                more = limit[o] > lo_r
                e, o, w = e[more], o[more], w[more]
            lo_w, width, nu = lo_w + width, width * 2, nu + 1


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    n, k = signatures.shape
    bands = k // rows
    bits = signatures[:, : bands * rows].copy().view(_U).reshape(n, bands, rows)
    salt = seeded(41, rows)
    total = np.zeros((n, bands), _U)
    for j in range(rows):
        total += mix(bits[:, :, j]) * salt[j]
    return mix(total + seeded(43, bands))


def weighted_shingles(texts: pa.Array, size: int, counts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their text and weight (occurrences, or 1)."""
    h, d, c = distinct(*shingles(*word_hashes(*byte_buffer(texts)), size))
    return h, d, c if counts else np.ones(len(h), np.int64)


def _sketch(size: int, counts: bool, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        darts, salt = DartSketch(bands * rows), seeded(47, 2)
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi in row_chunks(texts):
                n = hi - lo
                h, d, w = weighted_shingles(texts.slice(lo, n), size, counts)
                keys = []
                for s in salt:
                    sums, term = np.zeros(n, _U), mix(h ^ s) * (2 * w - 1).astype(_U)
                    np.add.at(sums, d, term)
                    keys.append(sums.view(np.int64))
                bucket = band_keys(darts.signatures(h, d, w.astype(float), n), rows).view(np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(bucket.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array(keys[0]),
                        pa.array(keys[1]),
                        pa.array(np.bincount(d, w, n).astype(np.int64)),
                        lists,
                    ],
                    names=["doc_id", "key1", "key2", "weight", "bands"],
                )

    return run


def _sets(size: int, counts: bool):
    """Rows (node, members): the shingles of each text, the n-th of equal ones as an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi in row_chunks(texts):
                h, d, w = weighted_shingles(texts.slice(lo, hi - lo), size, counts)
                nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                members = np.where(nth == 0, np.repeat(h, w), mix(np.repeat(h, w) + nth.astype(_U)))
                cut = np.searchsorted(np.repeat(d, w), np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(members.view(np.int64))),
                    ],
                    names=["node", "members"],
                )

    return run


def _similarity(x: str, y: str) -> Column:
    """Weighted Jaccard similarity of two member arrays."""
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact similarity of the pairs (a, b)."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("m1"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("m2"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", _similarity("m1", "m2").alias("sim"))


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    size: int = 5,
    counts: bool = False,
    bands: int = 36,
    rows: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, class_id) of every document: classes are joined by links of ``threshold`` or more.

    Similarity is Jaccard on distinct shingles of ``size`` words (``counts``: weighted by how often each
    occurs). ``class_id`` is the least document id of the class. Texts with equal shingles are one node.
    A pair at the threshold shares a band but for ``(1 - threshold**rows)**bands`` (2e-5).

    Within a band's bucket each node is compared with the bucket's centre first, the node that meets most
    others in all its buckets; what that joins needs no more comparing. Where a bucket still holds several components, nodes outside its largest one are compared
    with nodes of other components, unless their distances to the centre differ by more than
    ``1 - threshold`` (Jaccard distance is a metric) or their sizes rule it out. No link inside a shared
    bucket is lost that way, and large groups of copies cost one comparison a member.

    Fewer than ``size`` words make one shingle of all words. Null and empty texts are alone in their class.
    Rows with a null id have no result; rows repeating an id and text give one row, one id with several
    texts joins their classes. Other columns are not read. An empty table gives an empty result.
    """
    texts = plain(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string").where("doc_id is not null")
    sketch = stored(
        texts.mapInArrow(
            releasing(_sketch(size, counts, bands, rows)),
            "doc_id long, key1 long, key2 long, weight long, bands array<long>",
        ),
        "darts",
    )
    wordy = sketch.where("weight > 0")
    nodes = wordy.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"))
    members = wordy.select("doc_id", "key1", "key2").distinct().join(nodes, ["key1", "key2"])
    copies = members.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).where("a != b")

    # The row that named a node brings its bands; equal rows of it fall together in distinct().
    named = wordy.join(nodes.withColumnRenamed("node", "doc_id"), ["key1", "key2", "doc_id"])
    spread = named.select(F.col("doc_id").alias("node"), "weight", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(
        F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")
    )
    crowded = stored(spread.join(buckets.where("least < most").select("bucket", "n"), "bucket").distinct(), "buckets")
    # The text that others were made from shares buckets with most of them: it is the centre of its buckets.
    crowd = crowded.groupBy("node").agg(F.sum("n").alias("crowd"))
    chosen = crowded.join(crowd, "node").groupBy("bucket").agg(
        F.max(F.struct("crowd", (-F.col("node")).alias("minus"))).alias("top")
    )
    shared = stored(
        crowded.join(chosen.select("bucket", (-F.col("top.minus")).alias("centre")), "bucket").drop("n"), "centres"
    )

    pairs = (
        shared.where("node != centre")
        .select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
        .distinct()
    )
    ids = shared.select(F.col("node").alias("doc_id")).distinct()
    wanted = texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = stored(wanted.mapInArrow(releasing(_sets(size, counts)), "node long, members array<long>"), "sets")
    first = stored(_verified(pairs, sets), "stars")

    # Repeated ids with other texts can give a pair twice; the closest counts.
    near = first.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    links = near.where(F.col("sim") >= threshold).select("a", "b")
    label = stored(components(links), "labels")

    placed = (
        shared.join(label, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumns({"a": F.least("centre", "node"), "b": F.greatest("centre", "node")})
        .join(near, ["a", "b"], "left")
        .withColumn("away", F.when(F.col("node") == F.col("centre"), 0.0).otherwise(1 - F.col("sim")))
        .drop("sim", "a", "b")
    )
    mixed = (
        placed.groupBy("bucket", "component")
        .agg(F.count("*").alias("n"))
        .groupBy("bucket")
        .agg(F.count("*").alias("kinds"), F.max(F.struct("n", "component")).alias("top"))
        .where("kinds > 1")
        .select("bucket", F.col("top.component").alias("main"))
    )
    # Compared inside the join, so that pairs that are no links are not rows.
    rest = placed.join(mixed, "bucket").where("node != centre").join(sets, "node")
    x, y = rest.where("component != main").alias("x"), rest.alias("y")
    second = (
        x.join(y, F.col("x.bucket") == F.col("y.bucket"))
        .where(
            (F.col("x.component") != F.col("y.component"))
            & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
            & (F.abs(F.col("x.away") - F.col("y.away")) <= 1 - threshold + 1e-9)
            & (F.least("x.weight", "y.weight") >= threshold * F.greatest("x.weight", "y.weight") - 1e-9)
            & (_similarity("x.members", "y.members") >= threshold)
        )
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    )
    classes = components(links.union(second).union(copies))
    everyone = texts.select("doc_id").distinct()
    return everyone.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id")
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id names its class (and rows without an id): one document of each class."""
    dropped = near_duplicates(docs, **options).where("doc_id != class_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")
