"""Correlations of features from cross products of blocks.

A split's matrix is cut into pieces, a run of features by a share of the samples each. Two pieces of the
same samples are multiplied in one task, and the products of a pair of feature blocks are summed over the
shares; a task holds two pieces and one product, however many features there are. Values are centred
first, so large means cost no digits. Only the correlations above a limit leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from sievework.session import cut_lineage

#: Features of a block and samples of a piece.
BLOCK = 512
PIECE_SAMPLES = 1024
#: Products that a task holds before it sends their sums.
HELD = 16
#: Less than this share of the sum of squares is rounding: a constant feature, whatever its unit.
ROUNDING = 1e-13


def feature_index(features: DataFrame, keys: list[str]) -> DataFrame:
    """Position 0.. of every feature of a split by name."""
    w = Window.partitionBy(*keys).orderBy("feature")
    pool = features.select(*keys, "feature").distinct()
    return pool.withColumn("idx", F.row_number().over(w) - 1)


def sample_vectors(features: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, sample_id, x``: the values of a sample in index order; every cell must exist."""
    n = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("_p"))
    rows = (
        features.join(index, [*keys, "feature"])
        .groupBy(*keys, "sample_id")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_x"))
        .join(F.broadcast(n), keys)  # one row a split
    )
    incomplete = F.raise_error(F.lit("a sample does not have every feature of its pool"))
    return rows.select(
        *keys,
        "sample_id",
        F.when(F.size("_x") == F.col("_p"), F.col("_x.value")).otherwise(
            incomplete.cast("array<double>")
        ).alias("x"),
    )


def stacked(rows: pa.ChunkedArray, place: np.ndarray) -> np.ndarray:
    """Vectors as rows of a matrix, each at its ``place``; NULL ones have none. No list becomes an object of its own."""
    out, lo = None, 0
    for chunk in rows.chunks:
        values = chunk.flatten().to_numpy(zero_copy_only=False)
        there = chunk.is_valid().to_numpy(zero_copy_only=False)
        if there.any():
            if out is None:
                out = np.empty((int(place.max()) + 1, len(values) // int(there.sum())))
            if not pc.all(pc.equal(pc.list_value_length(chunk), out.shape[1])).as_py():
                raise ValueError("a sample does not have every feature of its pool")
            out[place[lo : lo + len(chunk)][there]] = values.reshape(-1, out.shape[1])
        lo += len(chunk)
    return out


def pieces(features: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """keys, piece, block, ids, x, raw: centred values of a block's features in a share of the samples.

    ``x`` is samples x features in order of sample and index, ``raw`` the sums of the squared uncentred values.
    """
    on = [*keys, "feature"]
    means = features.groupBy(*on).agg(F.avg("value").alias("_m"))
    per_split = F.ceil(F.count_distinct("sample_id") / PIECE_SAMPLES).alias("_pieces")
    shares = features.groupBy(*keys).agg(per_split)
    cells = (
        features.join(index.join(means, on), on)
        .join(shares, keys)
        .select(
            *keys,
            F.pmod(F.xxhash64("sample_id"), F.col("_pieces")).alias("piece"),
            F.floor(F.col("idx") / BLOCK).cast("int").alias("block"),
            F.struct(F.xxhash64("sample_id").alias("s"), "idx", (F.col("value") - F.col("_m")).alias("v"), "_m").alias("c"),
        )
    )
    grouped = cells.groupBy(*keys, "piece", "block").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return grouped.select(
        *keys, "piece", "block", F.col("c.s").alias("s"), F.col("c.idx").alias("i"), F.col("c.v").alias("v"), F.col("c._m").alias("m")
    )


def piece_matrix(samples: np.ndarray, i: np.ndarray, v: np.ndarray, m: np.ndarray):
    """Samples, first index, centred matrix and raw sums of squares of a piece; every cell must exist once."""
    ids, first = np.unique(samples, return_index=True)
    width = int(i.max()) - int(i.min()) + 1
    if len(v) != len(ids) * width:
        raise ValueError("a sample does not have every feature of its pool, or has one twice")
    x = np.asarray(v, float).reshape(len(ids), width)
    raw = ((x + np.asarray(m, float)[:width]) ** 2).sum(0)
    return ids, int(i.min()), x, raw


def _products(keys: list[str]):
    """Sums over pieces of x_i' x_j, and of the squares on either side, for pairs of blocks."""

    def run(batches):
        held: dict[tuple, list] = {}

        def rows():
            for (key, i, j), (n, *parts) in held.items():
                yield dict(zip(keys, key)) | {
                    "i": i, "j": j, "n": n, **{k: p.tobytes() for k, p in zip(("xy", "si", "sj", "ri", "rj"), parts)}
                }
            held.clear()

        for batch in batches:
            for r in batch.itertuples(index=False):
                a_ids, i, a, a_raw = piece_matrix(r.s, r.i, r.v, r.m)
                b_ids, j, b, b_raw = (a_ids, i, a, a_raw) if r.block == r.block2 else piece_matrix(r.s2, r.i2, r.v2, r.m2)
                if not np.array_equal(a_ids, b_ids):
                    raise ValueError("a sample does not have every feature of its pool")
                parts = [len(a), a.T @ b, (a * a).sum(0), (b * b).sum(0), a_raw, b_raw]
                at = (tuple(getattr(r, k) for k in keys), i, j)
                held[at] = [x + y for x, y in zip(held[at], parts)] if at in held else parts
                if len(held) >= HELD:
                    yield pd.DataFrame(list(rows()))
        if held:
            yield pd.DataFrame(list(rows()))

    return run


def _strong(keys: list[str], above: float, strict: bool):
    """Index pairs of two blocks whose correlation is above the limit, from all their partial sums."""

    def run(key, parts):
        def total(name):
            return sum(np.frombuffer(b) for b in parts[name])

        si, sj = total("si"), total("sj")
        varies_i, varies_j = si > ROUNDING * total("ri"), sj > ROUNDING * total("rj")
        scale = np.sqrt(np.outer(np.where(varies_i, si, np.nan), np.where(varies_j, sj, np.nan)))
        r = total("xy").reshape(len(si), len(sj)) / scale
        i, j = key[-2], key[-1]
        if i == j:
            r[np.tril_indices(len(si))] = np.nan
        with np.errstate(invalid="ignore"):
            a, b = np.nonzero(np.abs(r) > above if strict else np.abs(r) >= above)
        out = pd.DataFrame({"i": i + a, "j": j + b, "r": r[a, b]})
        for k, v in zip(keys, key):
            out[k] = pd.Series([v] * len(out), dtype=object)
        return out

    return run


def correlation_edges(
    features: DataFrame, keys: list[str], above: float = 0.0, strict: bool = True
) -> DataFrame:
    """Pairs ``feature_a < feature_b`` with |r| above a limit; constant features have no pair.

    Every sample needs every feature of its split once. Pools may have any number of features.
    """
    index = cut_lineage(feature_index(features, keys))
    parts = cut_lineage(pieces(features, index, keys))
    other = parts.select(*keys, "piece", *[F.col(c).alias(f"{c}2") for c in ("block", "s", "i", "v", "m")])
    pairs = parts.join(other, [*keys, "piece"]).where("block <= block2")
    fields = [parts.schema[k] for k in keys]
    numbers = [StructField("i", IntegerType()), StructField("j", IntegerType())]
    sums = [StructField("n", LongType()), *[StructField(c, BinaryType()) for c in ("xy", "si", "sj", "ri", "rj")]]
    products = pairs.mapInPandas(_products(keys), StructType([*fields, *numbers, *sums]))
    found = products.groupBy(*keys, "i", "j").applyInPandas(
        _strong(keys, above, strict), StructType([*numbers, StructField("r", DoubleType()), *fields])
    )
    a = index.select(*keys, F.col("idx").alias("i"), F.col("feature").alias("feature_a"))
    b = index.select(*keys, F.col("idx").alias("j"), F.col("feature").alias("feature_b"))
    return found.join(a, [*keys, "i"]).join(b, [*keys, "j"]).select(*keys, "feature_a", "feature_b", "r")


def redundancy_filter(
    rankings: DataFrame, features: DataFrame, keys: list[str], tau: float = 0.7
) -> DataFrame:
    """Walk the ranking and skip a feature that correlates above tau with a picked one.

    Skipped features follow the picked ones in their old order. The walk picks the
    lexicographically first independent set, found in rounds: a feature with no undecided better
    neighbour is picked, and its worse neighbours are skipped. Each round decides the best
    undecided feature of every cluster at least; only the shrinking edge table is carried over.
    """
    links = correlation_edges(features, keys, tau)
    place = rankings.select(*keys, "feature", "rank")
    edges = (
        links.join(place.withColumnRenamed("feature", "feature_a").withColumnRenamed("rank", "ra"),
                   [*keys, "feature_a"])
        .join(place.withColumnRenamed("feature", "feature_b").withColumnRenamed("rank", "rb"),
              [*keys, "feature_b"])
        .select(
            *keys,
            F.when(F.col("ra") < F.col("rb"), F.col("feature_a")).otherwise(F.col("feature_b")).alias("better"),
            F.when(F.col("ra") < F.col("rb"), F.col("feature_b")).otherwise(F.col("feature_a")).alias("worse"),
        )
    )
    edges = cut_lineage(edges)
    skipped = []
    while not edges.isEmpty():
        blocked = edges.select(*keys, F.col("worse").alias("better")).distinct()
        won = edges.join(blocked, [*keys, "better"], "left_anti")
        out = cut_lineage(won.select(*keys, F.col("worse").alias("feature")).distinct())
        skipped.append(out)
        done = won.select(*keys, "better").distinct()
        edges = cut_lineage(
            edges.join(done, [*keys, "better"], "left_anti")
            .join(out.withColumnRenamed("feature", "better"), [*keys, "better"], "left_anti")
            .join(out.withColumnRenamed("feature", "worse"), [*keys, "worse"], "left_anti")
        )
    marked = rankings
    if skipped:
        gone = skipped[0]
        for s in skipped[1:]:
            gone = gone.unionByName(s)
        marked = rankings.join(
            gone.distinct().withColumn("redundant", F.lit(True)), [*keys, "feature"], "left"
        )
    else:
        marked = rankings.withColumn("redundant", F.lit(None).cast("boolean"))
    w = Window.partitionBy(*keys).orderBy("redundant", "_old")  # one pool, limited in size
    return (
        marked.withColumn("redundant", F.coalesce("redundant", F.lit(False)))
        .withColumnRenamed("rank", "_old")
        .withColumn("rank", F.row_number().over(w))
        .drop("_old")
    )


def data_modules(
    features: DataFrame, keys: list[str], tau: float = 0.5, smallest: int = 10, largest: int = 200
) -> DataFrame:
    """Connected components of |r| >= tau with a size in range: ``keys, set_id, feature``.

    Every feature takes the least label among itself and its neighbours until nothing changes.
    """
    links = correlation_edges(features, keys, tau, strict=False)
    both = links.select(*keys, F.col("feature_a").alias("a"), F.col("feature_b").alias("b"))
    both = cut_lineage(both.unionByName(both.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = both.select(*keys, "a").distinct().withColumn("label", F.col("a"))
    while True:
        seen = both.join(labels.withColumnRenamed("a", "b"), [*keys, "b"]).groupBy(*keys, "a").agg(
            F.min("label").alias("_l")
        )
        moved = labels.join(seen, [*keys, "a"]).select(
            *keys, "a", F.least("label", "_l").alias("label"), (F.col("_l") < F.col("label")).alias("_m")
        )
        # follow the label's own label as well, which halves long chains
        jump = moved.select(*keys, F.col("a").alias("label"), F.col("label").alias("_up"))
        moved = moved.join(jump, [*keys, "label"], "left").select(
            *keys,
            "a",
            F.least("label", F.coalesce("_up", "label")).alias("label"),
            (F.col("_m") | F.coalesce(F.col("_up") < F.col("label"), F.lit(False))).alias("_m"),
        )
        moved = cut_lineage(moved)
        labels = moved.drop("_m")
        if moved.where("_m").isEmpty():
            break
    sizes = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    kept = sizes.where(F.col("n").between(smallest, largest))
    return labels.join(kept, [*keys, "label"]).select(
        *keys, F.col("label").alias("set_id"), F.col("a").alias("feature"), F.col("n").alias("set_size")
    )
