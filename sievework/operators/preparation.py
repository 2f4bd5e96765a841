"""Collapse of features and preprocessing that is fitted on training samples only.

``split`` names the columns that identify a split in ``folds``; ``folds`` holds one row per
(split, sample) with ``role``. Features are joined to the folds by sample, so a split is never
gathered: training statistics are grouped sums over (split, feature).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sievework.functions.columns import safe_div
from sievework.functions.ordering import average_ranks, numbered
from sievework.session import cut_lineage, settled


def collapse_max_mean(
    features: DataFrame, probe_map: DataFrame, keys: Sequence[str] = ("dataset",)
) -> DataFrame:
    """Of several probes of a symbol keep the one with the highest mean (first name on ties)."""
    k = list(keys)
    means = (
        features.groupBy(*k, "feature")
        .agg(F.avg("value").alias("_m"))
        .join(probe_map.withColumnRenamed("probe", "feature"), "feature")
    )
    best = means.groupBy(*k, "symbol").agg(
        F.min(F.struct((-F.col("_m")).alias("m"), "feature")).alias("b")
    )
    chosen = best.select(*k, "symbol", F.col("b.feature").alias("feature"))
    return (
        features.join(chosen, [*k, "feature"])
        .withColumnRenamed("feature", "probe")
        .withColumnRenamed("symbol", "feature")
    )


def unmapped_probes(
    features: DataFrame, probe_map: DataFrame, keys: Sequence[str] = ("dataset",)
) -> DataFrame:
    probes = features.select(*keys, F.col("feature").alias("probe")).distinct()
    return (
        probes.join(probe_map.select("probe").distinct(), "probe", "left_anti")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_unmapped"))
    )


def _collapse(features, probe_map, keys, agg) -> DataFrame:
    return (
        features.join(probe_map.withColumnRenamed("probe", "feature"), "feature")
        .groupBy(*keys, "sample_id", F.col("symbol").alias("feature"))
        .agg(agg("value").alias("value"))
    )


def collapse_mean(features, probe_map, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Mean of all probes of a symbol."""
    return _collapse(features, probe_map, keys, F.avg)


def collapse_sum(features, probe_map, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Sum of all probes of a symbol."""
    return _collapse(features, probe_map, keys, F.sum)


def collapse_scores_max(scores: DataFrame, pool: DataFrame) -> DataFrame:
    """Best score of every pool feature over all sources; 0 where there is none."""
    best = scores.groupBy("feature").agg(F.max("score").alias("score"))
    return pool.join(best, "feature", "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def filter_low_count(
    features: DataFrame,
    folds: DataFrame,
    split: list[str],
    min_count: float = 10,
    min_samples: int = 10,
) -> DataFrame:
    """(split, feature) pairs seen at ``min_count`` in enough training samples.

    The number of samples asked for is never more than the training samples there are.
    """
    train = folds.where("role = 'train'")
    n = train.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    enough = (
        features.where(F.col("value") >= min_count)
        .join(train.select(*split, "sample_id"), ["dataset", "sample_id"])
        .groupBy(*split, "feature")
        .agg(F.count(F.lit(1)).alias("n_samples"))
    )
    return (
        enough.join(n, split)
        .where(F.col("n_samples") >= F.least(F.lit(min_samples), F.col("_n")))
        .drop("_n")
    )


def log_cpm(features: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """log2 of counts per million of the sample's total, plus one."""
    on = [*keys, "sample_id"]
    totals = features.groupBy(*on).agg(F.sum("value").alias("_t"))
    return (
        features.join(totals, on)
        .withColumn("value", F.log2(safe_div(F.col("value"), F.col("_t")) * 1e6 + 1))
        .drop("_t")
    )


def reference_sample(features: DataFrame, folds: DataFrame, split: list[str]) -> DataFrame:
    """Training sample whose upper-quartile CPM is nearest to the mean of them all."""
    on = ["dataset", "sample_id"]
    totals = features.groupBy(*on).agg(F.sum("value").alias("_t")).where("_t > 0")
    cpm = features.join(totals, on).withColumn("cpm", F.col("value") / F.col("_t") * 1e6)
    q = cpm.groupBy(*on).agg(F.percentile("cpm", F.lit(0.75)).alias("q"))  # one feature vector
    train = folds.where("role = 'train'").select(*split, "sample_id").join(q, on)
    means = train.groupBy(*split).agg(F.avg("q").alias("mean_q"))
    return (
        train.join(means, split)
        .groupBy(*split, "mean_q")
        .agg(
            F.min(
                F.struct(F.round(F.abs(F.col("q") - F.col("mean_q")), 9).alias("d"), "sample_id")
            ).alias("b")
        )
        .select(*split, F.col("b.sample_id").alias("reference"), "mean_q")
    )


def tmm_factors(
    features: DataFrame,
    folds: DataFrame,
    references: DataFrame,
    split: list[str],
    trim_m: float = 0.3,
    trim_a: float = 0.05,
) -> DataFrame:
    """Trimmed mean of M-values of every sample against the fixed training reference.

    Factors are scaled so that the training samples have geometric mean 1. A held-out sample
    meets only the reference, no other held-out sample.
    """
    on = ["dataset", "sample_id"]
    totals = features.groupBy(*on).agg(F.sum("value").alias("n"))
    x = features.join(totals, on)
    obs = x.join(folds.select(*split, "sample_id", "role"), on)
    ref = (
        x.join(references.withColumnRenamed("reference", "sample_id"), on)
        .select(*split, "feature", F.col("value").alias("r"), F.col("n").alias("nr"))
    )
    pair = obs.join(ref, [*split, "feature"]).where("value > 0 and r > 0")
    po, pr = F.col("value") / F.col("n"), F.col("r") / F.col("nr")
    pair = pair.select(
        *split,
        "sample_id",
        F.log2(po / pr).alias("m"),
        ((F.log2(po) + F.log2(pr)) / 2).alias("a"),
        (
            (F.col("n") - F.col("value")) / F.col("n") / F.col("value")
            + (F.col("nr") - F.col("r")) / F.col("nr") / F.col("r")
        ).alias("v"),
    )
    key = [*split, "sample_id"]
    sizes = pair.groupBy(*key).agg(
        F.count(F.lit(1)).alias("k"), F.max(F.abs("m")).alias("far")
    )
    # equal ratios must tie as they do in exact arithmetic
    pair = pair.withColumn("mr", F.round("m", 9)).withColumn("ar", F.round("a", 9))
    # a group is the feature vector of one sample
    ranked = average_ranks(pair, key, "mr", "rm", bounded=True)
    ranked = average_ranks(ranked, key, "ar", "ra", bounded=True).join(sizes, key)
    low_m, low_a = F.floor(F.col("k") * trim_m) + 1, F.floor(F.col("k") * trim_a) + 1
    kept = ranked.where(
        F.col("rm").between(low_m, F.col("k") + 1 - low_m)
        & F.col("ra").between(low_a, F.col("k") + 1 - low_a)
    )
    mean_m = kept.groupBy(*key).agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("f"))
    raw = (
        folds.select(*split, "sample_id", "role")
        .join(sizes, key, "left")
        .join(mean_m, key, "left")
        .withColumn(
            "raw", F.when(F.col("far") < 1e-6, 0.0).otherwise(F.coalesce("f", F.lit(0.0)))
        )
    )
    centre = raw.where("role = 'train'").groupBy(*split).agg(F.avg("raw").alias("c"))
    return raw.join(centre, split).select(
        *split, "sample_id", "role", F.pow(F.lit(2.0), F.col("raw") - F.col("c")).alias("factor")
    )


def normalised_log_cpm(
    features: DataFrame,
    factors: DataFrame,
    references: DataFrame,
    split: list[str],
    prior: float = 1.0,
) -> DataFrame:
    """log2 CPM with effective library sizes and a prior count scaled to the library.

    The prior of training samples is scaled by the mean training library, that of a held-out
    sample by the mean of its own and the reference library. Zero counts must be rows.
    """
    on = ["dataset", "sample_id"]
    totals = features.groupBy(*on).agg(F.sum("value").alias("_t"))
    lib = factors.join(totals, on).withColumn("lib", F.col("_t") * F.col("factor")).drop("_t")
    train_mean = lib.where("role = 'train'").groupBy(*split).agg(F.avg("lib").alias("train_lib"))
    ref = lib.join(
        references.select(*split, F.col("reference").alias("sample_id")), [*split, "sample_id"]
    ).select(*split, F.col("lib").alias("ref_lib"))
    sized = lib.join(train_mean, split).join(ref, split)
    scale = F.when(F.col("role") == "train", F.col("train_lib")).otherwise(
        (F.col("lib") + F.col("ref_lib")) / 2
    )
    sized = sized.withColumn("_p", F.col("lib") / scale * prior)
    return features.join(sized, on).select(
        *split,
        "sample_id",
        "role",
        "feature",
        F.log2((F.col("value") + F.col("_p")) / (F.col("lib") + 2 * F.col("_p")) * 1e6).alias("value"),
    )


def train_variance(features: DataFrame, folds: DataFrame, split: list[str]) -> DataFrame:
    train = folds.where("role = 'train'").select(*split, "sample_id")
    return (
        features.join(train, ["dataset", "sample_id"])
        .groupBy(*split, "feature")
        .agg(F.var_samp("value").alias("variance"))
        .where("variance > 0")
    )


def make_pools(
    features: DataFrame,
    folds: DataFrame,
    split: list[str],
    annotated: DataFrame,
    top: int = 2000,
    bounded: bool = False,
) -> DataFrame:
    """Three pools by training variance: ``variance`` (the top N), ``annotated`` (all annotated
    features that vary) and ``size_control`` (as many top features as there are annotated ones)."""
    v = train_variance(features, folds, split)
    ranked = numbered(v, split, "variance", "feature", "position", bounded=bounded)
    marked = ranked.join(
        annotated.select("feature", F.lit(1).alias("_a")).distinct(), "feature", "left"
    )
    size = marked.groupBy(*split).agg(F.count("_a").alias("n_annotated"))
    pools = marked.join(size, split).withColumn(
        "pool",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("position") <= top, F.lit("variance")),
                    F.when(F.col("_a") == 1, F.lit("annotated")),
                    F.when(F.col("position") <= F.col("n_annotated"), F.lit("size_control")),
                )
            )
        ),
    )
    return pools.select(*split, "pool", "feature", "position", "variance")


def standardise(features: DataFrame, folds: DataFrame, split: list[str]) -> DataFrame:
    """z-scores with the mean and sd of the training samples; sd 0 or NULL counts as 1."""
    on = ["dataset", "sample_id"]
    placed = features.join(folds.select(*split, "sample_id", "role"), on)
    train = F.when(F.col("role") == "train", F.col("value"))
    stats = placed.groupBy(*split, "feature").agg(
        F.avg(train).alias("_m"), F.stddev_samp(train).alias("_s")
    )
    sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    # Written first and offered for broadcast: else every value of every split is shuffled once more to meet them.
    return placed.join(settled(stats), [*split, "feature"]).select(
        *split, "sample_id", "role", "feature", ((F.col("value") - F.col("_m")) / sd).alias("value")
    )


def _level(col: str) -> Column:
    c = F.col(col).cast("string")
    return F.when(c.isNull() | (c == ""), "NA_level").otherwise(c)


def residualise_one(
    features: DataFrame, samples: DataFrame, folds: DataFrame, split: list[str], confounder: str
) -> DataFrame:
    """Remove one categorical confounder: value minus the training mean of its level.

    That is the residual of an intercept-and-dummies fit. A level unseen in training counts as
    the reference (first) level; blanks form a level of their own.
    """
    on = ["dataset", "sample_id"]
    levels = folds.join(samples.select(*on, _level(confounder).alias("_l")), on)
    known = levels.where("role = 'train'").select(*split, "_l").distinct()
    reference = known.groupBy(*split).agg(F.min("_l").alias("_ref"))
    placed = (
        levels.join(known.withColumn("_known", F.lit(True)), [*split, "_l"], "left")
        .join(reference, split)
        .withColumn("_l", F.when(F.col("_known"), F.col("_l")).otherwise(F.col("_ref")))
        .select(*split, "sample_id", "role", "_l")
    )
    x = features.join(placed, on)
    means = (
        x.where("role = 'train'").groupBy(*split, "feature", "_l").agg(F.avg("value").alias("_m"))
    )
    return x.join(means, [*split, "feature", "_l"]).select(
        *split, "sample_id", "role", "feature", (F.col("value") - F.col("_m")).alias("value")
    )


def normal_solver(xtx: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """The matrix that turns X'y into least-squares coefficients; a column that earlier ones explain gets 0.

    One pass of elimination in column order: what is left of a column's square after the kept ones decides.
    """
    d = len(xtx)
    rest, kept = xtx.astype(float).copy(), []
    for j in range(d):
        if rest[j, j] > tol * max(xtx[j, j], 1.0):
            kept.append(j)
            rest -= np.outer(rest[:, j], rest[j]) / rest[j, j]
    out = np.zeros((d, d))
    if kept:
        out[np.ix_(kept, kept)] = np.linalg.inv(xtx[np.ix_(kept, kept)])
    return out


def residualise(
    features: DataFrame,
    samples: DataFrame,
    folds: DataFrame,
    split: list[str],
    confounders: Sequence[str],
) -> DataFrame:
    """Remove several categorical confounders by an intercept-and-dummies fit on training samples.

    The design is kept sparse: a sample has one entry per confounder. Cross products are grouped
    sums; each (split, feature) solves its own d x d system inside an Arrow batch, where d is the
    number of levels.
    """
    on = ["dataset", "sample_id"]
    levels = folds.join(
        samples.select(*on, *[_level(c).alias(f"_l{i}") for i, c in enumerate(confounders)]), on
    )
    entries = F.array(
        F.lit("0"), *[F.concat(F.lit(f"{i + 1}:"), F.col(f"_l{i}")) for i in range(len(confounders))]
    )
    rows = levels.select(*split, "sample_id", "role", F.explode(entries).alias("col"))
    # columns of the design: the intercept and every training level but the first of its confounder
    train_cols = rows.where("role = 'train'").select(*split, "col").distinct()
    w = Window.partitionBy(*split, F.split("col", ":")[0]).orderBy("col")  # levels of one confounder
    columns = train_cols.withColumn("_i", F.row_number().over(w)).where("_i > 1 or col = '0'").drop("_i")
    design = rows.join(columns, [*split, "col"])
    train = design.where("role = 'train'").drop("role")
    cross = (
        train.join(train.withColumnRenamed("col", "col2"), [*split, "sample_id"])
        .groupBy(*split, "col", "col2")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    xtx = cross.groupBy(*split).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\t", "col", "col2"), "n"))).alias("xtx")
    )
    columns_of = columns.groupBy(*split).agg(F.array_sort(F.collect_list("col")).alias("cols"))
    flat = F.flatten(
        F.transform(
            "cols",
            lambda a: F.transform(
                "cols",
                lambda b: F.coalesce(F.try_element_at("xtx", F.concat_ws("\t", a, b)), F.lit(0.0)),
            ),
        )
    )
    systems = xtx.join(columns_of, split).select(*split, "cols", flat.alias("xtx"))
    kept = [f for f in systems.schema.fields if f.name not in ("cols", "xtx")]

    def invert(batches):
        for b in batches:
            solvers = [normal_solver(np.asarray(m, float).reshape(len(c), len(c))) for m, c in zip(b["xtx"], b["cols"])]
            yield b.drop(columns=["xtx"]).assign(solver=[list(s.ravel()) for s in solvers])

    schema = StructType([*kept, systems.schema["cols"], StructField("solver", ArrayType(DoubleType()))])
    # One factorisation a split; the coefficients of a feature are its product with the feature's sums.
    solvers = cut_lineage(systems.mapInPandas(invert, schema))
    sums = features.join(train, on).groupBy(*split, "feature", "col").agg(F.sum("value").alias("s"))
    terms = sums.join(
        solvers.select(*split, "cols", "solver", F.posexplode("cols").alias("at", "col")), [*split, "col"]
    ).select(
        *split, "feature", "s", F.posexplode("cols").alias("to", "out"), "solver", "at", F.size("cols").alias("d")
    )
    coefs = (
        terms.groupBy(*split, "feature", "out")
        .agg(F.sum(F.col("s") * F.element_at("solver", F.col("to") * F.col("d") + F.col("at") + 1)).alias("coef"))
        .groupBy(*split, "feature")
        .agg(F.map_from_entries(F.collect_list(F.struct("out", "coef"))).alias("coef"))
    )
    fitted = coefs
    per_sample = design.groupBy(*split, "sample_id", "role").agg(F.collect_list("col").alias("cols"))
    fit = F.aggregate("cols", F.lit(0.0), lambda s, c: s + F.col("coef")[c])
    return (
        features.join(per_sample, on)
        .join(fitted, [*split, "feature"])
        .select(*split, "sample_id", "role", "feature", (F.col("value") - fit).alias("value"))
    )
