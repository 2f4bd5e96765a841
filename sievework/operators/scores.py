"""Univariate scores of features, multiple-testing correction and rank transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.columns import hash_order, no_nan, safe_div
from sievework.functions.ordering import (
    average_ranks,
    dealt,
    fits_one_task,
    numbered,
    order_cuts,
    running,
)
from sievework.functions.special import t_pvalue


def class_stats(df: DataFrame, keys: list[str], label: str = "label", value: str = "value"):
    """Size, mean and variance of ``value`` in both classes, in one aggregation."""
    one, zero = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    return df.groupBy(*keys).agg(
        F.count(one).alias("n1"),
        F.count(zero).alias("n0"),
        F.avg(one).alias("m1"),
        F.avg(zero).alias("m0"),
        F.var_samp(one).alias("v1"),
        F.var_samp(zero).alias("v0"),
    )


def pooled_t(df: DataFrame, keys: list[str]) -> DataFrame:
    """Equal-variance two-sample t; NULL where the pooled variance is zero."""
    s = class_stats(df, keys)
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (
        F.nullif(F.col("n1") + F.col("n0") - 2, F.lit(0))
    )
    return s.withColumn(
        "t",
        F.when(
            pooled > 0,
            (F.col("m1") - F.col("m0"))
            / (F.sqrt(pooled) * F.sqrt(1 / F.col("n1") + 1 / F.col("n0"))),
        ),
    )


def welch_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unequal-variance t and its degrees of freedom; NULL where the test is not defined."""
    s = class_stats(df, keys)
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    ok = (F.col("n1") > 1) & (F.col("n0") > 1) & (a + b > 0)
    return s.withColumn(
        "t", F.when(ok, (F.col("m1") - F.col("m0")) / F.sqrt(a + b))
    ).withColumn(
        "df",
        F.when(
            ok,
            (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1)),
        ),
    )


def welch_rank(df: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Rank by -log10(p) * |t|; ``selected`` where the adjusted p is below ``alpha``."""
    w = welch_statistics(df, [*keys, "feature"])
    w = w.withColumn("p", F.coalesce(t_pvalue(F.col("t"), F.col("df")), F.lit(1.0)))
    w = w.withColumn(
        "score",
        F.coalesce(-F.log10(F.greatest("p", F.lit(1e-300))) * F.abs("t"), F.lit(0.0)),
    )
    small = fits_one_task(df.select(*keys, "feature").distinct())
    adjusted = bh_adjust(w, keys, "p", "q", bounded=small)
    return numbered(
        adjusted.withColumn("selected", F.col("q") < alpha),
        keys,
        "score",
        "feature",
        bounded=small,
    )


def bh_adjust(
    df: DataFrame, keys: list[str], p: str = "p", name: str = "q", bounded: bool = False
) -> DataFrame:
    """Benjamini-Hochberg; NULL p stays NULL and does not count.

    Works on distinct p-values: with c(p) values at or below p and n in all, the adjusted value is
    the least p' * n / c(p') over p' >= p.
    """
    distinct = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(
        F.count(F.lit(1)).alias("_ties")
    )
    sizes = df.groupBy(*keys).agg(F.count(p).alias("_m"))
    cuts = [] if bounded else order_cuts(distinct, p, None)
    steps = running(distinct, keys, p, ["_ties"], cuts=cuts).join(sizes, keys)
    steps = steps.withColumn(
        "_raw", F.col(p) * F.col("_m") / (F.col("before__ties") + F.col("_ties"))
    )
    best = running(steps, keys, p, ["_raw"], descending=True, how="min", cuts=cuts)
    best = best.select(*keys, p, F.least(F.lit(1.0), "least__raw").alias(name))
    return df.join(best, [*keys, p], "left")


def auc_score(
    df: DataFrame,
    keys: list[str],
    label: str = "label",
    score: str = "score",
    bounded: bool = False,
) -> DataFrame:
    """Rank-sum AUC with average ties and no automatic direction; NULL with one class only.

    Equal scores are counted per class first, so the ordered table has one row per distinct score.
    """
    per_score = (
        df.where(no_nan(F.col(score)).isNotNull())
        .groupBy(*keys, score)
        .agg(
            F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
            F.count(F.when(F.col(label) == 0, 1)).alias("neg"),
        )
    )
    ordered = running(per_score, keys, score, ["neg"], bounded=bounded)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    return ordered.groupBy(*keys).agg(
        safe_div(wins, F.sum("pos") * F.sum("neg")).alias("auc"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )


def univariate_auc_rank(df: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """Rank features by |AUC - 0.5|; a feature without an AUC scores 0."""
    scored = auc_score(df, [*keys, "feature"], score="value", bounded=bounded).withColumn(
        "score", F.coalesce(F.abs(F.col("auc") - 0.5), F.lit(0.0))
    )
    return numbered(scored, keys, "score", "feature", bounded=bounded)


def equal_bins(
    df: DataFrame,
    keys: list[str],
    value: str,
    tie: str,
    bins: int,
    min_rows: int = 1,
    bounded: bool = False,
) -> DataFrame:
    """Equal-frequency bin 1..bins; the first n mod bins bins hold one row more.

    Fewer bins are used where a bin would have under ``min_rows`` rows.
    """
    placed = numbered(df, keys, value, tie, "_rn", descending=False, bounded=bounded)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bins = F.greatest(F.least(F.lit(bins), F.floor(F.col("_n") / min_rows)), F.lit(1))
    small = F.floor(F.col("_n") / bins)
    extra = F.col("_n") % bins
    big_rows = extra * (small + 1)
    return (
        placed.join(sizes, keys)
        .withColumn(
            "bin",
            F.when(F.col("_rn") <= big_rows, F.ceil(F.col("_rn") / (small + 1)))
            .otherwise(extra + F.ceil((F.col("_rn") - big_rows) / F.greatest(small, F.lit(1))))
            .cast("int"),
        )
        .drop("_rn", "_n")
    )


def mutual_information(
    df: DataFrame,
    keys: list[str],
    bins: int = 5,
    resample: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Plug-in mutual information (nats) of binned value and label, averaged over resamples."""
    group = [*keys, *([resample] if resample else []), "feature"]
    binned = equal_bins(df, group, "value", "sample_id", bins, bounded=bounded)
    cells = binned.groupBy(*group, "bin", "label").agg(F.count(F.lit(1)).alias("c"))
    # at most 2 * bins rows per group from here on
    w = Window.partitionBy(*group)
    n, row, col = (
        F.sum("c").over(w),
        F.sum("c").over(w.partitionBy(*group, "bin")),
        F.sum("c").over(w.partitionBy(*group, "label")),
    )
    terms = cells.select(*group, (F.col("c") / n * F.log(F.col("c") * n / (row * col))).alias("x"))
    mi = terms.groupBy(*group).agg(F.sum("x").alias("mi"))
    return mi.groupBy(*keys, "feature").agg(F.avg("mi").alias("mi")) if resample else mi


def percentile01(
    df: DataFrame, keys: list[str], value: str, name: str = "pct", bounded: bool = False
) -> DataFrame:
    """(average rank - 1) / (n - 1); 0 in a group of one."""
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_m"))
    ranked = average_ranks(df, keys, value, "_r", bounded=bounded).join(sizes, keys)
    return ranked.withColumn(
        name,
        F.when(
            F.col("_r").isNotNull(),
            safe_div(F.col("_r") - 1, F.col("_m") - 1, F.lit(0.0)),
        ),
    ).drop("_r", "_m")


def random_rank(features: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Baseline ranking in hash order."""
    pool = features.select(*keys, "feature").distinct()
    hashed = pool.withColumn("_h", hash_order(seed, *keys, "feature"))
    return dealt(hashed, keys, "_h", "rank").drop("_h")


def variance_rank(df: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """Rank features by their sample variance; constant features are left out."""
    scored = (
        df.groupBy(*keys, "feature").agg(F.var_samp("value").alias("score")).where("score > 0")
    )
    return numbered(scored, keys, "score", "feature", bounded=bounded)
