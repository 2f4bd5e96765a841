"""Stability of panels over splits, overlap of methods, recurrence of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import no_nan, quartiles, safe_div
from sievework.functions.ordering import average_ranks, value_ranks
from sievework.session import cut_lineage, settled


def common_pool(pools: DataFrame, keys: list[str], split: list[str]) -> DataFrame:
    """Features present in the pool of every split."""
    n = pools.select(*keys, *split).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (
        pools.select(*keys, *split, "feature")
        .distinct()
        .groupBy(*keys, "feature")
        .agg(F.count(F.lit(1)).alias("n_available"))
        .join(n, keys)
        .where("n_available = _n")
        .drop("_n")
    )


def union_pool(pools: DataFrame, keys: list[str]) -> DataFrame:
    """Features present in the pool of at least one split."""
    return pools.select(*keys, "feature").distinct()


def _split_pairs(panels: DataFrame, keys: list[str], split: list[str]) -> DataFrame:
    """Intersection size of every pair of splits.

    A feature has at most one row per split, and the pairs are summed before they are shuffled.
    Pairs come from the list of splits, so disjoint panels count as well.
    """
    rows = panels.select(*keys, F.struct(*split).alias("s"), "feature").distinct()
    sizes = rows.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("n"))
    a = rows.withColumnRenamed("s", "a")
    b = rows.withColumnRenamed("s", "b")
    shared = (
        a.join(b, [*keys, "feature"])
        .where("a < b")
        .groupBy(*keys, "a", "b")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    left = sizes.select(*keys, F.col("s").alias("a"), F.col("n").alias("na"))
    right = sizes.select(*keys, F.col("s").alias("b"), F.col("n").alias("nb"))
    return (
        left.join(right, keys)
        .where("a < b")
        .join(shared, [*keys, "a", "b"], "left")
        .fillna(0, subset=["shared"])
    )


def pairwise_overlap(panels: DataFrame, keys: list[str], split: list[str]) -> DataFrame:
    """Jaccard, Dice and overlap coefficient over all pairs of splits."""
    p = _split_pairs(panels, keys, split)
    s, na, nb = F.col("shared"), F.col("na"), F.col("nb")
    p = (
        p.withColumn("jaccard", safe_div(s, na + nb - s))
        .withColumn("dice", safe_div(2 * s, na + nb))
        .withColumn("overlap", safe_div(s, F.least(na, nb)))
    )
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("jaccard").alias("mean_jaccard"),
        *quartiles("jaccard", "jaccard_"),
        F.min("jaccard").alias("jaccard_min"),
        F.avg("dice").alias("mean_dice"),
        F.avg("overlap").alias("mean_overlap"),
        F.avg("shared").alias("mean_shared"),
    )


def nogueira(
    panels: DataFrame, universe: DataFrame, keys: list[str], split: list[str]
) -> DataFrame:
    """Stability index of the panels over a universe of d features.

    ``universe`` has rows of (its own subset of keys, feature); unselected features contribute 0.
    """
    on = [k for k in keys if k in universe.columns]
    if not on:
        raise ValueError("the universe must carry at least one of the keys")
    d = universe.select(*on, "feature").distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("d"))
    rows = panels.select(*keys, *split, "feature").distinct()
    m = rows.select(*keys, *split).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    per_feature = rows.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("c")).join(m, keys)
    p = F.col("c") / F.col("m")
    sums = per_feature.groupBy(*keys, "m").agg(
        F.sum(p * (1 - p)).alias("spread"), F.sum("c").alias("total")
    )
    out = sums.join(d, on)
    q = F.col("total") / F.col("m") / F.col("d")
    variance = F.col("m") / (F.col("m") - 1) * F.col("spread") / F.col("d")
    return out.select(
        *keys,
        F.col("m").alias("n_splits"),
        F.col("d").alias("universe"),
        (F.col("total") / F.col("m")).alias("mean_size"),
        F.when((F.col("m") > 1) & (q * (1 - q) > 0), 1 - variance / (q * (1 - q))).alias("nogueira"),
    )


def recurrence(
    panels: DataFrame, pools: DataFrame, keys: list[str], split: list[str]
) -> DataFrame:
    """How often a feature is selected, of all splits and of those where it is available."""
    on = [k for k in keys if k in pools.columns]
    n = pools.select(*on, *split).distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("n_splits"))
    available = (
        pools.select(*on, *split, "feature")
        .distinct()
        .groupBy(*on, "feature")
        .agg(F.count(F.lit(1)).alias("n_available"))
    )
    return (
        panels.groupBy(*keys, "feature")
        .agg(F.count(F.lit(1)).alias("n_selected"))
        .join(available, [*on, "feature"])
        .join(n, on)
        .withColumn("share_all", F.col("n_selected") / F.col("n_splits"))
        .withColumn("share_available", F.col("n_selected") / F.col("n_available"))
    )


def recurrence_counts(recurrent: DataFrame, keys: list[str]) -> DataFrame:
    """Number of features selected in all, and in at least half, of the splits."""
    return recurrent.groupBy(*keys).agg(
        F.count_if(F.col("n_selected") == F.col("n_splits")).alias("in_all"),
        F.count_if(F.col("n_selected") >= F.ceil(F.col("n_splits") / 2)).alias("in_half"),
        F.count(F.lit(1)).alias("ever"),
    )


def method_overlap(
    panels: DataFrame, a: str, b: str, keys: list[str], split: list[str]
) -> DataFrame:
    """Shared features of two methods in every split."""
    first = panels.where(F.col("method") == a).select(*keys, *split, "feature").distinct()
    second = panels.where(F.col("method") == b).select(*keys, *split, "feature").distinct()
    both = first.withColumn("a", F.lit(1)).join(
        second.withColumn("b", F.lit(1)), [*keys, *split, "feature"], "full"
    )
    return (
        both.groupBy(*keys, *split)
        .agg(
            F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"),
            F.count(F.lit(1)).alias("union"),
            F.count("a").alias("n_a"),
        )
        .withColumn("jaccard", safe_div(F.col("shared"), F.col("union")))
        .withColumn("shared_fraction", safe_div(F.col("shared"), F.col("n_a")))
        .drop("n_a")
    )


def overlap_summary(per_split: DataFrame, keys: list[str]) -> DataFrame:
    return per_split.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_splits"),
        F.avg("shared").alias("mean_shared"),
        F.avg("jaccard").alias("mean_jaccard"),
        F.percentile("jaccard", F.lit(0.5)).alias("median_jaccard"),
        F.avg("shared_fraction").alias("mean_fraction"),
    )


def correlations(df: DataFrame, keys: list[str], x: str, y: str, bounded: bool = False) -> DataFrame:
    """Pearson and Spearman per group over the rows where both are present.

    NULL unless there are three pairs and two distinct values on each side. Unless ``bounded``, the pairs are written
    once without their other columns, as ordering in slices reads them several times, and both ranks come from them.
    """
    pairs = df.where(no_nan(F.col(x)).isNotNull() & no_nan(F.col(y)).isNotNull()).select(*keys, x, y)
    if bounded:
        ranked = average_ranks(pairs, keys, x, "_rx", bounded=True)
        ranked = average_ranks(ranked, keys, y, "_ry", bounded=True)
    else:
        ranked = pairs = cut_lineage(pairs)
        for value, name in ((x, "_rx"), (y, "_ry")):
            ranked = ranked.join(settled(value_ranks(pairs, keys, value, name, once=True)), [*keys, value], "left")
    ok = (
        (F.count(F.lit(1)) >= 3)
        & (F.min(x) < F.max(x))
        & (F.min(y) < F.max(y))
    )
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(ok, F.corr(x, y)).alias("pearson"),
        F.when(ok, F.corr("_rx", "_ry")).alias("spearman"),
    )


def correlation_summary(per_split: DataFrame, keys: list[str], value: str = "spearman"):
    return per_split.groupBy(*keys).agg(
        F.count(value).alias("n_splits"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
    )


def selection_groups(
    panels: DataFrame, a: str, b: str, keys: list[str]
) -> DataFrame:
    """Each feature of two panels as SHARED, A_ONLY or B_ONLY."""
    first = panels.where(F.col("method") == a).select(*keys, "feature", F.lit(True).alias("_a"))
    second = panels.where(F.col("method") == b).select(*keys, "feature", F.lit(True).alias("_b"))
    return first.join(second, [*keys, "feature"], "full").select(
        *keys,
        "feature",
        F.when(F.col("_a") & F.col("_b"), "SHARED")
        .when(F.col("_a"), "A_ONLY")
        .otherwise("B_ONLY")
        .alias("group"),
    )


def group_recurrence(
    groups: DataFrame, scores: DataFrame, keys: list[str], split: list[str]
) -> DataFrame:
    """Per feature: splits in each group, shares of all and of candidate splits, mean score."""
    n = scores.select(*keys, *split).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_splits")
    )
    means = scores.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n_candidate"), F.avg("score").alias("mean_score")
    )
    counts = groups.groupBy(*[k for k in groups.columns if k in (*keys, "k")], "feature").agg(
        F.count_if(F.col("group") == "SHARED").alias("n_shared"),
        F.count_if(F.col("group") == "A_ONLY").alias("n_a_only"),
        F.count_if(F.col("group") == "B_ONLY").alias("n_b_only"),
    )
    out = counts.join(means, [*keys, "feature"], "left").join(n, keys)
    for g in ("shared", "a_only", "b_only"):
        out = out.withColumn(f"share_{g}", F.col(f"n_{g}") / F.col("n_splits")).withColumn(
            f"available_{g}", safe_div(F.col(f"n_{g}"), F.col("n_candidate"))
        )
    return out


def group_recurrence_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row per feature and group it occurs in."""
    return (
        wide.unpivot([*keys, "feature"], ["n_shared", "n_a_only", "n_b_only"], "group", "n")
        .where("n > 0")
        .withColumn("group", F.upper(F.regexp_replace("group", "^n_", "")))
    )
