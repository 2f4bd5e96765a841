"""Intervals, tests and cross-dataset summaries of evaluation rows.

The windows here run over methods, sizes or datasets of one cell, which are few by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.columns import (
    finite,
    hash_order,
    numbered_copies,
    safe_div,
    share,
)
from sievework.functions.ordering import average_ranks, group_quantiles, numbered
from sievework.functions.special import normal_two_sided, t_critical, t_pvalue
from sievework.operators.metrics import PRIMARY_KS, with_random
from sievework.operators.scores import bh_adjust
from sievework.operators.stability import correlations


def describe_groups(
    df: DataFrame, keys: list[str], value: str, bounded: bool = False
) -> DataFrame:
    """n, mean, median, sd and quartiles of the finite values of groups of any size."""
    clean = df.withColumn("_x", finite(F.col(value)))
    moments = clean.groupBy(*keys).agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd")
    )
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return moments.join(group_quantiles(clean, keys, "_x", probs, bounded), keys, "left")


def _interval(df: DataFrame, level: float = 0.975) -> DataFrame:
    """Add low, high, t and p from mean, se and df."""
    crit = t_critical(level, F.col("df"))
    return (
        df.withColumn("_c", crit)
        .withColumn("low", F.col("mean") - F.col("_c") * F.col("se"))
        .withColumn("high", F.col("mean") + F.col("_c") * F.col("se"))
        .withColumn("t", safe_div(F.col("mean"), F.col("se")))
        .withColumn("p", t_pvalue(F.col("t"), F.col("df")))
        .drop("_c")
    )


def corrected_t_interval(
    df: DataFrame, keys: list[str], value: str, test_over_train: float = 0.25
) -> DataFrame:
    """Resampled-t interval with the variance factor 1/n + n_test/n_train."""
    n = F.count(value)
    base = df.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(value).alias("mean"),
        F.sqrt((safe_div(F.lit(1.0), n) + test_over_train) * F.var_samp(value)).alias("se"),
        (n - 1).alias("df"),
    )
    return _interval(base)


def adjust_within(df: DataFrame, within: list[str]) -> DataFrame:
    """Benjamini-Hochberg of ``p`` inside groups such as one panel size."""
    return bh_adjust(df, within, "p", "q")


def repeat_t_interval(df: DataFrame, keys: list[str], repeat: str, value: str) -> DataFrame:
    """t interval over the repeat means; df = repeats - 1."""
    means = df.groupBy(*keys, repeat).agg(F.avg(value).alias("m"))
    base = means.groupBy(*keys).agg(
        F.count("m").alias("n_repeats"),
        F.avg("m").alias("mean"),
        (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("se"),
        (F.count("m") - 1).alias("df"),
    )
    return _interval(base)


def bootstrap_means(
    df: DataFrame, keys: list[str], cluster: str, value: str, b: int, seed: int
) -> DataFrame:
    """Mean of the rows of clusters drawn with replacement, for ``b`` replicates per group.

    Clusters are first reduced to their sum and count, so a replicate reads a few numbers however
    many rows a cluster has.
    """
    sums = df.groupBy(*keys, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    w = Window.partitionBy(*keys)
    indexed = sums.withColumn(
        "_i", F.row_number().over(w.orderBy(cluster)).cast("long")
    ).withColumn("_r", F.count(F.lit(1)).over(w))
    sizes = indexed.groupBy(*keys).agg(F.max("_r").alias("_r"))
    slots = numbered_copies(sizes, "replicate", b).withColumn(
        "slot", F.explode(F.sequence(F.lit(1), F.col("_r").cast("int")))
    )
    digest = F.conv(F.substring(hash_order(seed, *keys, "replicate", "slot"), 1, 8), 16, 10)
    picks = slots.withColumn("_i", digest.cast("long") % F.col("_r") + 1).drop("_r")
    return (
        picks.join(indexed.drop("_r"), [*keys, "_i"])
        .groupBy(*keys, "replicate")
        .agg(safe_div(F.sum("_s"), F.sum("_c")).alias("boot_mean"))
    )


def cluster_bootstrap(
    df: DataFrame, keys: list[str], cluster: str, value: str, b: int = 10000, seed: int = 1
) -> DataFrame:
    """Percentile interval of the cluster bootstrap per group."""
    return (
        bootstrap_means(df, keys, cluster, value, b, seed)
        .groupBy(*keys)
        .agg(
            F.avg("boot_mean").alias("boot_mean"),
            F.percentile("boot_mean", F.lit(0.025)).alias("low"),
            F.percentile("boot_mean", F.lit(0.975)).alias("high"),
        )
    )


def balanced_bootstrap(
    df: DataFrame,
    keys: list[str],
    dataset: str,
    cluster: str,
    value: str,
    b: int = 10000,
    seed: int = 1,
) -> DataFrame:
    """Clusters drawn inside each dataset; a replicate is the mean of its dataset means."""
    return (
        bootstrap_means(df, [*keys, dataset], cluster, value, b, seed)
        .groupBy(*keys, "replicate")
        .agg(F.avg("boot_mean").alias("m"))
        .groupBy(*keys)
        .agg(
            F.percentile("m", F.lit(0.025)).alias("low"),
            F.percentile("m", F.lit(0.975)).alias("high"),
        )
    )


def balanced_mean(df: DataFrame, keys: list[str], dataset: str, value: str) -> DataFrame:
    """Mean of dataset means with the t interval over datasets."""
    return repeat_t_interval(df, keys, dataset, value).withColumnRenamed("n_repeats", "n_datasets")


def wilcoxon_signed_rank(
    df: DataFrame, keys: list[str], diff: str, bounded: bool = False
) -> DataFrame:
    """Signed-rank test: zeros dropped, average ranks, tie and continuity corrected normal p."""
    d = df.where((F.col(diff) != 0) & F.col(diff).isNotNull()).withColumn("_a", F.abs(diff))
    ranked = average_ranks(d, keys, "_a", "_r", bounded=bounded)
    ties = (
        d.groupBy(*keys, "_a")
        .agg(F.count(F.lit(1)).alias("t"))
        .groupBy(*keys)
        .agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie_term"))
    )
    n = F.col("n")
    stat = (
        ranked.groupBy(*keys)
        .agg(
            F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0.0)).alias("v"),
            F.count(F.lit(1)).alias("n"),
        )
        .join(ties, keys)
        .withColumn("_m", n * (n + 1) / 4)
        .withColumn("_s", F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48))
        .withColumn("_d", F.col("v") - F.col("_m"))
        .withColumn("z", safe_div(F.col("_d") - F.signum("_d") * 0.5, F.col("_s")))
    )
    return stat.withColumn("p", normal_two_sided(F.col("z"))).drop("_m", "_s", "_d")


def dataset_ranks(
    df: DataFrame, keys: list[str], value: str, ties: str = "average"
) -> DataFrame:
    """Rank of every method inside a dataset, best value first; ties average or min."""
    if ties == "average":
        return average_ranks(df, keys, value, "dataset_rank", descending=True, bounded=True)
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    return df.withColumn("dataset_rank", F.rank().over(w).cast("double"))


def method_ranks(primary: DataFrame, value: str = "primary_delta", ties: str = "average"):
    """Methods over all datasets: ranks, first places, gains and overall order."""
    ranked = dataset_ranks(primary, ["dataset"], value, ties)
    out = ranked.groupBy("method").agg(
        F.count("dataset_rank").alias("n_datasets"),
        F.avg("dataset_rank").alias("mean_rank"),
        F.percentile("dataset_rank", F.lit(0.5)).alias("median_rank"),
        F.count_if(F.col("dataset_rank") == 1).alias("n_first"),
        F.avg(value).alias("mean_delta"),
        F.percentile(value, F.lit(0.5)).alias("median_delta"),
        F.min(value).alias("min_delta"),
        F.max(value).alias("max_delta"),
    )
    w = Window.orderBy("mean_rank", F.col("mean_delta").desc(), "method")  # one row per method
    return out.withColumn("overall_order", F.row_number().over(w))


def curve_area(df: DataFrame, keys: list[str], x: str, y: str, name: str = "area") -> DataFrame:
    """Trapezoid area of y over log x, divided by the log range."""
    w = Window.partitionBy(*keys).orderBy(x)
    lx = F.log(x)
    steps = df.select(
        *keys,
        lx.alias("_x"),
        ((lx - F.lag(lx).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("_a"),
    )
    return steps.groupBy(*keys).agg(
        safe_div(F.sum("_a"), F.max("_x") - F.min("_x")).alias(name)
    )


def efficiency_curve(evaluations: DataFrame) -> DataFrame:
    """Area of the gain and of the value over log k: per split, then the mean per dataset."""
    d = with_random(evaluations)
    split = ["dataset", "repeat_idx", "fold_idx", "method"]
    gain = curve_area(d, split, "k", "delta", "delta_area")
    level = curve_area(d, split, "k", "auc", "auc_area")
    return (
        gain.join(level, split)
        .groupBy("dataset", "method")
        .agg(
            F.avg("delta_area").alias("delta_area"),
            F.stddev_samp("delta_area").alias("sd_delta_area"),
            F.avg("auc_area").alias("auc_area"),
            F.count(F.lit(1)).alias("n_splits"),
        )
    )


def efficiency_overall(by_dataset: DataFrame) -> DataFrame:
    """Dataset-balanced areas with the order of methods."""
    out = by_dataset.groupBy("method").agg(
        F.avg("delta_area").alias("delta_area"),
        F.stddev_samp("delta_area").alias("sd_across_datasets"),
        F.avg("auc_area").alias("auc_area"),
    )
    w = Window.orderBy(F.col("delta_area").desc(), "method")  # one row per method
    return out.withColumn("rank", F.row_number().over(w))


def k_sensitivity(by_k: DataFrame) -> DataFrame:
    """Best and worst size, range of the mean gain, its Spearman correlation with log2 k.

    The smaller k wins among equal gains.
    """
    d = by_k.withColumn("log2_k", F.log2("k"))
    best = d.groupBy("dataset", "method").agg(
        F.max(F.struct("mean_delta", -F.col("k"))).alias("b"),
        F.min(F.struct("mean_delta", "k")).alias("w"),
    ).select(
        "dataset",
        "method",
        (-F.col("b.col2")).alias("best_k"),
        F.col("b.mean_delta").alias("best_delta"),
        F.col("w.k").alias("worst_k"),
        F.col("w.mean_delta").alias("worst_delta"),
        (F.col("b.mean_delta") - F.col("w.mean_delta")).alias("delta_range"),
    )
    rho = correlations(d, ["dataset", "method"], "log2_k", "mean_delta", bounded=True)
    return best.join(rho.drop("n", "pearson"), ["dataset", "method"], "left")


def adaptive_summary(adaptive: DataFrame, small: int = 50) -> DataFrame:
    """Value, gain and chosen sizes of adaptive panels per dataset and method."""
    return adaptive.groupBy("dataset", "method").agg(
        F.count(F.lit(1)).alias("n_splits"),
        F.avg("outer_auc").alias("mean_auc"),
        F.avg("random_auc").alias("mean_random_auc"),
        F.avg("outer_delta").alias("mean_delta"),
        F.percentile("chosen_k", F.lit(0.5)).alias("median_k"),
        F.avg("chosen_k").alias("mean_k"),
        share(F.col("chosen_k") <= small).alias("share_small"),
    )


def adaptive_size_counts(adaptive: DataFrame) -> DataFrame:
    return adaptive.groupBy("dataset", "method", "chosen_k").agg(
        F.count(F.lit(1)).alias("n_splits")
    )


def adaptive_vs_fixed(adaptive: DataFrame, evaluations: DataFrame, k: int) -> DataFrame:
    """Adaptive minus fixed-k value and gain, paired by split."""
    split = ["dataset", "repeat_idx", "fold_idx", "method"]
    fixed = (
        with_random(evaluations)
        .where(F.col("k") == k)
        .select(*split, F.col("auc").alias("fixed_auc"), F.col("delta").alias("fixed_delta"))
    )
    d = adaptive.join(fixed, split, "left").withColumn(
        "_d", F.col("outer_auc") - F.col("fixed_auc")
    )
    return d.groupBy("dataset", "method").agg(
        F.avg("_d").alias("mean_auc_diff"),
        F.avg(F.col("outer_delta") - F.col("fixed_delta")).alias("mean_delta_diff"),
        share(F.col("_d") > 0).alias("share_above"),
    )


def run_stats(runs: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """Run seconds (quartiles, total) and the share of fallbacks."""
    totals = runs.groupBy(*keys).agg(
        F.count("seconds").alias("n_runs"),
        F.sum("seconds").alias("total_seconds"),
        share(F.col("fallback")).alias("fallback_share"),
    )
    probs = {"seconds_q1": 0.25, "seconds_median": 0.5, "seconds_q3": 0.75}
    return totals.join(group_quantiles(runs, keys, "seconds", probs, bounded), keys, "left")


def choice_shares(runs: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """How often each setting was chosen, and its share in the group."""
    counts = runs.groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))  # one row per setting
    return counts.withColumn("share", F.col("n") / total)


def best_per_cell(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The top method of every cell; the first name wins among equals."""
    return numbered(df, keys, value, "method", "_rn", bounded=True).where("_rn = 1").drop("_rn")


def compare_runs(df: DataFrame, keys: list[str], source: str, a: str, b: str, value: str):
    """Two sources side by side and their difference."""
    wide = df.groupBy(*keys).pivot(source, [a, b]).agg(F.avg(value))
    return wide.withColumn("difference", F.col(a) - F.col(b))


def wide_by_k(df: DataFrame, ks: Sequence[int], value: str, order_k: int) -> DataFrame:
    """Method x k table with the order of methods at one size."""
    wide = df.groupBy("dataset", "method").pivot("k", list(ks)).agg(F.avg(value))
    wide = wide.select("dataset", "method", *[F.col(str(k)).alias(f"k{k}") for k in ks])
    w = Window.partitionBy("dataset").orderBy(F.col(f"k{order_k}").desc_nulls_last(), "method")
    return wide.withColumn("position", F.row_number().over(w))


def tradeoff_table(
    by_k: DataFrame, stability: DataFrame, enrichment: DataFrame, k: int = 50
) -> DataFrame:
    """Value at one size next to stability, and enrichment where there is one (else 0)."""
    auc = by_k.where(F.col("k") == k).select("dataset", "method", "mean_auc")
    stab = stability.where(F.col("k") == k).select("dataset", "method", "nogueira")
    enr = enrichment.select("dataset", "method", "enrichment")
    return (
        auc.join(stab, ["dataset", "method"])
        .join(enr, ["dataset", "method"], "left")
        .withColumn("enrichment", F.coalesce("enrichment", F.lit(0.0)))
    )


def macro_means(
    evaluations: DataFrame,
    validation: Sequence[str],
    value: str = "auc",
    ks: Sequence[int] = PRIMARY_KS,
    first: str = "mean",
) -> DataFrame:
    """(dataset, method, k) -> primary sizes -> equal weight over the validation datasets.

    ``first='median'`` takes medians over splits before the means.
    """
    agg = F.avg(value) if first == "mean" else F.percentile(value, F.lit(0.5))
    by_k = evaluations.groupBy("dataset", "method", "k").agg(agg.alias("v"))
    primary = (
        by_k.where(F.col("k").isin(list(ks))).groupBy("dataset", "method").agg(F.avg("v").alias("v"))
    )
    return (
        primary.where(F.col("dataset").isin(list(validation)))
        .groupBy("method")
        .agg(F.avg("v").alias("macro_mean"), F.count("v").alias("n_datasets"))
    )


def selected_size_summary(
    selected: DataFrame, keys: list[str], split: list[str], cuts: Sequence[int] = (10, 20, 50)
) -> DataFrame:
    """Native panel sizes: min, median, max and the splits below each cut.

    ``selected`` has a boolean column; splits with nothing selected count as size 0.
    """
    sizes = selected.groupBy(*keys, *split).agg(F.count_if("selected").alias("n"))
    return sizes.groupBy(*keys).agg(
        F.min("n").alias("min_size"),
        F.percentile("n", F.lit(0.5)).alias("median_size"),
        F.max("n").alias("max_size"),
        *[F.count_if(F.col("n") < c).alias(f"below_{c}") for c in cuts],
    )


def win_counts(wide: DataFrame, axes: Sequence[str], reference: float) -> DataFrame:
    """Number of datasets where a method's axis exceeds the reference, methods x axes."""
    long = wide.unpivot(["dataset", "method"], list(axes), "axis", "value")
    return (
        long.groupBy("method")
        .pivot("axis", list(axes))
        .agg(F.count_if(F.col("value") > reference))
    )


def arm_report(evaluations: DataFrame) -> DataFrame:
    """Arm means against the random arm of the same pool, with the count of gate fallbacks.

    Input has ``pool, arm, k, auc, gate_fallback``; the random arm of a pool is ``Random``.
    """
    keys = ["dataset", "pool", "k"]
    base = (
        evaluations.where("arm = 'Random'").groupBy(*keys).agg(F.avg("auc").alias("mean_random"))
    )
    return (
        evaluations.where("arm != 'Random'")
        .groupBy(*keys, "arm")
        .agg(
            F.count(F.lit(1)).alias("n_splits"),
            F.avg("auc").alias("mean_auc"),
            F.stddev_samp("auc").alias("sd_auc"),
            F.sum(F.col("gate_fallback").cast("int")).alias("n_fallback"),
        )
        .join(base, keys, "left")
        .withColumn("delta", F.col("mean_auc") - F.col("mean_random"))
    )


def gate_report(gate: DataFrame, keys: list[str], levels: Sequence[float] = (0.05, 0.1, 0.2)):
    """Per split: tested sets, least q, sets certified at each level, self-test passes."""
    return gate.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sets"),
        F.min("q").alias("min_q"),
        *[F.count_if(F.col("q") <= v).alias(f"n_q{round(v * 100):02d}") for v in levels],
        F.count_if(F.col("q_self") <= 0.2).alias("self_test_pass"),
    )
