"""Predictive metrics and comparisons of methods on evaluation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import each, quartiles, safe_div, share
from sievework.functions.ordering import numbered
from sievework.functions.special import binomial_upper

PRIMARY_KS = (10, 20, 50)
CELL = ["dataset", "repeat_idx", "fold_idx", "k"]


def threshold_metrics(
    df: DataFrame, keys: list[str], score: str = "score", at: float = 0.5, empty: str = "zero"
) -> DataFrame:
    """Confusion counts, balanced accuracy and Matthews correlation at a threshold.

    ``empty`` says what an undefined ratio becomes: ``zero`` or ``null``.
    """
    if empty not in ("zero", "null"):
        raise ValueError("empty must be 'zero' or 'null'")
    hit, pos = F.col(score) >= at, F.col("label") == 1
    fill = F.lit(0.0) if empty == "zero" else F.lit(None).cast("double")
    c = df.groupBy(*keys).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumn("sensitivity", safe_div(tp, tp + fn, fill)).withColumn(
        "specificity", safe_div(tn, tn + fp, fill)
    )
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.withColumn(
        "balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2
    ).withColumn("mcc", safe_div(tp * tn - fp * fn, root, fill))


def average_precision(
    df: DataFrame,
    keys: list[str],
    score: str = "score",
    tie: str = "sample_id",
    bounded: bool = False,
) -> DataFrame:
    """Mean precision at the positives in descending score order; NULL without positives."""
    ordered = numbered(df, keys, score, tie, "_at", cumulate="label", bounded=bounded)
    return ordered.groupBy(*keys).agg(
        F.avg(F.when(F.col("label") == 1, F.col("cum_label") / F.col("_at"))).alias(
            "average_precision"
        )
    )


def brier(df: DataFrame, keys: list[str], prob: str = "prob") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(prob) - F.col("label"), 2)).alias("brier"))


def metric_summary(df: DataFrame, keys: list[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sd of every metric and the number of rows with it, in long form."""
    long = df.unpivot(keys, list(metrics), "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.count("value").alias("n"),
    )


def with_random(evaluations: DataFrame, random: str = "Random", value: str = "auc") -> DataFrame:
    """Rows of real methods next to the matched random value of the same cell, and their delta."""
    base = evaluations.where(F.col("method") == random).select(
        *CELL, F.col(value).alias("random_auc")
    )
    real = evaluations.where(F.col("method") != random)
    return real.join(base, CELL).withColumn("delta", F.col(value) - F.col("random_auc"))


def delta_by_k(evaluations: DataFrame) -> DataFrame:
    """Per dataset, method and k: distribution of the value and of its gain over random."""
    d = with_random(evaluations)
    return d.groupBy("dataset", "method", "k").agg(
        F.count("delta").alias("n"),
        F.avg("auc").alias("mean_auc"),
        F.stddev_samp("auc").alias("sd_auc"),
        F.avg("random_auc").alias("mean_random_auc"),
        F.avg("delta").alias("mean_delta"),
        F.stddev_samp("delta").alias("sd_delta"),
        *quartiles("delta", "delta_"),
        share(F.col("delta") > 0).alias("positive_share"),
    )


def delta_primary(evaluations: DataFrame, ks: Sequence[int] = PRIMARY_KS) -> DataFrame:
    """Gain over random pooled over the primary sizes, with the range of its repeat means."""
    d = with_random(evaluations).where(F.col("k").isin(list(ks)))
    repeats = (
        d.groupBy("dataset", "method", "repeat_idx")
        .agg(F.avg("delta").alias("m"))
        .groupBy("dataset", "method")
        .agg(F.min("m").alias("repeat_min"), F.max("m").alias("repeat_max"))
    )
    return (
        d.groupBy("dataset", "method")
        .agg(
            F.count("delta").alias("n"),
            F.avg("auc").alias("primary_auc"),
            F.avg("delta").alias("primary_delta"),
            F.stddev_samp("delta").alias("sd_delta"),
            *quartiles("delta", "delta_"),
            share(F.col("delta") > 0).alias("positive_share"),
        )
        .join(repeats, ["dataset", "method"])
    )


def recovery(
    predicted: DataFrame, truth: DataFrame, universe: DataFrame, ks: Sequence[int], keys: list[str]
) -> DataFrame:
    """True features among the top k: precision, recall, F1 and the one-sided binomial p."""
    marked = predicted.join(
        truth.select("feature", F.lit(1).alias("_true")).distinct(), "feature", "left"
    )
    counts = (
        each(marked.where(F.col("rank") <= max(ks)), "k", ks)
        .where("rank <= k")
        .groupBy(*keys, "k")
        .agg(F.count("_true").alias("tp"), F.count(F.lit(1)).alias("n_selected"))
    )
    out = counts.withColumn("n_true", F.lit(truth.select("feature").distinct().count())).withColumn(
        "n_universe", F.lit(universe.select("feature").distinct().count())
    )
    precision = F.col("tp") / F.col("n_selected")
    recall = safe_div(F.col("tp"), F.col("n_true"))
    return (
        out.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", safe_div(2 * precision * recall, precision + recall, F.lit(0.0)))
        .withColumn(
            "p",
            binomial_upper(
                F.col("tp"), F.col("n_selected"), safe_div(F.col("n_true"), F.col("n_universe"))
            ),
        )
    )


def pairwise_methods(
    evaluations: DataFrame, headline: str | None = None, ks: Sequence[int] = PRIMARY_KS
) -> DataFrame:
    """Paired differences of two methods over the cells both have.

    A cell holds one row per method, so the pairs of a cell are bounded by the method count.
    With ``headline`` only the pairs with that method are formed.
    """
    e = evaluations.where(F.col("k").isin(list(ks)))
    a = e.select(*CELL, F.col("method").alias("method_a"), F.col("auc").alias("a"))
    b = e.select(*CELL, F.col("method").alias("method_b"), F.col("auc").alias("b"))
    if headline:
        pairs = a.where(F.col("method_a") == headline).join(
            b.where(F.col("method_b") != headline), CELL
        )
    else:
        pairs = a.join(b, CELL).where("method_a < method_b")
    d = pairs.withColumn("diff", F.col("a") - F.col("b"))
    key = ["dataset", "method_a", "method_b"]
    repeats = (
        d.groupBy(*key, "repeat_idx")
        .agg(F.avg("diff").alias("m"))
        .groupBy(*key)
        .agg(F.min("m").alias("repeat_min"), F.max("m").alias("repeat_max"))
    )
    return (
        d.groupBy(*key)
        .agg(
            F.count("diff").alias("n"),
            F.avg("diff").alias("mean_diff"),
            F.stddev_samp("diff").alias("sd_diff"),
            *quartiles("diff", "diff_"),
            share(F.col("diff") > 0).alias("win_share"),
            share(F.col("diff") == 0).alias("tie_share"),
        )
        .join(repeats, key)
    )


def random_mc(draws: DataFrame, keys: list[str], value: str = "auc") -> DataFrame:
    """Mean, sd, Monte-Carlo error and 95 % range over the random draws of each split."""
    return draws.groupBy(*keys).agg(
        F.count(value).alias("n_draws"),
        F.avg(value).alias("mean_random"),
        F.stddev_samp(value).alias("sd_random"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("mc_se"),
        F.percentile(value, F.lit(0.025)).alias("q025"),
        F.percentile(value, F.lit(0.975)).alias("q975"),
    )


def random_mc_overall(draws: DataFrame, keys: list[str], split: list[str], value: str = "auc"):
    """Split means summarised over the splits, with the mean within-split error."""
    return (
        random_mc(draws, [*keys, *split], value)
        .groupBy(*keys)
        .agg(
            F.avg("mean_random").alias("mean_random"),
            F.stddev_samp("mean_random").alias("sd_across_splits"),
            (F.stddev_samp("mean_random") / F.sqrt(F.count("mean_random"))).alias(
                "se_across_splits"
            ),
            F.avg("mc_se").alias("mean_mc_se"),
            F.count("mean_random").alias("n_splits"),
        )
    )


def variant_vs_current(evaluations: DataFrame, current: str) -> DataFrame:
    """Every variant minus the baseline variant, paired by cell, per dataset and k."""
    base = evaluations.where(F.col("method") == current).select(*CELL, F.col("auc").alias("base"))
    d = (
        evaluations.where(F.col("method") != current)
        .join(base, CELL)
        .withColumn("diff", F.col("auc") - F.col("base"))
    )
    return d.groupBy("dataset", "method", "k").agg(
        F.count("diff").alias("n"),
        F.avg("auc").alias("mean_variant"),
        F.avg("base").alias("mean_current"),
        F.avg("diff").alias("mean_diff"),
        F.percentile("diff", F.lit(0.5)).alias("median_diff"),
        share(F.col("diff") > 0).alias("better_share"),
    )


def component_table(evaluations: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Mean value of each named variant side by side, per dataset and k."""
    return (
        evaluations.where(F.col("method").isin(list(methods)))
        .groupBy("dataset", "k")
        .pivot("method", list(methods))
        .agg(F.avg("auc"))
    )
