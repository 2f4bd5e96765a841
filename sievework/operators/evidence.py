"""Selection frequency, held-out utility and their calibration by label permutations.

Keys: ``keys`` name the split. Coefficients are ``keys, resample_id, feature, beta``, fits are
``keys, resample_id, intercept, oob_auc``, nulls are ``keys, perm_id, feature, pi, u`` with both
statistics of a permutation on the same row. A window over the permutations of one feature is as
short as the number of permutations.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from sievework.functions.columns import clipped_ratio, finite, safe_div, share, softplus
from sievework.functions.ordering import average_ranks, fits_one_task, group_quantiles, numbered
from sievework.operators.folds import permute_labels
from sievework.operators.gramian import ROUNDING, feature_index, piece_matrix, pieces
from sievework.operators.scores import bh_adjust, percentile01
from sievework.session import cut_lineage


def selection_frequency(coefs: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    """Share of resamples with a nonzero coefficient and mean absolute coefficient.

    Both divide by the number of resamples; a resample without a row is a zero.
    """
    return coefs.groupBy(*keys, "feature").agg(
        (F.count_if(F.col("beta") != 0) / resamples).alias("frequency"),
        (F.sum(F.abs("beta")) / resamples).alias("mean_abs"),
        F.count_if(F.col("beta") != 0).alias("n_selected"),
    )


def prediction_first_score(
    frequency: DataFrame, keys: list[str], gamma: float = 0.25, bounded: bool = False
) -> DataFrame:
    """Mean absolute coefficient times frequency to the power gamma, ranked."""
    scored = frequency.withColumn("score", F.col("mean_abs") * F.pow("frequency", F.lit(gamma)))
    return numbered(scored, keys, "score", "feature", bounded=bounded)


def linear_predictor(
    features: DataFrame, coefs: DataFrame, fits: DataFrame, members: DataFrame, keys: list[str]
) -> DataFrame:
    """eta of every held-out sample of every resample; only nonzero coefficients are joined."""
    on = [*keys, "resample_id"]
    terms = (
        features.join(coefs.where("beta != 0"), [*keys, "feature"])
        .join(members, [*on, "sample_id"])
        .groupBy(*on, "sample_id")
        .agg(F.sum(F.col("beta") * F.col("value")).alias("_xb"))
    )
    return (
        members.join(terms, [*on, "sample_id"], "left")
        .join(fits.select(*on, "intercept"), on)
        .withColumn("eta", F.col("intercept") + F.coalesce("_xb", F.lit(0.0)))
        .drop("_xb", "intercept")
    )


def deviance_utility(
    features: DataFrame, coefs: DataFrame, fits: DataFrame, members: DataFrame, keys: list[str]
) -> DataFrame:
    """Rise in held-out binomial deviance when a feature's coefficient is set to zero.

    ``members`` holds the held-out samples with their label. The rise is averaged over the
    resamples that chose the feature, weighted by max(AUC - .5, 0) (.5 for a missing AUC), then
    clipped at zero; without any weight it is 0.
    """
    on = [*keys, "resample_id"]
    eta = linear_predictor(features, coefs, fits.where("intercept is not null"), members, keys)
    x = (
        features.join(coefs.where("beta != 0"), [*keys, "feature"])
        .join(eta, [*on, "sample_id"])
        .withColumn("_less", F.col("eta") - F.col("beta") * F.col("value"))
    )
    y = F.col("label")
    rise = -2 * (
        (y * F.col("_less") - softplus(F.col("_less"))) - (y * F.col("eta") - softplus(F.col("eta")))
    )
    delta = x.groupBy(*on, "feature").agg(F.sum(rise).alias("rise"))
    return utility_of_rises(delta, fits, keys, on)


def utility_of_rises(rises: DataFrame, fits: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Mean held-out deviance rise of a feature over the fits ``on`` that chose it, weighted by max(AUC - .5, 0).

    A missing AUC counts as .5. Negative means are 0, and so is a feature without any weight.
    """
    weight = F.greatest(F.coalesce(finite(F.col("oob_auc")), F.lit(0.5)) - 0.5, F.lit(0.0))
    weighted = rises.select(*on, "feature", "rise").join(fits.select(*on, weight.alias("w")), on)
    return weighted.groupBy(*keys, "feature").agg(
        F.greatest(
            safe_div(F.sum(F.col("rise") * F.col("w")), F.sum("w"), F.lit(0.0)), F.lit(0.0)
        ).alias("utility"),
        F.count(F.lit(1)).alias("n_selected"),
    )


def sign_consistency(coefs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the majority sign among selecting resamples; NULL if never selected."""
    chosen = F.when(F.col("beta") != 0, F.col("beta"))
    return coefs.groupBy(*keys, "feature").agg(
        F.greatest(share(chosen > 0), share(chosen < 0)).alias("sign_consistency")
    )


def exceedance(
    observed: DataFrame, nulls: DataFrame, keys: list[str], stats: Sequence[str] = ("pi", "u")
) -> DataFrame:
    """(1 + number of null values at or above the observed one) / (M + 1) for each statistic.

    A feature without null values stops the query: it could not be judged like the others.
    """
    on = [*keys, "feature"]
    n = nulls.select(*on, F.lit(1).alias("_m"), *[F.col(s).alias(f"_n_{s}") for s in stats])
    alone = F.raise_error(F.concat(F.lit("no null values for feature "), F.col("feature")))
    counted = (
        observed.join(n, on, "left")
        .groupBy(*on, *stats)
        .agg(F.count("_m").alias("_n"), *[F.count_if(F.col(f"_n_{s}") >= F.col(s)).alias(f"_c_{s}") for s in stats])
    )
    m = F.when(F.col("_n") > 0, F.col("_n")).otherwise(alone.cast("bigint"))
    return counted.select(
        *on, *stats, m.alias("n_null"), *[((1 + F.col(f"_c_{s}")) / (m + 1)).alias(f"e_{s}") for s in stats]
    )


def loo_exceedance(
    nulls: DataFrame, keys: list[str], stats: Sequence[str] = ("pi", "u")
) -> DataFrame:
    """Each permutation against the others of its feature, on the same add-one scale.

    The permutation itself is at or above its own value, which supplies the one.
    """
    w = Window.partitionBy(*keys, "feature")
    out = nulls
    for s in stats:
        above = F.count(s).over(
            w.orderBy(F.col(s).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        )
        out = out.withColumn(f"e_{s}", above / F.count(s).over(w))
    return out


def joint_null(
    observed: DataFrame, nulls: DataFrame, keys: list[str], bounded: bool = False
) -> DataFrame:
    """Fisher combination of both exceedances, judged against the same combination of the nulls.

    Ranked by p, then by larger pi. Every feature must have the same number of permutations.
    """
    on = [*keys, "feature"]
    fisher = -2 * (F.log("e_pi") + F.log("e_u"))
    obs = exceedance(observed, nulls, keys).withColumn("t_obs", fisher)
    null = loo_exceedance(nulls, keys).withColumn("t_null", fisher)
    # sums of the same logarithms must tie
    p = (
        obs.join(null.select(*on, "t_null"), on)
        .groupBy(*on, "pi", "u", "e_pi", "e_u", "t_obs", "n_null")
        .agg(
            (
                (1 + F.count_if(F.round("t_null", 9) >= F.round("t_obs", 9))) / (F.col("n_null") + 1)
            ).alias("p")
        )
    )
    return numbered(
        p, keys, "p", "feature", descending=False, then=[F.col("pi").desc()], bounded=bounded
    )


def check_nulls(observed: DataFrame, nulls: DataFrame, keys: list[str], least: int = 20):
    """Dimension check: features without nulls or with another number of permutations."""
    per = nulls.groupBy(*keys, "feature").agg(F.count_distinct("perm_id").alias("m"))
    m = per.groupBy(*keys).agg(F.max("m").alias("n_perm"))
    return (
        observed.select(*keys, "feature")
        .withColumn("_o", F.lit(1))
        .join(per, [*keys, "feature"], "full")
        .join(m, keys)
        .groupBy(*keys, "n_perm")
        .agg(
            F.count_if(F.col("_o").isNull() | F.col("m").isNull()).alias("unpaired"),
            F.count_if(F.col("m") != F.col("n_perm")).alias("uneven"),
        )
        .withColumn("coarse", F.col("n_perm") < least)
    )


def panel_membership(fits: DataFrame, keys: list[str], refit: str, k: int, p: str = "p"):
    """Share of refits in which a feature is among the first k by p (name order on ties)."""
    w = Window.partitionBy(*keys, refit).orderBy(F.col(p).asc_nulls_last(), "feature")
    top = fits.withColumn("_r", F.row_number().over(w)).where(f"_r <= {k}")
    n = fits.groupBy(*keys).agg(F.count_distinct(refit).alias("_n"))
    counts = top.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("_c"))
    everyone = fits.select(*keys, "feature").distinct()
    return (
        everyone.join(counts, [*keys, "feature"], "left")
        .join(n, keys)
        .select(
            *keys, "feature", (F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("membership")
        )
    )


def utility_epsilon(
    observed: DataFrame, keys: list[str], stat: str = "u", bounded: bool = False
) -> DataFrame:
    """95th percentile of the positive observed utilities, 1e-6 where there is none."""
    positive = observed.where(F.col(stat) > 0)
    q = group_quantiles(positive, keys, stat, {"eps": 0.95}, bounded)
    return (
        observed.select(*keys).distinct().join(q, keys, "left").withColumn(
            "eps", F.coalesce("eps", F.lit(1e-6))
        )
    )


def evidence_ratio(
    observed: DataFrame,
    nulls: DataFrame,
    keys: list[str],
    stat: str,
    eps: float | DataFrame,
    width: float = 4,
) -> DataFrame:
    """(observed + eps) / (mean null + eps), log2 clipped to +-width.

    ``eps`` is a number, or a table with one ``eps`` per split.
    """
    on = [*keys, "feature"]
    means = nulls.groupBy(*on).agg(F.avg(stat).alias("null_mean"))
    both = observed.select(*on, stat).join(means, on)
    both = both.join(eps, keys) if isinstance(eps, DataFrame) else both.withColumn("eps", F.lit(eps))
    return both.withColumn(
        "ratio",
        clipped_ratio((F.col(stat) + F.col("eps")) / (F.col("null_mean") + F.col("eps")), width),
    )


def lopo_ratio(
    nulls: DataFrame, keys: list[str], stat: str, eps: float | DataFrame, width: float = 4
) -> DataFrame:
    """Each permutation against the mean of the other permutations of its feature."""
    w = Window.partitionBy(*keys, "feature")
    n = nulls.join(eps, keys) if isinstance(eps, DataFrame) else nulls.withColumn("eps", F.lit(eps))
    others = safe_div(F.sum(stat).over(w) - F.col(stat), F.count(stat).over(w) - 1)
    return n.withColumn("_others", others).withColumn(
        "ratio",
        clipped_ratio((F.col(stat) + F.col("eps")) / (F.col("_others") + F.col("eps")), width),
    )


def ratio_summary(ratios: DataFrame, keys: list[str], width: float = 4) -> DataFrame:
    """Centre, spread and shares of calibrated ratios."""
    r, log = F.col("ratio"), F.log2("ratio")
    return ratios.groupBy(*keys).agg(
        F.count("ratio").alias("n_values"),
        F.percentile("ratio", F.lit(0.5)).alias("median_ratio"),
        F.avg(log).alias("mean_log2"),
        F.stddev_samp(log).alias("sd_log2"),
        share((r >= 0.5) & (r <= 2)).alias("share_half_two"),
        share(r > 2).alias("share_above_two"),
        share(r < 0.5).alias("share_below_half"),
        share(log <= -width + 1e-9).alias("share_at_floor"),
        share(log >= width - 1e-9).alias("share_at_ceiling"),
    )


UTILITY_FLOOR = 1e-5  # square root of the constant inside the utility score


def null_gene_level(
    observed: DataFrame,
    nulls: DataFrame,
    keys: list[str],
    stat: str,
    eps: DataFrame,
    floor: float = UTILITY_FLOOR,
    bounded: bool = False,
) -> DataFrame:
    """Per feature: moments of its nulls, observed ratio, ranges under leave-one-permutation-out.

    ``obs_bin`` is 0 at the utility floor and the decile (1..10) of the values above it.
    """
    on = [*keys, "feature"]
    x = nulls.select(*on, F.col(stat).alias("_x")).join(
        observed.select(*on, F.col(stat).alias("obs")), on
    ).join(eps, keys)
    w = Window.partitionBy(*on)
    others = safe_div(F.sum("_x").over(w) - F.col("_x"), F.count("_x").over(w) - 1)
    x = x.withColumn("_others", others)
    e = F.col("eps")
    x = x.withColumn("_lopo", clipped_ratio((F.col("_x") + e) / (F.col("_others") + e), 4)).withColumn(
        "_obs", clipped_ratio((F.col("obs") + e) / (F.col("_others") + e), 4)
    )
    g = x.groupBy(*on, "obs", "eps").agg(
        F.avg("_x").alias("null_mean"),
        F.stddev_samp("_x").alias("null_sd"),
        F.count_if(F.col("_x") > 0).alias("null_n_positive"),
        F.max("_x").alias("null_max"),
        F.min("_lopo").alias("lopo_min"),
        F.max("_lopo").alias("lopo_max"),
        (F.log2(F.max("_lopo")) - F.log2(F.min("_lopo"))).alias("lopo_log2_range"),
        F.max(((F.col("_lopo") < 0.5) | (F.col("_lopo") > 2)).cast("int")).alias("lopo_outside"),
        (F.log2(F.max("_obs")) - F.log2(F.min("_obs"))).alias("obs_log2_range"),
    )
    g = (
        g.withColumn(
            "null_cv", F.when(F.col("null_mean") > 0, F.col("null_sd") / F.col("null_mean"))
        )
        .withColumn(
            "ratio",
            clipped_ratio((F.col("obs") + F.col("eps")) / (F.col("null_mean") + F.col("eps")), 4),
        )
        .withColumn("at_floor", F.col("obs") <= floor * 1.0001)
    )
    free = clipped_ratio((F.col("obs") + 1e-12) / (F.col("null_mean") + 1e-12), 4)
    g = g.withColumn("eps_log2", F.log2("ratio") - F.log2(free))
    above = g.where(~F.col("at_floor"))
    n = above.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bins = (
        average_ranks(above.select(*on, "obs"), keys, "obs", "_r", bounded=bounded)
        .join(n, keys)
        .select(*on, F.ceil(10 * F.col("_r") / F.col("_n")).cast("int").alias("obs_bin"))
    )
    return g.join(bins, on, "left").withColumn("obs_bin", F.coalesce("obs_bin", F.lit(0)))


def null_bin_summary(gene_level: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of the null diagnostics per observed-utility bin."""
    half = F.lit(0.5)
    return gene_level.groupBy(*keys, "obs_bin").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.percentile("obs", half).alias("median_obs"),
        share(F.col("at_floor")).alias("share_at_floor"),
        F.percentile("null_mean", half).alias("median_null_mean"),
        F.percentile("null_cv", half).alias("median_null_cv"),
        share(F.col("null_mean") == 0).alias("share_null_zero"),
        F.percentile("null_n_positive", half).alias("median_n_positive"),
        F.percentile("lopo_log2_range", half).alias("median_lopo_range"),
        F.avg("lopo_outside").alias("share_lopo_outside"),
        F.percentile("obs_log2_range", half).alias("median_obs_range"),
        F.percentile("ratio", half).alias("median_ratio"),
        F.percentile("eps_log2", half).alias("median_eps_log2"),
    )


def null_floor_summary(gene_level: DataFrame, keys: list[str]) -> DataFrame:
    """How much of a split sits at the floor or is set by epsilon; shares of the top features."""
    w = Window.partitionBy(*keys).orderBy(F.col("obs").desc(), "feature")
    top = (
        gene_level.select(*keys, "feature", "obs")
        .withColumn("_r", F.row_number().over(w))
        .where("_r <= 50")
        .groupBy(*keys)
        .agg(F.sum(F.when(F.col("_r") <= 10, F.col("obs"))).alias("t10"), F.sum("obs").alias("t50"))
    )
    half = F.lit(0.5)
    return (
        gene_level.groupBy(*keys, "eps")
        .agg(
            share(F.col("at_floor")).alias("share_at_floor"),
            F.count_if(~F.col("at_floor")).alias("n_above_floor"),
            F.sum("obs").alias("_total"),
            share(F.col("null_mean") == 0).alias("share_null_zero"),
            F.percentile("null_mean", half).alias("median_null_mean"),
            F.percentile(F.col("null_mean") / F.col("eps"), half).alias("median_null_over_eps"),
            F.percentile("null_cv", half).alias("median_null_cv"),
            share(F.col("null_cv") > 1).alias("share_cv_above_1"),
            F.percentile("null_n_positive", half).alias("median_n_positive"),
            share(F.col("obs") < 0.01 * F.col("eps")).alias("share_numerator_eps"),
            share(F.col("null_mean") < 0.01 * F.col("eps")).alias("share_denominator_eps"),
            F.percentile(
                F.when(F.col("at_floor"), F.col("null_mean") / F.col("eps")), half
            ).alias("median_floor_null_over_eps"),
        )
        .join(top, keys)
        .withColumn("top10_share", safe_div(F.col("t10"), F.col("_total")))
        .withColumn("top50_share", safe_div(F.col("t50"), F.col("_total")))
        .drop("_total", "t10", "t50")
    )


def eps_sensitivity(
    observed: DataFrame, nulls: DataFrame, keys: list[str], stat: str, eps: DataFrame
) -> DataFrame:
    """Leave-one-out and observed ratios under the saved epsilon, a hundredth of it, and 1e-6."""
    variants = eps.select(
        *keys,
        F.explode(
            F.create_map(
                F.lit("saved"), F.col("eps"),
                F.lit("saved_over_100"), F.col("eps") / 100,
                F.lit("fixed_1e_6"), F.lit(1e-6),
            )
        ).alias("variant", "eps"),
    )
    more = [*keys, "variant"]
    lopo = lopo_ratio(nulls.join(variants.select(*more), keys), more, stat, variants)
    obs = evidence_ratio(
        observed.join(variants.select(*more), keys),
        nulls.join(variants.select(*more), keys),
        more,
        stat,
        variants,
    )
    a = ratio_summary(lopo, more).select(
        *more,
        F.col("median_ratio").alias("lopo_median"),
        F.col("sd_log2").alias("lopo_sd_log2"),
        F.col("share_half_two").alias("lopo_half_two"),
        F.col("share_at_floor").alias("lopo_at_floor"),
    )
    b = ratio_summary(obs, more).select(
        *more,
        F.col("median_ratio").alias("obs_median"),
        F.col("sd_log2").alias("obs_sd_log2"),
        F.col("share_half_two").alias("obs_half_two"),
    )
    return a.join(b, more)


def variance_split(
    nulls: DataFrame, keys: list[str], stat: str, eps: DataFrame
) -> DataFrame:
    """Spread of the leave-one-out log ratios between features, inside features, and its parts."""
    on = [*keys, "feature"]
    w = Window.partitionBy(*on)
    x = lopo_ratio(nulls, keys, stat, eps).withColumn("_l", F.log2("ratio"))
    x = x.withColumn("_mean", F.avg(stat).over(w)).withColumn(
        "_own", F.log2((F.col(stat) + F.col("eps")) / (F.col("_mean") + F.col("eps")))
    )
    per = x.groupBy(*on).agg(
        F.avg("_l").alias("m"), F.var_samp("_l").alias("v"), F.var_samp("_own").alias("o")
    )
    total = x.groupBy(*keys).agg(F.stddev_samp("_l").alias("total_sd"))
    return (
        per.groupBy(*keys)
        .agg(
            F.stddev_samp("m").alias("between_sd"),
            F.sqrt(F.avg("v")).alias("within_sd"),
            F.sqrt(F.avg("o")).alias("own_spread_sd"),
            F.sqrt(F.greatest(F.avg("v") - F.avg("o"), F.lit(0.0))).alias("reference_noise_sd"),
        )
        .join(total, keys)
    )


def instance_frequency(
    contributions: DataFrame, keys: list[str], bounded: bool = False
) -> DataFrame:
    """Share of samples where a feature's contribution reaches the sample's upper quartile.

    The quartile is taken over the positive contributions of the sample; a sample without any
    counts for no feature.
    """
    on = [*keys, "sample_id"]
    positive = contributions.where("value > 0")
    cut = group_quantiles(positive, on, "value", {"cut": 0.75}, bounded)
    n = contributions.groupBy(*keys).agg(F.count_distinct("sample_id").alias("_n"))
    hits = (
        contributions.join(cut, on)
        .where(F.round("value", 12) >= F.round("cut", 12))
        .groupBy(*keys, "feature")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    everyone = contributions.select(*keys, "feature").distinct()
    return (
        everyone.join(hits, [*keys, "feature"], "left")
        .join(n, keys)
        .select(*keys, "feature", (F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("frequency"))
    )


def utility_score(
    frequency: DataFrame, information: DataFrame, keys: list[str], bounded: bool = False
) -> DataFrame:
    """Percentile of the geometric mean of instance frequency and information percentiles."""
    both = frequency.join(information, [*keys, "feature"])
    small = bounded or fits_one_task(frequency)  # one row per feature, like everything below
    a = percentile01(both, keys, "frequency", "_f", bounded=small)
    a = percentile01(a, keys, "mi", "_i", bounded=small)
    raw = F.round(F.sqrt(F.col("_f") * F.col("_i") + 1e-10), 12)
    out = percentile01(a.withColumn("raw", raw), keys, "raw", "utility", bounded=small)
    return out.drop("_f", "_i")


def combine_scores(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """Weighted geometric mean of score columns; 0 where a positively weighted score is 0."""
    total = sum(weights.values())
    logs = sum((w / total) * F.log(F.col(c)) for c, w in weights.items())
    zero = F.least(*[F.col(c) for c, w in weights.items() if w > 0], F.lit(float("inf"))) <= 0
    return df.withColumn(name, F.when(zero, 0.0).otherwise(F.exp(logs)))


def component_rankings(
    scores: DataFrame,
    keys: list[str],
    components: dict[str, tuple[str, str]],
    bounded: bool = False,
) -> DataFrame:
    """The same table ranked by each component: (main score, raw score) and the name on ties."""
    rows = scores.select(
        *keys,
        "feature",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("method"),
                        F.col(a).cast("double").alias("score"),
                        F.col(b).cast("double").alias("raw"),
                    )
                    for n, (a, b) in components.items()
                ]
            )
        ).alias("c"),
    ).select(*keys, "feature", "c.*")
    then = [F.col("raw").desc_nulls_last()]
    return numbered(rows, [*keys, "method"], "score", "feature", then=then, bounded=bounded)


def label_matrix(samples: DataFrame, keys: list[str], m: int, seed: int) -> DataFrame:
    """keys, sample_id and ``labels``: the observed label, that of the self-test permutation, then of ``m`` others."""
    shuffled = permute_labels(samples, m + 1, seed, keys, first=0)
    real = samples.select(*keys, F.lit(-1).alias("perm_id"), "sample_id", "label")
    each_label = F.struct("perm_id", F.col("label").cast("tinyint").alias("label"))
    rows = shuffled.select(*keys, "perm_id", "sample_id", "label").unionByName(real)
    return rows.groupBy(*keys, "sample_id").agg(F.array_sort(F.collect_list(each_label)).alias("_l")).select(
        *keys, "sample_id", F.col("_l.label").alias("labels")
    )


def permutation_t(
    features: DataFrame, samples: DataFrame, keys: list[str], m: int, seed: int
) -> DataFrame:
    """keys, feature and ``abs_t``: |t| under the observed labels, a self-test permutation and ``m`` null ones.

    A permutation only moves samples between the classes: with the totals known, the sums over the positive samples
    give both means and the pooled variance. They come for all permutations at once from the product of a piece of
    the feature matrix with the label matrix of the same samples, and are added up over the pieces. An entry is NULL
    where the feature does not vary inside the classes.
    """
    index = cut_lineage(feature_index(features, keys))
    cells = pieces(features, index, keys)
    shares = cells.select(*keys, "piece", F.explode("s").alias("s")).distinct()
    labels = label_matrix(samples, keys, m, seed).withColumn("s", F.xxhash64("sample_id"))
    rows = labels.join(shares, [*keys, "s"]).groupBy(*keys, "piece").agg(
        F.array_sort(F.collect_list(F.struct("s", "labels"))).alias("l")
    )
    both = cells.join(rows.select(*keys, "piece", F.col("l.labels").alias("l")), [*keys, "piece"])
    fields = [cells.schema[k] for k in keys]

    def multiply(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, first, x, raw = piece_matrix(r.s, r.i, r.v, r.m)
                label = np.vstack(list(r.l)).astype(float)
                if len(label) != len(ids):
                    raise ValueError("a sample has features but no label, or more than one")
                row = {k: getattr(r, k) for k in keys} | {"first": first, "n": len(ids), "width": x.shape[1]}
                parts = {"n1": label.sum(0), "s1": x.T @ label, "s": x.sum(0), "q": (x * x).sum(0), "raw": raw}
                yield pd.DataFrame([row | {k: v.tobytes() for k, v in parts.items()}])

    blobs = ["n1", "s1", "s", "q", "raw"]
    sums = [StructField("first", IntegerType()), StructField("n", IntegerType()), StructField("width", IntegerType())]
    products = both.mapInPandas(multiply, StructType([*fields, *sums, *[StructField(c, BinaryType()) for c in blobs]]))

    def statistics(key, parts):
        n1, s1, s, q, raw = (sum(np.frombuffer(b) for b in parts[c]) for c in blobs)
        n, width = int(parts["n"].sum()), int(parts["width"].iloc[0])
        s1, n0 = s1.reshape(width, -1), n - n1
        with np.errstate(invalid="ignore", divide="ignore"):
            m1, m0 = s1 / n1, (s[:, None] - s1) / n0
            rest = q[:, None] - n1 * m1 * m1 - n0 * m0 * m0
            t = np.abs(m1 - m0) / np.sqrt(rest / (n - 2) * (1 / n1 + 1 / n0))
        varies = (rest > ROUNDING * raw[:, None]) & (n1 > 0) & (n0 > 0) & (n > 2)
        out = pd.DataFrame({"idx": key[-1] + np.arange(width)})
        out["abs_t"] = [[v if ok else None for v, ok in zip(a, b)] for a, b in zip(t.tolist(), varies.tolist())]
        for k, v in zip(keys, key):
            out[k] = pd.Series([v] * len(out), dtype=object)
        return out

    scored = products.groupBy(*keys, "first").applyInPandas(
        statistics, StructType([StructField("idx", IntegerType()), StructField("abs_t", ArrayType(DoubleType())), *fields])
    )
    return scored.join(index, [*keys, "idx"]).select(*keys, "feature", "abs_t")


def _set_statistics(t: DataFrame, feature_sets: DataFrame, keys: list[str], minimum: int):
    """``stats``: mean |t| over the members of every set, permutation by permutation; small sets drop.

    The sets are a sparse matrix of zeros and ones: its product with the |t| of the features is a grouped sum of vectors.
    """
    members = feature_sets.select("set_id", "feature").distinct()
    zeros = F.transform("abs_t", lambda x: F.coalesce(x, F.lit(0.0)))
    known = F.transform("abs_t", lambda x: F.when(x.isNull(), 0.0).otherwise(1.0))
    some = t.withColumn("_t", array_to_vector(zeros)).withColumn("_k", array_to_vector(known))
    summed = (
        some.join(members, "feature")
        .groupBy(*keys, "set_id")
        .agg(
            F.count_if(F.exists("abs_t", lambda x: x.isNotNull())).alias("n_members"),
            Summarizer.sum(F.col("_t")).alias("_t"),
            Summarizer.sum(F.col("_k")).alias("_k"),
        )
    )
    means = F.zip_with(vector_to_array("_t"), vector_to_array("_k"), lambda a, b: F.when(b > 0, a / b))
    return summed.where(F.col("n_members") >= minimum).select(*keys, "set_id", "n_members", means.alias("stats"))


def _nulls(stats: str = "stats"):
    return F.slice(stats, 3, F.size(stats))


def _mean(values):
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(values))


def set_gate(
    t: DataFrame, feature_sets: DataFrame, keys: list[str], m: int, minimum: int = 10
) -> DataFrame:
    """Permutation p and q of every set, and the same for the self-test permutation.

    ``t`` comes from ``permutation_t`` with ``m`` permutations. A set below ``minimum`` members that vary is left out.
    """
    stats = _set_statistics(t, feature_sets, keys, minimum)
    stats = stats.withColumn("stat_obs", F.col("stats")[0]).withColumn("stat_self", F.col("stats")[1])

    def tail(of: str):
        return (1 + F.size(F.filter(_nulls(), lambda x: x >= F.col(of)))) / (m + 1)

    g = stats.select(
        *keys,
        "set_id",
        "n_members",
        "stat_obs",
        "stat_self",
        _mean(_nulls()).alias("null_mean"),
        tail("stat_obs").alias("p"),
        tail("stat_self").alias("p_self"),
    )
    g = cut_lineage(g)
    small = fits_one_task(g)
    g = bh_adjust(g, keys, "p", "q", bounded=small)
    return bh_adjust(g, keys, "p_self", "q_self", bounded=small)


def certified_features(
    gate: DataFrame,
    feature_sets: DataFrame,
    pools: DataFrame,
    keys: list[str],
    levels: Sequence[float] = (0.05, 0.1, 0.2),
) -> DataFrame:
    """Pool features in at least one set with q at or below each level."""
    rows = gate.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    return (
        rows.where(F.col("q") <= F.col("level"))
        .join(feature_sets.select("set_id", "feature"), "set_id")
        .select(*keys, "level", "feature")
        .distinct()
        .join(pools.select(*keys, "feature"), [*keys, "feature"], "left_semi")
    )


def set_scores(
    t: DataFrame, feature_sets: DataFrame, keys: list[str], minimum: int = 10
) -> DataFrame:
    """z of each set's statistic against its permutation null; 0 without spread."""
    stats = _set_statistics(t, feature_sets, keys, minimum)
    stats = stats.withColumn("null_mean", _mean(_nulls()))
    squares = F.aggregate(
        _nulls(), F.lit(0.0), lambda s, x: s + (x - F.col("null_mean")) * (x - F.col("null_mean"))
    )
    sd = F.sqrt(squares / F.nullif(F.size(_nulls()) - 1, F.lit(0)))
    return stats.select(
        *keys,
        "set_id",
        F.col("stats")[0].alias("stat_obs"),
        "null_mean",
        F.coalesce(safe_div(F.col("stats")[0] - F.col("null_mean"), sd), F.lit(0.0)).alias("z"),
    )
