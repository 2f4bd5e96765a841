"""Selection frequency and held-out utility of every feature, judged by the same fits under permuted labels.

In every split elastic nets are fitted to resamples of the training samples, the mix is chosen by the mean
held-out AUC, and the fits are repeated with permuted labels. Both statistics of a permutation come from the same
fits, which is what makes their joint null valid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import numbered_copies
from sievework.operators.evidence import joint_null, selection_frequency, sign_consistency, utility_of_rises
from sievework.operators.folds import subsamples
from sievework.operators.models import choose_alpha
from sievework.operators.penalised import permuted_fits, resample_fits
from sievework.operators.preparation import standardise
from sievework.session import cut_lineage, stored


def statistics(coefs: DataFrame, fits: DataFrame, pool: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    """``pi`` and ``u`` of every feature of ``pool`` (keys, feature): selection frequency and utility, 0 if never chosen."""
    frequency = selection_frequency(coefs, keys, resamples).select(*keys, "feature", F.col("frequency").alias("pi"))
    on = [*keys, "resample_id"]
    utility = utility_of_rises(coefs, fits, keys, on).select(*keys, "feature", F.col("utility").alias("u"))
    both = pool.join(frequency, [*keys, "feature"], "left").join(utility, [*keys, "feature"], "left")
    return both.fillna(0.0, subset=["pi", "u"])


def training_part(samples: DataFrame, features: DataFrame, folds: DataFrame, split: list[str]):
    """Labels and z-scores of the training samples of every split."""
    train = folds.where("role = 'train'").select(*split, "sample_id")
    labels = train.join(samples.select("dataset", "sample_id", "label"), ["dataset", "sample_id"])
    z = standardise(features, folds, split).where("role = 'train'").drop("role")
    return cut_lineage(labels.select(*split, "sample_id", "label")), stored(z)


def null_study(
    samples: DataFrame,
    features: DataFrame,
    folds: DataFrame,
    split: list[str],
    alphas: Sequence[float] = (0.5, 1.0),
    resamples: int = 50,
    permutations: int = 100,
    null_resamples: int = 20,
    k: int = 5,
    seed: int = 123,
) -> DataFrame:
    """Features of every split ranked by the joint null of their selection frequency and utility.

    Returns split, feature, alpha, pi, u, sign_consistency, e_pi, e_u, t_obs, n_null, p and rank. ``folds`` holds
    split, sample_id and role; ``split`` begins with the dataset. Only training samples are read.
    """
    labels, z = training_part(samples, features, folds, split)
    pool = cut_lineage(z.select(*split, "feature").distinct())

    drawn = subsamples(labels, resamples, k, seed, by=split)
    coefs, fits = resample_fits(z, drawn, split, ["resample_id"], alphas, k, seed, least=0.05)
    alpha = cut_lineage(choose_alpha(fits, split).select(*split, "alpha"))
    coefs, fits = coefs.join(alpha, [*split, "alpha"]), fits.join(alpha, [*split, "alpha"])
    observed = cut_lineage(statistics(coefs, fits, pool, split, resamples))

    per = [*split, "perm_id"]
    null_coefs, null_fits = permuted_fits(
        z, labels, split, alpha, permutations, null_resamples, k, seed, least=0.05
    )
    every = numbered_copies(pool, "perm_id", permutations)
    nulls = cut_lineage(statistics(null_coefs, null_fits, every, per, null_resamples))

    judged = joint_null(observed, nulls, split)
    signs = sign_consistency(coefs, split)
    return judged.join(signs, [*split, "feature"], "left").join(alpha, split)
