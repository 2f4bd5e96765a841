"""Which ranking method beats matched random panels, and by how much?

Rankings, panels and random panels of the same pool are each one lazy DataFrame over the split
tables and the training scores; a panel predicts by the mean of its sign-aligned z-scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.columns import each
from sievework.functions.ordering import fits_one_task
from sievework.operators.folds import fold_roles, random_panels, repeated_cv
from sievework.operators.metrics import delta_by_k
from sievework.operators.preparation import standardise
from sievework.operators.ranking import top_k
from sievework.operators.scores import auc_score, pooled_t
from sievework.session import cut_lineage

SPLIT = ["dataset", "repeat_idx", "fold_idx"]


def train_scores(labelled: DataFrame, folds: DataFrame, bounded: bool = False) -> DataFrame:
    """|t|, |AUC - .5| and the sign of the effect of every feature on the training samples.

    Scores are rounded so that equal effects tie in whatever order they were summed.
    """
    train = folds.where("role = 'train'").select(*SPLIT, "sample_id")
    rows = labelled.join(train, ["dataset", "sample_id"])
    key = [*SPLIT, "feature"]
    t = pooled_t(rows, key).select(*key, F.coalesce("t", F.lit(0.0)).alias("t"))
    a = auc_score(rows, key, score="value", bounded=bounded).select(*key, "auc")
    return t.join(a, key).select(
        *key,
        F.signum("t").alias("sign"),
        F.round(F.abs("t"), 9).alias("t_test"),
        F.round(F.abs(F.coalesce("auc", F.lit(0.5)) - 0.5), 9).alias("auc_test"),
    )


def train_rankings(scores: DataFrame, largest: int) -> DataFrame:
    """The first ``largest`` features of a split by each score."""
    scored = scores.unpivot([*SPLIT, "feature", "sign"], ["t_test", "auc_test"], "method", "score")
    w = Window.partitionBy(*SPLIT, "method").orderBy(F.col("score").desc(), "feature")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= largest)


def evaluate_panels_by_mean(
    z_test: DataFrame, panels: DataFrame, keys: list[str], bounded: bool = False
) -> DataFrame:
    """AUC of every panel on the test samples; the score is the mean of sign * z."""
    scored = (
        z_test.join(panels, [*SPLIT, "feature"])
        .groupBy(*keys, "sample_id", "label")
        .agg(F.round(F.avg(F.col("sign") * F.col("value")), 9).alias("score"))
    )
    return auc_score(scored, keys, bounded=bounded)


def benchmark(
    samples: DataFrame,
    labelled: DataFrame,
    k: int = 5,
    repeats: int = 3,
    ks: Sequence[int] = (10, 20, 50),
    draws: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Evaluation rows ``dataset, repeat_idx, fold_idx, method, k, auc``.

    Methods are the two rankings and ``Random``, the mean over matched random panels.
    """
    few_cells = fits_one_task(labelled, k * repeats)
    few_scores = fits_one_task(samples, repeats * len(ks) * (draws + 2))
    # split tables and training scores are read by every later step: computed once, kept on disk
    folds = cut_lineage(fold_roles(repeated_cv(samples, k, repeats, seed), k).drop("fold"))
    features = labelled.drop("label")
    z = standardise(features, folds, SPLIT).where("role = 'test'").drop("role")
    z = z.join(samples.select("dataset", "sample_id", "label"), ["dataset", "sample_id"])
    scores = cut_lineage(train_scores(labelled, folds, few_cells))
    ranked = train_rankings(scores, max(ks))
    panels = top_k(ranked, [*SPLIT, "method"], ks)
    key = [*SPLIT, "method", "k"]
    real = evaluate_panels_by_mean(z, panels.select(*key, "feature", "sign"), key, few_scores)
    pool = scores.select(*SPLIT, "feature", "sign")
    drawn = random_panels(pool.select(*SPLIT, "feature"), max(ks), draws, seed, SPLIT)
    drawn = each(drawn, "k", sorted(ks)).where("position <= k").join(pool, [*SPLIT, "feature"])
    rkey = [*SPLIT, "k", "draw_id"]
    chance = evaluate_panels_by_mean(z, drawn.select(*rkey, "feature", "sign"), rkey, few_scores)
    mean = chance.groupBy(*SPLIT, "k").agg(F.avg("auc").alias("auc"))
    return real.select(*key, "auc").unionByName(
        mean.withColumn("method", F.lit("Random")).select(*key, "auc")
    )


def methods_vs_random(samples: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """Gain of each method over random, per dataset and panel size."""
    return delta_by_k(benchmark(samples, labelled, **options))
