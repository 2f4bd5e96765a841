"""Operations on ranking tables (``rank`` is a column, 1 is best)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.columns import each, safe_div
from sievework.functions.ordering import leading, numbered
from sievework.session import cut_lineage, settled


def rerank(rankings: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """Close the gaps of a ranking after rows were removed."""
    old = rankings.withColumnRenamed("rank", "_old")
    return numbered(old, keys, "_old", "feature", "rank", False, bounded=bounded).drop("_old")


def top_k(
    rankings: DataFrame,
    keys: list[str],
    ks: Sequence[int],
    allowed: DataFrame | None = None,
    allowed_on: Sequence[str] = ("feature",),
    strict: bool = False,
) -> DataFrame:
    """The first k features of every ranking, one panel per k.

    ``allowed`` restricts the features before the cut. With ``strict`` a panel with fewer than k
    features raises an error when it is read.
    """
    kept = rankings.where(F.col("rank") <= max(ks))
    if allowed is not None:
        inside = rankings.join(allowed.select(*allowed_on).distinct(), list(allowed_on), "left_semi")
        w = Window.partitionBy(*keys).orderBy("rank", "feature")
        kept = (
            inside.withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= max(ks))
            .drop("rank")
            .withColumnRenamed("_r", "rank")
        )
    panels = each(kept, "k", sorted(ks)).where("rank <= k")
    if strict:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "k"))
        message = F.concat(F.lit("ranking holds fewer than "), F.col("k"), F.lit(" features"))
        panels = panels.withColumn("_n", n).where(
            F.when(F.col("_n") < F.col("k"), F.raise_error(message).cast("boolean")).otherwise(True)
        )
        panels = panels.drop("_n")
    return panels


def rank_average(
    rankings: DataFrame,
    pools: DataFrame,
    keys: list[str],
    lists: str = "method",
    bounded: bool = False,
) -> DataFrame:
    """Mean rank over the lists of a group; ties keep the pool order (feature name).

    A feature missing in a list counts as that list's length plus its pool position / (n + 1).
    The sum over missing lists is had from the total of all lengths, so no grid is built.
    """
    flat = pools.withColumn("_z", F.lit(0.0))
    pool = numbered(flat, keys, "_z", "feature", "pos", False, bounded=bounded).drop("_z")
    n_pool = pools.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pool"))
    per_list = rankings.groupBy(*keys, lists).agg(F.max("rank").alias("len"))
    totals = per_list.groupBy(*keys).agg(
        F.sum("len").alias("all_len"), F.count(F.lit(1)).alias("n_lists")
    )
    seen = (
        rankings.join(per_list, [*keys, lists])
        .groupBy(*keys, "feature")
        .agg(F.sum(F.col("rank") - F.col("len")).alias("gain"), F.count(F.lit(1)).alias("seen"))
    )
    scored = (
        pool.join(n_pool, keys)
        .join(totals, keys)
        .join(seen, [*keys, "feature"], "left")
        .fillna(0, subset=["gain", "seen"])
        .withColumn(
            "mean_rank",
            (
                F.col("all_len")
                + F.col("gain")
                + (F.col("n_lists") - F.col("seen")) * F.col("pos") / (F.col("n_pool") + 1)
            )
            / F.col("n_lists"),
        )
    )
    scored = scored if bounded else cut_lineage(scored)  # ordering in slices reads its rows several times
    return numbered(
        scored, keys, "mean_rank", "feature", descending=False, then=[F.col("pos")], bounded=bounded
    )


def switch_ranking(panels: DataFrame, cut: int, small: str, large: str, name: str) -> DataFrame:
    """One method's panels up to ``cut`` features, another's above it."""
    chosen = F.when(F.col("k") <= cut, F.lit(small)).otherwise(F.lit(large))
    return panels.where(F.col("method") == chosen).withColumn("method", F.lit(name))


def consensus_rank(
    rankings: DataFrame,
    keys: list[str],
    lists: list[str],
    universe: DataFrame | None = None,
    bounded: bool = False,
    first: int | None = None,
) -> DataFrame:
    """Mean reciprocal rank over all lists (absent = 0), then frequency, mean rank and name.

    ``universe`` keeps only features that exist there, after the scores were computed. With ``first`` only the rows
    up to that rank are returned, and the others are not ordered.
    """
    n_lists = rankings.select(*keys, *lists).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n")
    )
    scored = (
        rankings.groupBy(*keys, "feature")
        .agg(
            F.sum(1.0 / F.col("rank")).alias("_rr"),
            F.count(F.lit(1)).alias("_seen"),
            F.avg("rank").alias("mean_observed_rank"),
        )
        .join(n_lists, keys)
        .withColumn("mean_reciprocal_rank", F.round(F.col("_rr") / F.col("_n"), 12))
        .withColumn("appearance_frequency", F.col("_seen") / F.col("_n"))
        .drop("_rr", "_seen", "_n")
    )
    if universe is not None:
        scored = scored.join(universe.select("feature").distinct(), "feature", "left_semi")
    scored = scored if bounded else cut_lineage(scored)  # read several times below
    if first is not None:
        scored = leading(scored, keys, "mean_reciprocal_rank", "feature", first)
    ranked = numbered(
        scored,
        keys,
        "mean_reciprocal_rank",
        "feature",
        then=[F.col("appearance_frequency").desc(), F.col("mean_observed_rank").asc()],
        bounded=bounded or first is not None,
    )
    return ranked if first is None else ranked.where(F.col("rank") <= first)


def soft_prior(
    rankings: DataFrame,
    feature_sets: DataFrame,
    z: DataFrame,
    w: float,
    keys: list[str],
    bounded: bool = False,
) -> DataFrame:
    """Score times 1 + w * max(0, best z of the feature's sets); ties keep the input order."""
    best = (
        feature_sets.join(z, "set_id")
        .groupBy(*[k for k in keys if k in z.columns], "feature")
        .agg(F.max("z").alias("best_z"))
    )
    on = [*[k for k in keys if k in z.columns], "feature"]
    boosted = rankings.join(best, on, "left").withColumn(
        "boosted",
        F.col("score") * (1 + F.lit(float(w)) * F.greatest(F.coalesce("best_z", F.lit(0.0)), F.lit(0.0))),
    )
    placed = boosted.withColumnRenamed("rank", "pos")
    return numbered(
        placed, keys, "boosted", "feature", then=[F.col("pos").asc()], bounded=bounded
    )


def gated_ranking(
    rankings: DataFrame,
    certified: DataFrame,
    keys: list[str],
    minimum: int = 10,
    bounded: bool = False,
) -> DataFrame:
    """Keep certified features, unless a split has fewer than ``minimum`` of them.

    Such a split falls back to its whole ranking, flagged by ``gate_fallback``.
    """
    cert = certified.select(*keys, "feature").distinct().withColumn("_c", F.lit(True))
    marked = rankings.join(cert, [*keys, "feature"], "left")
    counts = marked.groupBy(*keys).agg(F.count("_c").alias("n_certified"))
    kept = (
        marked.join(counts, keys)
        .withColumn("gate_fallback", F.col("n_certified") < minimum)
        .where("gate_fallback or _c")
        .drop("_c")
    )
    return rerank(kept, keys, bounded)


def prefilter_rank(
    primary: DataFrame, filter_by: DataFrame, m: int, keys: list[str]
) -> DataFrame:
    """The order of one ranking inside the top m of another."""
    inside = filter_by.where(F.col("rank") <= m).select(*keys, "feature")
    kept = primary.join(inside, [*keys, "feature"], "left_semi")
    w = Window.partitionBy(*keys).orderBy("_old", "feature")  # at most m rows per group
    return kept.withColumnRenamed("rank", "_old").withColumn("rank", F.row_number().over(w)).drop("_old")


def rank_percentile(rankings: DataFrame, keys: list[str]) -> DataFrame:
    """1 for the best rank down to 0; 1 in a ranking of one."""
    n = rankings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (
        rankings.join(n, keys)
        .withColumn(
            "rank_percentile",
            F.when(F.col("_n") > 1, 1 - (F.col("rank") - 1) / (F.col("_n") - 1)).otherwise(1.0),
        )
        .drop("_n")
    )


def adaptive_k(inner: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest k whose mean inner value reaches the best mean minus its standard error.

    The first k (ascending) wins among equal means. One row per group of ``keys``.
    """
    curve = inner.groupBy(*keys, "k").agg(
        F.avg("auc").alias("m"), (F.stddev_samp("auc") / F.sqrt(F.count("auc"))).alias("se")
    )
    best = curve.groupBy(*keys).agg(
        F.max(F.struct("m", -F.col("k"), "se")).alias("b")
    ).select(
        *keys,
        (-F.col("b.col2")).alias("best_inner_k"),
        F.col("b.m").alias("best_inner_mean"),
        F.col("b.se").alias("best_inner_se"),
        (F.col("b.m") - F.coalesce("b.se", F.lit(0.0))).alias("one_se_threshold"),
    )
    return (
        curve.join(best, keys)
        .where("m >= one_se_threshold")
        .groupBy(*keys, "best_inner_k", "best_inner_mean", "best_inner_se", "one_se_threshold")
        .agg(F.min("k").alias("chosen_k"))
    )


def adaptive_outcome(chosen: DataFrame, outer: DataFrame, split: list[str]) -> DataFrame:
    """Outer value and matched random value at the chosen size."""
    real = outer.where("method != 'Random'").select(
        *split, "method", F.col("k").alias("chosen_k"), F.col("auc").alias("outer_auc")
    )
    base = outer.where("method = 'Random'").select(
        *split, F.col("k").alias("chosen_k"), F.col("auc").alias("random_auc")
    )
    return (
        chosen.join(real, [*split, "method", "chosen_k"])
        .join(base, [*split, "chosen_k"])
        .withColumn("outer_delta", F.col("outer_auc") - F.col("random_auc"))
    )


def lock_panels(
    rankings: DataFrame,
    keys: list[str],
    lists: list[str],
    ks: Sequence[int],
    universe: DataFrame,
    minimum_coverage: float,
    provenance: dict[str, str],
    bounded: bool = False,
) -> DataFrame:
    """Consensus panels fixed for another dataset, with coverage there and provenance columns.

    A panel whose share of measurable features is under ``minimum_coverage`` is marked unusable.
    """
    consensus = consensus_rank(rankings, keys, lists, bounded=bounded, first=max(ks))
    panels = settled(top_k(consensus, keys, ks))
    marked = panels.join(
        universe.select("feature", F.lit(1).alias("_u")).distinct(), "feature", "left"
    )
    cover = marked.groupBy(*keys, "k").agg(
        F.count("_u").alias("n_measured"), F.count(F.lit(1)).alias("n_panel")
    )
    out = (
        marked.withColumn("measured", F.col("_u").isNotNull())
        .drop("_u")
        .join(cover, [*keys, "k"])
        .withColumn("coverage", safe_div(F.col("n_measured"), F.col("n_panel")))
        .withColumn("usable", F.col("coverage") >= minimum_coverage)
    )
    for name, value in provenance.items():
        out = out.withColumn(name, F.lit(value))
    return out
