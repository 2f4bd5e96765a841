"""Enrichment of panels in feature sets, scores and graphs against matched random panels.

Random panels of one split are nested: a draw orders the pool, and its panel of size s is the
first s features. One set of draws therefore serves every panel size, and an edge belongs to the
panel of size s exactly when the later of its two positions is at most s.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.columns import clipped_ratio, each, numbered_copies, safe_div, share
from sievework.functions.ordering import average_ranks
from sievework.operators.folds import random_panels
from sievework.operators.inference import dataset_ranks
from sievework.operators.metrics import with_random
from sievework.operators.scores import equal_bins
from sievework.operators.stability import correlations
from sievework.session import cut_lineage, settled


#: Splits that a number has bits for, and splits from which on edges get their splits by joins.
WORD = 62
MOST_BITS = 1024


def co_membership_edges(feature_sets: DataFrame, panels: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pairs of one panel that share at least one set: ``keys, src, dst``.

    Only members of the same panel are paired, so a large set costs no more than the panel size
    squared.
    """
    m = panels.select(*keys, "feature").distinct().join(
        feature_sets.select("set_id", "feature").distinct(), "feature"
    )
    a = m.withColumnRenamed("feature", "src")
    b = m.withColumnRenamed("feature", "dst")
    return a.join(b, [*keys, "set_id"]).where("src < dst").select(*keys, "src", "dst").distinct()


def map_features(rows: DataFrame, id_map: DataFrame) -> DataFrame:
    """Features renamed to graph ids; unmapped ones are dropped, two on one id count once."""
    return (
        rows.join(id_map.select("feature", "id"), "feature")
        .drop("feature")
        .withColumnRenamed("id", "feature")
        .distinct()
    )


def restrict_edges(
    edges: DataFrame, pool: DataFrame, split: list[str], dedupe: bool = True
) -> DataFrame:
    """Edges with both ends in the pool of a split.

    Parallel and reversed edges count once, or separately with ``dedupe=False``. A feature's splits are numbered and
    sent as bits, so an edge is shuffled twice, however many splits its ends are in; it gets a row a split at the end.
    """
    known = " and ".join(f"`{c}` is not null" for c in [*split, "feature"])
    inside = pool.select(*split, "feature").where(known)
    e = edges.select("src", "dst")
    if dedupe:
        e = e.where("src != dst").select(
            F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
        ).distinct()
    w = Window.orderBy(*split)  # one row a split
    splits = cut_lineage(inside.select(*split).distinct().withColumn("_s", F.row_number().over(w) - 1))
    n = max(1, splits.count())
    if n > MOST_BITS:
        inside = inside.distinct()
        return e.join(inside.withColumnRenamed("feature", "src"), "src").join(
            inside.withColumnRenamed("feature", "dst"), [*split, "dst"], "left_semi"
        )
    words = -(-n // WORD)
    one = F.expr(f"shiftleft(1L, cast(_s % {WORD} as int))")
    bits = [F.bit_or(F.when(F.floor(F.col("_s") / WORD) == i, one).otherwise(F.lit(0).cast("long"))).alias(f"_{i}") for i in range(words)]
    sets = inside.join(F.broadcast(splits), split).groupBy("feature").agg(*bits)

    def of(end):
        return sets.select(F.col("feature").alias(end), *[F.col(f"_{i}").alias(f"_{end}{i}") for i in range(words)])

    both = [F.col(f"_src{i}").bitwiseAND(F.col(f"_dst{i}")).alias(f"_{i}") for i in range(words)]
    met = e.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", *both)

    def numbers(i):
        at = F.sequence(F.lit(i * WORD), F.lit(min(n, (i + 1) * WORD) - 1))
        return F.filter(at, lambda s: F.getbit(F.col(f"_{i}"), s - i * WORD) == 1)

    rows = met.where(" or ".join(f"_{i} != 0" for i in range(words)))
    rows = rows.select("src", "dst", F.explode(F.concat(*map(numbers, range(words)))).alias("_s"))
    return rows.join(F.broadcast(splits), "_s").select(*split, "dst", "src")


def edges_among(
    edges: DataFrame, pools: DataFrame, split: list[str], panels: DataFrame, positions: DataFrame | None = None
) -> DataFrame:
    """The edges of ``restrict_edges`` that have both ends in panels or random panels of the split.

    No other edge can lie inside a panel, and the edges of a pool are many times those of its panels. Random panels
    come from the pool; features of ``panels`` have to be looked up there.
    """
    members = panels.select(*split, "feature").distinct()
    members = members.join(pools.select(*split, "feature"), [*split, "feature"], "left_semi")
    if positions is not None:
        members = members.unionByName(positions.select(*split, "feature"))
    members = settled(members.distinct())
    names = settled(members.select("feature").distinct())
    near = edges.join(names.withColumnRenamed("feature", "src"), "src", "left_semi")
    near = near.join(names.withColumnRenamed("feature", "dst"), "dst", "left_semi")
    return settled(restrict_edges(near, members, split))


def induced_edge_count(
    edges: DataFrame, panels: DataFrame, keys: list[str], split: list[str], empty: str = "null"
) -> DataFrame:
    """Edges inside every panel; a panel of fewer than two features gets NULL (or 0)."""
    p = panels.select(*keys, "feature").distinct()
    inner = (
        edges.join(p.withColumnRenamed("feature", "src"), [*split, "src"])
        .join(p.withColumnRenamed("feature", "dst"), [*keys, "dst"], "left_semi")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_edges"))
    )
    sizes = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features"))
    few = F.lit(0 if empty == "zero" else None).cast("long")
    return sizes.join(inner, keys, "left").withColumn(
        "n_edges",
        F.when(F.col("n_features") < 2, few).otherwise(F.coalesce("n_edges", F.lit(0))),
    )


def _sizes(panels: DataFrame, split: list[str], size: str) -> DataFrame:
    return panels.select(*split, F.col(size).cast("long").alias("size")).distinct()


def null_score_sums(
    positions: DataFrame, scores: DataFrame, sizes: DataFrame, split: list[str]
) -> DataFrame:
    """Score sum of every random panel: ``split, size, draw_id`` and the scores' other columns.

    ``scores`` holds ``feature, score`` (and columns such as a cutoff); missing scores are 0.
    """
    extra = [c for c in scores.columns if c not in ("feature", "score", *split)]
    on = [*[c for c in split if c in scores.columns], "feature"]
    return (
        positions.join(scores, on)
        .join(sizes, split)
        .where(F.col("position") <= F.col("size"))
        .groupBy(*split, "size", "draw_id", *extra)
        .agg(F.sum("score").alias("value"))
    )


def null_edge_counts(positions: DataFrame, edges: DataFrame, sizes: DataFrame, split: list[str]):
    """Edges inside every random panel of each size; only panels with an edge have a row."""
    p = positions.select(*split, "draw_id", "feature", "position")
    level = (
        edges.join(
            p.withColumnRenamed("feature", "src").withColumnRenamed("position", "_a"),
            [*split, "src"],
        )
        .join(
            p.withColumnRenamed("feature", "dst").withColumnRenamed("position", "_b"),
            [*split, "draw_id", "dst"],
        )
        .groupBy(*split, "draw_id", F.greatest("_a", "_b").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        level.join(sizes, split)
        .where("level <= size")
        .groupBy(*split, "size", "draw_id")
        .agg(F.sum("n").cast("double").alias("value"))
    )


def empirical_summary(
    observed: DataFrame, null: DataFrame, on: list[str], draws: int, value: str = "observed"
) -> DataFrame:
    """Expected value, ratio, z and add-one p of each observed value against its null draws.

    Draws without a row are zeros, so moments use the known number of draws. The ratio is NULL
    if nothing is expected, z is NULL without spread. Values are compared at nine places: equal
    panels must tie in whatever order their scores were added.
    """
    joined = observed.join(null.select(*on, F.col("value").alias("_x")), on, "left")
    keys = observed.columns
    d = F.lit(float(draws))
    agg = joined.groupBy(*keys).agg(
        F.count("_x").alias("_n"),
        F.coalesce(F.sum("_x"), F.lit(0.0)).alias("_s"),
        F.coalesce(F.sum(F.col("_x") * F.col("_x")), F.lit(0.0)).alias("_q"),
        F.count_if(F.round("_x", 9) >= F.round(value, 9)).alias("_ge"),
    )
    zeros = F.when(F.col(value) <= 0, d - F.col("_n")).otherwise(F.lit(0.0))
    mean = F.col("_s") / d
    var = F.greatest(F.col("_q") - F.col("_s") * mean, F.lit(0.0)) / (d - 1)
    out = agg.withColumn("expected", mean).withColumn("_sd", F.sqrt(var))
    return out.select(
        *keys,
        "expected",
        F.when(F.col("expected") > 0, F.col(value) / F.col("expected")).alias("ratio"),
        F.when(F.col("_sd") > 1e-9, (F.col(value) - F.col("expected")) / F.col("_sd")).alias("z"),
        F.when(F.col(value).isNotNull(), (1 + F.col("_ge") + zeros) / (d + 1)).alias("p"),
    )


def empirical_medians(null: DataFrame, on: list[str]) -> DataFrame:
    """Median variant of the reference value; ``null`` must have a row for every draw."""
    return null.groupBy(*on).agg(F.percentile("value", F.lit(0.5)).alias("null_median"))


def fill_draws(null: DataFrame, sizes: DataFrame, split: list[str], draws: int) -> DataFrame:
    """A row for every (split, size, draw), with 0 where the panel had nothing."""
    grid = numbered_copies(sizes, "draw_id", draws)
    return grid.join(null, [*split, "size", "draw_id"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0))
    )


def edge_enrichment(
    edges: DataFrame,
    panels: DataFrame,
    pools: DataFrame,
    keys: list[str],
    split: list[str],
    largest: int,
    draws: int = 1000,
    seed: int = 1,
    minimum: int = 5,
    positions: DataFrame | None = None,
) -> DataFrame:
    """Edges inside each panel against random panels of the same mapped size from the same pool.

    Panels and pools are already in graph ids. ``largest`` is the largest panel size. Panels with
    fewer than ``minimum`` mapped features have no values. ``positions`` gives random panels drawn before.
    """
    panels = settled(panels.select(*keys, "feature"))
    if positions is None:
        positions = settled(random_panels(pools, largest, draws, seed, split))
    inside = edges_among(edges, pools, split, panels, positions)
    observed = induced_edge_count(inside, panels, keys, split).withColumnRenamed(
        "n_features", "size"
    )
    counted = observed.where(F.col("size") >= minimum)
    null = null_edge_counts(positions, inside, _sizes(counted, split, "size"), split)
    tested = empirical_summary(counted, null, [*split, "size"], draws, "n_edges")
    pairs = F.col("size") * (F.col("size") - 1) / 2
    tested = tested.withColumn("density", F.col("n_edges") / pairs)
    rest = observed.where(F.col("size") < minimum).withColumn("n_edges", F.lit(None).cast("long"))
    return tested.unionByName(rest, allowMissingColumns=True)


def co_membership_enrichment(
    feature_sets: DataFrame,
    panels: DataFrame,
    pools: DataFrame,
    keys: list[str],
    split: list[str],
    largest: int,
    draws: int = 1000,
    seed: int = 1,
    positions: DataFrame | None = None,
) -> DataFrame:
    """Pairs of a panel that share a set against random panels of the same size and pool.

    Also the number of annotated features. The pairs of the largest random panel serve all its
    prefixes.
    """
    panels = settled(panels.select(*keys, "feature"))
    if positions is None:
        positions = settled(random_panels(pools, largest, draws, seed, split))
    known = feature_sets.select("feature").distinct().withColumn("_k", F.lit(1))
    observed = (
        panels.select(*keys, "feature")
        .join(known, "feature", "left")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("size"), F.count("_k").alias("annotated"))
        .join(
            co_membership_edges(feature_sets, panels, keys)
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_pairs")),
            keys,
            "left",
        )
        .withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    )
    drawn = [*split, "draw_id"]
    pairs = co_membership_edges(feature_sets, positions, drawn)
    p = positions.select(*drawn, "feature", "position")
    level = (
        pairs.join(p.withColumnRenamed("feature", "src").withColumnRenamed("position", "_a"), [*drawn, "src"])
        .join(p.withColumnRenamed("feature", "dst").withColumnRenamed("position", "_b"), [*drawn, "dst"])
        .groupBy(*drawn, F.greatest("_a", "_b").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    null = (
        level.join(_sizes(observed, split, "size"), split)
        .where("level <= size")
        .groupBy(*split, "size", "draw_id")
        .agg(F.sum("n").cast("double").alias("value"))
    )
    return empirical_summary(observed, null, [*split, "size"], draws, "n_pairs")


def cut_scores(scores: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """Scores at or above each cutoff, one copy per cutoff; lower ones are absent (0)."""
    return each(scores, "cutoff", [float(c) for c in cutoffs]).where("score >= cutoff")


def pool_targets(pools: DataFrame, scores: DataFrame, split: list[str], cutoffs: Sequence[float]) -> DataFrame:
    """Scored features of each pool at each cutoff; all cutoffs are counted in one pass over pools and scores."""
    at = [float(c) for c in cutoffs]
    counts = (
        pools.select(*split, "feature")
        .join(scores.where(F.col("score") >= min(at)).select("feature", "score"), "feature")
        .groupBy(*split)
        .agg(*[F.count_if(F.col("score") >= c).alias(f"_{i}") for i, c in enumerate(at)])
    )
    rows = [F.struct(F.lit(c).alias("cutoff"), F.col(f"_{i}").alias("pool_targets")) for i, c in enumerate(at)]
    return counts.select(*split, F.explode(F.array(*rows)).alias("x")).select(*split, "x.*")


def score_enrichment(
    scores: DataFrame,
    panels: DataFrame,
    pools: DataFrame,
    keys: list[str],
    split: list[str],
    ks: Sequence[int],
    cutoffs: Sequence[float],
    draws: int = 1000,
    seed: int = 1,
    positions: DataFrame | None = None,
) -> DataFrame:
    """Score sum of each panel at each cutoff against random panels of the same pool.

    Also the number of panel features with a score, of scored pool features and their share.
    """
    panels = settled(panels.select(*keys, "feature"))
    if positions is None:
        positions = settled(random_panels(pools, max(ks), draws, seed, split))
    cut = cut_scores(scores, cutoffs)
    base = each(panels.select(*keys).distinct(), "cutoff", [float(c) for c in cutoffs])
    hits = (
        panels.select(*keys, "feature")
        .join(cut, "feature")
        .groupBy(*keys, "cutoff")
        .agg(F.sum("score").alias("observed"), F.count(F.lit(1)).alias("overlap"))
    )
    targets = pool_targets(pools, scores, split, cutoffs)
    observed = (
        base.join(hits, [*keys, "cutoff"], "left")
        .fillna(0.0, subset=["observed"])
        .fillna(0, subset=["overlap"])
        .withColumn("size", F.col("k").cast("long"))
    )
    null = null_score_sums(positions, cut, _sizes(observed, split, "size"), split)
    tested = empirical_summary(observed, null, [*split, "size", "cutoff"], draws)
    return (
        tested.drop("size")
        .join(targets, [*split, "cutoff"], "left")
        .fillna(0, subset=["pool_targets"])
        .withColumn("recall", safe_div(F.col("overlap"), F.col("pool_targets")))
    )


def mean_enrichment(
    scores: DataFrame,
    panels: DataFrame,
    pools: DataFrame,
    keys: list[str],
    split: list[str],
    ks: Sequence[int],
    draws: int = 1000,
    seed: int = 1,
) -> DataFrame:
    """Mean score of each panel against random panels; features without a score count as 0."""
    panels = settled(panels.select(*keys, "feature"))
    observed = (
        panels.select(*keys, "feature")
        .join(scores, "feature", "left")
        .groupBy(*keys)
        .agg((F.coalesce(F.sum("score"), F.lit(0.0)) / F.col("k")).alias("observed"))
        .withColumn("size", F.col("k").cast("long"))
    )
    positions = settled(random_panels(pools, max(ks), draws, seed, split))
    null = null_score_sums(positions, scores, _sizes(observed, split, "size"), split)
    null = null.withColumn("value", F.col("value") / F.col("size"))
    return empirical_summary(observed, null, [*split, "size"], draws).drop("size")


def depth_calibrate(
    scores: DataFrame,
    keys: list[str],
    bins: int = 10,
    min_bin: int = 20,
    eps: float = 0.01,
    width: float = 4,
    bounded: bool = False,
) -> DataFrame:
    """Score over the mean score of features of similar ``depth``, log2-clipped.

    Bins hold equally many features by depth; there are fewer of them where one would have under
    ``min_bin`` features.
    """
    binned = equal_bins(scores, keys, "depth", "feature", bins, min_bin, bounded)
    means = binned.groupBy(*keys, "bin").agg(F.avg("score").alias("bin_mean"))
    return binned.join(means, [*keys, "bin"]).withColumn(
        "ratio", clipped_ratio((F.col("score") + eps) / (F.col("bin_mean") + eps), width)
    )


GROUPS = ("SHARED", "A_ONLY", "B_ONLY")


def group_enrichment(
    groups: DataFrame,
    scores: DataFrame,
    edges: DataFrame,
    pools: DataFrame,
    cells: list[str],
    split: list[str],
    largest: int,
    draws: int = 1000,
    seed: int = 1,
) -> DataFrame:
    """Score sum and edge count of the SHARED, A_ONLY and B_ONLY features of every cell.

    Each group meets random panels of its own size. All three groups are listed for a cell;
    ``missing_reason`` says why a value is absent.
    """
    key = [*cells, "group"]
    groups = settled(groups.select(*key, "feature"))
    grid = each(groups.select(*cells).distinct(), "group", GROUPS)
    sized = grid.join(groups.groupBy(*key).agg(F.count(F.lit(1)).alias("size")), key, "left").fillna(
        0, subset=["size"]
    )
    sizes = _sizes(sized.where("size > 0"), split, "size")
    positions = settled(random_panels(pools, largest, draws, seed, split))
    hits = groups.join(scores, "feature").groupBy(*key).agg(F.sum("score").alias("observed"))
    score_rows = (
        sized.join(hits, key, "left")
        .withColumn("observed", F.when(F.col("size") > 0, F.coalesce("observed", F.lit(0.0))))
        .withColumn("metric", F.lit("score_sum"))
    )
    inside = edges_among(edges, pools, split, groups, positions)
    counts = induced_edge_count(inside, groups, key, split).drop("n_features")
    edge_rows = (
        sized.join(counts, key, "left")
        .withColumn("observed", F.col("n_edges").cast("double"))
        .drop("n_edges")
        .withColumn("metric", F.lit("edges"))
    )
    null = null_score_sums(positions, scores, sizes, split).withColumn("metric", F.lit("score_sum"))
    null = null.unionByName(
        null_edge_counts(positions, inside, sizes, split).withColumn("metric", F.lit("edges"))
    )
    out = empirical_summary(
        score_rows.unionByName(edge_rows), null, [*split, "size", "metric"], draws
    )
    reason = (
        F.when(F.col("size") == 0, "empty_group")
        .when((F.col("metric") == "edges") & (F.col("size") < 2), "fewer_than_two")
        .when(F.col("expected") <= 0, "mean_zero")
        .otherwise("")
    )
    out = out.withColumn("missing_reason", reason)
    known = F.col("missing_reason").isin("", "mean_zero")
    return out.withColumn("expected", F.when(known, F.col("expected")))


def group_medians(enriched: DataFrame, keys: list[str]) -> DataFrame:
    return enriched.groupBy(*keys).agg(
        F.percentile("ratio", F.lit(0.5)).alias("median_ratio"),
        F.count("ratio").alias("n_valid"),
        F.percentile("size", F.lit(0.5)).alias("median_size"),
    )


def axis_long(wide: DataFrame, keys: list[str], axes: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Wide enrichment axes to rows: each axis names its ratio, p and coverage columns."""
    rows: list[Column] = [
        F.struct(
            F.lit(axis).alias("axis"),
            F.col(r).cast("double").alias("enrichment"),
            F.col(p).cast("double").alias("p"),
            F.col(c).cast("double").alias("coverage"),
        )
        for axis, (r, p, c) in axes.items()
    ]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def axis_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """Median enrichment, shares above 1 and with p <= .05, median coverage, valid splits."""
    return long.groupBy(*keys, "axis").agg(
        F.percentile("enrichment", F.lit(0.5)).alias("median_enrichment"),
        share(F.col("enrichment") > 1).alias("share_above_1"),
        share(F.col("p") <= 0.05).alias("share_significant"),
        F.percentile("coverage", F.lit(0.5)).alias("median_coverage"),
        F.count("enrichment").alias("valid_splits"),
    )


def axis_prediction_corr(
    long: DataFrame, evaluations: DataFrame, keys: list[str], bounded: bool = False
) -> DataFrame:
    """Spearman of enrichment and gain over random, per ``keys`` and axis."""
    cell = ["dataset", "repeat_idx", "fold_idx", "method", "k"]
    both = with_random(evaluations).join(long, cell)
    return correlations(both, [*keys, "axis"], "enrichment", "delta", bounded)


def axis_method_corr(summary: DataFrame, primary: DataFrame) -> DataFrame:
    """Per dataset and axis: rank of each method by enrichment and by gain, and the difference."""
    x = summary.groupBy("dataset", "method", "axis").agg(
        F.avg("median_enrichment").alias("enrichment")
    )
    both = x.join(primary.select("dataset", "method", "primary_delta"), ["dataset", "method"])
    group = ["dataset", "axis"]
    ranked = average_ranks(both, group, "enrichment", "axis_rank", descending=True, bounded=True)
    ranked = average_ranks(ranked, group, "primary_delta", "delta_rank", descending=True, bounded=True)
    return ranked.withColumn("rank_difference", F.col("axis_rank") - F.col("delta_rank"))


def coverage_table(by_split: DataFrame, keys: list[str]) -> DataFrame:
    """Pool targets and panel overlap over the splits."""
    return by_split.groupBy(*keys).agg(
        F.percentile("pool_targets", F.lit(0.5)).alias("median_pool_targets"),
        F.min("pool_targets").alias("min_pool_targets"),
        F.max("pool_targets").alias("max_pool_targets"),
        F.percentile("overlap", F.lit(0.5)).alias("median_overlap"),
        share(F.col("overlap") == 0).alias("share_zero_overlap"),
    )


def cell_ranks(by_split: DataFrame, cells: list[str], value: str = "ratio") -> DataFrame:
    """Median over splits per method, and the method's average-tie rank inside its cell."""
    medians = by_split.groupBy(*cells, "method").agg(
        F.percentile(value, F.lit(0.5)).alias("median_value"), F.count(F.lit(1)).alias("n_splits")
    )
    return dataset_ranks(medians, cells, "median_value").withColumnRenamed(
        "dataset_rank", "cell_rank"
    )


def overall_cell_ranks(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Cell medians averaged with equal weight, and the overall rank of the methods."""
    means = ranked.groupBy(*keys, "method").agg(F.avg("median_value").alias("balanced_mean"))
    return dataset_ranks(means, keys, "balanced_mean").withColumnRenamed("dataset_rank", "rank")
