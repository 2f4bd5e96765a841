"""Panels of all methods and sizes against one set of random panels, on several axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import enrichment as en
from sievework.operators.folds import random_panels
from sievework.operators.ranking import top_k
from sievework.session import settled

SPLIT = ["dataset", "repeat_idx", "fold_idx"]
CELL = [*SPLIT, "method", "k"]


def enrichment_wide(
    rankings: DataFrame,
    pools: DataFrame,
    scores: DataFrame,
    feature_sets: DataFrame,
    edges: DataFrame,
    ks: Sequence[int],
    cutoff: float = 0.0,
    draws: int = 1000,
    seed: int = 1,
) -> DataFrame:
    """One row per cell with ratio, p and coverage on the score, set and graph axes.

    Every axis meets the same random panels.
    """
    panels = settled(top_k(rankings, [*SPLIT, "method"], ks).select(*CELL, "feature"))
    positions = settled(random_panels(pools, max(ks), draws, seed, SPLIT))
    largest = max(ks)
    score = en.score_enrichment(scores, panels, pools, CELL, SPLIT, ks, [cutoff], draws, seed, positions)
    sets = en.co_membership_enrichment(feature_sets, panels, pools, CELL, SPLIT, largest, draws, seed, positions)
    graph = en.edge_enrichment(edges, panels, pools, CELL, SPLIT, largest, draws, seed, positions=positions)

    def axis(df: DataFrame, name: str, coverage: str) -> DataFrame:
        return df.select(
            *CELL,
            F.col("ratio").alias(f"{name}_ratio"),
            F.col("p").alias(f"{name}_p"),
            F.col(coverage).alias(f"{name}_coverage"),
        )

    return (
        axis(score, "score", "overlap")
        .join(axis(sets, "set", "annotated"), CELL)
        .join(axis(graph, "graph", "size"), CELL)
    )


def enrichment_summary(wide: DataFrame) -> DataFrame:
    """Medians and shares per dataset, method, size and axis."""
    axes = {n: (f"{n}_ratio", f"{n}_p", f"{n}_coverage") for n in ("score", "set", "graph")}
    return en.axis_summary(en.axis_long(wide, CELL, axes), ["dataset", "method", "k"])
