"""Stability of each method's panels, and how two methods complement each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import stability as st
from sievework.operators.ranking import top_k

SPLITS = ["repeat_idx", "fold_idx"]
KEYS = ["dataset", "method", "k"]


def stability_table(rankings: DataFrame, pools: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Nogueira index over the union pool, overlap of split pairs, recurrence counts."""
    panels = top_k(rankings, ["dataset", "method", *SPLITS], ks)
    index = st.nogueira(panels, pools, KEYS, SPLITS)
    overlap = st.pairwise_overlap(panels, KEYS, SPLITS)
    again = st.recurrence_counts(st.recurrence(panels, pools, KEYS, SPLITS), KEYS)
    return index.join(overlap, KEYS).join(again, KEYS)


def complementarity_table(
    rankings: DataFrame, a: str, b: str, ks: Sequence[int]
) -> DataFrame:
    """Per dataset and size: features found by both methods, by one only, and mean Jaccard."""
    panels = top_k(
        rankings.where(F.col("method").isin(a, b)), ["dataset", "method", *SPLITS], ks
    )
    cell = ["dataset", "k"]
    groups = st.selection_groups(panels, a, b, [*cell, *SPLITS])
    counts = groups.groupBy(*cell).agg(
        F.count_if(F.col("group") == "SHARED").alias("n_shared"),
        F.count_if(F.col("group") == "A_ONLY").alias("n_a_only"),
        F.count_if(F.col("group") == "B_ONLY").alias("n_b_only"),
    )
    overlap = st.overlap_summary(st.method_overlap(panels, a, b, cell, SPLITS), cell)
    return counts.join(overlap, cell)
