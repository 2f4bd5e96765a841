"""Scale detection, sample selection, audits and reconstruction checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.columns import finite
from sievework.functions.ordering import numbered
from sievework.session import spread

# The four scales and the limits between them.
COUNTS, BACKGROUND, LOG, LINEAR = (
    "counts",
    "linear_background_corrected",
    "log_normalized",
    "linear_normalized",
)
UNKNOWN = "unknown"
COUNTS_ABOVE = 100
LOG_BELOW = 30


def detect_scale(
    features: DataFrame, keys: Sequence[str] = ("dataset",), tolerance: float = 0.0,
    counts_without_negatives: bool = False,
) -> DataFrame:
    """Scale of each dataset from all of its values.

    ``tolerance`` is the allowed distance to an integer. ``counts_without_negatives`` is the
    stricter variant where a negative value rules counts out. A dataset without a finite value is unknown.
    """
    clean = features.withColumn("_x", finite(F.col("value")))
    agg = clean.groupBy(*keys).agg(
        F.min("_x").alias("minimum"),
        F.max("_x").alias("maximum"),
        F.bool_and(F.abs(F.col("_x") - F.round("_x")) <= tolerance).alias("all_integers"),
        F.bool_or(F.col("_x") < 0).alias("has_negatives"),
    )
    counts = F.col("all_integers") & (F.col("maximum") > COUNTS_ABOVE)
    if counts_without_negatives:
        counts = counts & ~F.col("has_negatives")
    return agg.withColumn(
        "scale",
        F.when(F.col("maximum").isNull(), UNKNOWN)
        .when(counts, COUNTS)
        .when(F.col("has_negatives") & (F.col("maximum") >= COUNTS_ABOVE), BACKGROUND)
        .when(F.col("maximum") < LOG_BELOW, LOG)
        .otherwise(LINEAR),
    )


def verify_scale(
    detected: DataFrame, declared: DataFrame, keys: Sequence[str] = ("dataset",), strict: bool = False
) -> DataFrame:
    """Declared against detected scale, with the likely cause of a mismatch; nothing detected is a mismatch too."""
    both = detected.join(declared, list(keys), "right").fillna(UNKNOWN, subset=["scale"])
    cause = (
        F.when(F.col("declared") == F.col("scale"), "")
        .when(
            (F.col("declared") == COUNTS) & (F.col("scale") == LINEAR),
            "fractional values: length-normalised, not counts",
        )
        .when(
            (F.col("declared") == COUNTS) & (F.col("scale") == LOG),
            "small values: already log-transformed",
        )
        .otherwise("declared and detected scale differ")
    )
    out = both.withColumn("cause", cause).withColumn("passed", F.col("cause") == "")
    if strict:
        text = F.concat_ws(": ", *keys, "cause")
        out = out.where(F.when(~F.col("passed"), F.raise_error(text).cast("boolean")).otherwise(True))
    return out


def transform_scale(features: DataFrame, scale: str = "scale") -> DataFrame:
    """Linear data to log2(x+1), background-corrected data floored at 0 first, others unchanged."""
    x = F.col("value")
    return features.withColumn(
        "value",
        F.when(F.col(scale) == LINEAR, F.log2(x + 1))
        .when(F.col(scale) == BACKGROUND, F.log2(F.greatest(x, F.lit(0.0)) + 1))
        .otherwise(x),
    )


def assert_counts(
    features: DataFrame, keys: Sequence[str] = ("dataset",), tolerance: float = 1e-8
) -> DataFrame:
    """Number of negative, non-finite and fractional values per dataset."""
    x = F.col("value").cast("double")
    bad = finite(x).isNull()
    return features.groupBy(*keys).agg(
        F.count_if(~bad & (x < 0)).alias("negative"),
        F.count_if(bad).alias("non_finite"),
        F.count_if(~bad & (F.abs(x - F.round(x)) > tolerance)).alias("fractional"),
    )


def strict_counts(features: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """The same rows; reading a value that is not a count fails."""
    x = F.col("value").cast("double")
    ok = finite(x).isNotNull() & (x >= 0) & (F.abs(x - F.round(x)) <= tolerance)
    return features.where(
        F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit("value is not a count")).cast("boolean"))
        .otherwise(True)
    )


def parse_characteristics(
    meta: DataFrame, keys: Sequence[str] = ("dataset",), minimum_share: float = 0.8
) -> DataFrame:
    """``key: value`` columns of long metadata to ``sample_id, field, value``.

    A column counts if at least ``minimum_share`` of its rows have a key; its most frequent key
    (the first in order among equals) names the field.
    """
    group = [*keys, "column"]
    found = meta.withColumn("_k", F.regexp_extract("value", r"^\s*([^:]+?)\s*:", 1)).withColumn(
        "_k", F.when(F.col("_k") != "", F.col("_k"))
    )
    per_key = found.groupBy(*group, "_k").agg(F.count(F.lit(1)).alias("_n"))
    chosen = (
        per_key.groupBy(*group)
        .agg(
            F.min(F.when(F.col("_k").isNotNull(), F.struct((-F.col("_n")).alias("n"), "_k"))).alias("top"),
            (F.sum(F.when(F.col("_k").isNotNull(), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("_s"),
        )
        .where(F.col("_s") >= minimum_share)
        .select(
            *group,
            F.concat(
                F.lit("ch_"), F.regexp_replace(F.lower(F.trim("top._k")), r"\W+", "_")
            ).alias("field"),
        )
    )
    return meta.join(chosen, group).select(
        *keys,
        "sample_id",
        "field",
        F.trim(F.regexp_replace("value", r"^\s*[^:]+?\s*:\s*", "")).alias("value"),
    )


def extract_key(columns: Sequence[str], key: str) -> Column:
    """Value of the first ``key: value`` entry among the columns of a row, else NULL."""
    hits = F.filter(
        F.array(*[F.col(c) for c in columns]), lambda v: v.rlike(rf"(?i)^\s*{key}\s*:")
    )
    return F.trim(F.regexp_replace(F.try_element_at(hits, F.lit(1)), "^[^:]*:", ""))


def split_compound(df: DataFrame, col: str, sep: str, first: str, rest: str) -> DataFrame:
    """First part of a compound string, and the other parts joined again."""
    parts = F.split(col, sep)
    return df.withColumn(first, F.trim(parts[0])).withColumn(
        rest, F.trim(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), sep))
    )


def _filtered(meta: DataFrame, filters, excluded: DataFrame | None) -> DataFrame:
    if excluded is not None:
        meta = meta.join(excluded.select("sample_id"), "sample_id", "left_anti")
    for column, keep in filters:
        meta = meta.where(F.col(column).isin(list(keep)))
    return meta


def select_samples(
    meta: DataFrame,
    outcome: str,
    negative: Sequence[str],
    positive: Sequence[str],
    filters: Sequence[tuple[str, Sequence[str]]] = (),
    excluded: DataFrame | None = None,
    group: str | None = None,
) -> DataFrame:
    """Samples that pass all filters and have a mapped outcome, with ``label`` and ``group_id``.

    Without a group column a sample is its own group; a missing group fails the read.
    """
    label = F.when(F.col(outcome).isin(list(negative)), 0).when(
        F.col(outcome).isin(list(positive)), 1
    )
    kept = _filtered(meta, filters, excluded).withColumn("label", label).where("label is not null")
    if group is None:
        return kept.withColumn("group_id", F.col("sample_id").cast("string"))
    g = F.col(group).cast("string")
    bad = g.isNull() | (g == "")
    return kept.withColumn(
        "group_id", F.when(bad, F.raise_error(F.lit("missing group id")).cast("string")).otherwise(g)
    )


def unmapped_outcomes(
    meta: DataFrame,
    outcome: str,
    known: Sequence[str],
    filters: Sequence[tuple[str, Sequence[str]]] = (),
    excluded: DataFrame | None = None,
) -> DataFrame:
    """Dropped outcome values and how many samples carry each."""
    rest = _filtered(meta, filters, excluded).where(
        ~F.coalesce(F.col(outcome).isin(list(known)), F.lit(False))
    )
    return rest.groupBy(F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def check_class_counts(
    samples: DataFrame, expected: DataFrame, minority: int = 20
) -> DataFrame:
    """Observed against expected samples per class, and whether the smaller class is small."""
    seen = samples.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("observed"))
    both = expected.join(seen, ["dataset", "label"], "left").fillna(0, subset=["observed"])
    w = Window.partitionBy("dataset")  # one row per class
    return both.withColumn("matches", F.col("observed") == F.col("expected")).withColumn(
        "small_minority", F.min("observed").over(w) < minority
    )


def align_samples(features: DataFrame, meta: DataFrame, keys: Sequence[str] = ("dataset",)):
    """Features of samples that have metadata."""
    on = [*keys, "sample_id"]
    return features.join(meta.select(*on).distinct(), on, "left_semi")


def samples_without_features(
    features: DataFrame, meta: DataFrame, keys: Sequence[str] = ("dataset",)
) -> DataFrame:
    on = [*keys, "sample_id"]
    return meta.join(features.select(*on).distinct(), on, "left_anti")


def mapped(col: Column, names: Mapping[str, str], default: Column | None = None) -> Column:
    """Rename by a fixed map; other values stay, or become ``default``."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(pairs, col), col if default is None else default)


def expected_grid(results: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Every combination of the values the dimensions take.

    The distinct values of a dimension are a few names; the grid unfolds from one row of them. Its combinations
    but for the last dimension are dealt to all tasks, which unfold that one.
    """
    *first, last = dims
    sets = results.agg(*[F.collect_set(d).alias(d) for d in dims])
    for d in first:
        sets = sets.withColumn(d, F.explode(d))
    return (spread(sets, *first) if first else sets).withColumn(last, F.explode(last))


def audit_grid(results: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Cells of the expected grid that are missing or occur more than once."""
    dims = list(dims)
    counts = results.groupBy(*dims).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = expected_grid(results, dims).join(counts, dims, "left").fillna(0, subset=["n_rows"])
    return joined.where("n_rows != 1").withColumn(
        "problem", F.when(F.col("n_rows") == 0, "missing").otherwise("duplicate")
    )


def qa_ranges(
    results: DataFrame,
    keys: Sequence[str],
    ranges: Mapping[str, tuple[float, float]],
    panel_size: tuple[str, str] | None = None,
    expected_rows: int | None = None,
) -> DataFrame:
    """Checks of a result table as ``name, observed, expected, passed``.

    Counts rows in all, distinct keys, non-finite and out-of-range metrics, and panels whose
    size differs from k.
    """
    per_key = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(finite(F.col(m)).isNull()).alias(f"{m}_non_finite") for m in ranges],
        *[
            F.count_if(~F.col(m).between(lo, hi)).alias(f"{m}_out_of_range")
            for m, (lo, hi) in ranges.items()
        ],
        *(
            [F.count_if(F.col(panel_size[0]) != F.col(panel_size[1])).alias("panel_size_differs")]
            if panel_size
            else []
        ),
    )
    zero = [c for c in per_key.columns if c not in (*keys, "rows")]
    total = per_key.agg(
        F.sum("rows").alias("rows"),
        F.count_if(F.col("rows") > 1).alias("duplicate_keys"),
        *[F.sum(c).alias(c) for c in zero],
    )
    long = total.unpivot([], ["rows", "duplicate_keys", *zero], "name", "observed")
    want = F.when(F.col("name") == "rows", F.lit(expected_rows).cast("long")).otherwise(0)
    return long.withColumn("expected", want).withColumn(
        "passed", F.coalesce(F.col("observed") == F.col("expected"), F.lit(True))
    )


def index_runs(results: DataFrame, run: str, key: Sequence[str], value: str = "auc") -> DataFrame:
    """Per run: methods, splits, sizes, expected and actual rows, duplicates, missing values."""
    distinct_keys = results.groupBy(run, *key).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(finite(F.col(value)).isNull()).alias("_m")
    )
    return (
        distinct_keys.groupBy(run)
        .agg(
            F.count_distinct("method").alias("n_methods"),
            F.count_distinct("repeat_idx", "fold_idx").alias("n_splits"),
            F.count_distinct("k").alias("n_sizes"),
            F.array_join(F.array_sort(F.collect_set(F.col("k"))), ",").alias("sizes"),
            F.sum("_n").alias("n_rows"),
            F.sum(F.col("_n") - 1).alias("n_duplicates"),
            F.sum("_m").alias("n_missing"),
        )
        .withColumn("expected_rows", F.col("n_methods") * F.col("n_splits") * F.col("n_sizes"))
        .withColumn(
            "complete",
            (F.col("n_rows") == F.col("expected_rows"))
            & (F.col("n_duplicates") == 0)
            & (F.col("n_missing") == 0),
        )
    )


def audit_dataset(features: DataFrame, samples: DataFrame) -> DataFrame:
    """Per dataset: duplicate cells, unaligned samples, non-finite values, class sizes, status."""
    cells = features.groupBy("dataset", "sample_id", "feature").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(finite(F.col("value")).isNull()).alias("_bad")
    )
    per_sample = cells.groupBy("dataset", "sample_id").agg(
        F.sum(F.col("_n") - 1).alias("dup"), F.sum("_bad").alias("bad"), F.count(F.lit(1)).alias("p")
    )
    meta = samples.groupBy("dataset", "sample_id").agg(
        F.count(F.lit(1)).alias("m"), F.max("label").alias("label")
    )
    joined = per_sample.join(meta, ["dataset", "sample_id"], "full")
    out = joined.groupBy("dataset").agg(
        F.count("p").alias("n_samples"),
        F.sum("dup").alias("duplicate_cells"),
        F.sum(F.coalesce(F.col("m") - 1, F.lit(0))).alias("duplicate_samples"),
        F.count_if(F.col("p").isNull() | F.col("m").isNull()).alias("unaligned_samples"),
        F.sum("bad").alias("non_finite"),
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
        F.count_distinct("p").alias("row_lengths"),
    )
    ready = (
        (F.col("duplicate_cells") == 0)
        & (F.col("duplicate_samples") == 0)
        & (F.col("unaligned_samples") == 0)
        & (F.col("non_finite") == 0)
        & (F.col("n_pos") > 0)
        & (F.col("n_neg") > 0)
    )
    return out.withColumn("status", F.when(ready, "ready").otherwise("invalid"))


def validate_rankings(rankings: DataFrame, pools: DataFrame, keys: list[str], split: list[str]):
    """Per ranking: features missing from it, outside its pool, repeated, or out of order.

    Positions in rank order are compared with the next one by a join, so a long ranking is spread over
    tasks, and a gap in the ranks hides nothing.
    """
    pool = pools.select(*split, "feature").distinct()
    sizes = pool.groupBy(*split).agg(F.count(F.lit(1)).alias("_size"))
    seen = rankings.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("_n"))
    membership = (
        seen.join(pool.withColumn("_pool", F.lit(1)), [*split, "feature"], "left")
        .groupBy(*keys)
        .agg(
            F.count("_pool").alias("_inside"),
            F.count_if(F.col("_pool").isNull()).alias("outside_pool"),
            F.sum(F.col("_n") - 1).alias("repeated"),
        )
        .join(sizes, split)
        .withColumn("missing", F.col("_size") - F.col("_inside"))
        .drop("_size", "_inside")
    )
    placed = numbered(rankings, keys, "rank", "feature", name="_pos", descending=False)
    here = placed.select(*keys, "_pos", F.col("score").alias("_s"))
    after = placed.select(*keys, (F.col("_pos") - 1).alias("_pos"), F.col("score").alias("_next"))
    order = here.join(after, [*keys, "_pos"]).groupBy(*keys).agg(
        F.count_if(F.col("_next") > F.col("_s")).alias("increasing")
    )
    return (
        membership.join(order, keys, "left")
        .fillna(0, subset=["increasing"])
        .withColumn(
            "passed",
            (F.col("missing") + F.col("outside_pool") + F.col("repeated") + F.col("increasing")) == 0,
        )
    )


def diff_tables(
    a: DataFrame, b: DataFrame, keys: list[str], cols: Sequence[str], tol: float
) -> DataFrame:
    """Reconstruction check: keys on one side only and the largest difference per column."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_b"))
    j = left.join(right, keys, "full")
    gap = {c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in cols}
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    one_sided_null = {c: F.count_if(both & (F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull())) for c in cols}
    agg = j.agg(
        F.count_if(both).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("name"),
                    F.max(gap[c]).alias("max_abs_diff"),
                    one_sided_null[c].alias("null_mismatch"),
                )
                for c in cols
            ]
        ).alias("c"),
    )
    out = agg.select("n_both", "only_a", "only_b", F.explode("c").alias("c")).select(
        F.col("c.name").alias("name"), "n_both", "only_a", "only_b", "c.max_abs_diff", "c.null_mismatch"
    )
    return out.withColumn(
        "passed",
        (F.col("only_a") + F.col("only_b") + F.col("null_mismatch") == 0)
        & (F.coalesce("max_abs_diff", F.lit(0.0)) <= tol),
    )


def filter_edges(
    edges: DataFrame, threshold: float, score: str = "weight", strict: bool = False
) -> DataFrame:
    """Edges with a finite score at or above the threshold; ``strict`` fails if none is left."""
    kept = edges.where(finite(F.col(score)).isNotNull() & (F.col(score) >= threshold))
    if strict and kept.isEmpty():
        raise ValueError("no edge reaches the threshold")
    return kept
