"""Queries over enrichment of panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.ranking import panels
from catalog.scores import avg_rank
from catalog.stability import groups
from catalog.standins import (
    SPLIT,
    cte,
    edges,
    evaluations,
    feature_scores,
    feature_sets,
    part_scores,
    pools,
    with_,
)
from sievework.functions.columns import each
from sievework.operators import enrichment as en
from sievework.operators import folds as fo
from sievework.operators import metrics as me
from sievework.session import settled

D = 20
SIZES = [10, 20, 50]
SQ = "dataset, repeat_idx, fold_idx"
PK = [*SPLIT, "method", "k"]
OUT = "dataset:s repeat_idx:i fold_idx:i "

cte("small_panels", "SELECT * FROM panels WHERE k IN (10, 20, 50)", "panels")
cte(
    "positions",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {SQ}, draw_id ORDER BY
      md5(concat_ws('|', '9', draw_id, {SQ}, feature))) AS position FROM pools, range(1, {D + 1}) g(draw_id))
    WHERE position <= 50""",
    "pools",
)
cte(
    "simple_edges",
    """SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src != dst""",
    "edges",
)
cte(
    "pool_edges",
    """SELECT x.* FROM (SELECT a.dataset, a.repeat_idx, a.fold_idx, src, dst FROM simple_edges JOIN pools a ON a.feature = src) x
    SEMI JOIN pools b ON b.feature = x.dst AND b.dataset = x.dataset AND b.repeat_idx = x.repeat_idx AND b.fold_idx = x.fold_idx""",
    "simple_edges",
    "pools",
)


def small_panels(t):
    return panels(t, SIZES)


@query(
    "co_membership_edges",
    OUT + "method:s k:i n_pairs:i",
    with_("small_panels", "feature_sets")
    + """SELECT dataset, repeat_idx, fold_idx, method, k, count(*) AS n_pairs FROM (
    SELECT DISTINCT a.dataset, a.repeat_idx, a.fold_idx, a.method, a.k, a.feature AS x, b.feature AS y FROM small_panels a
    JOIN small_panels b ON a.dataset = b.dataset AND a.repeat_idx = b.repeat_idx AND a.fold_idx = b.fold_idx
      AND a.method = b.method AND a.k = b.k AND a.feature < b.feature
    JOIN feature_sets s ON s.feature = a.feature JOIN feature_sets r ON r.feature = b.feature AND r.set_id = s.set_id)
    GROUP BY ALL""",
)
def co_membership_edges(t):
    e = en.co_membership_edges(feature_sets(t), small_panels(t), PK)
    return e.groupBy(*PK).agg(F.count(F.lit(1)).alias("n_pairs"))


@query(
    "restrict_edges",
    OUT + "n_edges:i",
    with_("pool_edges") + f"SELECT {SQ}, count(*) AS n_edges FROM pool_edges GROUP BY ALL",
)
def restrict_edges(t):
    e = en.restrict_edges(edges(t), pools(t), SPLIT)
    return e.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("n_edges"))


@query(
    "restrict_edges_parallel",
    OUT + "n_edges:i",
    with_("edges", "pools")
    + """SELECT dataset, repeat_idx, fold_idx, count(*) AS n_edges FROM (
      SELECT a.dataset, a.repeat_idx, a.fold_idx, dst FROM edges JOIN pools a ON a.feature = src) x
    SEMI JOIN pools b ON b.feature = x.dst AND b.dataset = x.dataset AND b.repeat_idx = x.repeat_idx AND b.fold_idx = x.fold_idx
    GROUP BY ALL""",
)
def restrict_edges_parallel(t):
    e = en.restrict_edges(edges(t), pools(t), SPLIT, dedupe=False)
    return e.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("n_edges"))


cte(
    "panel_src",
    """SELECT a.dataset, a.repeat_idx, a.fold_idx, a.method, a.k, e.src, e.dst FROM pool_edges e JOIN small_panels a
    ON a.feature = e.src AND a.dataset = e.dataset AND a.repeat_idx = e.repeat_idx AND a.fold_idx = e.fold_idx""",
    "small_panels",
    "pool_edges",
)
cte(
    "drawn_src",
    """SELECT a.dataset, a.repeat_idx, a.fold_idx, a.draw_id, a.position, e.src, e.dst FROM pool_edges e JOIN positions a
    ON a.feature = e.src AND a.dataset = e.dataset AND a.repeat_idx = e.repeat_idx AND a.fold_idx = e.fold_idx""",
    "positions",
    "pool_edges",
)
cte(
    "drawn_edges",
    """SELECT a.dataset, a.repeat_idx, a.fold_idx, a.draw_id, a.src, greatest(a.position, b.position) AS level FROM drawn_src a
    JOIN positions b ON b.feature = a.dst AND a.dataset = b.dataset AND a.repeat_idx = b.repeat_idx AND a.fold_idx = b.fold_idx
      AND a.draw_id = b.draw_id""",
    "drawn_src",
)
cte(
    "observed_edges",
    """SELECT p.dataset, p.repeat_idx, p.fold_idx, p.method, p.k, p.size, coalesce(n, 0) AS n_edges FROM (
      SELECT dataset, repeat_idx, fold_idx, method, k, count(*) AS size FROM small_panels GROUP BY ALL) p
    LEFT JOIN (SELECT dataset, repeat_idx, fold_idx, method, k, count(*) AS n FROM panel_src e
      SEMI JOIN small_panels b ON b.feature = e.dst AND e.dataset = b.dataset AND e.repeat_idx = b.repeat_idx AND e.fold_idx = b.fold_idx
        AND e.method = b.method AND e.k = b.k GROUP BY ALL) o USING (dataset, repeat_idx, fold_idx, method, k)""",
    "panel_src",
)


@query(
    "induced_edge_count",
    OUT + "method:s k:i n_features:i n_edges:i",
    with_("observed_edges") + "SELECT *, size AS n_features FROM observed_edges",
)
def induced_edge_count(t):
    chosen = settled(small_panels(t))
    inside = en.edges_among(edges(t), pools(t), SPLIT, chosen)
    return en.induced_edge_count(inside, chosen, PK, SPLIT)


def summary_sql(observed: str, null: str, on: str, keys: str, value: str = "observed") -> str:
    """SQL of the empirical summary; ``null`` has one row per draw."""
    return f"""SELECT {keys}, expected, CASE WHEN expected > 0 THEN {value} / expected END AS ratio,
      CASE WHEN sd > 0.000000001 THEN ({value} - expected) / sd END AS z, (1 + ge) / (nd + 1.0::DOUBLE) AS p FROM (
      SELECT {keys}, avg(x) AS expected, stddev_samp(x) AS sd, count(*) FILTER (round(x, 9) >= round({value}, 9)) AS ge, count(*) AS nd
      FROM {observed} JOIN {null} USING ({on}) GROUP BY {keys})"""


cte(
    "null_edges",
    f"""SELECT s.dataset, s.repeat_idx, s.fold_idx, s.size, s.draw_id, CAST(count(e.src) AS DOUBLE) AS x FROM (
      SELECT DISTINCT dataset, repeat_idx, fold_idx, size, draw_id FROM observed_edges, range(1, {D + 1}) g(draw_id)) s
    LEFT JOIN drawn_edges e ON e.dataset = s.dataset AND e.repeat_idx = s.repeat_idx AND e.fold_idx = s.fold_idx
      AND e.draw_id = s.draw_id AND e.level <= s.size GROUP BY ALL""",
    "observed_edges",
    "drawn_edges",
)


@query(
    "edge_enrichment",
    OUT + "method:s k:i size:i n_edges:i expected:f ratio:f z:f p:f density:f",
    with_("null_edges")
    + """SELECT *, n_edges / (size * (size - 1) / 2) AS density FROM ("""
    + summary_sql(
        "observed_edges", "null_edges", SQ + ", size", SQ + ", method, k, size, n_edges", "n_edges"
    )
    + ")",
)
def edge_enrichment(t):
    return en.edge_enrichment(
        edges(t), small_panels(t), pools(t), PK, SPLIT, max(SIZES), draws=D, seed=9
    )


cte("cuts", "SELECT feature, score, cutoff FROM feature_scores JOIN (VALUES (0.05), (0.5)) g(cutoff) ON score >= cutoff", "feature_scores")
cte(
    "observed_scores",
    """SELECT p.*, cutoff, coalesce(s, 0) AS observed, coalesce(o, 0) AS overlap, k AS size FROM (
      SELECT DISTINCT dataset, repeat_idx, fold_idx, method, k FROM small_panels) p JOIN (VALUES (0.05), (0.5)) g(cutoff) ON true
    LEFT JOIN (SELECT dataset, repeat_idx, fold_idx, method, k, cutoff, sum(c.score) AS s, count(*) AS o FROM small_panels
      JOIN cuts c USING (feature) GROUP BY ALL) h USING (dataset, repeat_idx, fold_idx, method, k, cutoff)""",
    "small_panels",
    "cuts",
)
cte(
    "null_scores",
    f"""SELECT s.dataset, s.repeat_idx, s.fold_idx, s.size, s.cutoff, s.draw_id, coalesce(sum(c.score), 0) AS x FROM (
      SELECT DISTINCT dataset, repeat_idx, fold_idx, size, cutoff, draw_id FROM observed_scores, range(1, {D + 1}) g(draw_id)) s
    JOIN positions p ON p.dataset = s.dataset AND p.repeat_idx = s.repeat_idx AND p.fold_idx = s.fold_idx
      AND p.draw_id = s.draw_id AND p.position <= s.size
    LEFT JOIN cuts c ON c.feature = p.feature AND c.cutoff = s.cutoff GROUP BY ALL""",
    "observed_scores",
    "positions",
)
cte(
    "score_enriched",
    f"""SELECT * EXCLUDE (pool_targets), coalesce(pool_targets, 0) AS pool_targets, CAST(overlap AS DOUBLE) / pool_targets AS recall FROM ("""
    + summary_sql(
        "observed_scores",
        "null_scores",
        SQ + ", size, cutoff",
        SQ + ", method, k, cutoff, observed, overlap",
    )
    + f""") LEFT JOIN (SELECT {SQ}, cutoff, count(*) AS pool_targets FROM pools JOIN cuts USING (feature) GROUP BY ALL)
    USING ({SQ}, cutoff)""",
    "null_scores",
    "pools",
)


def score_enriched(t):
    return en.score_enrichment(
        feature_scores(t), small_panels(t), pools(t), PK, SPLIT, SIZES, [0.05, 0.5], D, 9
    )


@query(
    "score_enrichment",
    OUT + "method:s k:i cutoff:f observed:f expected:f ratio:f z:f p:f overlap:i pool_targets:i recall:f",
    with_("score_enriched") + "SELECT * FROM score_enriched",
)
def score_enrichment(t):
    return score_enriched(t)


@query(
    "mean_enrichment",
    OUT + "method:s k:i observed:f ratio:f p:f",
    with_("small_panels", "positions", "feature_scores")
    + f""", o AS (SELECT {SQ}, method, k, k AS size, coalesce(sum(f.score), 0) / max(k) AS observed FROM small_panels
      LEFT JOIN feature_scores f USING (feature) GROUP BY {SQ}, method, k),
    n AS (SELECT {SQ}, size, draw_id, coalesce(sum(f.score), 0) / max(size) AS x FROM positions
      JOIN (VALUES (10), (20), (50)) g(size) ON position <= size LEFT JOIN feature_scores f USING (feature) GROUP BY {SQ}, size, draw_id)
    """
    + summary_sql("o", "n", SQ + ", size", SQ + ", method, k, observed"),
)
def mean_enrichment(t):
    return en.mean_enrichment(
        feature_scores(t), small_panels(t), pools(t), PK, SPLIT, SIZES, D, 9
    )


@query(
    "empirical_medians",
    OUT + "size:i cutoff:f null_median:f",
    with_("null_scores")
    + f"SELECT {SQ}, size, cutoff, median(x) AS null_median FROM null_scores GROUP BY ALL",
)
def empirical_medians(t):
    sizes = each(pools(t).select(*SPLIT).distinct(), "size", SIZES)
    positions = fo.random_panels(pools(t), max(SIZES), D, 9, SPLIT)

    def drawn(cutoff):
        null = en.null_score_sums(positions, en.cut_scores(feature_scores(t), [cutoff]), sizes, SPLIT).drop("cutoff")
        return en.fill_draws(null, sizes, SPLIT, D).withColumn("cutoff", F.lit(cutoff))

    full = drawn(0.05).unionByName(drawn(0.5))
    return en.empirical_medians(full, [*SPLIT, "size", "cutoff"])


@query(
    "depth_calibrate",
    OUT + "method:s feature:s bin:i ratio:f",
    with_("part_scores", "feature_scores")
    + f""", b AS (SELECT *, least(10, greatest(count(*) OVER (PARTITION BY {SQ}, method) // 20, 1)) AS bins,
        count(*) OVER (PARTITION BY {SQ}, method) AS n,
        row_number() OVER (PARTITION BY {SQ}, method ORDER BY depth, feature) AS rn FROM (
        SELECT {SQ}, method, feature, p.score AS depth, f.score AS score FROM part_scores p JOIN feature_scores f USING (feature))),
    c AS (SELECT *, CASE WHEN rn <= (n % bins) * (n // bins + 1) THEN (rn - 1) // (n // bins + 1) + 1
        ELSE n % bins + (rn - (n % bins) * (n // bins + 1) - 1) // (n // bins) + 1 END AS bin FROM b)
    SELECT *, pow(2, greatest(least(log2((score + 0.01) / (avg(score) OVER (PARTITION BY {SQ}, method, bin) + 0.01)), 4), -4)) AS ratio FROM c""",
)
def depth_calibrate(t):
    scored = part_scores(t).withColumnRenamed("score", "depth").join(feature_scores(t), "feature")
    return en.depth_calibrate(scored, [*SPLIT, "method"], bounded=t.fits("lineitem", 4))


GE = (
    "dataset:s k:i repeat_idx:i fold_idx:i grp:s metric:s size:i observed:f expected:f ratio:f p:f "
    "missing_reason:s"
)
cte("small_groups", "SELECT * FROM sel_groups WHERE k IN (10, 20, 50)", "sel_groups")
cte(
    "group_rows",
    f"""SELECT {SQ}, k, grp, metric, count(feature) AS size FROM (SELECT DISTINCT {SQ}, k FROM small_groups)
      JOIN (VALUES ('SHARED'), ('A_ONLY'), ('B_ONLY')) g(grp) ON true JOIN (VALUES ('score_sum'), ('edges')) m(metric) ON true
      LEFT JOIN small_groups USING ({SQ}, k, grp) GROUP BY ALL""",
    "small_groups",
)
cte(
    "group_src",
    """SELECT a.dataset, a.repeat_idx, a.fold_idx, a.k, a.grp, e.src, e.dst FROM pool_edges e JOIN small_groups a
    ON a.feature = e.src AND a.dataset = e.dataset AND a.repeat_idx = e.repeat_idx AND a.fold_idx = e.fold_idx""",
    "small_groups",
    "pool_edges",
)
cte(
    "group_observed",
    f"""SELECT r.*, CASE WHEN size = 0 OR (metric = 'edges' AND size < 2) THEN NULL
      WHEN metric = 'edges' THEN coalesce(e.n, 0) ELSE coalesce(s.n, 0) END AS observed FROM group_rows r
    LEFT JOIN (SELECT {SQ}, k, grp, sum(score) AS n FROM small_groups JOIN feature_scores USING (feature) GROUP BY ALL) s
      USING ({SQ}, k, grp)
    LEFT JOIN (SELECT a.dataset, a.repeat_idx, a.fold_idx, a.k, a.grp, CAST(count(*) AS DOUBLE) AS n FROM group_src a
      SEMI JOIN small_groups b ON b.feature = a.dst AND b.dataset = a.dataset AND b.repeat_idx = a.repeat_idx AND b.fold_idx = a.fold_idx
        AND a.k = b.k AND a.grp = b.grp GROUP BY ALL) e USING ({SQ}, k, grp)""",
    "group_rows",
    "group_src",
    "feature_scores",
)
cte(
    "group_null",
    f"""SELECT s.dataset, s.repeat_idx, s.fold_idx, s.size, s.metric, s.draw_id, coalesce(sum(v), 0) AS x FROM (
      SELECT DISTINCT {SQ}, size, metric, draw_id FROM group_rows, range(1, {D + 1}) g(draw_id)) s LEFT JOIN (
        SELECT {SQ}, draw_id, position AS level, score AS v, 'score_sum' AS metric FROM positions JOIN feature_scores USING (feature)
        UNION ALL SELECT dataset, repeat_idx, fold_idx, draw_id, level, 1, 'edges' FROM drawn_edges) l ON l.dataset = s.dataset AND l.repeat_idx = s.repeat_idx AND l.fold_idx = s.fold_idx
      AND l.draw_id = s.draw_id AND l.metric = s.metric AND l.level <= s.size GROUP BY ALL""",
    "group_rows",
    "drawn_edges",
    "feature_scores",
)
cte(
    "group_enriched",
    f"""SELECT {SQ}, k, grp, metric, size, observed, CASE WHEN reason IN ('', 'mean_zero') THEN expected END AS expected,
      CASE WHEN expected > 0 AND observed IS NOT NULL THEN observed / expected END AS ratio,
      CASE WHEN observed IS NOT NULL THEN (1 + ge) / (nd + 1.0::DOUBLE) END AS p, reason AS missing_reason FROM (
      SELECT *, CASE WHEN size = 0 THEN 'empty_group' WHEN metric = 'edges' AND size < 2 THEN 'fewer_than_two'
        WHEN expected <= 0 THEN 'mean_zero' ELSE '' END AS reason FROM (
        SELECT {SQ}, k, grp, metric, size, observed, avg(x) AS expected, count(*) FILTER (round(x, 9) >= round(observed, 9)) AS ge, count(*) AS nd
        FROM group_observed JOIN group_null USING ({SQ}, size, metric) GROUP BY ALL))""",
    "group_observed",
    "group_null",
)


def group_enriched(t):
    g = groups(t).where(F.col("k").isin(SIZES))
    return en.group_enrichment(
        g, feature_scores(t), edges(t), pools(t), ["dataset", "k", "repeat_idx", "fold_idx"], SPLIT, max(SIZES), D, 9
    ).withColumnRenamed("group", "grp")


@query("group_enrichment", GE, with_("group_enriched") + "SELECT * FROM group_enriched")
def group_enrichment(t):
    return group_enriched(t)


@query(
    "group_medians",
    "dataset:s k:i grp:s metric:s median_ratio:f n_valid:i median_size:f",
    with_("group_enriched")
    + """SELECT dataset, k, grp, metric, median(ratio) AS median_ratio, count(ratio) AS n_valid,
    median(size) AS median_size FROM group_enriched GROUP BY 1, 2, 3, 4""",
)
def group_medians(t):
    return en.group_medians(group_enriched(t), ["dataset", "k", "grp", "metric"])


cte(
    "axes",
    """SELECT dataset, repeat_idx, fold_idx, method, k, 'score@' || CAST(cutoff AS DOUBLE) AS axis, ratio AS enrichment, p, CAST(overlap AS DOUBLE) AS coverage
      FROM score_enriched
    UNION ALL SELECT dataset, repeat_idx, fold_idx, method, k, 'recall@' || CAST(cutoff AS DOUBLE), 2 * recall, p, CAST(pool_targets AS DOUBLE)
      FROM score_enriched""",
    "score_enriched",
)
cte(
    "axis_sums",
    """SELECT dataset, method, k, axis, median(enrichment) AS median_enrichment,
      avg(CAST(enrichment > 1 AS INT)) AS share_above_1, avg(CAST(p <= 0.05 AS INT)) AS share_significant,
      median(coverage) AS median_coverage, count(enrichment) AS valid_splits FROM axes GROUP BY 1, 2, 3, 4""",
    "axes",
)


def axes(t):
    wide = score_enriched(t).withColumn("twice", 2 * F.col("recall"))
    long = en.axis_long(
        wide, [*PK, "cutoff"], {"score": ("ratio", "p", "overlap"), "recall": ("twice", "p", "pool_targets")}
    )
    return long.withColumn("axis", F.concat_ws("@", "axis", F.col("cutoff").cast("string"))).drop("cutoff")


@query(
    "axis_long",
    OUT + "method:s k:i axis:s enrichment:f p:f coverage:f",
    with_("axes") + "SELECT * FROM axes",
)
def axis_long(t):
    return axes(t)


@query(
    "axis_summary",
    "dataset:s method:s k:i axis:s median_enrichment:f share_above_1:f share_significant:f "
    "median_coverage:f valid_splits:i",
    with_("axis_sums") + "SELECT * FROM axis_sums",
)
def axis_summary(t):
    return en.axis_summary(axes(t), ["dataset", "method", "k"])


MAP = "CASE method WHEN 'm1' THEN 'revenue' WHEN 'm2' THEN 'price' WHEN 'm3' THEN 'orders' WHEN 'm4' THEN 'quantity' ELSE method END"


@query(
    "axis_prediction_corr",
    "dataset:s axis:s n:i spearman:f",
    with_("axes", "with_random")
    + f""", b AS (SELECT a.dataset, axis, enrichment AS x, delta AS y FROM axes a JOIN (
      SELECT *, {MAP} AS m FROM with_random) e ON e.dataset = a.dataset AND e.repeat_idx = a.repeat_idx
      AND e.fold_idx = a.fold_idx AND e.m = a.method AND e.k = a.k WHERE enrichment IS NOT NULL AND delta IS NOT NULL)
    SELECT dataset, axis, count(*) AS n, corr(rx, ry) AS spearman FROM (SELECT *, {avg_rank('dataset, axis', 'x')} AS rx,
      {avg_rank('dataset, axis', 'y')} AS ry FROM b) GROUP BY 1, 2""",
)
def axis_prediction_corr(t):
    e = evaluations(t).withColumn("method", F.expr(MAP))
    return en.axis_prediction_corr(axes(t), e, ["dataset"], t.fits("lineitem"))


@query(
    "axis_method_corr",
    "dataset:s axis:s method:s axis_rank:f delta_rank:f rank_difference:f",
    with_("axis_sums", "delta_primary")
    + f""", b AS (SELECT x.*, primary_delta FROM (SELECT dataset, method, axis, round(avg(median_enrichment), 12) AS e FROM axis_sums GROUP BY 1, 2, 3) x
      JOIN (SELECT dataset, {MAP} AS method, primary_delta FROM delta_primary) d USING (dataset, method))
    SELECT *, axis_rank - delta_rank AS rank_difference FROM (SELECT *, {avg_rank('dataset, axis', 'e', True)} AS axis_rank,
      {avg_rank('dataset, axis', 'primary_delta', True)} AS delta_rank FROM b)""",
)
def axis_method_corr(t):
    s = en.axis_summary(axes(t), ["dataset", "method", "k"])
    p = me.delta_primary(evaluations(t)).withColumn("method", F.expr(MAP))
    return en.axis_method_corr(s, p)


@query(
    "coverage_table",
    "dataset:s k:i cutoff:f median_pool_targets:f min_pool_targets:i max_pool_targets:i median_overlap:f share_zero_overlap:f",
    with_("score_enriched")
    + """SELECT dataset, k, cutoff, median(pool_targets) AS median_pool_targets, min(pool_targets) AS min_pool_targets,
    max(pool_targets) AS max_pool_targets, median(overlap) AS median_overlap, avg(CAST(overlap = 0 AS INT)) AS share_zero_overlap
    FROM score_enriched GROUP BY 1, 2, 3""",
)
def coverage_table(t):
    return en.coverage_table(score_enriched(t), ["dataset", "k", "cutoff"])


cte(
    "cell_medians",
    f"""SELECT *, {avg_rank('dataset, k, cutoff', 'median_value', True)} AS cell_rank FROM (
    SELECT dataset, k, cutoff, method, median(ratio) AS median_value, count(*) AS n_splits FROM score_enriched GROUP BY 1, 2, 3, 4)""",
    "score_enriched",
)


@query(
    "cell_ranks",
    "dataset:s k:i cutoff:f method:s median_value:f n_splits:i cell_rank:f",
    with_("cell_medians") + "SELECT * FROM cell_medians",
)
def cell_ranks(t):
    return en.cell_ranks(score_enriched(t), ["dataset", "k", "cutoff"])


@query(
    "overall_cell_ranks",
    "cutoff:f method:s balanced_mean:f rank:f",
    with_("cell_medians")
    + f"""SELECT *, {avg_rank('cutoff', 'balanced_mean', True)} AS rank FROM (
    SELECT cutoff, method, avg(median_value) AS balanced_mean FROM cell_medians GROUP BY 1, 2)""",
)
def overall_cell_ranks(t):
    return en.overall_cell_ranks(en.cell_ranks(score_enriched(t), ["dataset", "k", "cutoff"]), ["cutoff"])


cte(
    "set_observed",
    f"""SELECT p.*, coalesce(n, 0) AS n_pairs FROM (SELECT {SQ}, method, k, count(*) AS size,
      count(*) FILTER (feature IN (SELECT feature FROM feature_sets)) AS annotated FROM small_panels GROUP BY {SQ}, method, k) p
    LEFT JOIN (SELECT {SQ}, method, k, count(*) AS n FROM (
      SELECT DISTINCT a.dataset, a.repeat_idx, a.fold_idx, a.method, a.k, a.feature AS x, b.feature AS y FROM small_panels a
      JOIN small_panels b ON a.dataset = b.dataset AND a.repeat_idx = b.repeat_idx AND a.fold_idx = b.fold_idx
        AND a.method = b.method AND a.k = b.k AND a.feature < b.feature
      JOIN feature_sets s ON s.feature = a.feature JOIN feature_sets r ON r.feature = b.feature AND r.set_id = s.set_id)
      GROUP BY ALL) q USING ({SQ}, method, k)""",
    "small_panels",
    "feature_sets",
)
cte(
    "drawn_pairs",
    f"""SELECT DISTINCT a.dataset, a.repeat_idx, a.fold_idx, a.draw_id, a.feature AS x, b.feature AS y,
      greatest(a.position, b.position) AS level FROM positions a JOIN positions b ON a.dataset = b.dataset
      AND a.repeat_idx = b.repeat_idx AND a.fold_idx = b.fold_idx AND a.draw_id = b.draw_id AND a.feature < b.feature
    JOIN feature_sets s ON s.feature = a.feature JOIN feature_sets r ON r.feature = b.feature AND r.set_id = s.set_id""",
    "positions",
    "feature_sets",
)
cte(
    "set_null",
    f"""SELECT s.dataset, s.repeat_idx, s.fold_idx, s.size, s.draw_id, CAST(count(d.x) AS DOUBLE) AS x FROM (
      SELECT DISTINCT {SQ}, size, draw_id FROM set_observed, range(1, {D + 1}) g(draw_id)) s LEFT JOIN drawn_pairs d
      ON d.dataset = s.dataset AND d.repeat_idx = s.repeat_idx AND d.fold_idx = s.fold_idx AND d.draw_id = s.draw_id
      AND d.level <= s.size GROUP BY ALL""",
    "set_observed",
    "drawn_pairs",
)
cte(
    "set_enriched",
    summary_sql("set_observed", "set_null", SQ + ", size", SQ + ", method, k, size, annotated, n_pairs", "n_pairs"),
    "set_null",
)


@query(
    "co_membership_enrichment",
    OUT + "method:s k:i size:i annotated:i n_pairs:i expected:f ratio:f z:f p:f",
    with_("set_enriched") + "SELECT * FROM set_enriched",
)
def co_membership_enrichment(t):
    return en.co_membership_enrichment(
        feature_sets(t), small_panels(t), pools(t), PK, SPLIT, max(SIZES), D, 9
    )
