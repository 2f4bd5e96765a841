"""Queries over ranking tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.standins import (
    SPLIT,
    cte,
    evaluations,
    feature_scores,
    feature_sets,
    leading_rankings,
    pools,
    rankings,
    with_,
)
from sievework.operators import ranking as ra

RK = [*SPLIT, "method"]
RK_SQL = "dataset, repeat_idx, fold_idx, method"
RK_OUT = "dataset:s repeat_idx:i fold_idx:i method:s "

cte(
    "panels",
    """SELECT r.*, k FROM rankings r JOIN (VALUES (10), (20), (50)) g(k) ON rank <= k""",
    "rankings",
)


def panels(t, ks=(10, 20, 50)):
    return ra.top_k(leading_rankings(t, max(ks)), RK, ks)


@query("top_k", RK_OUT + "k:i rank:i feature:s", with_("panels") + "SELECT * FROM panels")
def top_k(t):
    return panels(t)


@query(
    "top_k_allowed",
    RK_OUT + "k:i rank:i feature:s",
    with_("rankings", "feature_scores")
    + f"""SELECT dataset, repeat_idx, fold_idx, method, feature, nr AS rank, k FROM (
    SELECT *, row_number() OVER (PARTITION BY {RK_SQL} ORDER BY rank) AS nr FROM rankings
    WHERE feature IN (SELECT feature FROM feature_scores)) JOIN (VALUES (10), (20)) g(k) ON nr <= k""",
)
def top_k_allowed(t):
    return ra.top_k(rankings(t), RK, [10, 20], feature_scores(t))


cte(
    "short_rankings",
    """SELECT * FROM rankings WHERE method != 'price' OR rank <= 100""",
    "rankings",
)


def short_rankings(t):
    return rankings(t).where("method != 'price' or rank <= 100")


@query(
    "rank_average",
    "dataset:s repeat_idx:i fold_idx:i feature:s mean_rank:f rank:i",
    with_("short_rankings", "pools")
    + """, l AS (SELECT dataset, repeat_idx, fold_idx, method, max(rank) AS len FROM short_rankings GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY dataset, repeat_idx, fold_idx ORDER BY feature) AS pos,
      count(*) OVER (PARTITION BY dataset, repeat_idx, fold_idx) AS n FROM pools),
    x AS (SELECT dataset, repeat_idx, fold_idx, feature, pos, n, count(*) AS lists,
        sum(CASE WHEN r.rank IS NULL THEN len ELSE r.rank END) AS whole,
        count(*) FILTER (r.rank IS NULL) AS missing
      FROM p JOIN l USING (dataset, repeat_idx, fold_idx)
      LEFT JOIN short_rankings r USING (dataset, repeat_idx, fold_idx, method, feature) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY dataset, repeat_idx, fold_idx ORDER BY mean_rank, pos) AS rank
    FROM (SELECT *, (whole + CAST(missing * pos AS DOUBLE) / (n + 1)) / lists AS mean_rank FROM x)""",
)
def rank_average(t):
    return ra.rank_average(short_rankings(t), pools(t), SPLIT, bounded=t.fits("lineitem"))


@query(
    "switch_ranking",
    RK_OUT + "k:i rank:i feature:s",
    with_("panels")
    + """SELECT * REPLACE ('switched' AS method) FROM panels
    WHERE method = CASE WHEN k <= 20 THEN 'orders' ELSE 'revenue' END""",
)
def switch_ranking(t):
    return ra.switch_ranking(panels(t), 20, "orders", "revenue", "switched")


cte(
    "consensus",
    """SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY mean_reciprocal_rank DESC,
      appearance_frequency DESC, mean_observed_rank, feature) AS rank FROM (
      SELECT dataset, method, feature, round(sum(1.0::DOUBLE / rank) / n, 12) AS mean_reciprocal_rank,
        CAST(count(*) AS DOUBLE) / n AS appearance_frequency, avg(rank) AS mean_observed_rank
      FROM rankings JOIN (SELECT dataset, method, count(*) AS n FROM (
        SELECT DISTINCT dataset, method, repeat_idx, fold_idx FROM rankings) GROUP BY 1, 2)
        USING (dataset, method) GROUP BY dataset, method, feature, n)
    WHERE feature IN (SELECT feature FROM feature_scores)""",
    "rankings",
    "feature_scores",
)


@query(
    "consensus_rank",
    "dataset:s method:s feature:s mean_reciprocal_rank:f appearance_frequency:f "
    "mean_observed_rank:f rank:i",
    with_("consensus") + "SELECT * FROM consensus",
)
def consensus_rank(t):
    return ra.consensus_rank(
        rankings(t),
        ["dataset", "method"],
        ["repeat_idx", "fold_idx"],
        feature_scores(t),
        t.fits("lineitem", 4),
    )


@query(
    "lock_panels",
    "dataset:s method:s k:i rank:i feature:s measured:b n_measured:i coverage:f usable:b source:s",
    with_("rankings", "feature_scores")
    + """, c AS (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY mrr DESC,
      freq DESC, mor, feature) AS rank FROM (
      SELECT dataset, method, feature, round(sum(1.0::DOUBLE / rank) / n, 12) AS mrr,
        CAST(count(*) AS DOUBLE) / n AS freq, avg(rank) AS mor
      FROM rankings JOIN (SELECT dataset, method, count(*) AS n FROM (
        SELECT DISTINCT dataset, method, repeat_idx, fold_idx FROM rankings) GROUP BY 1, 2)
        USING (dataset, method) GROUP BY dataset, method, feature, n)),
    m AS (SELECT c.*, k, feature IN (SELECT feature FROM feature_scores) AS measured
      FROM c JOIN (VALUES (10), (20)) g(k) ON rank <= k)
    SELECT *, coverage >= 0.75 AS usable, 'ranked lines' AS source FROM (
      SELECT *, sum(CAST(measured AS INT)) OVER (PARTITION BY dataset, method, k) AS n_measured,
      avg(CAST(measured AS INT)) OVER (PARTITION BY dataset, method, k) AS coverage FROM m)""",
)
def lock_panels(t):
    return ra.lock_panels(
        rankings(t),
        ["dataset", "method"],
        ["repeat_idx", "fold_idx"],
        [10, 20],
        feature_scores(t),
        0.75,
        {"source": "ranked lines"},
        t.fits("lineitem", 4),
    )


cte(
    "set_z",
    """SELECT set_id, CAST(length(set_id) % 3 AS DOUBLE) - 1 + CAST(count(*) % 7 AS DOUBLE) / 10 AS z
    FROM feature_sets GROUP BY set_id""",
    "feature_sets",
)


def set_z(t):
    return feature_sets(t).groupBy("set_id").agg(
        (F.length("set_id") % 3 - 1 + (F.count(F.lit(1)) % 7) / 10).alias("z")
    )


@query(
    "soft_prior",
    RK_OUT + "feature:s boosted:g rank:i",
    with_("rankings", "set_z")
    + f"""SELECT *, row_number() OVER (PARTITION BY {RK_SQL} ORDER BY boosted DESC, pos) AS rank FROM (
    SELECT r.dataset, r.repeat_idx, r.fold_idx, r.method, r.feature, r.rank AS pos,
      r.score * (1 + 0.5::DOUBLE * greatest(coalesce(b.best_z, 0), 0)) AS boosted FROM rankings r LEFT JOIN (
        SELECT feature, max(z) AS best_z FROM feature_sets JOIN set_z USING (set_id) GROUP BY 1) b USING (feature))""",
)
def soft_prior(t):
    return ra.soft_prior(rankings(t), feature_sets(t), set_z(t), 0.5, RK, t.fits("lineitem", 4))


cte(
    "certified",
    """SELECT dataset, repeat_idx, fold_idx, method, feature FROM rankings WHERE
    CASE WHEN fold_idx = 1 THEN right(feature, 2) IN ('11', '37') ELSE right(feature, 4) = '0011' END""",
    "rankings",
)


@query(
    "gated_ranking",
    RK_OUT + "feature:s n_certified:i gate_fallback:b rank:i",
    with_("rankings", "certified")
    + f"""SELECT *, row_number() OVER (PARTITION BY {RK_SQL} ORDER BY old) AS rank FROM (
    SELECT r.dataset, r.repeat_idx, r.fold_idx, r.method, r.feature, r.rank AS old, c.feature IS NOT NULL AS cert,
      count(c.feature) OVER w AS n_certified, count(c.feature) OVER w < 10 AS gate_fallback
    FROM rankings r LEFT JOIN certified c USING (dataset, repeat_idx, fold_idx, method, feature)
    WINDOW w AS (PARTITION BY r.dataset, r.repeat_idx, r.fold_idx, r.method)) WHERE gate_fallback OR cert""",
)
def gated_ranking(t):
    r = rankings(t)
    tail = F.substring("feature", -2, 2).isin("11", "37")
    c = r.where(F.when(F.col("fold_idx") == 1, tail).otherwise(F.substring("feature", -4, 4) == "0011"))
    return ra.gated_ranking(r, c, RK, bounded=t.fits("lineitem", 4))


@query(
    "prefilter_rank",
    "dataset:s repeat_idx:i fold_idx:i feature:s rank:i",
    with_("rankings")
    + """SELECT a.dataset, a.repeat_idx, a.fold_idx, a.feature, row_number() OVER (
      PARTITION BY a.dataset, a.repeat_idx, a.fold_idx ORDER BY a.rank) AS rank
    FROM rankings a JOIN rankings b USING (dataset, repeat_idx, fold_idx, feature)
    WHERE a.method = 'revenue' AND b.method = 'price' AND b.rank <= 200""",
)
def prefilter_rank(t):
    r = rankings(t)
    return ra.prefilter_rank(
        r.where("method = 'revenue'"), r.where("method = 'price'"), 200, SPLIT
    )


@query(
    "rank_percentile",
    RK_OUT + "feature:s rank_percentile:f",
    with_("rankings")
    + f"""SELECT *, CASE WHEN n > 1 THEN 1 - CAST(rank - 1 AS DOUBLE) / (n - 1) ELSE 1 END AS rank_percentile
    FROM (SELECT *, count(*) OVER (PARTITION BY {RK_SQL}) AS n FROM rankings)""",
)
def rank_percentile(t):
    return ra.rank_percentile(rankings(t), RK)


cte(
    "adaptive",
    """SELECT c.dataset, c.repeat_idx, c.method, b.best_inner_k, b.best_m, b.thr, min(c.k) AS chosen_k FROM (
      SELECT dataset, repeat_idx, method, k, avg(auc) AS m FROM evaluations WHERE method != 'Random' GROUP BY ALL) c
    JOIN (SELECT dataset, repeat_idx, method, k AS best_inner_k, m AS best_m, m - coalesce(se, 0) AS thr FROM (
      SELECT *, row_number() OVER (PARTITION BY dataset, repeat_idx, method ORDER BY m DESC, k) AS rn FROM (
        SELECT dataset, repeat_idx, method, k, avg(auc) AS m, stddev_samp(auc) / sqrt(count(*)) AS se
        FROM evaluations WHERE method != 'Random' GROUP BY ALL)) WHERE rn = 1) b
    USING (dataset, repeat_idx, method) WHERE c.m >= b.thr GROUP BY ALL""",
    "evaluations",
)
cte(
    "adaptive_outcome",
    """SELECT a.*, f.fold_idx, f.auc AS outer_auc, r.auc AS random_auc, f.auc - r.auc AS outer_delta FROM adaptive a
    JOIN evaluations f ON a.dataset = f.dataset AND a.repeat_idx = f.repeat_idx AND a.method = f.method AND a.chosen_k = f.k
    JOIN evaluations r ON r.method = 'Random' AND r.dataset = f.dataset AND r.repeat_idx = f.repeat_idx
      AND r.fold_idx = f.fold_idx AND r.k = f.k""",
    "adaptive",
    "evaluations",
)


def adaptive(t):
    return ra.adaptive_k(
        evaluations(t).where("method != 'Random'"), ["dataset", "repeat_idx", "method"]
    )


def adaptive_outcomes(t):
    e = evaluations(t)
    folds = e.select("dataset", "repeat_idx", "fold_idx").distinct()
    return ra.adaptive_outcome(
        adaptive(t).join(folds, ["dataset", "repeat_idx"]), e, SPLIT
    )


@query(
    "adaptive_k",
    "dataset:s repeat_idx:i method:s best_inner_k:i best_inner_mean:f one_se_threshold:f chosen_k:i",
    with_("adaptive")
    + "SELECT *, best_m AS best_inner_mean, thr AS one_se_threshold FROM adaptive",
)
def adaptive_k(t):
    return adaptive(t)


@query(
    "adaptive_outcome",
    "dataset:s repeat_idx:i fold_idx:i method:s chosen_k:i outer_auc:f random_auc:f outer_delta:f",
    with_("adaptive_outcome") + "SELECT * FROM adaptive_outcome",
)
def adaptive_outcome(t):
    return adaptive_outcomes(t)
