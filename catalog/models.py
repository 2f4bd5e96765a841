"""Queries over fitted models. Fits have no SQL counterpart, their bookkeeping has."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import query
from catalog.evidence import feat_sets, nulls
from catalog.evidence import fits as screening_fits
from catalog.standins import cte, evaluations, features, samples, with_
from sievework.functions.columns import each
from sievework.operators import folds as fo
from sievework.operators import models as mo
from sievework.operators import penalised as pen
from sievework.operators import trees as tr
from sievework.operators.preparation import standardise
from sievework.operators.scores import pooled_t, univariate_auc_rank
from sievework.plans import decoy_study as ds
from sievework.plans import nested_choice as nc
from sievework.plans import null_study as ns
from sievework.plans.null_study import training_part
from sievework.session import cut_lineage


FOLD = ["dataset", "fold_idx"]


def roles(t):
    """Four stratified folds of the embedding samples, each the test part of one split."""
    return fo.fold_roles(fo.stratified_folds(samples(t), 4, 42), 4).drop("fold")


cte(
    "roles",
    """SELECT dataset, f AS fold_idx, sample_id, label, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS role FROM (
    SELECT *, (row_number() OVER (PARTITION BY dataset, label ORDER BY md5(concat_ws('|', '42', sample_id))) - 1) % 4 + 1
      AS fold FROM samples), range(1, 5) g(f)""",
    "samples",
)


def training(t):
    """Labels and z-scores of the training samples of all splits."""
    return training_part(samples(t), features(t), roles(t), FOLD)


RANKED = "dataset:s fold_idx:i feature:s score:e rank:i selected:b alpha:e penalty:e"


@query("elastic_net_rank", RANKED)
def elastic_net_rank(t):
    y, x = training(t)
    return pen.elastic_net_rank(x, y, FOLD)


@query("lasso_rank", RANKED)
def lasso_rank(t):
    y, x = training(t)
    return pen.elastic_net_rank(x, y, FOLD, alphas=(1.0,))


@query("forest_rank", "dataset:s fold_idx:i feature:s score:e rank:i")
def forest_rank(t):
    y, x = training(t)
    return tr.forest_rank(x, y, FOLD)


def all_panels(t):
    """The first k features of every split by |t| and by AUC, and three random panels of each size."""
    y, x = training(t)
    rows = x.join(y, [*FOLD, "sample_id"])
    by_t = pooled_t(rows, [*FOLD, "feature"]).select(*FOLD, "feature", F.round(F.abs("t"), 9).alias("score"))
    by_auc = univariate_auc_rank(rows, FOLD).select(*FOLD, "feature", F.round("score", 9).alias("score"))
    scores = by_t.withColumn("method", F.lit("t_test")).unionByName(by_auc.withColumn("method", F.lit("auc")))
    w = Window.partitionBy(*FOLD, "method").orderBy(F.col("score").desc(), "feature")
    ranked = scores.withColumn("position", F.row_number().over(w)).drop("score")
    drawn = fo.random_panels(x.select(*FOLD, "feature").distinct(), max(PANEL_SIZES), 3, 5, FOLD)
    drawn = drawn.withColumn("method", F.concat(F.lit("random"), "draw_id")).drop("draw_id")
    panels = ranked.unionByName(drawn.select(*ranked.columns))
    return each(panels, "k", PANEL_SIZES).where(F.col("position") <= F.col("k")).drop("position")


PANEL_SIZES = [5, 10, 20, 50]


@query("evaluate_panels", "dataset:s fold_idx:i method:s k:i evaluator:s n_features:i auc:e")
def evaluate_panels(t):
    z = cut_lineage(standardise(features(t), roles(t), FOLD).drop("role"))
    return tr.evaluate_panels(z, roles(t), cut_lineage(all_panels(t)), FOLD)


def _fits(t):
    y, x = training(t)
    return pen.resample_fits(x, fo.subsamples(y, 50, 5, 7, by=FOLD), FOLD)


@query(
    "resample_fits",
    "dataset:s fold_idx:i resample_id:i alpha:e penalty:e deviance:e intercept:e oob_auc:e",
)
def resample_fits(t):
    return _fits(t)[1]


@query("resample_coefficients", "dataset:s fold_idx:i resample_id:i alpha:e feature:s beta:e rise:e")
def resample_coefficients(t):
    return _fits(t)[0]


# What the fits of a permutation are made of: shuffled labels, their own resamples and inner folds.
cte(
    "null_members",
    """WITH train AS (SELECT * FROM roles WHERE role = 'train'),
    shuffled AS (SELECT a.dataset, a.fold_idx, a.perm_id, a.sample_id, b.label FROM (
        SELECT dataset, fold_idx, sample_id, perm_id, row_number() OVER (PARTITION BY dataset, fold_idx, perm_id
          ORDER BY md5(concat_ws('|', 'base', sample_id))) AS pos FROM train, range(1, 101) g(perm_id)) a
      JOIN (SELECT dataset, fold_idx, label, perm_id, row_number() OVER (PARTITION BY dataset, fold_idx, perm_id
          ORDER BY md5(concat_ws('|', '123', perm_id, sample_id))) AS pos FROM train, range(1, 101) g(perm_id)) b
      USING (dataset, fold_idx, perm_id, pos)),
    dealt AS (SELECT *, (row_number() OVER (PARTITION BY dataset, fold_idx, perm_id, r, label
        ORDER BY md5(concat_ws('|', '123', 123 + 1000 * r, sample_id))) - 1) % 5 + 1 AS part
      FROM shuffled, range(1, 5) g(r)),
    member AS (SELECT dataset, fold_idx, perm_id, (r - 1) * 5 + f AS resample_id, sample_id, label, part = f AS oob
      FROM dealt, range(1, 6) h(f))
    SELECT *, CASE WHEN oob THEN 0 ELSE (row_number() OVER (PARTITION BY dataset, fold_idx, perm_id, resample_id, label, oob
      ORDER BY md5(concat_ws('|', '123', dataset, fold_idx, perm_id, resample_id, sample_id))) - 1) % 5 + 1 END AS fold
    FROM member""",
    "roles",
)


@query(
    "null_fit_members",
    "dataset:s fold_idx:i perm_id:i resample_id:i fold:i n:i n_positive:i first_id:i id_sum:i",
    with_("null_members")
    + """SELECT dataset, fold_idx, perm_id, resample_id, fold, count(*) AS n, sum(label) AS n_positive,
    min(sample_id) AS first_id, sum(sample_id) AS id_sum FROM null_members GROUP BY 1, 2, 3, 4, 5""",
)
def null_fit_members(t):
    labels = roles(t).where("role = 'train'").drop("role")
    members = pen.permuted_members(labels, FOLD, 100, 20, 5, 123)
    n = F.size("sample_ids").cast("long")
    total = F.aggregate("sample_ids", F.lit(0).cast("long"), lambda a, i: a + i)
    return members.groupBy(*FOLD, "perm_id", "resample_id", "fold").agg(
        F.sum(n).alias("n"),
        F.sum(F.col("label") * n).alias("n_positive"),
        F.min(F.array_min("sample_ids")).alias("first_id"),
        F.sum(total).alias("id_sum"),
    )


@query(
    "null_study",
    "dataset:s fold_idx:i feature:s alpha:e pi:e u:e sign_consistency:e e_pi:e e_u:e t_obs:e n_null:i p:e rank:i",
)
def null_study(t):
    return ns.null_study(samples(t), features(t), roles(t), FOLD)


@query(
    "choose_alpha",
    "dataset:s alpha:f mean_value:f",
    with_("fits")
    + """SELECT dataset, alpha, m AS mean_value FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY m DESC, alpha) AS rn FROM (
    SELECT dataset, resample_id % 2 / 2.0::DOUBLE AS alpha, round(avg(auc), 12) AS m FROM fits GROUP BY 1, 2)) WHERE rn = 1""",
)
def choose_alpha(t):
    f = screening_fits(t).withColumn("alpha", F.col("resample_id") % 2 / 2)
    return mo.choose_alpha(f, ["dataset"])


@query("shadow_importance", "dataset:s fold_idx:i feature:s score:e hits:i decision:s rank:i")
def shadow_importance(t):
    y, x = training(t)
    return tr.shadow_importance(x, y, FOLD)


# The first pick of every split is the most informative feature, the second gives up what it shares with the first.
MRMR_SQL = """
    , train AS (SELECT r.dataset, r.fold_idx, r.sample_id, r.label, f.feature, f.value FROM roles r
      JOIN (SELECT sample_id, feature, value FROM features) f USING (sample_id) WHERE role = 'train'),
    info AS (SELECT dataset, fold_idx, feature, -0.5 * ln(1 - least(abs(corr(value, label)), 1 - 1e-12) ** 2) AS rel
      FROM train GROUP BY 1, 2, 3),
    shared AS (SELECT a.dataset, a.fold_idx, a.feature, b.feature AS other,
        -0.5 * ln(1 - least(abs(corr(a.value, b.value)), 1 - 1e-12) ** 2) AS red
      FROM train a JOIN train b USING (dataset, fold_idx, sample_id) GROUP BY 1, 2, 3, 4),
    pick1 AS (SELECT dataset, fold_idx, feature AS p1, rel FROM info
      QUALIFY row_number() OVER (PARTITION BY dataset, fold_idx ORDER BY round(rel, 12) DESC, feature) = 1),
    pick2 AS (SELECT dataset, fold_idx, p1, i.feature AS p2, i.rel - red AS s2 FROM info i JOIN pick1 USING (dataset, fold_idx)
      JOIN (SELECT dataset, fold_idx, feature, other, red FROM shared) s ON s.dataset = i.dataset AND s.fold_idx = i.fold_idx
        AND s.feature = i.feature AND s.other = p1 WHERE i.feature != p1
      QUALIFY row_number() OVER (PARTITION BY i.dataset, i.fold_idx ORDER BY round(i.rel - red, 12) DESC, i.feature) = 1),
    pick3 AS (SELECT i.dataset, i.fold_idx, i.feature AS p3, i.rel - (a.red + b.red) / 2 AS s3 FROM info i
      JOIN pick2 p ON p.dataset = i.dataset AND p.fold_idx = i.fold_idx
      JOIN shared a ON a.dataset = i.dataset AND a.fold_idx = i.fold_idx AND a.feature = i.feature AND a.other = p.p1
      JOIN shared b ON b.dataset = i.dataset AND b.fold_idx = i.fold_idx AND b.feature = i.feature AND b.other = p.p2
      WHERE i.feature NOT IN (p.p1, p.p2)
      QUALIFY row_number() OVER (PARTITION BY i.dataset, i.fold_idx ORDER BY round(i.rel - (a.red + b.red) / 2, 12) DESC, i.feature) = 1)
    SELECT dataset, fold_idx, p1 AS feature, 1 AS rank, rel AS score, true AS selected FROM pick1
    UNION ALL SELECT dataset, fold_idx, p2, 2, s2, true FROM pick2
    UNION ALL SELECT dataset, fold_idx, p3, 3, s3, true FROM pick3
    UNION ALL SELECT i.dataset, i.fold_idx, feature, 3 + row_number() OVER (PARTITION BY i.dataset, i.fold_idx ORDER BY feature), NULL, false
      FROM info i JOIN pick1 a USING (dataset, fold_idx) JOIN (SELECT dataset, fold_idx, p2 FROM pick2) b USING (dataset, fold_idx)
      JOIN pick3 c USING (dataset, fold_idx) WHERE feature NOT IN (p1, p2, p3)"""


@query("mrmr_rank", "dataset:s fold_idx:i feature:s rank:i score:f selected:b")
def mrmr_rank(t):
    y, x = training(t)
    return mo.mrmr_rank(x, y, FOLD)


@query(
    "mrmr_first_picks",
    "dataset:s fold_idx:i feature:s rank:i score:f selected:b",
    with_("roles", "features").rstrip() + MRMR_SQL,
)
def mrmr_first_picks(t):
    y, x = training(t)
    return mo.mrmr_rank(x, y, FOLD, picks=3)


cte(
    "decoy_freqs",
    """SELECT dataset, feature, CAST(right(feature, 1) AS INT) % 2 = 1 AS decoy, penalty,
    avg(CAST(pi > penalty AS INT)) AS frequency FROM null_stats JOIN (VALUES (0.7), (1.1), (1.6)) g(penalty) ON true
    GROUP BY 1, 2, 3, 4""",
    "null_stats",
)


@query(
    "decoy_select",
    "dataset:s feature:s score:f threshold:f fdp:f selected:b",
    with_("decoy_freqs")
    + """, s AS (SELECT dataset, decoy, feature, round(max(frequency), 9) AS score FROM decoy_freqs GROUP BY 1, 2, 3),
    b AS (SELECT t / 100.0::DOUBLE AS t, round((1 + count(*) FILTER (decoy AND score > t / 100.0::DOUBLE)
        * CAST(count(*) FILTER (NOT decoy) AS DOUBLE) / count(*) FILTER (decoy))
        / greatest(count(*) FILTER (NOT decoy AND score > t / 100.0::DOUBLE), 1), 12) AS fdp
      FROM s, range(10, 100) g(t) GROUP BY 1)
    SELECT dataset, feature, score, t AS threshold, fdp, score > t AS selected FROM s,
      (SELECT t, fdp FROM b ORDER BY fdp, t LIMIT 1) WHERE NOT decoy""",
)
def decoy_select(t):
    f = each(nulls(t), "penalty", [0.7, 1.1, 1.6]).withColumn(
        "decoy", F.substring("feature", -1, 1).cast("int") % 2 == 1
    )
    f = f.groupBy("dataset", "feature", "decoy", "penalty").agg(
        F.avg((F.col("pi") > F.col("penalty")).cast("int")).alias("frequency")
    )
    return mo.decoy_select(f, ["dataset"])


@query("decoy_features", "feature:s n:i mean:e")
def decoy_features(t):
    d = mo.decoy_features(features(t))
    return d.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("decoy_study", "dataset:s fold_idx:i feature:s score:e threshold:e fdp:e selected:b")
def decoy_study(t):
    y, x = training(t)
    return ds.decoy_study(x, y, FOLD)


@query("forward_panel", "dataset:s fold_idx:i feature:s rank:i inner_auc:e")
def forward_panel(t):
    y, x = training(t)
    return mo.forward_panel(x, y, FOLD)


@query(
    "tune_weight",
    "dataset:s weight:f mean_value:f",
    with_("evaluations")
    + """SELECT dataset, weight, m AS mean_value FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY m DESC, weight) AS rn FROM (
    SELECT dataset, ([0, 0.5, 1, 2, 4])[fold_idx] AS weight, round(avg(auc), 12) AS m FROM evaluations WHERE k = 20 GROUP BY 1, 2)) WHERE rn = 1""",
)
def tune_weight(t):
    weights = F.array(*[F.lit(v) for v in (0.0, 0.5, 1.0, 2.0, 4.0)])
    inner = evaluations(t).withColumn("weight", F.element_at(weights, F.col("fold_idx")))
    return mo.tune_weight(inner, ["dataset"])


@query(
    "nested_size",
    "dataset:s fold_idx:i method:s best_inner_k:i best_inner_mean:e one_se_threshold:e chosen_k:i outer_auc:e random_auc:e outer_delta:e",
)
def nested_size(t):
    return nc.nested_size(samples(t), features(t), roles(t), FOLD)


@query("nested_weight", "dataset:s fold_idx:i weight:e mean_value:e outer_auc:e n_changed:i")
def nested_weight(t):
    return nc.nested_weight(samples(t), features(t), roles(t), feat_sets(t), FOLD, minimum=4)


# The inner folds that both choices rest on.
@query(
    "nested_members",
    "dataset:s fold_idx:i inner_idx:i role:s n:i n_positive:i id_sum:i",
    with_("roles")
    + """SELECT dataset, fold_idx, inner_idx, CASE WHEN fold = inner_idx THEN 'test' ELSE 'train' END AS role,
    count(*) AS n, sum(label) AS n_positive, sum(sample_id) AS id_sum FROM (
    SELECT *, (row_number() OVER (PARTITION BY dataset, fold_idx, label
      ORDER BY md5(concat_ws('|', '7', dataset, fold_idx, sample_id))) - 1) % 3 + 1 AS fold
    FROM roles WHERE role = 'train'), range(1, 4) g(inner_idx) GROUP BY 1, 2, 3, 4""",
)
def nested_members(t):
    inner = nc.inner_roles(samples(t), roles(t), FOLD, 3, 7)
    return inner.groupBy(*FOLD, "inner_idx", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive"), F.sum("sample_id").alias("id_sum")
    )
