"""Queries over selection frequency, utility and permutation nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.folds import PERMUTED_SQL
from catalog.scores import auc_sql, avg_rank, bh_sql, mi_table
from catalog.standins import cte, features, samples, with_
from sievework.operators import evidence as ev
from sievework.operators import folds as fo
from sievework.operators import inference as inf
from sievework.operators.scores import auc_score, class_stats

K = ["dataset"]

# --- one screening model per half-sample: mean differences above a threshold --------------------

cte(
    "coefs",
    """SELECT dataset, resample_id, feature, CASE WHEN abs(d) > 0.012 THEN d ELSE 0 END AS beta FROM (
      SELECT f.dataset, h.resample_id, f.feature, avg(value) FILTER (f.label = 1) - avg(value) FILTER (f.label = 0) AS d
      FROM features f JOIN half_samples h ON h.sample_id = f.sample_id AND h.role = 'train' GROUP BY 1, 2, 3)""",
    "features",
    "half_samples",
)
cte(
    "etas",
    """SELECT h.dataset, h.resample_id, h.sample_id, h.label, 0.1 + coalesce(xb, 0) AS eta FROM half_samples h LEFT JOIN (
      SELECT h.resample_id, h.sample_id, sum(beta * value) AS xb FROM half_samples h JOIN features f ON f.sample_id = h.sample_id
      JOIN coefs c ON c.resample_id = h.resample_id AND c.feature = f.feature WHERE h.role = 'oob' AND beta != 0 GROUP BY 1, 2) x
    ON x.resample_id = h.resample_id AND x.sample_id = h.sample_id WHERE h.role = 'oob'""",
    "coefs",
)
cte(
    "fits",
    "SELECT *, 0.1 AS intercept FROM ("
    + auc_sql("etas", "dataset, resample_id", "eta")
    + ")",
    "etas",
)


def resamples(t):
    return fo.subsamples(samples(t), 4, seed=7, scheme="half").select(
        "dataset", "resample_id", "sample_id", "label", "role"
    )


def coefs(t):
    train = resamples(t).where("role = 'train'").drop("role")
    s = class_stats(features(t).join(train, ["dataset", "sample_id"]), ["dataset", "resample_id", "feature"])
    d = F.col("m1") - F.col("m0")
    return s.select(
        "dataset", "resample_id", "feature", F.when(F.abs(d) > 0.012, d).otherwise(0.0).alias("beta")
    )


def oob(t):
    return resamples(t).where("role = 'oob'").drop("role")


def fits(t):
    base = coefs(t).select("dataset", "resample_id").distinct().withColumn("intercept", F.lit(0.1))
    eta = ev.linear_predictor(features(t), coefs(t), base, oob(t), K)
    auc = auc_score(
        eta, ["dataset", "resample_id"], score="eta", bounded=t.fits("embeddings", 4)
    )
    return base.join(auc.select("dataset", "resample_id", F.col("auc").alias("oob_auc")), ["dataset", "resample_id"])


cte(
    "frequency",
    """SELECT dataset, feature, count(*) FILTER (beta != 0) / 4.0::DOUBLE AS frequency,
    sum(abs(beta)) / 4 AS mean_abs, count(*) FILTER (beta != 0) AS n_selected FROM coefs GROUP BY 1, 2""",
    "coefs",
)


@query(
    "selection_frequency",
    "dataset:s feature:s frequency:f mean_abs:f n_selected:i",
    with_("frequency") + "SELECT * FROM frequency",
)
def selection_frequency(t):
    return ev.selection_frequency(coefs(t), K, 4)


@query(
    "prediction_first_score",
    "dataset:s feature:s score:f rank:i",
    with_("frequency")
    + """SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, feature) AS rank FROM (
    SELECT *, mean_abs * pow(frequency, 0.25) AS score FROM frequency)""",
)
def prediction_first_score(t):
    f = ev.selection_frequency(coefs(t), K, 4)
    return ev.prediction_first_score(f, K, bounded=t.fits("embeddings", 64))


cte(
    "utilities",
    """SELECT dataset, feature, greatest(CASE WHEN sum(w) > 0 THEN sum(delta * w) / sum(w) ELSE 0 END, 0) AS utility,
      count(*) AS n_selected FROM (
      SELECT e.dataset, c.feature, e.resample_id, sum(-2 * ((label * (eta - beta * value) - ln(1 + exp(eta - beta * value)))
        - (label * eta - ln(1 + exp(eta))))) AS delta FROM (SELECT dataset, resample_id, sample_id, label, eta FROM etas) e
      JOIN (SELECT sample_id, feature, value FROM features) f USING (sample_id)
      JOIN coefs c ON c.resample_id = e.resample_id AND c.feature = f.feature AND beta != 0 GROUP BY 1, 2, 3)
    JOIN (SELECT resample_id, greatest(auc - 0.5, 0) AS w FROM fits) USING (resample_id) GROUP BY 1, 2""",
    "etas",
    "fits",
)


@query(
    "deviance_utility",
    "dataset:s feature:s utility:f n_selected:i",
    with_("utilities") + "SELECT * FROM utilities",
)
def deviance_utility(t):
    return ev.deviance_utility(features(t), coefs(t), fits(t), oob(t), K)


@query(
    "resample_fit_auc",
    "dataset:s resample_id:i intercept:f oob_auc:f",
    with_("fits") + "SELECT *, auc AS oob_auc FROM fits",
)
def resample_fit_auc(t):
    return fits(t)


@query(
    "sign_consistency",
    "dataset:s feature:s sign_consistency:f",
    with_("coefs")
    + """SELECT dataset, feature, greatest(avg(CAST(beta > 0 AS INT)) FILTER (beta != 0),
    avg(CAST(beta < 0 AS INT)) FILTER (beta != 0)) AS sign_consistency FROM coefs GROUP BY 1, 2""",
)
def sign_consistency(t):
    return ev.sign_consistency(coefs(t), K)


# --- statistics under 20 label permutations ------------------------------------------------------

cte("permuted", PERMUTED_SQL, "samples")
cte(
    "perm_stats",
    """SELECT dataset, perm_id, feature, round(abs(m1 - m0) / (sqrt(pv) * sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)), 4) AS pi,
      round(greatest(m1 - m0 - 0.002, 0), 4) AS u FROM (
      SELECT *, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS pv FROM (
        SELECT f.dataset, perm_id, feature, sum(p.label) AS n1, count(*) - sum(p.label) AS n0,
          avg(value) FILTER (p.label = 1) AS m1, avg(value) FILTER (p.label = 0) AS m0,
          var_samp(value) FILTER (p.label = 1) AS v1, var_samp(value) FILTER (p.label = 0) AS v0
        FROM features f JOIN (SELECT perm_id, sample_id, label FROM permuted
          UNION ALL SELECT 0, sample_id, label FROM samples) p USING (sample_id) GROUP BY 1, 2, 3))""",
    "permuted",
    "features",
)
cte("obs_stats", "SELECT dataset, feature, pi, u FROM perm_stats WHERE perm_id = 0", "perm_stats")
cte("null_stats", "SELECT dataset, perm_id, feature, pi, u FROM perm_stats WHERE perm_id > 0", "perm_stats")


def _stats(t, labels, keys):
    s = class_stats(features(t).join(labels, ["dataset", "sample_id"]), keys)
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (
        F.col("n1") + F.col("n0") - 2
    )
    d = F.col("m1") - F.col("m0")
    return s.select(
        *keys,
        F.round(
            F.abs(d) / (F.sqrt(pooled) * F.sqrt(1 / F.col("n1") + 1 / F.col("n0"))), 4
        ).alias("pi"),
        F.round(F.greatest(d - 0.002, F.lit(0.0)), 4).alias("u"),
    )


def nulls(t):
    return _stats(t, fo.permute_labels(samples(t), 20, 11), ["dataset", "perm_id", "feature"])


def observed(t):
    return _stats(t, samples(t).select("dataset", "sample_id", "label"), ["dataset", "feature"])


cte(
    "exceed",
    """SELECT o.dataset, o.feature, o.pi, o.u, (1 + count(*) FILTER (n.pi >= o.pi)) / 21.0::DOUBLE AS e_pi,
    (1 + count(*) FILTER (n.u >= o.u)) / 21.0::DOUBLE AS e_u FROM obs_stats o JOIN null_stats n USING (dataset, feature)
    GROUP BY 1, 2, 3, 4""",
    "obs_stats",
    "null_stats",
)
cte(
    "loo",
    """SELECT a.dataset, a.feature, a.perm_id, count(*) FILTER (b.pi >= a.pi) / 20.0::DOUBLE AS e_pi,
    count(*) FILTER (b.u >= a.u) / 20.0::DOUBLE AS e_u FROM null_stats a JOIN null_stats b USING (dataset, feature)
    GROUP BY 1, 2, 3""",
    "null_stats",
)


@query(
    "exceedance",
    "dataset:s feature:s e_pi:f e_u:f",
    with_("exceed") + "SELECT * FROM exceed",
)
def exceedance(t):
    return ev.exceedance(observed(t), nulls(t), K)


@query(
    "loo_exceedance",
    "dataset:s feature:s perm_id:i e_pi:f e_u:f",
    with_("loo") + "SELECT * FROM loo",
)
def loo_exceedance(t):
    return ev.loo_exceedance(nulls(t), K)


@query(
    "joint_null",
    "dataset:s feature:s t_obs:f p:f rank:i",
    with_("exceed", "loo")
    + """SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p, pi DESC, feature) AS rank FROM (
    SELECT o.dataset, o.feature, o.pi, t_obs, (1 + count(*) FILTER (round(t_null, 9) >= round(t_obs, 9))) / 21.0::DOUBLE AS p FROM
      (SELECT *, -2 * (ln(e_pi) + ln(e_u)) AS t_obs FROM exceed) o
      JOIN (SELECT dataset, feature, -2 * (ln(e_pi) + ln(e_u)) AS t_null FROM loo) n USING (dataset, feature) GROUP BY 1, 2, 3, 4)""",
)
def joint_null(t):
    return ev.joint_null(observed(t), nulls(t), K, t.fits("embeddings", 64))


@query(
    "check_nulls",
    "dataset:s n_perm:i unpaired:i uneven:i coarse:b",
    with_("null_stats", "obs_stats")
    + """, n AS (SELECT dataset, feature, count(DISTINCT perm_id) AS m FROM null_stats WHERE feature != 'f01' OR perm_id != 3
      GROUP BY 1, 2), o AS (SELECT dataset, feature, 1 AS seen FROM obs_stats WHERE feature != 'f00')
    SELECT dataset, (SELECT max(m) FROM n) AS n_perm, count(*) FILTER (seen IS NULL OR m IS NULL) AS unpaired,
      count(*) FILTER (m != (SELECT max(m) FROM n)) AS uneven, (SELECT max(m) FROM n) < 20 AS coarse
    FROM n FULL JOIN o USING (dataset, feature) GROUP BY 1""",
)
def check_nulls(t):
    o = observed(t).where("feature != 'f00'")
    n = nulls(t).where("feature != 'f01' or perm_id != 3")
    return ev.check_nulls(o, n, K)


@query(
    "panel_membership",
    "dataset:s feature:s membership:f",
    with_("null_stats")
    + """SELECT dataset, feature, avg(CAST(r <= 10 AS INT)) AS membership FROM (SELECT *, row_number() OVER (
    PARTITION BY dataset, perm_id ORDER BY pi, feature) AS r FROM null_stats) GROUP BY 1, 2""",
)
def panel_membership(t):
    return ev.panel_membership(nulls(t), K, "perm_id", 10, "pi")


def epsilon(t, obs):
    return ev.utility_epsilon(obs, K, bounded=t.fits("embeddings", 64))


cte("eps", "SELECT dataset, quantile_cont(u, 0.95) AS eps FROM obs_stats WHERE u > 0 GROUP BY 1", "obs_stats")


def ratio_sql(num: str, den: str, eps: str = "eps") -> str:
    return f"pow(2, greatest(least(log2(({num} + {eps}) / ({den} + {eps})), 4), -4))"


@query(
    "evidence_ratio_frequency",
    "dataset:s feature:s null_mean:f ratio:f",
    with_("obs_stats", "null_stats")
    + f"""SELECT *, {ratio_sql('pi', 'null_mean', '0.01')} AS ratio FROM (SELECT o.dataset, o.feature, o.pi, avg(n.pi) AS null_mean
    FROM obs_stats o JOIN null_stats n USING (dataset, feature) GROUP BY 1, 2, 3)""",
)
def evidence_ratio_frequency(t):
    return ev.evidence_ratio(observed(t), nulls(t), K, "pi", 0.01)


@query(
    "evidence_ratio_utility",
    "dataset:s feature:s eps:f ratio:f",
    with_("obs_stats", "null_stats", "eps")
    + f"""SELECT *, {ratio_sql('u', 'null_mean')} AS ratio FROM (SELECT o.dataset, o.feature, o.u, eps, avg(n.u) AS null_mean
    FROM obs_stats o JOIN null_stats n USING (dataset, feature) JOIN eps USING (dataset) GROUP BY 1, 2, 3, 4)""",
)
def evidence_ratio_utility(t):
    o = observed(t)
    return ev.evidence_ratio(o, nulls(t), K, "u", epsilon(t, o))


cte(
    "lopo",
    f"""SELECT *, {ratio_sql('u', '((su - u) / 19)')} AS ratio, log2({ratio_sql('u', '((su - u) / 19)')}) AS l FROM (
    SELECT *, sum(u) OVER (PARTITION BY dataset, feature) AS su FROM null_stats JOIN eps USING (dataset))""",
    "null_stats",
    "eps",
)


@query(
    "lopo_ratio",
    "dataset:s feature:s perm_id:i ratio:f",
    with_("lopo") + "SELECT * FROM lopo",
)
def lopo_ratio(t):
    return ev.lopo_ratio(nulls(t), K, "u", epsilon(t, observed(t)))


@query(
    "lopo_summary",
    "dataset:s n_values:i median_ratio:f mean_log2:f sd_log2:f share_half_two:f share_above_two:f "
    "share_below_half:f share_at_floor:f share_at_ceiling:f",
    with_("lopo")
    + """SELECT dataset, count(*) AS n_values, median(ratio) AS median_ratio, avg(l) AS mean_log2, stddev_samp(l) AS sd_log2,
    avg(CAST(ratio >= 0.5 AND ratio <= 2 AS INT)) AS share_half_two, avg(CAST(ratio > 2 AS INT)) AS share_above_two,
    avg(CAST(ratio < 0.5 AS INT)) AS share_below_half, avg(CAST(l <= -4 + 0.000000001 AS INT)) AS share_at_floor,
    avg(CAST(l >= 4 - 0.000000001 AS INT)) AS share_at_ceiling FROM lopo GROUP BY 1""",
)
def lopo_summary(t):
    r = ev.lopo_ratio(nulls(t), K, "u", epsilon(t, observed(t)))
    return ev.ratio_summary(r, K)


cte(
    "gene_level",
    f"""SELECT g.*, coalesce(b.obs_bin, 0) AS obs_bin, log2(ratio) - log2({ratio_sql('obs', 'null_mean', '0.000000000001')}) AS eps_log2 FROM (
      SELECT *, CASE WHEN null_mean > 0 THEN null_sd / null_mean END AS null_cv, {ratio_sql('obs', 'null_mean')} AS ratio,
        obs <= 0.000010001 AS at_floor FROM (
        SELECT l.dataset, l.feature, o.u AS obs, eps, avg(l.u) AS null_mean, stddev_samp(l.u) AS null_sd,
          count(*) FILTER (l.u > 0) AS null_n_positive, max(l.u) AS null_max, min(l.ratio) AS lopo_min, max(l.ratio) AS lopo_max,
          max(l.l) - min(l.l) AS lopo_log2_range, max(CAST(l.ratio < 0.5 OR l.ratio > 2 AS INT)) AS lopo_outside,
          max(log2({ratio_sql('o.u', '((su - l.u) / 19)')})) - min(log2({ratio_sql('o.u', '((su - l.u) / 19)')})) AS obs_log2_range
        FROM lopo l JOIN obs_stats o USING (dataset, feature) GROUP BY 1, 2, 3, 4)) g
    LEFT JOIN (SELECT dataset, feature, ceil(10 * {avg_rank('dataset', 'u')} / count(*) OVER (PARTITION BY dataset)) AS obs_bin
      FROM obs_stats WHERE u > 0.000010001) b USING (dataset, feature)""",
    "lopo",
    "obs_stats",
)


def gene_level(t):
    o = observed(t)
    return ev.null_gene_level(
        o, nulls(t), K, "u", epsilon(t, o), bounded=t.fits("embeddings", 64)
    )


@query(
    "null_gene_level",
    "dataset:s feature:s obs:f obs_bin:i null_mean:f null_sd:f null_cv:f null_n_positive:i null_max:f "
    "ratio:f eps_log2:f lopo_min:f lopo_max:f lopo_log2_range:f obs_log2_range:f",
    with_("gene_level") + "SELECT * FROM gene_level",
)
def null_gene_level(t):
    return gene_level(t)


@query(
    "null_bin_summary",
    "dataset:s obs_bin:i n_features:i median_obs:f share_at_floor:f median_null_mean:f median_null_cv:f "
    "share_null_zero:f median_n_positive:f median_lopo_range:f share_lopo_outside:f median_obs_range:f "
    "median_ratio:f median_eps_log2:f",
    with_("gene_level")
    + """SELECT dataset, obs_bin, count(*) AS n_features, median(obs) AS median_obs, avg(CAST(at_floor AS INT)) AS share_at_floor,
    median(null_mean) AS median_null_mean, median(null_cv) AS median_null_cv, avg(CAST(null_mean = 0 AS INT)) AS share_null_zero,
    median(null_n_positive) AS median_n_positive, median(lopo_log2_range) AS median_lopo_range,
    avg(lopo_outside) AS share_lopo_outside, median(obs_log2_range) AS median_obs_range, median(ratio) AS median_ratio,
    median(eps_log2) AS median_eps_log2 FROM gene_level GROUP BY 1, 2""",
)
def null_bin_summary(t):
    return ev.null_bin_summary(gene_level(t), K)


@query(
    "null_floor_summary",
    "dataset:s eps:f share_at_floor:f n_above_floor:i top10_share:f top50_share:f share_null_zero:f "
    "median_null_mean:f median_null_over_eps:f median_null_cv:f share_cv_above_1:f median_n_positive:f "
    "share_numerator_eps:f share_denominator_eps:f median_floor_null_over_eps:f",
    with_("gene_level")
    + """SELECT dataset, eps, avg(CAST(at_floor AS INT)) AS share_at_floor, count(*) FILTER (NOT at_floor) AS n_above_floor,
    sum(obs) FILTER (r <= 10) / sum(obs) AS top10_share, sum(obs) FILTER (r <= 50) / sum(obs) AS top50_share,
    avg(CAST(null_mean = 0 AS INT)) AS share_null_zero, median(null_mean) AS median_null_mean,
    median(null_mean / eps) AS median_null_over_eps, median(null_cv) AS median_null_cv,
    avg(CAST(null_cv > 1 AS INT)) AS share_cv_above_1, median(null_n_positive) AS median_n_positive,
    avg(CAST(obs < 0.01 * eps AS INT)) AS share_numerator_eps, avg(CAST(null_mean < 0.01 * eps AS INT)) AS share_denominator_eps,
    median(null_mean / eps) FILTER (at_floor) AS median_floor_null_over_eps FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY obs DESC, feature) AS r FROM gene_level) GROUP BY 1, 2""",
)
def null_floor_summary(t):
    return ev.null_floor_summary(gene_level(t), K)


@query(
    "eps_sensitivity",
    "dataset:s variant:s lopo_median:f lopo_sd_log2:f lopo_half_two:f lopo_at_floor:f obs_median:f "
    "obs_sd_log2:f obs_half_two:f",
    with_("null_stats", "obs_stats", "eps")
    + f""", v AS (SELECT dataset, 'saved' AS variant, eps FROM eps UNION ALL SELECT dataset, 'saved_over_100', eps / 100 FROM eps
      UNION ALL SELECT dataset, 'fixed_1e_6', 0.000001 FROM eps),
    a AS (SELECT *, log2(r) AS l FROM (SELECT dataset, variant, {ratio_sql('u', '((su - u) / 19)')} AS r FROM (
      SELECT *, sum(u) OVER (PARTITION BY dataset, feature) AS su FROM null_stats) JOIN v USING (dataset))),
    b AS (SELECT *, log2(r) AS l FROM (SELECT dataset, variant, {ratio_sql('u', 'nm')} AS r FROM obs_stats JOIN (
      SELECT dataset, feature, avg(u) AS nm FROM null_stats GROUP BY 1, 2) USING (dataset, feature) JOIN v USING (dataset)))
    SELECT * FROM (SELECT dataset, variant, median(r) AS lopo_median, stddev_samp(l) AS lopo_sd_log2,
      avg(CAST(r >= 0.5 AND r <= 2 AS INT)) AS lopo_half_two, avg(CAST(l <= -4 + 0.000000001 AS INT)) AS lopo_at_floor FROM a GROUP BY 1, 2)
    JOIN (SELECT dataset, variant, median(r) AS obs_median, stddev_samp(l) AS obs_sd_log2,
      avg(CAST(r >= 0.5 AND r <= 2 AS INT)) AS obs_half_two FROM b GROUP BY 1, 2) USING (dataset, variant)""",
)
def eps_sensitivity(t):
    o = observed(t)
    return ev.eps_sensitivity(o, nulls(t), K, "u", epsilon(t, o))


@query(
    "variance_split",
    "dataset:s total_sd:f between_sd:f within_sd:f own_spread_sd:f reference_noise_sd:f",
    with_("lopo")
    + """SELECT * FROM (SELECT dataset, stddev_samp(l) AS total_sd FROM lopo GROUP BY 1) JOIN (
    SELECT dataset, stddev_samp(m) AS between_sd, sqrt(avg(v)) AS within_sd, sqrt(avg(o)) AS own_spread_sd,
      sqrt(greatest(avg(v) - avg(o), 0)) AS reference_noise_sd FROM (
      SELECT dataset, feature, avg(l) AS m, var_samp(l) AS v, var_samp(log2((u + eps) / (su / 20 + eps))) AS o
      FROM lopo GROUP BY 1, 2) GROUP BY 1) USING (dataset)""",
)
def variance_split(t):
    return ev.variance_split(nulls(t), K, "u", epsilon(t, observed(t)))


cte(
    "instances",
    """SELECT dataset, feature, avg(CAST(coalesce(round(value, 12) >= round(cut, 12), false) AS INT)) AS frequency FROM features
    LEFT JOIN (SELECT sample_id, quantile_cont(value, 0.75) AS cut FROM features WHERE value > 0 GROUP BY 1) USING (sample_id)
    GROUP BY 1, 2""",
    "features",
)


@query(
    "instance_frequency",
    "dataset:s feature:s frequency:f",
    with_("instances") + "SELECT * FROM instances",
)
def instance_frequency(t):
    return ev.instance_frequency(features(t), K, t.fits("embeddings", 64))


cte(
    "utility_pct",
    f"""SELECT *, ({avg_rank('dataset', 'raw')} - 1) / (count(*) OVER (PARTITION BY dataset) - 1) AS utility FROM (
    SELECT *, round(sqrt(f * i + 0.0000000001), 12) AS raw FROM (SELECT *, ({avg_rank('dataset', 'frequency')} - 1) / (count(*) OVER (PARTITION BY dataset) - 1) AS f,
      ({avg_rank('dataset', 'mi')} - 1) / (count(*) OVER (PARTITION BY dataset) - 1) AS i FROM instances JOIN mi USING (dataset, feature)))""",
    "instances",
    "mi",
)


@query(
    "utility_score",
    "dataset:s feature:s raw:f utility:f",
    with_("utility_pct") + "SELECT * FROM utility_pct",
)
def utility_score(t):
    small = t.fits("embeddings", 64)
    return ev.utility_score(ev.instance_frequency(features(t), K, small), mi_table(t), K, small)


@query(
    "combine_scores",
    "dataset:s feature:s equal:f weighted:f",
    with_("obs_stats")
    + """SELECT dataset, feature, CASE WHEN least(pi, u) <= 0 THEN 0 ELSE sqrt(pi * u) END AS equal,
    CASE WHEN least(pi, u) <= 0 THEN 0 ELSE exp(0.75 * ln(CASE WHEN pi > 0 THEN pi ELSE 1 END)
      + 0.25 * ln(CASE WHEN u > 0 THEN u ELSE 1 END)) END AS weighted FROM obs_stats""",
)
def combine_scores(t):
    o = ev.combine_scores(observed(t), {"pi": 1, "u": 1}, "equal")
    return ev.combine_scores(o, {"pi": 3, "u": 1}, "weighted")


@query(
    "component_rankings",
    "dataset:s method:s feature:s rank:i",
    with_("obs_stats", "frequency")
    + """SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY score DESC, raw DESC, feature) AS rank FROM (
    SELECT dataset, feature, 'utility' AS method, u AS score, pi AS raw FROM obs_stats UNION ALL
    SELECT dataset, feature, 'frequency', frequency, round(mean_abs, 9) FROM frequency)""",
)
def component_rankings(t):
    f = ev.selection_frequency(coefs(t), K, 4).withColumn("mean_abs", F.round("mean_abs", 9))
    s = observed(t).join(f, ["dataset", "feature"])
    columns = {"utility": ("u", "pi"), "frequency": ("frequency", "mean_abs")}
    return ev.component_rankings(s, K, columns, t.fits("embeddings", 64))


# --- set tests -----------------------------------------------------------------------------------

cte(
    "feat_sets",
    """SELECT DISTINCT feature, set_id FROM (SELECT feature, 'd' || (CAST(substr(feature, 2) AS INT) % 5) AS set_id FROM features
    UNION ALL SELECT feature, 'q' || (CAST(substr(feature, 2) AS INT) // 4) FROM features)""",
    "features",
)


def feat_sets(t):
    f = features(t).select("feature", F.substring("feature", 2, 2).cast("int").alias("i")).distinct()
    return f.select(
        "feature",
        F.explode(
            F.array(F.concat(F.lit("d"), F.col("i") % 5), F.concat(F.lit("q"), F.expr("i div 4")))
        ).alias("set_id"),
    )


cte(
    "perm_t",
    """SELECT f.dataset, perm_id, feature, abs((avg(value) FILTER (p.label = 1) - avg(value) FILTER (p.label = 0))
      / (sqrt(((sum(p.label) - 1) * var_samp(value) FILTER (p.label = 1) + (count(*) - sum(p.label) - 1) * var_samp(value) FILTER (p.label = 0))
        / (count(*) - 2)) * sqrt(1.0::DOUBLE / sum(p.label) + 1.0::DOUBLE / (count(*) - sum(p.label))))) AS abs_t
    FROM features f JOIN (SELECT perm_id - 1 AS perm_id, sample_id, label FROM (
      SELECT a.perm_id, a.sample_id, b.label FROM (
        SELECT sample_id, perm_id, row_number() OVER (PARTITION BY perm_id ORDER BY md5(concat_ws('|', 'base', sample_id))) AS pos
          FROM samples, range(1, 1002) g(perm_id)) a
        JOIN (SELECT label, perm_id, row_number() OVER (PARTITION BY perm_id ORDER BY md5(concat_ws('|', '13', perm_id - 1, sample_id))) AS pos
          FROM samples, range(1, 1002) g(perm_id)) b USING (perm_id, pos))
      UNION ALL SELECT -1, sample_id, label FROM samples) p USING (sample_id) GROUP BY 1, 2, 3""",
    "features",
    "samples",
)
cte(
    "set_stats",
    """SELECT dataset, perm_id, set_id, avg(abs_t) AS stat, count(*) AS n_members FROM perm_t JOIN feat_sets USING (feature)
    GROUP BY 1, 2, 3 HAVING count(*) >= 4""",
    "perm_t",
    "feat_sets",
)
cte(
    "gate",
    bh_sql(
        "("
        + bh_sql(
            """(SELECT o.dataset, o.set_id, o.n_members, o.stat AS stat_obs, avg(n.stat) AS null_mean,
          (1 + count(*) FILTER (n.stat >= o.stat)) / 1001.0::DOUBLE AS p, (1 + count(*) FILTER (n.stat >= s.stat)) / 1001.0::DOUBLE AS p_self
          FROM set_stats o JOIN set_stats s ON s.set_id = o.set_id AND s.perm_id = 0
          JOIN set_stats n ON n.set_id = o.set_id AND n.perm_id > 0 WHERE o.perm_id = -1 GROUP BY ALL, s.stat)""".replace("GROUP BY ALL, s.stat", "GROUP BY 1, 2, 3, 4"),
            "dataset",
        ).replace("bh_n", "bh_n1").replace("bh_r", "bh_r1")
        + ")",
        "dataset",
        "p_self",
        "q_self",
    ),
    "set_stats",
)


def gate(t):
    pt = ev.permutation_t(features(t), samples(t), K, 1000, 13)
    return ev.set_gate(pt, feat_sets(t), K, 1000, 4)


@query(
    "set_gate",
    "dataset:s set_id:s n_members:i stat_obs:f null_mean:f p:f q:f p_self:f q_self:f",
    with_("gate") + "SELECT * FROM gate",
)
def set_gate(t):
    return gate(t)


@query(
    "certified_features",
    "dataset:s level:f feature:s",
    with_("gate")
    + """SELECT DISTINCT dataset, level, feature FROM gate JOIN feat_sets USING (set_id)
    JOIN (VALUES (0.3), (0.6), (1.0)) g(level) ON q <= level""",
)
def certified_features(t):
    pool = features(t).select("dataset", "feature").distinct()
    return ev.certified_features(gate(t), feat_sets(t), pool, K, (0.3, 0.6, 1.0))


@query(
    "gate_report",
    "dataset:s n_sets:i min_q:f n_q05:i n_q10:i n_q20:i self_test_pass:i",
    with_("gate")
    + """SELECT dataset, count(*) AS n_sets, min(q) AS min_q, count(*) FILTER (q <= 0.05) AS n_q05,
    count(*) FILTER (q <= 0.1) AS n_q10, count(*) FILTER (q <= 0.2) AS n_q20, count(*) FILTER (q_self <= 0.2) AS self_test_pass
    FROM gate GROUP BY 1""",
)
def gate_report(t):
    return inf.gate_report(gate(t), K)


@query(
    "set_scores",
    "dataset:s set_id:s stat_obs:f null_mean:f z:f",
    with_("set_stats")
    + """SELECT *, coalesce((stat_obs - null_mean) / nullif(sd, 0), 0) AS z FROM (SELECT dataset, set_id,
    max(stat) FILTER (perm_id = -1) AS stat_obs, avg(stat) FILTER (perm_id > 0) AS null_mean,
    stddev_samp(stat) FILTER (perm_id > 0) AS sd FROM set_stats GROUP BY 1, 2)""",
)
def set_scores(t):
    pt = ev.permutation_t(features(t), samples(t), K, 1000, 13)
    return ev.set_scores(pt, feat_sets(t), K, 4)
