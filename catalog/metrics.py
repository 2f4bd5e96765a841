"""Queries over predictive metrics and paired comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.standins import SPLIT, cte, evaluations, part_id, part_scores, pools, rankings, scored_docs, with_
from sievework.operators import folds as fo
from sievework.operators import metrics as me
from sievework.operators.scores import auc_score

Q = """quantile_cont({0}, 0.25) AS {1}q1, quantile_cont({0}, 0.5) AS {1}median,
  quantile_cont({0}, 0.75) AS {1}q3"""


def quart(col: str, prefix: str = "") -> str:
    return Q.format(col, prefix)


cte(
    "with_random",
    """SELECT e.*, r.auc AS random_auc, e.auc - r.auc AS delta FROM evaluations e
    JOIN (SELECT * FROM evaluations WHERE method = 'Random') r USING (dataset, repeat_idx, fold_idx, k)
    WHERE e.method != 'Random'""",
    "evaluations",
)
cte(
    "delta_by_k",
    f"""SELECT dataset, method, k, count(*) AS n, avg(auc) AS mean_auc, stddev_samp(auc) AS sd_auc,
    avg(random_auc) AS mean_random_auc, avg(delta) AS mean_delta, stddev_samp(delta) AS sd_delta,
    {quart('delta', 'delta_')}, avg(CAST(delta > 0 AS INT)) AS positive_share
    FROM with_random GROUP BY 1, 2, 3""",
    "with_random",
)
cte(
    "delta_primary",
    f"""SELECT * FROM (SELECT dataset, method, count(*) AS n, avg(auc) AS primary_auc,
    avg(delta) AS primary_delta, stddev_samp(delta) AS sd_delta, {quart('delta', 'delta_')},
    avg(CAST(delta > 0 AS INT)) AS positive_share FROM with_random WHERE k IN (10, 20, 50) GROUP BY 1, 2)
    JOIN (SELECT dataset, method, min(m) AS repeat_min, max(m) AS repeat_max FROM (
      SELECT dataset, method, repeat_idx, avg(delta) AS m FROM with_random WHERE k IN (10, 20, 50)
      GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (dataset, method)""",
    "with_random",
)

THRESHOLD_BASE = """SELECT dataset, count(*) FILTER (prob >= 0.5 AND label = 1) AS tp,
  count(*) FILTER (prob >= 0.5 AND label = 0) AS fp, count(*) FILTER (prob < 0.5 AND label = 0) AS tn,
  count(*) FILTER (prob < 0.5 AND label = 1) AS fn FROM scored_docs GROUP BY 1"""


def threshold_sql(fill: str) -> str:
    return f"""SELECT *, (sensitivity + specificity) / 2 AS balanced_accuracy,
    CASE WHEN root > 0 THEN (tp * tn - fp * fn) / root ELSE {fill} END AS mcc FROM (
    SELECT *, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE {fill} END AS sensitivity,
      CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE {fill} END AS specificity,
      sqrt(CAST((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) AS DOUBLE)) AS root FROM ({THRESHOLD_BASE}))"""


TH = "dataset:s tp:i fp:i tn:i fn:i sensitivity:f specificity:f balanced_accuracy:f mcc:f"


@query("threshold_metrics_zero", TH, with_("scored_docs") + threshold_sql("0.0::DOUBLE"))
def threshold_metrics_zero(t):
    return me.threshold_metrics(scored_docs(t), ["dataset"], "prob", empty="zero")


@query("threshold_metrics_null", TH, with_("scored_docs") + threshold_sql("NULL"))
def threshold_metrics_null(t):
    return me.threshold_metrics(scored_docs(t), ["dataset"], "prob", empty="null")


@query(
    "average_precision",
    "dataset:s average_precision:f",
    with_("scored_docs")
    + """SELECT dataset, avg(CASE WHEN label = 1 THEN CAST(cp AS DOUBLE) / pos END) AS average_precision FROM (
    SELECT *, sum(label) OVER w AS cp, row_number() OVER w AS pos FROM scored_docs
    WINDOW w AS (PARTITION BY dataset ORDER BY score DESC, CAST(sample_id AS VARCHAR)
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1""",
)
def average_precision(t):
    return me.average_precision(scored_docs(t), ["dataset"], bounded=t.fits("labels"))


@query(
    "brier",
    "dataset:s brier:f",
    with_("scored_docs") + "SELECT dataset, avg((prob - label) ** 2) AS brier FROM scored_docs GROUP BY 1",
)
def brier(t):
    return me.brier(scored_docs(t), ["dataset"])


cte(
    "scored_cells",
    "SELECT *, sample_id % 3 AS repeat_idx FROM scored_docs",
    "scored_docs",
)


@query(
    "auc_by_cell",
    "dataset:s repeat_idx:i auc:f n_pos:i n_neg:i",
    with_("scored_cells")
    + """SELECT dataset, repeat_idx, sum(label) AS n_pos, count(*) - sum(label) AS n_neg,
      CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN
        (sum(label * ar) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
        / (sum(label) * (count(*) - sum(label))) END AS auc FROM (
      SELECT *, rank() OVER (PARTITION BY dataset, repeat_idx ORDER BY score)
        + (count(*) OVER (PARTITION BY dataset, repeat_idx, score) - 1) / 2.0::DOUBLE AS ar
      FROM scored_cells) GROUP BY 1, 2""",
)
def auc_by_cell(t):
    return auc_score(cells(t), ["dataset", "repeat_idx"], bounded=t.fits("labels"))


def cells(t):
    return scored_docs(t).withColumn("repeat_idx", F.col("sample_id") % 3)


@query(
    "metric_summary",
    "dataset:s metric:s mean:f sd:f n:i",
    with_("evaluations")
    + """SELECT dataset, metric, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM (
    SELECT dataset, method, auc, 2 * auc - 1 AS gini FROM evaluations)
    UNPIVOT (value FOR metric IN (auc, gini)) GROUP BY 1, 2""",
)
def metric_summary(t):
    e = evaluations(t).withColumn("gini", 2 * F.col("auc") - 1)
    return me.metric_summary(e, ["dataset"], ["auc", "gini"])


@query(
    "delta_vs_random_by_k",
    "dataset:s method:s k:i n:i mean_auc:f sd_auc:f mean_random_auc:f mean_delta:f sd_delta:f "
    "delta_q1:f delta_median:f delta_q3:f positive_share:f",
    with_("delta_by_k") + "SELECT * FROM delta_by_k",
)
def delta_vs_random_by_k(t):
    return me.delta_by_k(evaluations(t))


@query(
    "delta_vs_random_primary",
    "dataset:s method:s n:i primary_auc:f primary_delta:f sd_delta:f delta_q1:f delta_median:f "
    "delta_q3:f positive_share:f repeat_min:f repeat_max:f",
    with_("delta_primary") + "SELECT * FROM delta_primary",
)
def delta_vs_random_primary(t):
    return me.delta_primary(evaluations(t))


def _recovery(t):
    truth = t.part.where("p_retailprice % 100 > 80").select(part_id("p_partkey").alias("feature"))
    universe = t.part.select(part_id("p_partkey").alias("feature"))
    return me.recovery(rankings(t), truth, universe, [10, 20, 50], [*SPLIT, "method"])


@query(
    "recovery",
    "dataset:s repeat_idx:i fold_idx:i method:s k:i tp:i n_selected:i precision:f recall:f f1:f",
    with_("rankings")
    + """SELECT *, CAST(tp AS DOUBLE) / n_selected AS precision, CAST(tp AS DOUBLE) / nullif(n_true, 0) AS recall,
      CASE WHEN tp > 0 THEN 2 * (CAST(tp AS DOUBLE) / n_selected) * (CAST(tp AS DOUBLE) / n_true)
        / (CAST(tp AS DOUBLE) / n_selected + CAST(tp AS DOUBLE) / n_true) ELSE 0 END AS f1 FROM (
      SELECT dataset, repeat_idx, fold_idx, method, k, count(*) AS n_selected,
        count(*) FILTER (feature IN (SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') FROM part
          WHERE p_retailprice % 100 > 80)) AS tp,
        (SELECT count(*) FROM part WHERE p_retailprice % 100 > 80) AS n_true
      FROM rankings JOIN (VALUES (10), (20), (50)) g(k) ON rank <= k GROUP BY 1, 2, 3, 4, 5)""",
)
def recovery(t):
    return _recovery(t)


@query("recovery_pvalues", "dataset:s repeat_idx:i fold_idx:i method:s k:i tp:i p:e")
def recovery_pvalues(t):
    return _recovery(t)


PAIR = (
    "dataset:s method_a:s method_b:s n:i mean_diff:f sd_diff:f diff_q1:f diff_median:f diff_q3:f "
    "win_share:f tie_share:f repeat_min:f repeat_max:f"
)


def pair_sql(cond: str) -> str:
    return (
        with_("evaluations")
        + f""", d AS (SELECT a.dataset, a.repeat_idx, a.method AS method_a, b.method AS method_b, a.auc - b.auc AS diff
      FROM evaluations a JOIN evaluations b USING (dataset, repeat_idx, fold_idx, k)
      WHERE k IN (10, 20, 50) AND {cond})
    SELECT * FROM (SELECT dataset, method_a, method_b, count(*) AS n, avg(diff) AS mean_diff,
      stddev_samp(diff) AS sd_diff, {quart('diff', 'diff_')}, avg(CAST(diff > 0 AS INT)) AS win_share,
      avg(CAST(diff = 0 AS INT)) AS tie_share FROM d GROUP BY 1, 2, 3)
    JOIN (SELECT dataset, method_a, method_b, min(m) AS repeat_min, max(m) AS repeat_max FROM (
      SELECT dataset, method_a, method_b, repeat_idx, avg(diff) AS m FROM d GROUP BY 1, 2, 3, 4)
      GROUP BY 1, 2, 3) USING (dataset, method_a, method_b)"""
    )


@query("pairwise_methods", PAIR, pair_sql("a.method < b.method"))
def pairwise_methods(t):
    return me.pairwise_methods(evaluations(t))


@query("headline_vs_methods", PAIR, pair_sql("a.method = 'm1' AND b.method != 'm1'"))
def headline_vs_methods(t):
    return me.pairwise_methods(evaluations(t), "m1")


cte(
    "panel_draws",
    """SELECT dataset, repeat_idx, fold_idx, method, draw_id, CAST(sum(score) AS DOUBLE) / total AS auc FROM (
      SELECT p.*, draw_id,
        row_number() OVER (PARTITION BY dataset, repeat_idx, fold_idx, draw_id ORDER BY
          md5(concat_ws('|', '5', draw_id, dataset, repeat_idx, fold_idx, feature))) AS position
      FROM pools p, range(1, 11) g(draw_id)) JOIN part_scores USING (dataset, repeat_idx, fold_idx, feature)
    JOIN (SELECT dataset, repeat_idx, fold_idx, method, sum(score) AS total FROM part_scores
      GROUP BY 1, 2, 3, 4) USING (dataset, repeat_idx, fold_idx, method)
    WHERE position <= 20 GROUP BY 1, 2, 3, 4, 5, total""",
    "pools",
    "part_scores",
)


def panel_draws(t):
    """Share of each measure that random 20-part panels hold, ten draws per split."""
    q = part_scores(t)
    panels = fo.random_panels(pools(t), 20, 10, 5, SPLIT)
    totals = q.groupBy(*SPLIT, "method").agg(F.sum("score").alias("total"))
    return (
        panels.join(q, [*SPLIT, "feature"])
        .groupBy(*SPLIT, "method", "draw_id")
        .agg(F.sum("score").alias("s"))
        .join(totals, [*SPLIT, "method"])
        .withColumn("auc", F.col("s") / F.col("total"))
    )


@query(
    "random_mc",
    "dataset:s repeat_idx:i fold_idx:i method:s n_draws:i mean_random:f sd_random:f mc_se:f q025:f q975:f",
    with_("panel_draws")
    + """SELECT dataset, repeat_idx, fold_idx, method, count(*) AS n_draws, avg(auc) AS mean_random,
    stddev_samp(auc) AS sd_random, stddev_samp(auc) / sqrt(count(*)) AS mc_se,
    quantile_cont(auc, 0.025) AS q025, quantile_cont(auc, 0.975) AS q975 FROM panel_draws GROUP BY 1, 2, 3, 4""",
)
def random_mc(t):
    return me.random_mc(panel_draws(t), [*SPLIT, "method"])


@query(
    "random_mc_overall",
    "dataset:s method:s mean_random:f sd_across_splits:f se_across_splits:f mean_mc_se:f n_splits:i",
    with_("panel_draws")
    + """SELECT dataset, method, avg(m) AS mean_random, stddev_samp(m) AS sd_across_splits,
    stddev_samp(m) / sqrt(count(*)) AS se_across_splits, avg(se) AS mean_mc_se, count(*) AS n_splits FROM (
    SELECT dataset, method, repeat_idx, fold_idx, avg(auc) AS m, stddev_samp(auc) / sqrt(count(*)) AS se
    FROM panel_draws GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
)
def random_mc_overall(t):
    return me.random_mc_overall(panel_draws(t), ["dataset", "method"], ["repeat_idx", "fold_idx"])


@query(
    "variant_vs_current",
    "dataset:s method:s k:i n:i mean_variant:f mean_current:f mean_diff:f median_diff:f better_share:f",
    with_("evaluations")
    + """SELECT a.dataset, a.method, a.k, count(*) AS n, avg(a.auc) AS mean_variant, avg(b.auc) AS mean_current,
    avg(a.auc - b.auc) AS mean_diff, median(a.auc - b.auc) AS median_diff,
    avg(CAST(a.auc - b.auc > 0 AS INT)) AS better_share FROM evaluations a
    JOIN (SELECT * FROM evaluations WHERE method = 'm1') b USING (dataset, repeat_idx, fold_idx, k)
    WHERE a.method != 'm1' GROUP BY 1, 2, 3""",
)
def variant_vs_current(t):
    return me.variant_vs_current(evaluations(t), "m1")


@query(
    "component_table",
    "dataset:s k:i m1:f m2:f m3:f",
    with_("evaluations")
    + """SELECT dataset, k, avg(auc) FILTER (method = 'm1') AS m1, avg(auc) FILTER (method = 'm2') AS m2,
    avg(auc) FILTER (method = 'm3') AS m3 FROM evaluations GROUP BY 1, 2""",
)
def component_table(t):
    return me.component_table(evaluations(t), ["m1", "m2", "m3"])
