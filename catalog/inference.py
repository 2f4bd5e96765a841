"""Queries over intervals, tests and cross-dataset summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.metrics import quart
from catalog.ranking import adaptive_outcomes, panels
from catalog.scores import avg_rank
from catalog.stability import nogueira_sql
from catalog.standins import cte, evaluations, feature_scores, part_scores, pools, with_
from sievework.functions.special import t_quantile
from sievework.operators import inference as inf
from sievework.operators import metrics as me
from sievework.operators import stability as st

DM = ["dataset", "method"]


@query(
    "describe_groups",
    "dataset:s method:s n:i mean:f sd:f q1:f median:f q3:f",
    with_("evaluations")
    + f"""SELECT dataset, method, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, {quart('x')} FROM (
    SELECT dataset, method, CASE WHEN auc != 0.5 THEN auc / (auc - 0.5) END AS x FROM evaluations) GROUP BY 1, 2""",
)
def describe_groups(t):
    e = evaluations(t).withColumn(
        "x", F.try_divide("auc", F.col("auc") - 0.5)
    ).withColumn("x", F.coalesce("x", F.lit(float("inf"))))
    return inf.describe_groups(e, DM, "x", t.fits("lineitem"))


T975 = ", ".join(f"({d}, {t_quantile(0.975, d)!r}::DOUBLE)" for d in range(1, 41))


def deltas(t):
    return me.with_random(evaluations(t))


@query(
    "corrected_t_interval",
    "dataset:s method:s k:i n:i mean:f se:f df:i t:f low:f high:f",
    with_("with_random")
    + f"""SELECT *, mean / se AS t, mean - c * se AS low, mean + c * se AS high FROM (
    SELECT dataset, method, k, count(*) AS n, count(*) - 1 AS df, avg(delta) AS mean,
      sqrt((1.0::DOUBLE / count(*) + 0.25) * var_samp(delta)) AS se FROM with_random GROUP BY 1, 2, 3)
    LEFT JOIN (VALUES {T975}) g(df, c) USING (df)""",
)
def corrected_t_interval(t):
    return inf.corrected_t_interval(deltas(t), [*DM, "k"], "delta")


@query("corrected_t_adjusted", "dataset:s method:s k:i t:e p:e q:e")
def corrected_t_adjusted(t):
    return inf.adjust_within(
        inf.corrected_t_interval(deltas(t), [*DM, "k"], "delta"), ["dataset", "k"]
    )


@query(
    "repeat_t_interval",
    "dataset:s method:s n_repeats:i mean:f se:f t:f low:f high:f",
    with_("with_random")
    + f"""SELECT *, mean / se AS t, mean - c * se AS low, mean + c * se AS high FROM (
    SELECT dataset, method, count(*) AS n_repeats, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS se FROM (
      SELECT dataset, method, repeat_idx, avg(delta) AS m FROM with_random GROUP BY 1, 2, 3)
    GROUP BY 1, 2) LEFT JOIN (VALUES {T975}) g(df, c) ON df = n_repeats - 1""",
)
def repeat_t_interval(t):
    return inf.repeat_t_interval(deltas(t), DM, "repeat_idx", "delta")


def boot_cte(keys: str, source: str, b: int, seed: int) -> str:
    """SQL of the cluster bootstrap means."""
    return f"""SELECT {keys}, replicate, sum(s) / sum(c) AS boot_mean FROM (
      SELECT {keys}, replicate, slot, ('0x' || substr(md5(concat_ws('|', '{seed}', {keys}, replicate, slot)), 1, 8))::BIGINT % r + 1 AS i
      FROM (SELECT {keys}, count(DISTINCT repeat_idx) AS r FROM {source} GROUP BY ALL),
        range(1, {b + 1}) g(replicate), range(1, 20) h(slot) WHERE slot <= r)
    JOIN (SELECT {keys}, repeat_idx, sum(delta) AS s, count(*) AS c,
        row_number() OVER (PARTITION BY {keys} ORDER BY repeat_idx) AS i FROM {source} GROUP BY {keys}, repeat_idx)
      USING ({keys}, i) GROUP BY ALL"""


cte("boot", boot_cte("dataset, method", "with_random", 400, 1), "with_random")
cte("boot_balanced", boot_cte("method, dataset", "with_random", 400, 1), "with_random")


@query(
    "cluster_bootstrap",
    "dataset:s method:s boot_mean:f low:f high:f",
    with_("boot")
    + """SELECT dataset, method, avg(boot_mean) AS boot_mean, quantile_cont(boot_mean, 0.025) AS low,
    quantile_cont(boot_mean, 0.975) AS high FROM boot GROUP BY 1, 2""",
)
def cluster_bootstrap(t):
    return inf.cluster_bootstrap(deltas(t), DM, "repeat_idx", "delta", 400, 1)


@query(
    "balanced_bootstrap",
    "method:s low:f high:f",
    with_("boot_balanced")
    + """SELECT method, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (
    SELECT method, replicate, avg(boot_mean) AS m FROM boot_balanced GROUP BY 1, 2) GROUP BY 1""",
)
def balanced_bootstrap(t):
    return inf.balanced_bootstrap(deltas(t), ["method"], "dataset", "repeat_idx", "delta", 400, 1)


@query(
    "balanced_mean",
    "method:s n_datasets:i mean:f se:f low:f high:f",
    with_("with_random")
    + """SELECT *, mean - 4.302652729749462 * se AS low, mean + 4.302652729749462 * se AS high FROM (
    SELECT method, count(*) AS n_datasets, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS se FROM (
    SELECT method, dataset, avg(delta) AS m FROM with_random GROUP BY 1, 2) GROUP BY 1)""",
)
def balanced_mean(t):
    return inf.balanced_mean(deltas(t), ["method"], "dataset", "delta")


cte(
    "rounded_deltas",
    """SELECT dataset, repeat_idx, fold_idx, method, k, round(delta, 3) AS d FROM with_random""",
    "with_random",
)


def rounded_deltas(t):
    return deltas(t).withColumn("d", F.round("delta", 3))


@query(
    "wilcoxon_signed_rank",
    "dataset:s method:s v:f n:i z:f",
    with_("rounded_deltas")
    + f"""SELECT *, (v - m - sign(v - m) * 0.5) / s AS z FROM (
    SELECT dataset, method, v, n, n * (n + 1) / 4 AS m,
      sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS s FROM (
      SELECT dataset, method, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS v, count(*) AS n FROM (
        SELECT *, {avg_rank('dataset, method', 'abs(d)')} AS r FROM rounded_deltas WHERE d != 0) GROUP BY 1, 2)
    JOIN (SELECT dataset, method, CAST(sum(t * t * t - t) AS DOUBLE) AS tie FROM (
      SELECT dataset, method, abs(d) AS a, count(*) AS t FROM rounded_deltas WHERE d != 0 GROUP BY 1, 2, 3)
      GROUP BY 1, 2) USING (dataset, method))""",
)
def wilcoxon_signed_rank(t):
    return inf.wilcoxon_signed_rank(rounded_deltas(t), DM, "d", t.fits("lineitem"))


@query("wilcoxon_adjusted", "dataset:s method:s k:i z:e p:e q:e")
def wilcoxon_adjusted(t):
    w = inf.wilcoxon_signed_rank(rounded_deltas(t), [*DM, "k"], "d", t.fits("lineitem"))
    return inf.adjust_within(w, ["dataset", "k"])


def ranks_sql(rank_expr: str) -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY mean_rank, mean_delta DESC, method) AS overall_order FROM (
    SELECT method, count(*) AS n_datasets, avg(r) AS mean_rank, median(r) AS median_rank,
      count(*) FILTER (r = 1) AS n_first, avg(primary_delta) AS mean_delta, median(primary_delta) AS median_delta,
      min(primary_delta) AS min_delta, max(primary_delta) AS max_delta FROM (
      SELECT *, {rank_expr} AS r FROM delta_primary) GROUP BY 1)"""


MR = (
    "method:s n_datasets:i mean_rank:f median_rank:f n_first:i mean_delta:f median_delta:f "
    "min_delta:f max_delta:f overall_order:i"
)


@query(
    "method_ranks",
    MR,
    with_("delta_primary") + ranks_sql(avg_rank("dataset", "primary_delta", True)),
)
def method_ranks(t):
    return inf.method_ranks(me.delta_primary(evaluations(t)))


@query(
    "method_ranks_min_ties",
    MR,
    with_("delta_primary")
    + ranks_sql("CAST(rank() OVER (PARTITION BY dataset ORDER BY primary_delta DESC) AS DOUBLE)"),
)
def method_ranks_min_ties(t):
    return inf.method_ranks(me.delta_primary(evaluations(t)), ties="min")


cte(
    "areas",
    """SELECT dataset, repeat_idx, fold_idx, method, sum(dx * (delta + pd) / 2) / (max(x) - min(x)) AS delta_area,
      sum(dx * (auc + pa) / 2) / (max(x) - min(x)) AS auc_area FROM (
      SELECT *, ln(k) AS x, ln(k) - lag(ln(k)) OVER w AS dx, lag(delta) OVER w AS pd, lag(auc) OVER w AS pa
      FROM with_random WINDOW w AS (PARTITION BY dataset, repeat_idx, fold_idx, method ORDER BY k)) GROUP BY 1, 2, 3, 4""",
    "with_random",
)
cte(
    "areas_by_dataset",
    """SELECT dataset, method, avg(delta_area) AS delta_area, stddev_samp(delta_area) AS sd_delta_area,
    avg(auc_area) AS auc_area, count(*) AS n_splits FROM areas GROUP BY 1, 2""",
    "areas",
)


@query(
    "efficiency_curve",
    "dataset:s method:s delta_area:f sd_delta_area:f auc_area:f n_splits:i",
    with_("areas_by_dataset") + "SELECT * FROM areas_by_dataset",
)
def efficiency_curve(t):
    return inf.efficiency_curve(evaluations(t))


@query(
    "efficiency_overall",
    "method:s delta_area:f sd_across_datasets:f auc_area:f rank:i",
    with_("areas_by_dataset")
    + """SELECT *, row_number() OVER (ORDER BY delta_area DESC, method) AS rank FROM (
    SELECT method, avg(delta_area) AS delta_area, stddev_samp(delta_area) AS sd_across_datasets,
    avg(auc_area) AS auc_area FROM areas_by_dataset GROUP BY 1)""",
)
def efficiency_overall(t):
    return inf.efficiency_overall(inf.efficiency_curve(evaluations(t)))


@query(
    "k_sensitivity",
    "dataset:s method:s best_k:i best_delta:f worst_k:i worst_delta:f delta_range:f spearman:f",
    with_("delta_by_k")
    + f"""SELECT * FROM (SELECT dataset, method, arg_max(k, (mean_delta, -k)) AS best_k, max(mean_delta) AS best_delta,
      arg_min(k, (mean_delta, k)) AS worst_k, min(mean_delta) AS worst_delta,
      max(mean_delta) - min(mean_delta) AS delta_range FROM delta_by_k GROUP BY 1, 2)
    JOIN (SELECT dataset, method, corr(rx, ry) AS spearman FROM (SELECT *, {avg_rank('dataset, method', 'k')} AS rx,
      {avg_rank('dataset, method', 'mean_delta')} AS ry FROM delta_by_k) GROUP BY 1, 2) USING (dataset, method)""",
)
def k_sensitivity(t):
    return inf.k_sensitivity(me.delta_by_k(evaluations(t)))


@query(
    "adaptive_summary",
    "dataset:s method:s n_splits:i mean_auc:f mean_random_auc:f mean_delta:f median_k:f mean_k:f share_small:f",
    with_("adaptive_outcome")
    + """SELECT dataset, method, count(*) AS n_splits, avg(outer_auc) AS mean_auc, avg(random_auc) AS mean_random_auc,
    avg(outer_delta) AS mean_delta, median(chosen_k) AS median_k, avg(chosen_k) AS mean_k,
    avg(CAST(chosen_k <= 50 AS INT)) AS share_small FROM adaptive_outcome GROUP BY 1, 2""",
)
def adaptive_summary(t):
    return inf.adaptive_summary(adaptive_outcomes(t))


@query(
    "adaptive_size_counts",
    "dataset:s method:s chosen_k:i n_splits:i",
    with_("adaptive_outcome")
    + "SELECT dataset, method, chosen_k, count(*) AS n_splits FROM adaptive_outcome GROUP BY 1, 2, 3",
)
def adaptive_size_counts(t):
    return inf.adaptive_size_counts(adaptive_outcomes(t))


@query(
    "adaptive_vs_fixed",
    "dataset:s method:s mean_auc_diff:f mean_delta_diff:f share_above:f",
    with_("adaptive_outcome", "with_random")
    + """SELECT a.dataset, a.method, avg(a.outer_auc - f.auc) AS mean_auc_diff,
    avg(a.outer_delta - f.delta) AS mean_delta_diff, avg(CAST(a.outer_auc - f.auc > 0 AS INT)) AS share_above
    FROM adaptive_outcome a LEFT JOIN (SELECT * FROM with_random WHERE k = 10) f
    USING (dataset, repeat_idx, fold_idx, method) GROUP BY 1, 2""",
)
def adaptive_vs_fixed(t):
    return inf.adaptive_vs_fixed(adaptive_outcomes(t), evaluations(t), 10)


cte(
    "runs",
    """SELECT l_returnflag AS dataset, 'm' || (l_partkey % 5) AS method, l_quantity AS seconds,
    l_linestatus = 'F' AS fallback, l_linenumber AS weight FROM lineitem""",
)


def runs(t):
    return t.lineitem.select(
        F.col("l_returnflag").alias("dataset"),
        F.concat(F.lit("m"), F.col("l_partkey") % 5).alias("method"),
        F.col("l_quantity").alias("seconds"),
        (F.col("l_linestatus") == "F").alias("fallback"),
        F.col("l_linenumber").alias("weight"),
    )


@query(
    "run_stats",
    "dataset:s method:s n_runs:i seconds_q1:f seconds_median:f seconds_q3:f total_seconds:f fallback_share:f",
    with_("runs")
    + f"""SELECT dataset, method, count(*) AS n_runs, {quart('seconds', 'seconds_')}, sum(seconds) AS total_seconds,
    avg(CAST(fallback AS INT)) AS fallback_share FROM runs GROUP BY 1, 2""",
)
def run_stats(t):
    return inf.run_stats(runs(t), DM, t.fits("lineitem"))


@query(
    "choice_shares",
    "dataset:s method:s weight:i n:i share:f",
    with_("runs")
    + """SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY dataset, method) AS share FROM (
    SELECT dataset, method, weight, count(*) AS n FROM runs GROUP BY 1, 2, 3)""",
)
def choice_shares(t):
    return inf.choice_shares(runs(t), DM, "weight")


@query(
    "best_per_cell",
    "dataset:s k:i method:s mean_auc:f",
    with_("delta_by_k")
    + """SELECT dataset, k, method, mean_auc FROM (SELECT *, row_number() OVER (PARTITION BY dataset, k
    ORDER BY mean_auc DESC, method) AS rn FROM delta_by_k) WHERE rn = 1""",
)
def best_per_cell(t):
    return inf.best_per_cell(me.delta_by_k(evaluations(t)), ["dataset", "k"], "mean_auc")


@query(
    "compare_runs",
    "dataset:s method:s k:i early:f late:f difference:f",
    with_("evaluations")
    + """SELECT *, early - late AS difference FROM (SELECT dataset, method, k,
    avg(auc) FILTER (repeat_idx < 1998) AS early, avg(auc) FILTER (repeat_idx >= 1998) AS late
    FROM evaluations GROUP BY 1, 2, 3)""",
)
def compare_runs(t):
    e = evaluations(t).withColumn(
        "source", F.when(F.col("repeat_idx") < 1998, "early").otherwise("late")
    )
    return inf.compare_runs(e, [*DM, "k"], "source", "early", "late", "auc")


@query(
    "wide_by_k",
    "dataset:s method:s k10:f k20:f k50:f position:i",
    with_("evaluations")
    + """SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY k50 DESC, method) AS position FROM (
    SELECT dataset, method, avg(auc) FILTER (k = 10) AS k10, avg(auc) FILTER (k = 20) AS k20,
    avg(auc) FILTER (k = 50) AS k50 FROM evaluations GROUP BY 1, 2)""",
)
def wide_by_k(t):
    return inf.wide_by_k(evaluations(t), [10, 20, 50], "auc", 50)


METHOD_MAP = "CASE method WHEN 'm1' THEN 'revenue' WHEN 'm2' THEN 'price' WHEN 'm3' THEN 'orders' ELSE 'quantity' END"


@query(
    "tradeoff_table",
    "dataset:s method:s mean_auc:f nogueira:f enrichment:f",
    with_("delta_by_k", "panels", "pools", "feature_scores")
    + f"""SELECT a.dataset, a.method, a.mean_auc, n.nogueira, coalesce(e.enrichment, 0) AS enrichment FROM
    (SELECT dataset, {METHOD_MAP} AS method, mean_auc FROM delta_by_k WHERE k = 50) a
    JOIN ({nogueira_sql('panels', 'pools')}) n ON n.k = 50 AND n.dataset = a.dataset AND n.method = a.method
    LEFT JOIN (SELECT dataset, method, avg(feature_scores.score) AS enrichment FROM panels JOIN feature_scores USING (feature)
      WHERE k = 50 AND method != 'orders' GROUP BY 1, 2) e ON e.dataset = a.dataset AND e.method = a.method""",
)
def tradeoff_table(t):
    p = panels(t)
    by_k = me.delta_by_k(evaluations(t)).withColumn("method", F.expr(METHOD_MAP))
    stab = st.nogueira(p, pools(t), [*DM, "k"], ["repeat_idx", "fold_idx"])
    enr = (
        p.where("k = 50 and method != 'orders'")
        .join(feature_scores(t).withColumnRenamed("score", "s"), "feature")
        .groupBy(*DM)
        .agg(F.avg("s").alias("enrichment"))
    )
    return inf.tradeoff_table(by_k, stab, enr)


def macro_sql(agg: str) -> str:
    return (
        with_("evaluations")
        + f"""SELECT method, avg(v) AS macro_mean, count(*) AS n_datasets FROM (
      SELECT dataset, method, avg(v) AS v FROM (SELECT dataset, method, k, {agg}(auc) AS v FROM evaluations
        GROUP BY 1, 2, 3) WHERE k IN (10, 20, 50) GROUP BY 1, 2) WHERE dataset IN ('A', 'N') GROUP BY 1"""
    )


@query("macro_means", "method:s macro_mean:f n_datasets:i", macro_sql("avg"))
def macro_means(t):
    return inf.macro_means(evaluations(t), ["A", "N"])


@query("macro_medians", "method:s macro_mean:f n_datasets:i", macro_sql("median"))
def macro_medians(t):
    return inf.macro_means(evaluations(t), ["A", "N"], first="median")


@query(
    "selected_size_summary",
    "dataset:s method:s min_size:i median_size:f max_size:i below_10:i below_20:i below_50:i",
    with_("part_scores")
    + """SELECT dataset, method, min(n) AS min_size, median(n) AS median_size, max(n) AS max_size,
    count(*) FILTER (n < 10) AS below_10, count(*) FILTER (n < 20) AS below_20, count(*) FILTER (n < 50) AS below_50
    FROM (SELECT dataset, method, repeat_idx, fold_idx, count(*) FILTER (score > 90) AS n FROM part_scores
      GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
)
def selected_size_summary(t):
    s = part_scores(t).withColumn("selected", F.col("score") > 90)
    return inf.selected_size_summary(s, DM, ["repeat_idx", "fold_idx"])


@query(
    "win_counts",
    "method:s auc:i gini:i",
    with_("evaluations")
    + """SELECT method, count(*) FILTER (auc > 0.5) AS auc, count(*) FILTER (2 * auc - 1 > 0.5) AS gini FROM (
    SELECT dataset, method, avg(auc) AS auc FROM evaluations GROUP BY 1, 2) GROUP BY 1""",
)
def win_counts(t):
    wide = (
        evaluations(t)
        .groupBy(*DM)
        .agg(F.avg("auc").alias("auc"))
        .withColumn("gini", 2 * F.col("auc") - 1)
    )
    return inf.win_counts(wide, ["auc", "gini"], 0.5)


@query(
    "arm_report",
    "dataset:s pool:s k:i arm:s n_splits:i mean_auc:f sd_auc:f n_fallback:i mean_random:f delta:f",
    with_("evaluations")
    + """, a AS (SELECT dataset, 'pool' || (repeat_idx % 2) AS pool, k, method AS arm, auc, fold_idx = 1 AS fb FROM evaluations)
    SELECT *, mean_auc - mean_random AS delta FROM (SELECT dataset, pool, k, arm, count(*) AS n_splits,
      avg(auc) AS mean_auc, stddev_samp(auc) AS sd_auc, sum(CAST(fb AS INT)) AS n_fallback FROM a
      WHERE arm != 'Random' GROUP BY 1, 2, 3, 4)
    LEFT JOIN (SELECT dataset, pool, k, avg(auc) AS mean_random FROM a WHERE arm = 'Random' GROUP BY 1, 2, 3)
      USING (dataset, pool, k)""",
)
def arm_report(t):
    e = (
        evaluations(t)
        .withColumn("pool", F.concat(F.lit("pool"), F.col("repeat_idx") % 2))
        .withColumn("gate_fallback", F.col("fold_idx") == 1)
        .withColumnRenamed("method", "arm")
    )
    return inf.arm_report(e)
