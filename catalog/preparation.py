"""Queries over feature collapse and train-fitted preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.standins import (
    SPLIT,
    count_folds,
    counts,
    cte,
    cv,
    features,
    part_id,
    samples,
    with_,
)
from sievework.operators import preparation as pr

CS = ["dataset", "fold_idx"]

cte(
    "probe_values",
    """SELECT 'parts' AS dataset, l_suppkey AS sample_id, l_partkey AS feature, sum(l_quantity) AS value
    FROM lineitem GROUP BY 1, 2, 3""",
)
cte(
    "probe_map",
    """SELECT p_partkey AS feature, p_name AS symbol FROM part WHERE p_partkey % 10 != 0""",
)


def probe_values(t):
    """Quantity per supplier and part; parts are the probes, part names the symbols."""
    return (
        t.lineitem.groupBy(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("feature"))
        .agg(F.sum("l_quantity").alias("value"))
        .withColumn("dataset", F.lit("parts"))
    )


def probe_map(t):
    return t.part.where("p_partkey % 10 != 0").select(
        F.col("p_partkey").alias("probe"), F.col("p_name").alias("symbol")
    )


@query(
    "collapse_max_mean",
    "dataset:s sample_id:i probe:i feature:s value:f",
    with_("probe_values", "probe_map")
    + """, best AS (SELECT symbol, feature FROM (SELECT symbol, feature, row_number() OVER (PARTITION BY symbol
      ORDER BY avg(value) DESC, feature) AS rn FROM probe_values JOIN probe_map USING (feature) GROUP BY 1, 2) WHERE rn = 1)
    SELECT dataset, sample_id, v.feature AS probe, symbol AS feature, value FROM probe_values v
    JOIN best b ON v.feature = b.feature""",
)
def collapse_max_mean(t):
    return pr.collapse_max_mean(probe_values(t), probe_map(t))


@query(
    "unmapped_probes",
    "dataset:s n_unmapped:i",
    with_("probe_values")
    + """SELECT dataset, count(DISTINCT feature) AS n_unmapped FROM probe_values
    WHERE feature % 10 = 0 GROUP BY 1""",
)
def unmapped_probes(t):
    return pr.unmapped_probes(probe_values(t), probe_map(t))


def collapse_sql(agg: str) -> str:
    return (
        with_("probe_values", "probe_map")
        + f"""SELECT dataset, sample_id, symbol AS feature, {agg}(value) AS value
      FROM probe_values JOIN probe_map USING (feature) GROUP BY 1, 2, 3"""
    )


@query("collapse_mean", "dataset:s sample_id:i feature:s value:f", collapse_sql("avg"))
def collapse_mean(t):
    return pr.collapse_mean(probe_values(t), probe_map(t))


@query("collapse_sum", "dataset:s sample_id:i feature:s value:f", collapse_sql("sum"))
def collapse_sum(t):
    return pr.collapse_sum(probe_values(t), probe_map(t))


@query(
    "collapse_scores_max",
    "feature:s score:f",
    """SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS feature, coalesce(s, 0) AS score FROM part
    LEFT JOIN (SELECT l_partkey AS p_partkey, max(l_extendedprice / 1000) AS s FROM lineitem
      GROUP BY 1) USING (p_partkey)""",
)
def collapse_scores_max(t):
    scores = t.lineitem.select(
        part_id("l_partkey").alias("feature"), (F.col("l_extendedprice") / 1000).alias("score")
    )
    return pr.collapse_scores_max(scores, t.part.select(part_id("p_partkey").alias("feature")))


cte(
    "low_count",
    """SELECT * FROM (SELECT dataset, fold_idx, feature, count(*) AS n_samples FROM counts
      JOIN (SELECT * FROM count_folds WHERE role = 'train') USING (dataset, sample_id)
      WHERE value >= 15 GROUP BY 1, 2, 3)
    JOIN (SELECT dataset, fold_idx, count(*) AS n FROM count_folds WHERE role = 'train' GROUP BY 1, 2) USING (dataset, fold_idx)
    WHERE n_samples >= least(34, n)""",
    "counts",
    "count_folds",
)


@query(
    "filter_low_count",
    "dataset:s fold_idx:i feature:s n_samples:i",
    with_("low_count") + "SELECT * FROM low_count",
)
def filter_low_count(t):
    return pr.filter_low_count(counts(t), count_folds(t), CS, 15, 34)


@query(
    "log_cpm",
    "dataset:s sample_id:i feature:s value:f",
    with_("counts")
    + """SELECT dataset, sample_id, feature, log2(value / sum(value) OVER (PARTITION BY sample_id) * 1000000 + 1) AS value
    FROM counts""",
)
def log_cpm(t):
    return pr.log_cpm(counts(t))


cte(
    "reference",
    """SELECT dataset, fold_idx, sample_id AS reference, mean_q FROM (
      SELECT *, row_number() OVER (PARTITION BY fold_idx ORDER BY round(abs(q - mean_q), 9), sample_id) AS rn FROM (
        SELECT *, avg(q) OVER (PARTITION BY fold_idx) AS mean_q FROM count_folds JOIN (
          SELECT sample_id, quantile_cont(cpm, 0.75) AS q FROM (
            SELECT *, value / sum(value) OVER (PARTITION BY sample_id) * 1000000 AS cpm FROM counts)
          GROUP BY 1) USING (sample_id) WHERE role = 'train')) WHERE rn = 1""",
    "counts",
    "count_folds",
)


@query(
    "reference_sample",
    "dataset:s fold_idx:i reference:i mean_q:f",
    with_("reference") + "SELECT * FROM reference",
)
def reference_sample(t):
    return pr.reference_sample(counts(t), count_folds(t), CS)


def ar(v: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY fold_idx, sample_id ORDER BY {v}) + "
        f"(count(*) OVER (PARTITION BY fold_idx, sample_id, {v}) - 1) / 2.0::DOUBLE)"
    )


cte("totals", "SELECT sample_id, sum(value) AS n FROM counts GROUP BY 1", "counts")
cte(
    "tmm",
    f"""SELECT dataset, fold_idx, sample_id, role, pow(2, raw - avg(raw) FILTER (role = 'train') OVER (PARTITION BY fold_idx)) AS factor
    FROM (SELECT cf.*, CASE WHEN far < 0.000001 THEN 0 ELSE coalesce(f, 0) END AS raw FROM count_folds cf LEFT JOIN (
      SELECT fold_idx, sample_id, max(far) AS far, sum(m / v) FILTER (keep) / sum(1 / v) FILTER (keep) AS f FROM (
        SELECT *, rm >= floor(k * 0.3) + 1 AND rm <= k - floor(k * 0.3)
          AND ra >= floor(k * 0.05) + 1 AND ra <= k - floor(k * 0.05) AS keep FROM (
          SELECT *, {ar('round(m, 9)')} AS rm, {ar('round(a, 9)')} AS ra, count(*) OVER (PARTITION BY fold_idx, sample_id) AS k,
            max(abs(m)) OVER (PARTITION BY fold_idx, sample_id) AS far FROM (
            SELECT cf.fold_idx, c.sample_id, log2((c.value / t.n) / (r.value / tr.n)) AS m,
              (log2(c.value / t.n) + log2(r.value / tr.n)) / 2 AS a,
              (t.n - c.value) / t.n / c.value + (tr.n - r.value) / tr.n / r.value AS v
            FROM counts c JOIN totals t ON t.sample_id = c.sample_id JOIN count_folds cf ON cf.sample_id = c.sample_id
            JOIN reference rf ON rf.fold_idx = cf.fold_idx JOIN counts r ON r.sample_id = rf.reference AND r.feature = c.feature
            JOIN totals tr ON tr.sample_id = r.sample_id))) GROUP BY 1, 2) g
      ON g.fold_idx = cf.fold_idx AND g.sample_id = cf.sample_id)""",
    "totals",
    "reference",
)


def tmm(t):
    c, f = counts(t), count_folds(t)
    ref = pr.reference_sample(c, f, CS).drop("mean_q")
    return pr.tmm_factors(c, f, ref, CS), ref


@query(
    "tmm_factors",
    "dataset:s fold_idx:i sample_id:i role:s factor:f",
    with_("tmm") + "SELECT * FROM tmm",
)
def tmm_factors(t):
    return tmm(t)[0]


@query(
    "normalised_log_cpm",
    "fold_idx:i sample_id:i role:s feature:s value:f",
    with_("tmm")
    + """, lib AS (SELECT tmm.*, n * factor AS lib FROM tmm JOIN totals USING (sample_id)),
    s AS (SELECT l.*, l.lib / CASE WHEN l.role = 'train' THEN tl ELSE (l.lib + rl) / 2 END AS p FROM lib l
      JOIN (SELECT fold_idx, avg(lib) AS tl FROM lib WHERE role = 'train' GROUP BY 1) a USING (fold_idx)
      JOIN (SELECT lib.fold_idx, lib.lib AS rl FROM lib JOIN reference r ON r.fold_idx = lib.fold_idx AND r.reference = lib.sample_id) b USING (fold_idx))
    SELECT fold_idx, sample_id, role, feature, log2((value + p) / (lib + 2 * p) * 1000000) AS value
    FROM s JOIN counts USING (sample_id)""",
)
def normalised_log_cpm(t):
    factors, ref = tmm(t)
    return pr.normalised_log_cpm(counts(t), factors, ref, CS)


cte(
    "train_var",
    """SELECT *, row_number() OVER (PARTITION BY repeat_idx, fold_idx ORDER BY variance DESC, feature) AS position FROM (
    SELECT c.dataset, repeat_idx, fold_idx, feature, var_samp(value) AS variance FROM cv c JOIN features f
      ON c.sample_id = f.sample_id WHERE role = 'train' GROUP BY 1, 2, 3, 4) WHERE variance > 0""",
    "cv",
    "features",
)


@query(
    "make_pools",
    "repeat_idx:i fold_idx:i pool:s feature:s position:i",
    with_("train_var")
    + """SELECT repeat_idx, fold_idx, 'variance' AS pool, feature, position FROM train_var WHERE position <= 20
    UNION ALL SELECT repeat_idx, fold_idx, 'annotated', feature, position FROM train_var WHERE right(feature, 1) IN ('1', '5')
    UNION ALL SELECT repeat_idx, fold_idx, 'size_control', feature, position FROM train_var WHERE position <= (
      SELECT count(DISTINCT feature) FROM train_var WHERE right(feature, 1) IN ('1', '5'))""",
)
def make_pools(t):
    f = features(t)
    annotated = f.where(F.substring("feature", -1, 1).isin("1", "5")).select("feature")
    return pr.make_pools(f, cv(t), SPLIT, annotated, 20, t.fits("embeddings", 64 * 10))


cte(
    "zscores",
    """SELECT c.dataset, c.repeat_idx, c.fold_idx, c.sample_id, c.role, c.label, f.feature,
      (f.value - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS value FROM cv c JOIN features f ON c.sample_id = f.sample_id
    JOIN (SELECT repeat_idx, fold_idx, feature, avg(value) AS m, stddev_samp(value) AS s FROM cv
      JOIN features USING (sample_id) WHERE role = 'train' GROUP BY 1, 2, 3) t
      ON t.repeat_idx = c.repeat_idx AND t.fold_idx = c.fold_idx AND t.feature = f.feature""",
    "cv",
    "features",
)


@query(
    "standardise",
    "repeat_idx:i fold_idx:i sample_id:i role:s feature:s value:f",
    with_("zscores") + "SELECT * FROM zscores",
)
def standardise(t):
    return pr.standardise(features(t), cv(t), SPLIT)


RES_OUT = "repeat_idx:i fold_idx:i sample_id:i role:s feature:s value:f"


@query(
    "residualise_one",
    RES_OUT,
    with_("cv", "features")
    + """, x AS (SELECT c.*, f.feature, f.value, s.conf FROM cv c JOIN features f ON c.sample_id = f.sample_id
      JOIN samples s ON s.sample_id = c.sample_id)
    SELECT x.repeat_idx, x.fold_idx, x.sample_id, x.role, x.feature, x.value - m AS value FROM x JOIN (
      SELECT repeat_idx, fold_idx, feature, conf, avg(value) AS m FROM x WHERE role = 'train' GROUP BY 1, 2, 3, 4) t
    ON t.repeat_idx = x.repeat_idx AND t.fold_idx = x.fold_idx AND t.feature = x.feature AND t.conf = x.conf""",
)
def residualise_one(t):
    return pr.residualise_one(features(t), samples(t), cv(t), SPLIT, "conf")


@query(
    "residualise_aliased",
    RES_OUT,
    with_("cv", "features")
    + """, x AS (SELECT c.*, f.feature, f.value, s.conf FROM cv c JOIN features f ON c.sample_id = f.sample_id
      JOIN samples s ON s.sample_id = c.sample_id)
    SELECT x.repeat_idx, x.fold_idx, x.sample_id, x.role, x.feature, x.value - m AS value FROM x JOIN (
      SELECT repeat_idx, fold_idx, feature, conf, avg(value) AS m FROM x WHERE role = 'train' GROUP BY 1, 2, 3, 4) t
    ON t.repeat_idx = x.repeat_idx AND t.fold_idx = x.fold_idx AND t.feature = x.feature AND t.conf = x.conf""",
)
def residualise_aliased(t):
    """The second confounder repeats the first, so it must change nothing."""
    s = samples(t).withColumn("twin", F.concat(F.lit("t"), "conf"))
    return pr.residualise(features(t), s, cv(t), SPLIT, ["conf", "twin"])


@query("residualise_two", "fold_idx:i role:s feature:s mean:e")
def residualise_two(t):
    s = samples(t).withColumn("wing", F.concat(F.lit("w"), F.col("sample_id") % 4))
    r = pr.residualise(features(t), s, cv(t), SPLIT, ["conf", "wing"])
    return r.groupBy("fold_idx", "role", "feature").agg(F.avg("value").alias("mean"))
