"""Queries over univariate scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.standins import (
    SPLIT,
    cte,
    features,
    labelled,
    part_scores,
    pools,
    rankings,
    samples,
    scored_docs,
    with_,
)
from sievework.operators import folds as fo
from sievework.operators import scores as sc


def avg_rank(keys: str, value: str, desc: bool = False) -> str:
    """SQL of the average-tie rank."""
    o = f"{value} DESC" if desc else value
    return (
        f"(CASE WHEN {value} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {o}) + "
        f"(count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0::DOUBLE END)"
    )


def auc_sql(source: str, keys: str, score: str) -> str:
    """SQL of the rank-sum AUC."""
    return f"""SELECT {keys}, sum(label) AS n_pos, count(*) - sum(label) AS n_neg,
      CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN
        (sum(label * ar) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
        / (sum(label) * (count(*) - sum(label))) END AS auc
      FROM (SELECT *, {avg_rank(keys, score)} AS ar FROM {source}) GROUP BY {keys}"""


def bh_sql(source: str, keys: str, p: str = "p", q: str = "q") -> str:
    """SQL of the Benjamini-Hochberg adjustment."""
    return f"""SELECT *, least(1.0::DOUBLE, min({p} * bh_n / bh_r) OVER (PARTITION BY {keys}
      ORDER BY {p} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {q} FROM (
      SELECT *, count(*) OVER (PARTITION BY {keys}) AS bh_n, count(*) OVER (PARTITION BY {keys}
        ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bh_r FROM {source})"""


cte(
    "class_stats",
    """SELECT dataset, feature, sum(label) AS n1, count(*) - sum(label) AS n0,
    avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label = 0) AS m0,
    var_samp(value) FILTER (label = 1) AS v1, var_samp(value) FILTER (label = 0) AS v0
    FROM features GROUP BY 1, 2""",
    "features",
)
cte(
    "pooled_t",
    """SELECT *, CASE WHEN pv > 0 THEN (m1 - m0) / (sqrt(pv) * sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) END AS t
    FROM (SELECT *, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS pv FROM class_stats)""",
    "class_stats",
)


@query(
    "pooled_t",
    "dataset:s feature:s n1:i n0:i m1:f m0:f t:f",
    with_("pooled_t") + "SELECT * FROM pooled_t",
)
def pooled_t(t):
    return sc.pooled_t(labelled(t), ["dataset", "feature"])


cte(
    "line_values",
    """SELECT l_returnflag AS dataset, 'g' || (l_partkey % 100) AS feature, l_quantity AS value,
    CAST(l_linestatus = 'F' AS INT) AS label FROM lineitem""",
)


def line_values(t):
    """Every line as one sample: few hot features over the whole table."""
    return t.lineitem.select(
        F.col("l_returnflag").alias("dataset"),
        F.concat(F.lit("g"), F.col("l_partkey") % 100).alias("feature"),
        F.col("l_quantity").alias("value"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
    )


WELCH_SQL = """SELECT *, CASE WHEN n1 > 1 AND n0 > 1 AND a + b > 0 THEN (m1 - m0) / sqrt(a + b) END AS t,
  CASE WHEN n1 > 1 AND n0 > 1 AND a + b > 0 THEN (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)) END AS df
  FROM (SELECT *, v1 / n1 AS a, v0 / n0 AS b FROM (
    SELECT dataset, feature, sum(label) AS n1, count(*) - sum(label) AS n0,
    avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label = 0) AS m0,
    var_samp(value) FILTER (label = 1) AS v1, var_samp(value) FILTER (label = 0) AS v0
    FROM line_values GROUP BY 1, 2))"""


@query(
    "welch_statistics",
    "dataset:s feature:s n1:i n0:i t:f df:g",
    with_("line_values") + WELCH_SQL,
)
def welch_statistics(t):
    return sc.welch_statistics(line_values(t), ["dataset", "feature"])


@query("welch_rank", "dataset:s feature:s t:f df:g p:e q:e score:e selected:b rank:i")
def welch_rank(t):
    return sc.welch_rank(labelled(t), ["dataset"])


cte(
    "pvalues",
    """SELECT dataset, repeat_idx, fold_idx, method, feature, round(1.0::DOUBLE / (1 + score % 997), 9) AS p
    FROM part_scores""",
    "part_scores",
)


@query(
    "bh_adjust",
    "dataset:s repeat_idx:i fold_idx:i method:s feature:s p:f q:f",
    with_("pvalues") + bh_sql("pvalues", "dataset, repeat_idx, fold_idx, method"),
)
def bh_adjust(t):
    p = part_scores(t).withColumn("p", F.round(1.0 / (1 + F.col("score") % 997), 9))
    return sc.bh_adjust(p, [*SPLIT, "method"], "p", "q", t.fits("lineitem", 4))


@query(
    "auc_score",
    "dataset:s n_pos:i n_neg:i auc:f",
    with_("scored_docs") + auc_sql("scored_docs", "dataset", "score"),
)
def auc_score(t):
    return sc.auc_score(scored_docs(t), ["dataset"], bounded=t.fits("labels"))


@query(
    "auc_score_hot_features",
    "dataset:s feature:s n_pos:i n_neg:i auc:f",
    with_("line_values") + auc_sql("line_values", "dataset, feature", "value"),
)
def auc_score_hot_features(t):
    return sc.auc_score(
        line_values(t), ["dataset", "feature"], score="value", bounded=t.fits("lineitem")
    )


@query(
    "univariate_auc_rank",
    "dataset:s feature:s auc:f score:f rank:i",
    with_("features")
    + f"""SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, feature) AS rank FROM (
    SELECT *, coalesce(abs(auc - 0.5), 0) AS score FROM ({auc_sql('features', 'dataset, feature', 'value')}))""",
)
def univariate_auc_rank(t):
    return sc.univariate_auc_rank(labelled(t), ["dataset"], t.fits("embeddings", 64))


cte(
    "half_samples",
    """SELECT *, CASE WHEN pos <= n // 2 THEN 'train' ELSE 'oob' END AS role FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, resample_id, label
      ORDER BY md5(concat_ws('|', '7', resample_id, sample_id))) AS pos,
      count(*) OVER (PARTITION BY dataset, resample_id, label) AS n
    FROM samples, range(1, 5) g(resample_id))""",
    "samples",
)
cte(
    "mi",
    """SELECT dataset, feature, avg(mi) AS mi FROM (
      SELECT dataset, feature, resample_id, sum(c / n * ln(c * n / (r * s))) AS mi FROM (
        SELECT *, sum(c) OVER (PARTITION BY dataset, feature, resample_id) AS n,
          sum(c) OVER (PARTITION BY dataset, feature, resample_id, bin) AS r,
          sum(c) OVER (PARTITION BY dataset, feature, resample_id, label) AS s FROM (
          SELECT dataset, feature, resample_id, bin, label, CAST(count(*) AS DOUBLE) AS c FROM (
            SELECT f.dataset, f.feature, f.label, h.resample_id, ntile(5) OVER (
              PARTITION BY f.dataset, f.feature, h.resample_id ORDER BY f.value, CAST(f.sample_id AS VARCHAR)) AS bin
            FROM features f JOIN half_samples h ON f.sample_id = h.sample_id AND h.role = 'train')
          GROUP BY ALL)) GROUP BY ALL) GROUP BY ALL""",
    "features",
    "half_samples",
)


def mi_table(t):
    train = (
        fo.subsamples(samples(t), 4, seed=7, scheme="half")
        .where("role = 'train'")
        .select("dataset", "sample_id", "resample_id", "label")
    )
    joined = features(t).join(train, ["dataset", "sample_id"])
    return sc.mutual_information(
        joined, ["dataset"], 5, "resample_id", t.fits("embeddings", 64 * 4)
    )


@query("mutual_information", "dataset:s feature:s mi:f", with_("mi") + "SELECT * FROM mi")
def mutual_information(t):
    return mi_table(t)


@query(
    "percentile01",
    "dataset:s repeat_idx:i fold_idx:i method:s feature:s pct:f",
    with_("part_scores")
    + f"""SELECT *, coalesce((ar - 1) / nullif(m - 1, 0), 0) AS pct FROM (SELECT *,
    {avg_rank('dataset, repeat_idx, fold_idx, method', 'score')} AS ar,
    count(*) OVER (PARTITION BY dataset, repeat_idx, fold_idx, method) AS m FROM part_scores)""",
)
def percentile01(t):
    return sc.percentile01(
        part_scores(t), [*SPLIT, "method"], "score", bounded=t.fits("lineitem", 4)
    )


@query(
    "random_rank",
    "dataset:s repeat_idx:i fold_idx:i feature:s rank:i",
    with_("pools")
    + """SELECT *, row_number() OVER (PARTITION BY dataset, repeat_idx, fold_idx ORDER BY
    md5(concat_ws('|', '3', dataset, repeat_idx, fold_idx, feature))) AS rank FROM pools""",
)
def random_rank(t):
    return sc.random_rank(pools(t), SPLIT, 3)




@query(
    "variance_rank",
    "dataset:s feature:s score:f rank:i",
    with_("line_values")
    + """SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, feature) AS rank FROM (
    SELECT dataset, feature, var_samp(value) AS score FROM line_values GROUP BY 1, 2) WHERE score > 0""",
)
def variance_rank(t):
    return sc.variance_rank(line_values(t), ["dataset"], t.fits("lineitem"))


@query(
    "feature_rankings",
    "dataset:s repeat_idx:i fold_idx:i method:s feature:s score:g rank:i",
    with_("rankings") + "SELECT * FROM rankings",
)
def feature_rankings(t):
    return rankings(t)
