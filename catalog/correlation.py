"""Queries over feature correlations."""

from __future__ import annotations

from catalog.base import query
from catalog.scores import auc_sql
from catalog.standins import cte, features, labelled, with_
from sievework.operators import gramian as gr
from sievework.operators.scores import univariate_auc_rank

cte(
    "feature_corr",
    """SELECT a.dataset, a.feature AS feature_a, b.feature AS feature_b, corr(a.value, b.value) AS r FROM features a
    JOIN features b ON a.sample_id = b.sample_id AND a.feature < b.feature GROUP BY 1, 2, 3""",
    "features",
)


@query(
    "correlation_edges",
    "dataset:s feature_a:s feature_b:s r:f",
    with_("feature_corr") + "SELECT * FROM feature_corr WHERE abs(r) > 0.1",
)
def correlation_edges(t):
    return gr.correlation_edges(features(t), ["dataset"], 0.1)


@query(
    "redundancy_filter",
    "dataset:s feature:s redundant:b rank:i",
    with_("feature_corr", "features").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", ranked AS (SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM (
      SELECT feature, coalesce(abs(auc - 0.5), 0) AS score FROM ({auc_sql('features', 'dataset, feature', 'value')}))),
    linked AS (SELECT r.rank, r.feature, list(CASE WHEN c.feature_a = r.feature THEN c.feature_b ELSE c.feature_a END)
        FILTER (c.r IS NOT NULL) AS near FROM ranked r LEFT JOIN feature_corr c
      ON abs(c.r) > 0.1 AND (c.feature_a = r.feature OR c.feature_b = r.feature) GROUP BY 1, 2),
    walk AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS picked UNION ALL
      SELECT w.step + 1, CASE WHEN len(list_intersect(picked, coalesce(near, CAST([] AS VARCHAR[])))) = 0
        THEN list_append(picked, feature) ELSE picked END FROM walk w JOIN linked l ON l.rank = w.step + 1)
    SELECT 'emb' AS dataset, feature, redundant, row_number() OVER (ORDER BY redundant, old) AS rank FROM (
      SELECT feature, rank AS old, NOT list_contains((SELECT picked FROM walk ORDER BY step DESC LIMIT 1), feature) AS redundant
      FROM ranked)""",
)
def redundancy_filter(t):
    ranked = univariate_auc_rank(labelled(t), ["dataset"])
    return gr.redundancy_filter(ranked, features(t), ["dataset"], 0.1)


@query(
    "data_modules",
    "dataset:s set_id:s feature:s set_size:i",
    with_("feature_corr").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT feature_a AS a, feature_b AS b FROM feature_corr WHERE abs(r) >= 0.1
      UNION ALL SELECT feature_b, feature_a FROM feature_corr WHERE abs(r) >= 0.1),
    reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
    SELECT 'emb' AS dataset, set_id, feature, set_size FROM (SELECT a AS feature, min(b) AS set_id, count(*) AS set_size
      FROM reach GROUP BY 1) WHERE set_size BETWEEN 2 AND 200""",
)
def data_modules(t):
    return gr.data_modules(features(t), ["dataset"], 0.1, 2, 200)
