"""Queries over folds, resamples and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.standins import SPLIT, cv, pools, samples, with_
from sievework.operators import folds as fo


def _fold_sql(part: str, hash_parts: str, k: int, source: str = "samples") -> str:
    return f"""(row_number() OVER (PARTITION BY {part}
      ORDER BY md5(concat_ws('|', {hash_parts}))) - 1) % {k} + 1"""


@query(
    "stratified_folds",
    "dataset:s sample_id:i label:i fold:i",
    with_("samples")
    + f"SELECT *, {_fold_sql('dataset, label', "'42', sample_id", 5)} AS fold FROM samples",
)
def stratified_folds(t):
    return fo.stratified_folds(samples(t), 5, 42)


@query(
    "paired_folds",
    "dataset:s sample_id:i group_id:i fold:i",
    with_("samples")
    + f"""SELECT s.*, g.fold FROM samples s JOIN (SELECT dataset, group_id,
    {_fold_sql('dataset', "'42', group_id", 5)} AS fold
    FROM (SELECT DISTINCT dataset, group_id FROM samples)) g USING (dataset, group_id)""",
)
def paired_folds(t):
    return fo.paired_folds(samples(t), 5, 42)


@query(
    "grouped_folds",
    "dataset:s sample_id:i group_id:i stratum:s fold:i",
    with_("samples")
    + f"""SELECT s.*, g.stratum, g.fold FROM samples s JOIN (SELECT dataset, group_id, stratum,
    {_fold_sql('dataset, stratum', "'42', group_id", 5)} AS fold
    FROM (SELECT dataset, group_id, CASE WHEN min(label) = 1 THEN 'positive'
      WHEN max(label) = 0 THEN 'negative' ELSE 'mixed' END AS stratum FROM samples GROUP BY 1, 2)) g
    USING (dataset, group_id)""",
)
def grouped_folds(t):
    return fo.grouped_folds(samples(t), 5, 42)


@query(
    "repeated_cv",
    "dataset:s repeat_idx:i fold_idx:i sample_id:i role:s",
    with_("cv") + "SELECT * FROM cv",
)
def repeated_cv(t):
    return cv(t)


@query(
    "subsamples_kfold",
    "dataset:s resample_id:i sample_id:i role:s",
    with_("samples")
    + f"""SELECT dataset, (r - 1) * 5 + f AS resample_id, sample_id,
    CASE WHEN fold = f THEN 'oob' ELSE 'train' END AS role FROM (
    SELECT *, {_fold_sql('dataset, r, label', "'7', 7 + 1000 * r, sample_id", 5)} AS fold
    FROM samples, range(1, 4) g(r)), range(1, 6) h(f) WHERE (r - 1) * 5 + f <= 12""",
)
def subsamples_kfold(t):
    return fo.subsamples(samples(t), 12, 5, 7)


@query(
    "subsamples_half",
    "dataset:s resample_id:i sample_id:i label:i role:s",
    with_("samples")
    + """SELECT *, CASE WHEN pos <= n // 2 THEN 'train' ELSE 'oob' END AS role FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, resample_id, label
      ORDER BY md5(concat_ws('|', '7', resample_id, sample_id))) AS pos,
      count(*) OVER (PARTITION BY dataset, resample_id, label) AS n
    FROM samples, range(1, 7) g(resample_id))""",
)
def subsamples_half(t):
    return fo.subsamples(samples(t), 6, seed=7, scheme="half")


PERMUTED_SQL = """SELECT a.dataset, a.perm_id, a.sample_id, b.label FROM (
    SELECT dataset, sample_id, perm_id, row_number() OVER (PARTITION BY dataset, perm_id
      ORDER BY md5(concat_ws('|', 'base', sample_id))) AS pos FROM samples, range(1, 21) g(perm_id)) a
  JOIN (SELECT dataset, label, perm_id, row_number() OVER (PARTITION BY dataset, perm_id
      ORDER BY md5(concat_ws('|', '11', perm_id, sample_id))) AS pos FROM samples, range(1, 21) g(perm_id)) b
  USING (dataset, perm_id, pos)"""


@query("permute_labels", "dataset:s perm_id:i sample_id:i label:i", with_("samples") + PERMUTED_SQL)
def permute_labels(t):
    return fo.permute_labels(samples(t), 20, 11)


@query(
    "random_panels",
    "dataset:s repeat_idx:i fold_idx:i draw_id:i position:i feature:s",
    with_("pools")
    + """SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY dataset, repeat_idx, fold_idx, draw_id ORDER BY
      md5(concat_ws('|', '5', draw_id, dataset, repeat_idx, fold_idx, feature))) AS position
    FROM pools, range(1, 6) g(draw_id)) WHERE position <= 20""",
)
def random_panels(t):
    return fo.random_panels(pools(t), 20, 5, 5, SPLIT)


@query(
    "inner_folds",
    "dataset:s repeat_idx:i fold_idx:i inner_idx:i sample_id:i inner_role:s",
    with_("cv")
    + f"""SELECT *, CASE WHEN fold = inner_idx THEN 'test' ELSE 'train' END AS inner_role FROM (
    SELECT *, {_fold_sql('dataset, repeat_idx, fold_idx, label',
                         "'7', dataset, repeat_idx, fold_idx, sample_id", 3)} AS fold
    FROM cv WHERE role = 'train'), range(1, 4) g(inner_idx)""",
)
def inner_folds(t):
    return fo.inner_folds(cv(t), SPLIT, 3, 7)


@query(
    "check_fold_leakage",
    "dataset:s repeat_idx:i fold_idx:i samples_in_both:i groups_in_both:i uncovered:i",
    with_("cv")
    + """SELECT dataset, repeat_idx, fold_idx, sum(dup) AS samples_in_both,
      sum(tr * te) AS groups_in_both, (SELECT count(*) FROM samples) - sum(n) AS uncovered FROM (
      SELECT dataset, repeat_idx, fold_idx, group_id, max(tr) AS tr, max(te) AS te, count(*) AS n,
        sum(tr * te) AS dup FROM (
        SELECT dataset, repeat_idx, fold_idx, sample_id, group_id,
          max(CAST(role = 'train' AS INT)) AS tr, max(CAST(role = 'test' AS INT)) AS te
        FROM cv GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""",
)
def check_fold_leakage(t):
    return fo.check_fold_leakage(cv(t), samples(t), SPLIT)
