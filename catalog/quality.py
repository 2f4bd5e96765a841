"""Queries over scale detection, sample selection and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.standins import (
    SPLIT,
    counts,
    cte,
    edges,
    evaluations,
    features,
    pools,
    rankings,
    samples,
    with_,
)
from sievework.operators import quality as qu

cte(
    "mixed",
    """SELECT 'prices' AS dataset, l_suppkey AS sample_id, 'p' || l_partkey AS feature, l_extendedprice AS value FROM lineitem
    UNION ALL SELECT 'signal', l_suppkey, 'p' || l_partkey, l_extendedprice / 10 - 300 FROM lineitem
    UNION ALL SELECT 'lines', l_suppkey, 'p' || l_partkey, CAST(l_orderkey % 500 AS DOUBLE) FROM lineitem
    UNION ALL SELECT 'rates', l_suppkey, 'p' || l_partkey, l_discount FROM lineitem""",
)


def mixed(t):
    """Four value columns of the lines as four datasets with different scales."""
    return t.lineitem.select(
        F.col("l_suppkey").alias("sample_id"),
        F.concat(F.lit("p"), "l_partkey").alias("feature"),
        F.explode(
            F.create_map(
                F.lit("prices"), F.col("l_extendedprice"),
                F.lit("signal"), F.col("l_extendedprice") / 10 - 300,
                F.lit("lines"), (F.col("l_orderkey") % 500).cast("double"),
                F.lit("rates"), F.col("l_discount"),
            )
        ).alias("dataset", "value"),
    )


DETECT = """SELECT *, CASE WHEN all_integers {extra} AND maximum > 100 THEN 'counts'
    WHEN has_negatives AND maximum >= 100 THEN 'linear_background_corrected'
    WHEN maximum < 30 THEN 'log_normalized' ELSE 'linear_normalized' END AS scale FROM (
    SELECT dataset, min(value) AS minimum, max(value) AS maximum, bool_and(abs(value - round(value)) <= {tol}) AS all_integers,
      bool_or(value < 0) AS has_negatives FROM mixed GROUP BY 1)"""
cte("scales", DETECT.format(extra="", tol="0"), "mixed")
SC = "dataset:s minimum:f maximum:f all_integers:b has_negatives:b scale:s"


@query("detect_scale", SC, with_("scales") + "SELECT * FROM scales")
def detect_scale(t):
    return qu.detect_scale(mixed(t))


@query(
    "detect_scale_no_negative_counts",
    SC,
    with_("mixed") + DETECT.format(extra="AND NOT has_negatives", tol="0.00000001"),
)
def detect_scale_no_negative_counts(t):
    return qu.detect_scale(mixed(t), tolerance=1e-8, counts_without_negatives=True)


@query(
    "verify_scale",
    "dataset:s declared:s scale:s cause:s passed:b",
    with_("scales")
    + """SELECT *, cause = '' AS passed FROM (SELECT dataset, declared, scale, CASE WHEN declared = scale THEN ''
      WHEN scale = 'linear_normalized' THEN 'fractional values: length-normalised, not counts'
      WHEN scale = 'log_normalized' THEN 'small values: already log-transformed'
      ELSE 'declared and detected scale differ' END AS cause FROM (SELECT *, 'counts' AS declared FROM scales))""",
)
def verify_scale(t):
    found = qu.detect_scale(mixed(t))
    return qu.verify_scale(found, found.select("dataset", F.lit("counts").alias("declared")))


@query(
    "transform_scale",
    "dataset:s n:i total:g",
    with_("mixed", "scales")
    + """SELECT dataset, count(*) AS n, sum(CASE scale WHEN 'linear_normalized' THEN log2(value + 1)
      WHEN 'linear_background_corrected' THEN log2(greatest(value, 0) + 1) ELSE value END) AS total
    FROM mixed JOIN scales USING (dataset) GROUP BY 1""",
)
def transform_scale(t):
    m = mixed(t)
    scaled = qu.transform_scale(m.join(qu.detect_scale(m).select("dataset", "scale"), "dataset"))
    return scaled.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )


@query(
    "assert_counts",
    "dataset:s negative:i non_finite:i fractional:i",
    with_("mixed")
    + """SELECT dataset, count(*) FILTER (value < 0) AS negative, 0 AS non_finite,
    count(*) FILTER (abs(value - round(value)) > 0.00000001) AS fractional FROM mixed GROUP BY 1""",
)
def assert_counts(t):
    return qu.assert_counts(mixed(t))


cte(
    "order_meta",
    """SELECT 'o' AS dataset, o_orderkey AS sample_id, col AS col, CASE col
      WHEN 'c1' THEN ' Order Priority : ' || o_orderpriority
      WHEN 'c2' THEN o_orderstatus || ': ' || o_custkey
      ELSE CASE WHEN o_custkey % 2 = 0 THEN 'free text' ELSE 'note: x' END END AS value
    FROM orders, (VALUES ('c1'), ('c2'), ('c3')) g(col)""",
)


def order_meta(t):
    wide = wide_meta(t)
    return wide.unpivot(["dataset", "sample_id"], ["c1", "c2", "c3"], "column", "value")


def wide_meta(t):
    return t.orders.select(
        F.lit("o").alias("dataset"),
        F.col("o_orderkey").alias("sample_id"),
        F.concat(F.lit(" Order Priority : "), "o_orderpriority").alias("c1"),
        F.concat_ws(": ", "o_orderstatus", F.col("o_custkey").cast("string")).alias("c2"),
        F.when(F.col("o_custkey") % 2 == 0, "free text").otherwise("note: x").alias("c3"),
    )


@query(
    "parse_characteristics",
    "dataset:s sample_id:i field:s value:s",
    with_("order_meta")
    + r""", k AS (SELECT *, nullif(regexp_extract(value, '^\s*([^:]+?)\s*:', 1), '') AS key FROM order_meta),
    top AS (SELECT col, 'ch_' || regexp_replace(lower(trim(key)), '\W+', '_', 'g') AS field FROM (
      SELECT col, key, row_number() OVER (PARTITION BY col ORDER BY n DESC, key) AS rn FROM (
        SELECT col, key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY 1, 2))
      WHERE rn = 1 AND col IN (SELECT col FROM k GROUP BY 1 HAVING count(key) >= 0.8 * count(*)))
    SELECT dataset, sample_id, field, trim(regexp_replace(value, '^\s*[^:]+?\s*:\s*', '')) AS value
    FROM k JOIN top USING (col)""",
)
def parse_characteristics(t):
    return qu.parse_characteristics(order_meta(t))


@query(
    "extract_key",
    "sample_id:i note:s finished:s",
    r"""SELECT o_orderkey AS sample_id, CASE WHEN o_custkey % 2 = 1 THEN 'x' END AS note,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) END AS finished FROM orders""",
)
def extract_key(t):
    return wide_meta(t).select(
        "sample_id",
        qu.extract_key(["c1", "c2", "c3"], "note").alias("note"),
        qu.extract_key(["c3", "c2", "c1"], "f").alias("finished"),
    )


@query(
    "split_compound",
    "p_partkey:i place:s diagnosis:s",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS place,
    CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS diagnosis FROM part""",
)
def split_compound(t):
    return qu.split_compound(t.part, "p_name", " ", "place", "diagnosis")


ORDERS = """SELECT 'o' AS dataset, o_orderkey AS sample_id, o_orderstatus, o_orderpriority, o_custkey FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
    AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')"""
cte("kept_orders", ORDERS)


def _order_meta(t):
    meta = t.orders.withColumnRenamed("o_orderkey", "sample_id").withColumn("dataset", F.lit("o"))
    bad = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    excluded = meta.join(bad, "o_custkey", "left_semi").select("sample_id")
    filters = [("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])]
    return meta, excluded, filters


@query(
    "select_samples",
    "sample_id:i label:i group_id:s",
    with_("kept_orders")
    + """SELECT sample_id, CAST(o_orderstatus = 'F' AS INT) AS label, o_custkey AS group_id FROM kept_orders
    WHERE o_orderstatus IN ('O', 'F')""",
)
def select_samples(t):
    meta, excluded, filters = _order_meta(t)
    return qu.select_samples(
        meta, "o_orderstatus", ["O"], ["F"], filters, excluded, group="o_custkey"
    )


@query(
    "unmapped_outcomes",
    "outcome:s n:i",
    with_("kept_orders")
    + """SELECT o_orderstatus AS outcome, count(*) AS n FROM kept_orders
    WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1""",
)
def unmapped_outcomes(t):
    meta, excluded, filters = _order_meta(t)
    return qu.unmapped_outcomes(meta, "o_orderstatus", ["O", "F"], filters, excluded)


@query(
    "check_class_counts",
    "dataset:s label:i expected:i observed:i matches:b small_minority:b",
    """SELECT *, observed = expected AS matches, min(observed) OVER (PARTITION BY dataset) < 20 AS small_minority FROM (
    SELECT lang AS dataset, label, expected, coalesce(observed, 0) AS observed FROM (
      SELECT lang, toxic AS label, count(*) AS expected FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
    LEFT JOIN (SELECT lang, quality AS label, count(*) AS observed
      FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2) USING (lang, label))""",
)
def check_class_counts(t):
    d = t.labels.join(t.documents.select("doc_id", F.col("lang").alias("dataset")), "doc_id")
    expected = d.groupBy("dataset", F.col("toxic").alias("label")).agg(
        F.count(F.lit(1)).alias("expected")
    )
    return qu.check_class_counts(d.withColumnRenamed("quality", "label"), expected)


@query(
    "align_samples",
    "sample_id:i n:i",
    """SELECT l_orderkey AS sample_id, count(*) AS n FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""",
)
def align_samples(t):
    f = t.lineitem.select(F.lit("o").alias("dataset"), F.col("l_orderkey").alias("sample_id"))
    meta = t.orders.where("o_orderstatus = 'F'").select(
        F.lit("o").alias("dataset"), F.col("o_orderkey").alias("sample_id")
    )
    return qu.align_samples(f, meta).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "samples_without_features",
    "sample_id:i",
    "SELECT o_orderkey AS sample_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def samples_without_features(t):
    f = t.lineitem.select(F.lit("o").alias("dataset"), F.col("l_orderkey").alias("sample_id"))
    meta = t.orders.select(F.lit("o").alias("dataset"), F.col("o_orderkey").alias("sample_id"))
    return qu.samples_without_features(f, meta)


@query(
    "canonical_method",
    "name:s family:s n:i",
    """SELECT name, family, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent'
      WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS name,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast' ELSE 'other' END AS family
    FROM orders) GROUP BY 1, 2""",
)
def canonical_method(t):
    p = F.col("o_orderpriority")
    named = t.orders.select(
        qu.mapped(p, {"1-URGENT": "urgent", "5-LOW": "low"}).alias("name"),
        qu.mapped(p, {"1-URGENT": "fast", "2-HIGH": "fast"}, F.lit("other")).alias("family"),
    )
    return named.groupBy("name", "family").agg(F.count(F.lit(1)).alias("n"))


DIMS = ["dataset", "method", "repeat_idx", "fold_idx", "k"]


@query(
    "audit_grid",
    "dataset:s method:s repeat_idx:i fold_idx:i k:i n_rows:i problem:s",
    with_("evaluations")
    + """, e AS (SELECT dataset, method, repeat_idx, fold_idx, k FROM evaluations
      UNION ALL SELECT dataset, method, repeat_idx, fold_idx, k FROM evaluations WHERE auc < 0.4)
    SELECT *, CASE WHEN n_rows = 0 THEN 'missing' ELSE 'duplicate' END AS problem FROM (
      SELECT d.dataset, m.method, r.repeat_idx, f.fold_idx, k.k, count(e.k) AS n_rows FROM
      (SELECT DISTINCT dataset FROM e) d, (SELECT DISTINCT method FROM e) m, (SELECT DISTINCT repeat_idx FROM e) r,
      (SELECT DISTINCT fold_idx FROM e) f, (SELECT DISTINCT k FROM e) k LEFT JOIN e ON e.dataset = d.dataset AND
      e.method = m.method AND e.repeat_idx = r.repeat_idx AND e.fold_idx = f.fold_idx AND e.k = k.k GROUP BY ALL)
    WHERE n_rows != 1""",
)
def audit_grid(t):
    e = evaluations(t)
    return qu.audit_grid(e.unionByName(e.where("auc < 0.4")), DIMS)


@query(
    "qa_ranges",
    "name:s observed:i expected:i passed:b",
    with_("evaluations")
    + """SELECT name, observed, expected, observed = expected AS passed FROM (
      SELECT 'rows' AS name, count(*) AS observed, 2940 AS expected FROM evaluations
      UNION ALL SELECT 'duplicate_keys', 0, 0
      UNION ALL SELECT 'auc_non_finite', 0, 0
      UNION ALL SELECT 'auc_out_of_range', count(*) FILTER (auc < 0.3 OR auc > 0.7), 0 FROM evaluations
      UNION ALL SELECT 'panel_size_differs', count(*) FILTER (k != (k // 10) * 10), 0 FROM evaluations)""",
)
def qa_ranges(t):
    e = evaluations(t).withColumn("n_panel", (F.floor(F.col("k") / 10) * 10).cast("int"))
    return qu.qa_ranges(e, DIMS, {"auc": (0.3, 0.7)}, ("n_panel", "k"), 2940)


@query(
    "index_runs",
    "dataset:s n_methods:i n_splits:i n_sizes:i sizes:s n_rows:i n_duplicates:i n_missing:i "
    "expected_rows:i complete:b",
    with_("evaluations")
    + """SELECT *, n_rows = expected_rows AND n_duplicates = 0 AND n_missing = 0 AS complete FROM (
    SELECT *, n_methods * n_splits * n_sizes AS expected_rows FROM (
    SELECT dataset, count(DISTINCT method) AS n_methods, count(DISTINCT repeat_idx * 10 + fold_idx) AS n_splits,
      count(DISTINCT k) AS n_sizes, string_agg(DISTINCT CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS dummy,
      array_to_string(list_sort(list_distinct(list(k))), ',') AS sizes, count(*) AS n_rows, 0 AS n_duplicates,
      count(*) FILTER (auc > 0.7) AS n_missing FROM evaluations GROUP BY 1))""",
)
def index_runs(t):
    e = evaluations(t).withColumn("auc", F.when(F.col("auc") <= 0.7, F.col("auc")))
    return qu.index_runs(e, "dataset", ["method", "repeat_idx", "fold_idx", "k"])


@query(
    "audit_dataset",
    "dataset:s n_samples:i duplicate_cells:i duplicate_samples:i unaligned_samples:i non_finite:i "
    "n_pos:i n_neg:i status:s",
    """SELECT 'emb' AS dataset, count(*) AS n_samples, 0 AS duplicate_cells, 0 AS duplicate_samples,
    0 AS unaligned_samples, 0 AS non_finite, count(*) FILTER (label < 5) AS n_pos, count(*) FILTER (label >= 5) AS n_neg,
    'ready' AS status FROM embeddings
    UNION ALL SELECT 'counts', count(DISTINCT l_suppkey), 0, 0, count(DISTINCT l_suppkey), 0, 0, 0, 'invalid' FROM lineitem""",
)
def audit_dataset(t):
    both = features(t).unionByName(counts(t))
    return qu.audit_dataset(both, samples(t))


@query(
    "validate_rankings",
    "dataset:s repeat_idx:i fold_idx:i method:s missing:i outside_pool:i repeated:i increasing:i passed:b",
    with_("rankings", "pools")
    + """, r AS (SELECT dataset, repeat_idx, fold_idx, method, feature, rank,
        CASE WHEN rank = 5 THEN score * 100 ELSE score END AS score FROM rankings WHERE method != 'price' OR rank != 3),
    o AS (SELECT dataset, repeat_idx, fold_idx, method, count(*) FILTER (nxt > score) AS increasing, count(*) AS n FROM (
      SELECT a.*, b.score AS nxt FROM r a LEFT JOIN r b ON a.dataset = b.dataset AND a.repeat_idx = b.repeat_idx
        AND a.fold_idx = b.fold_idx AND a.method = b.method AND b.rank = a.rank + 1) GROUP BY 1, 2, 3, 4),
    p AS (SELECT dataset, repeat_idx, fold_idx, count(*) AS m FROM pools GROUP BY 1, 2, 3)
    SELECT *, m - n AS missing, 0 AS outside_pool, 0 AS repeated, m = n AND increasing = 0 AS passed
    FROM o JOIN p USING (dataset, repeat_idx, fold_idx)""",
)
def validate_rankings(t):
    r = rankings(t).where("method != 'price' or rank != 3")
    r = r.withColumn("score", F.when(F.col("rank") == 5, F.col("score") * 100).otherwise(F.col("score")))
    return qu.validate_rankings(r, pools(t), [*SPLIT, "method"], SPLIT)


@query(
    "diff_tables",
    "name:s n_both:i only_a:i only_b:i max_abs_diff:f null_mismatch:i passed:b",
    with_("evaluations")
    + """SELECT 'auc' AS name, count(*) FILTER (k != 5 AND k != 500) AS n_both, count(*) FILTER (k = 500) AS only_a,
    count(*) FILTER (k = 5) AS only_b, 0.000001 * max(repeat_idx) FILTER (k != 5 AND k != 500) AS max_abs_diff,
    0 AS null_mismatch, false AS passed FROM evaluations""",
)
def diff_tables(t):
    e = evaluations(t)
    other = e.where("k != 500").withColumn("auc", F.col("auc") + F.col("repeat_idx") * 1e-6)
    return qu.diff_tables(e.where("k != 5"), other, DIMS, ["auc"], 1e-9)


@query(
    "filter_edges",
    "src:s dst:s weight:i",
    with_("edges") + "SELECT * FROM edges WHERE weight >= 2",
)
def filter_edges(t):
    return qu.filter_edges(edges(t), 2)
