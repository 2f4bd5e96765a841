"""Canonical tables derived from the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog.base import Tables
from sievework.functions.columns import each, literals
from sievework.functions.ordering import leading, numbered
from sievework.operators import folds as fo
from sievework.session import stored

KS = [5, 10, 20, 50, 100, 200, 500]

_CTE: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    _CTE[name] = (body, list(needs))


def with_(*names: str) -> str:
    """``WITH`` clause holding the named expressions and all they need."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for need in _CTE[n][1]:
            add(need)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_CTE[n][0]})" for n in ordered) + "\n"


# --- samples and features from the embedding vectors -------------------------------------------


def samples(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.lit("emb").alias("dataset"),
        F.col("vec_id").alias("sample_id"),
        (F.col("label") < 5).cast("int").alias("label"),
        F.expr("vec_id div 2").alias("group_id"),
        F.concat(F.lit("c"), F.col("label") % 3).alias("conf"),
    )


def features(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.lit("emb").alias("dataset"),
        F.col("vec_id").alias("sample_id"),
        F.posexplode("embedding").alias("pos", "v"),
    ).select(
        "dataset",
        "sample_id",
        F.concat(F.lit("f"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("feature"),
        F.col("v").cast("double").alias("value"),
    )


def labelled(t: Tables) -> DataFrame:
    """Features with their sample's label: one scan, no join."""
    return t.embeddings.select(
        F.lit("emb").alias("dataset"),
        F.col("vec_id").alias("sample_id"),
        (F.col("label") < 5).cast("int").alias("label"),
        F.posexplode("embedding").alias("pos", "v"),
    ).select(
        "dataset",
        "sample_id",
        "label",
        F.concat(F.lit("f"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("feature"),
        F.col("v").cast("double").alias("value"),
    )


cte(
    "samples",
    """SELECT 'emb' AS dataset, vec_id AS sample_id, CAST(label < 5 AS INT) AS label,
    vec_id // 2 AS group_id, 'c' || (label % 3) AS conf FROM embeddings""",
)
cte(
    "features",
    """SELECT 'emb' AS dataset, vec_id AS sample_id, CAST(label < 5 AS INT) AS label,
    'f' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, CAST(embedding[i] AS DOUBLE) AS value
    FROM embeddings, range(1, 65) g(i)""",
)


def cv(t: Tables, k: int = 5, repeats: int = 2) -> DataFrame:
    assigned = fo.repeated_cv(samples(t), k, repeats, 42)
    return fo.fold_roles(assigned, k).drop("fold")


cte(
    "cv_assigned",
    """SELECT dataset, r AS repeat_idx, sample_id, label, group_id, (row_number() OVER (
      PARTITION BY r, label ORDER BY md5(concat_ws('|', '42', 42 + 1000 * r, sample_id))) - 1) % 5 + 1
      AS fold FROM samples, range(1, 3) g(r)""",
    "samples",
)
cte(
    "cv",
    """SELECT dataset, repeat_idx, f AS fold_idx, sample_id, label, group_id,
    CASE WHEN fold = f THEN 'test' ELSE 'train' END AS role FROM cv_assigned, range(1, 6) g(f)""",
    "cv_assigned",
)

# --- count matrix: lines per supplier and part bucket ------------------------------------------


def counts(t: Tables) -> DataFrame:
    return (
        t.lineitem.groupBy(
            F.col("l_suppkey").alias("sample_id"),
            F.concat(F.lit("g"), F.lpad((F.col("l_partkey") % 40).cast("string"), 2, "0")).alias(
                "feature"
            ),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .withColumn("dataset", F.lit("counts"))
    )


cte(
    "counts",
    """SELECT 'counts' AS dataset, l_suppkey AS sample_id,
    'g' || lpad(CAST(l_partkey % 40 AS VARCHAR), 2, '0') AS feature,
    CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2, 3""",
)


def count_folds(t: Tables) -> DataFrame:
    """Two splits of the suppliers: every third one is held out."""
    return each(
        t.supplier.select(F.lit("counts").alias("dataset"), F.col("s_suppkey").alias("sample_id")),
        "fold_idx",
        [0, 1],
    ).withColumn(
        "role", F.when(F.col("sample_id") % 3 == F.col("fold_idx"), "test").otherwise("train")
    )


cte(
    "count_folds",
    """SELECT 'counts' AS dataset, s_suppkey AS sample_id, f AS fold_idx,
    CASE WHEN s_suppkey % 3 = f THEN 'test' ELSE 'train' END AS role
    FROM supplier, (VALUES (0), (1)) g(f)""",
)

# --- rankings: parts ranked by four measures per flag, year and half-year -----------------------

SPLIT = ["dataset", "repeat_idx", "fold_idx"]


def _half(col: str):
    return F.when(F.month(col) <= 6, 1).otherwise(2)


def part_measures(t: Tables) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    kept = F.round((1 - F.col("l_discount")) * 100).cast("long")
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("dataset"),
        F.year("l_shipdate").alias("repeat_idx"),
        _half("l_shipdate").alias("fold_idx"),
        F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("feature"),
    ).agg(
        F.sum(cents * kept).alias("revenue"),
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        F.count(F.lit(1)).alias("orders"),
        F.max(cents).alias("price"),
    )


def part_scores(t: Tables, measures: DataFrame | None = None) -> DataFrame:
    measures = part_measures(t) if measures is None else measures
    return measures.unpivot(
        [*SPLIT, "feature"], ["revenue", "quantity", "orders", "price"], "method", "score"
    ).withColumn("score", F.col("score").cast("double"))


def rankings(t: Tables) -> DataFrame:
    """Long ones are counted, cut and ordered in several jobs, and so are those made of them: measures are written once."""
    bounded = t.fits("lineitem", 4)
    scores = part_scores(t) if bounded else part_scores(t, stored(part_measures(t)))
    return numbered(scores, [*SPLIT, "method"], "score", "feature", bounded=bounded)


def leading_rankings_among(t: Tables, k: int, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Rankings of the allowed features that can be among the first ``k`` of them, as ranked among each other."""
    key = [*SPLIT, "method"]
    inside = part_scores(t, part_measures(t).join(allowed.select(*on).distinct(), on, "left_semi"))
    return numbered(leading(inside, key, "score", "feature", k), key, "score", "feature", bounded=True)


def leading_rankings(t: Tables, k: int) -> DataFrame:
    """The first ``k`` rows of every ranking, had without ordering the others."""
    key = [*SPLIT, "method"]
    near = leading(part_scores(t), key, "score", "feature", k)
    return numbered(near, key, "score", "feature", bounded=True).where(F.col("rank") <= k)


cte(
    "part_scores",
    """SELECT dataset, repeat_idx, fold_idx, feature, method, CAST(score AS DOUBLE) AS score FROM (
      SELECT l_returnflag AS dataset, year(l_shipdate) AS repeat_idx,
        CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 2 END AS fold_idx,
        'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS feature,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS orders,
        max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price
      FROM lineitem GROUP BY 1, 2, 3, 4)
    UNPIVOT (score FOR method IN (revenue, quantity, orders, price))""",
)
cte(
    "rankings",
    """SELECT *, row_number() OVER (PARTITION BY dataset, repeat_idx, fold_idx, method
    ORDER BY score DESC, feature) AS rank FROM part_scores""",
    "part_scores",
)


def pools(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_returnflag").alias("dataset"),
        F.year("l_shipdate").alias("repeat_idx"),
        _half("l_shipdate").alias("fold_idx"),
        F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("feature"),
    ).distinct()


cte(
    "pools",
    """SELECT DISTINCT l_returnflag AS dataset, year(l_shipdate) AS repeat_idx,
        CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 2 END AS fold_idx,
        'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS feature FROM lineitem""",
)

# --- evaluations: one value per dataset, repeat, fold, method and k -----------------------------


def evaluations(t: Tables) -> DataFrame:
    m = F.col("l_partkey") % 5
    return (
        t.lineitem.groupBy(
            F.col("l_returnflag").alias("dataset"),
            F.year("l_shipdate").alias("repeat_idx"),
            F.quarter("l_shipdate").alias("fold_idx"),
            F.when(m == 0, "Random").otherwise(F.concat(F.lit("m"), m)).alias("method"),
            F.element_at(literals(KS), F.col("l_linenumber")).alias("k"),
        )
        .agg(
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("s"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "dataset",
            "repeat_idx",
            "fold_idx",
            "method",
            "k",
            (F.col("s") / (F.col("n") * 10)).alias("auc"),
        )
    )


cte(
    "evaluations",
    f"""SELECT dataset, repeat_idx, fold_idx, method, k, CAST(s AS DOUBLE) / (n * 10) AS auc FROM (
      SELECT l_returnflag AS dataset, year(l_shipdate) AS repeat_idx, quarter(l_shipdate) AS fold_idx,
        CASE WHEN l_partkey % 5 = 0 THEN 'Random' ELSE 'm' || (l_partkey % 5) END AS method,
        ([{', '.join(map(str, KS))}])[l_linenumber] AS k,
        sum(CAST(round(l_discount * 100) AS BIGINT)) AS s, count(*) AS n
      FROM lineitem GROUP BY 1, 2, 3, 4, 5)""",
)

# --- feature sets, scores and edges over parts --------------------------------------------------


def part_id(col: str):
    return F.concat(F.lit("p"), F.lpad(F.col(col).cast("string"), 9, "0"))


def feature_sets(t: Tables) -> DataFrame:
    """Two sets per part: its brand and its size class."""
    return t.part.select(
        part_id("p_partkey").alias("feature"),
        F.explode(F.array("p_brand", F.concat(F.lit("size"), F.col("p_size")))).alias("set_id"),
    )


cte(
    "feature_sets",
    """SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS feature, p_brand AS set_id FROM part
    UNION ALL
    SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 'size' || p_size FROM part""",
)


def feature_scores(t: Tables) -> DataFrame:
    """Score in [0, 1); every fourth part has none."""
    return t.part.where("p_partkey % 4 != 0").select(
        part_id("p_partkey").alias("feature"), (F.col("p_retailprice") % 100 / 100).alias("score")
    )


cte(
    "feature_scores",
    """SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS feature,
    p_retailprice % 100 / 100 AS score FROM part WHERE p_partkey % 4 != 0""",
)


def edges(t: Tables) -> DataFrame:
    """Parts on neighbouring lines of one order, weighted by how often that happens."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return (
        t.lineitem.select(
            part_id("l_partkey").alias("a"), F.lag("l_partkey").over(w).alias("prev")
        )
        .where("prev is not null")
        .select(F.col("a").alias("src"), part_id("prev").alias("dst"))
        .where("src != dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


cte(
    "edges",
    """SELECT src, dst, count(*) AS weight FROM (
      SELECT 'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS src,
        'p' || lpad(CAST(prev AS VARCHAR), 9, '0') AS dst FROM (
        SELECT l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_partkey, l_suppkey) AS prev FROM lineitem)
      WHERE prev IS NOT NULL AND prev != l_partkey) GROUP BY 1, 2""",
)

# --- scored documents --------------------------------------------------------------------------


def scored_docs(t: Tables) -> DataFrame:
    """Predictions per language: a document's length as a score, its quality as the label."""
    return t.labels.join(t.documents, "doc_id").select(
        F.col("lang").alias("dataset"),
        F.col("doc_id").alias("sample_id"),
        F.col("quality").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") / (F.col("n_chars") + 400.0)).alias("prob"),
    )


cte(
    "scored_docs",
    """SELECT lang AS dataset, doc_id AS sample_id, quality AS label, CAST(n_chars AS DOUBLE) AS score,
    n_chars / (n_chars + 400.0::DOUBLE) AS prob FROM labels JOIN documents USING (doc_id)""",
)
