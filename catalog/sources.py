"""Queries over readers and sinks: Spark writes the test tables out as files, then reads them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import query
from catalog.standins import counts, evaluations, with_
from sievework.session import shared_dir
from sievework.sources import matrices as mx
from sievework.sources import tables as tb


def place(t, name: str) -> str:
    """A new folder for one run under the session's shared folder."""
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "read_matrix",
    "sample_id:s feature:s value:f",
    with_("counts") + "SELECT 's' || sample_id AS sample_id, feature, value FROM counts",
)
def read_matrix(t):
    """Part buckets x suppliers as a tab-separated table with a header; a pair without lines is an empty cell."""
    c = counts(t).withColumn("sample", F.concat(F.lit("s"), "sample_id"))
    suppliers = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("sample"))
    w = Window.orderBy("sample")  # the header of a wide file is one line
    names = suppliers.union(c.select("sample")).distinct().withColumn("i", F.row_number().over(w))
    grid = c.select("feature").distinct().crossJoin(names).join(c, ["feature", "sample"], "left")
    cells = grid.groupBy("feature").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("i", "value"))),
                lambda x: F.coalesce(x["value"].cast("string"), F.lit("")),
            ),
            "\t",
        ).alias("cells")
    )
    head = names.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "sample"))), lambda x: x["sample"]),
            "\t",
        ).alias("cells")
    )
    lines = head.select(F.lit(0).alias("o"), F.concat_ws("\t", F.lit("gene"), "cells").alias("value"))
    lines = lines.unionByName(
        cells.select(F.lit(1).alias("o"), F.concat_ws("\t", "feature", "cells").alias("value"))
    )
    path = place(t, "matrix")
    lines.coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return mx.read_matrix(t.spark, path).where("value is not null")


def series_folder(t) -> str:
    """One text file per nation: header lines, then a table of two rows over its customers."""
    c = t.customer.select(
        "c_nationkey",
        F.struct("c_custkey", "c_mktsegment", "c_acctbal").alias("x"),
    )
    per = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def line(first, fn):
        return F.concat_ws("\t", F.lit(first), F.array_join(F.transform("x", fn), "\t"))

    quoted = line("!Sample_geo_accession", lambda v: F.concat(F.lit('"c'), v["c_custkey"], F.lit('"')))
    lines = F.array(
        F.lit("!Series_title\tcustomers"),
        quoted,
        line("!Sample_title", lambda v: F.concat(F.lit("t"), v["c_custkey"])),
        line("!Sample_ch", lambda v: F.concat(F.lit("segment: "), v["c_mktsegment"])),
        line("!Sample_ch", lambda v: F.concat(F.lit("rich: "), v["c_acctbal"] > 5000)),
        F.lit("!series_matrix_table_begin"),
        line('"ID_REF"', lambda v: F.concat(F.lit('"c'), v["c_custkey"], F.lit('"'))),
        line("bal", lambda v: v["c_acctbal"].cast("string")),
        line("neg", lambda v: F.when(v["c_acctbal"] < 0, "null").otherwise("1.5")),
        F.lit("!series_matrix_table_end"),
    )
    path = place(t, "series")
    (
        per.select("c_nationkey", F.posexplode(lines).alias("o", "value"))
        .repartition("c_nationkey")
        .sortWithinPartitions("c_nationkey", "o")
        .select("c_nationkey", "value")
        .write.partitionBy("c_nationkey")
        .text(path)
    )
    return path + "/*/*.txt"


@query(
    "read_series_metadata",
    "sample_id:s key:s value:s",
    """SELECT 'c' || c_custkey AS sample_id, 'Sample_title' AS key, 't' || c_custkey AS value FROM customer
    UNION ALL SELECT 'c' || c_custkey, 'Sample_ch_1', 'segment: ' || c_mktsegment FROM customer
    UNION ALL SELECT 'c' || c_custkey, 'Sample_ch_2', 'rich: ' || CAST(c_acctbal > 5000 AS VARCHAR) FROM customer""",
)
def read_series_metadata(t):
    return mx.read_series_text(t.spark, series_folder(t))[0]


@query(
    "read_series_features",
    "sample_id:s feature:s value:f",
    """SELECT 'c' || c_custkey AS sample_id, 'bal' AS feature, c_acctbal AS value FROM customer
    UNION ALL SELECT 'c' || c_custkey, 'neg', CASE WHEN c_acctbal >= 0 THEN 1.5 END FROM customer""",
)
def read_series_features(t):
    return mx.read_series_text(t.spark, series_folder(t))[1]


def sample_folder(t) -> str:
    path = place(t, "samples")
    (
        t.lineitem.select(
            F.concat(F.lit("L"), F.col("l_linenumber")).alias("sample"),
            F.concat(F.lit("p"), "l_partkey").alias("Gene"),
            F.col("l_quantity").alias("TPM"),
        )
        .repartition("sample")
        .write.partitionBy("sample")
        .csv(path, sep="\t", header=True)
    )
    return path + "/*/*.csv"


@query(
    "read_per_sample_files",
    "sample_id:s feature:s value:f",
    """SELECT 'L' || l_linenumber AS sample_id, 'p' || l_partkey AS feature, log2(sum(l_quantity) + 1) AS value
    FROM lineitem GROUP BY 1, 2""",
)
def read_per_sample_files(t):
    return mx.read_per_sample_files(t.spark, sample_folder(t), r"sample=(L\d+)/", log=True)


@query(
    "uneven_features",
    "feature:s n_present:i n_samples:i",
    """SELECT 'p' || l_partkey AS feature, count(DISTINCT l_linenumber) AS n_present,
    (SELECT count(DISTINCT l_linenumber) FROM lineitem) AS n_samples FROM lineitem GROUP BY 1 HAVING n_present < 7""",
)
def uneven_features(t):
    return mx.uneven_features(
        t.lineitem.select(
            F.concat(F.lit("p"), "l_partkey").alias("feature"), F.col("l_linenumber").alias("sample_id")
        )
    )


@query(
    "read_annotation",
    "probe:s symbol:s",
    """SELECT 'p' || p_partkey AS probe, p_name AS symbol FROM part WHERE p_partkey % 7 NOT IN (0, 1)""",
)
def read_annotation(t):
    """Parts as an annotation table with placeholders and multi-maps among the symbols."""
    symbol = (
        F.when(F.col("p_partkey") % 7 == 0, "---")
        .when(F.col("p_partkey") % 7 == 1, F.concat(F.col("p_name"), F.lit("///x")))
        .otherwise(F.col("p_name"))
    )
    body = t.part.select(
        F.lit(2).alias("o"),
        F.concat_ws("\t", F.concat(F.lit("p"), "p_partkey"), "p_type", symbol).alias("value"),
    )
    top = t.part.agg(F.count(F.lit(1))).select(
        F.posexplode(F.array(F.lit("#comment\tline"), F.lit("ID\tTitle\tGene Symbol"))).alias("o", "value")
    )
    path = place(t, "annotation")
    top.unionByName(body).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return mx.read_annotation(t.spark, path)


EV = "dataset:s repeat_idx:i fold_idx:i method:s k:i auc:f"
KEY = ["dataset", "repeat_idx", "fold_idx", "method", "k"]


@query("append_missing", EV, with_("evaluations") + "SELECT * FROM evaluations")
def append_missing(t):
    """A table that holds the first years is completed, twice; nothing is written double."""
    path = place(t, "results")
    e = evaluations(t)
    tb.write_table(e.where("repeat_idx < 1998"), path)
    tb.append_missing(t.spark, path, e, KEY)
    tb.append_missing(t.spark, path, e, KEY)
    return t.spark.read.parquet(path)


@query(
    "union_runs",
    "dataset:s method:s repeat_idx:s k:s extra:s",
    with_("evaluations")
    + """SELECT dataset, method, CAST(repeat_idx AS VARCHAR) AS repeat_idx, CAST(k AS VARCHAR) AS k,
    CASE WHEN dataset = 'N' THEN 'x' END AS extra FROM evaluations""",
)
def union_runs(t):
    e = evaluations(t).drop("auc")
    a, n, r = place(t, "run-a"), place(t, "run-n"), place(t, "run-r")
    e.where("dataset = 'A'").drop("dataset").withColumnRenamed("k", "size").write.csv(a, header=True)
    e.where("dataset = 'N'").drop("dataset").withColumn("extra", F.lit("x")).write.csv(n, header=True)
    e.where("dataset = 'R'").drop("dataset").write.csv(r, header=True)
    return tb.union_runs(t.spark, {"A": a, "N": n, "R": r}, {"size": "k"})


@query(
    "kv_metadata",
    "event_type:s user_id:i first:s last:s",
    """SELECT event_type, user_id, min(ts_key) AS first, max(ts_key) AS last FROM (SELECT event_type, user_id,
    props AS ts_key FROM events) GROUP BY 1, 2""",
)
def kv_metadata(t):
    e = t.events.groupBy("event_type", "user_id").agg(
        F.min("props").alias("first"), F.max("props").alias("last")
    )
    rows = e.unpivot(["event_type", "user_id"], ["first", "last"], "key", "value")
    return tb.kv_metadata(rows, ["event_type", "user_id"], ["first", "last"])
