"""Readers from delimited and text files to long tables. Files are read as lines in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.columns import finite


def _unquote(col):
    return F.regexp_replace(F.trim(col), '^"|"$', "")


def _lines(spark: SparkSession, paths) -> DataFrame:
    """Lines with their file and their order in it."""
    return (
        spark.read.text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
        .withColumn("line", F.monotonically_increasing_id())
        .withColumnRenamed("value", "text")
    )


def read_matrix(spark: SparkSession, path, sep: str = "\t", dataset: str = "matrix") -> DataFrame:
    """Features x samples table with a header line to ``dataset, sample_id, feature, value``.

    The header of a file is its first line; it may list the samples with or without a name for
    the feature column.
    """
    lines = _lines(spark, path)
    cells = lines.withColumn("cells", F.split("text", sep))
    first = cells.groupBy("file").agg(
        F.min_by("cells", F.struct("block", "line")).alias("names"),
        F.min(F.struct("block", "line")).alias("at"),
    )
    body = cells.join(first, "file").where(F.struct("block", "line") != F.col("at"))
    shift = F.size("names") - F.size("cells")
    return (
        body.select(
            _unquote(F.col("cells")[0]).alias("feature"),
            "names",
            shift.alias("shift"),
            F.posexplode("cells").alias("pos", "raw"),
        )
        .where("pos > 0")
        .select(
            F.lit(dataset).alias("dataset"),
            _unquote(F.col("names")[F.col("pos") + F.col("shift")]).alias("sample_id"),
            "feature",
            finite(F.expr("try_cast(raw AS double)")).alias("value"),
        )
    )


def read_series_text(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Files of ``!``-prefixed header lines followed by a marked table.

    Returns metadata ``file, sample_id, key, value`` and features ``file, sample_id, feature,
    value``. A key that occurs on several lines is numbered in file order. A file whose table is
    empty simply has no features.
    """
    lines = _lines(spark, paths)
    header = lines.where(F.col("text").startswith("!Sample_")).select(
        "file", "block", "line", F.split("text", "\t").alias("cells")
    )
    header = header.select(
        "file",
        "block",
        "line",
        F.substring(F.col("cells")[0], 2, 1000).alias("key"),
        F.expr("slice(cells, 2, greatest(size(cells) - 1, 0))").alias("values"),
    )
    ids = header.where("key = 'Sample_geo_accession'").select(
        "file", F.col("values").alias("ids")
    )
    w = Window.partitionBy("file", "key")  # the lines of one key of one file
    numbered = (
        header.where("key != 'Sample_geo_accession'")
        .withColumn("n", F.count(F.lit(1)).over(w))
        .withColumn("i", F.row_number().over(w.orderBy("block", "line")))
        .join(ids, "file")
        .where(F.size("values") == F.size("ids"))
    )
    metadata = numbered.select(
        "file",
        F.when(F.col("n") > 1, F.concat_ws("_", "key", "i")).otherwise(F.col("key")).alias("key"),
        F.explode(F.arrays_zip("ids", "values")).alias("z"),
    ).select(
        "file",
        _unquote(F.col("z.ids")).alias("sample_id"),
        "key",
        _unquote(F.col("z.values")).alias("value"),
    )
    table = lines.where(~F.col("text").startswith("!") & (F.trim("text") != "")).select(
        "file", F.split("text", "\t").alias("cells")
    )
    is_head = _unquote(F.col("cells")[0]) == "ID_REF"
    names = table.where(is_head).select("file", F.col("cells").alias("names"))
    features = (
        table.where(~is_head)
        .join(names, "file")
        .select(
            "file",
            _unquote(F.col("cells")[0]).alias("feature"),
            F.explode(F.arrays_zip("names", "cells")).alias("z"),
        )
        .where(_unquote(F.col("z.names")) != "ID_REF")
        .select(
            "file",
            _unquote(F.col("z.names")).alias("sample_id"),
            "feature",
            finite(F.expr("try_cast(z.cells AS double)")).alias("value"),
        )
    )
    return metadata, features


def read_per_sample_files(
    spark: SparkSession, path, id_pattern: str, sep: str = "\t", log: bool = False
) -> DataFrame:
    """One two-column file per sample; the id is the first group of ``id_pattern`` in the path.

    Values of a repeated feature are summed; a negative or unreadable value fails the read, and so do a
    file whose path has no id and one whose header has other names, or another order of them, than the first.
    """
    raw = (
        spark.read.csv(path, sep=sep, header=True, inferSchema=False, enforceSchema=False)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    feature, value = raw.columns[:2]
    sample = F.regexp_extract("_path", id_pattern, 1)
    x = finite(F.expr(f"try_cast(`{value}` AS double)"))
    checked = F.when(
        x.isNull() | (x < 0),
        F.raise_error(F.concat(F.lit("bad value in "), F.col("_path"))).cast("double"),
    ).otherwise(x)
    summed = (
        raw.select(
            F.when(sample != "", sample)
            .otherwise(F.raise_error(F.concat(F.lit("no sample id in "), F.col("_path"))).cast("string"))
            .alias("sample_id"),
            F.col(f"`{feature}`").alias("feature"),
            checked.alias("value"),
        )
        .groupBy("sample_id", "feature")
        .agg(F.sum("value").alias("value"))
    )
    return summed.withColumn("value", F.log2(F.col("value") + 1)) if log else summed


def uneven_features(features: DataFrame) -> DataFrame:
    """Features that are not in every sample, with the number of samples that have them."""
    n = features.select("sample_id").distinct().count()
    return (
        features.groupBy("feature")
        .agg(F.count_distinct("sample_id").alias("n_present"))
        .withColumn("n_samples", F.lit(n))
        .where("n_present < n_samples")
    )


def read_annotation(
    spark: SparkSession, path, symbol_pattern: str = r"(?i)gene[\s_]*symbol"
) -> DataFrame:
    """Comment-prefixed table to ``probe, symbol``; placeholders and multi-maps are left out."""
    lines = _lines(spark, path).where(
        ~F.substring("text", 1, 1).isin("#", "^", "!") & (F.trim("text") != "")
    )
    cells = lines.withColumn("cells", F.split("text", "\t"))
    head = cells.groupBy("file").agg(
        F.min_by("cells", F.struct("block", "line")).alias("names"),
        F.min(F.struct("block", "line")).alias("at"),
    )
    column = F.array_position(
        F.transform("names", lambda n: F.trim(n).rlike(f"^(?:{symbol_pattern})$")), True
    )
    return (
        cells.join(head, "file")
        .where(F.struct("block", "line") != F.col("at"))
        .withColumn("_at", column.cast("int"))
        .where("_at > 0")
        .select(
            F.trim(F.col("cells")[0]).alias("probe"),
            F.trim(F.try_element_at("cells", F.col("_at"))).alias("symbol"),
        )
        .where("symbol is not null and symbol not in ('', '---')")
        .where(~F.contains("symbol", F.lit("///")))
    )
