"""Result tables: writing, resuming and reading many runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a Parquet table; the job's commit makes the new files visible together."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def missing_rows(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key the target does not have yet, one of each key. NULL keys are equal to each other."""
    known, fresh = target.select(*keys).distinct().alias("known"), new.dropDuplicates(list(keys)).alias("fresh")
    same = reduce(
        lambda a, b: a & b, (F.col(f"fresh.{k}").eqNullSafe(F.col(f"known.{k}")) for k in keys)
    )
    return fresh.join(known, same, "left_anti")


def append_missing(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> None:
    """Resumable append: a key that is already in the table is not written again. No table yet means none is."""
    try:
        target = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        target = new.limit(0)
    missing_rows(target, new, keys).write.mode("append").parquet(path)


def union_runs(
    spark: SparkSession,
    paths: dict[str, str],
    rename: dict[str, str] | None = None,
) -> DataFrame:
    """The same CSV of several datasets as one table with a ``dataset`` column.

    Columns missing in a file become NULL; ``rename`` standardises column names.
    """
    frames = []
    for dataset, path in paths.items():
        df = spark.read.csv(path, header=True, inferSchema=False)
        for old, new in (rename or {}).items():
            if old in df.columns:
                df = df.withColumnRenamed(old, new)
        frames.append(df.withColumn("dataset", F.lit(dataset)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def kv_metadata(
    df: DataFrame, keys: Sequence[str], names: Sequence[str], key: str = "key", value: str = "value"
) -> DataFrame:
    """Key/value rows to one column per name."""
    return df.groupBy(*keys).pivot(key, list(names)).agg(F.min(value))
