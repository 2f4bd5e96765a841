"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = 4_000_000
BROADCAST_ROWS = 200_000
_shipped: dict[str, str] = {}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName("sievework")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) a temporary one is set.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sievework-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, unless their Python path already has it."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or _shipped.get("to") == context.applicationId:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="sievework-"), "sievework.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(os.path.join(root, "sievework")):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    _shipped["to"] = context.applicationId


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once like ``cut_lineage``, and offered for broadcast where its counted rows are few.

    A written frame keeps the size estimate of what it was made from, so Spark cannot see that it is small.
    """
    out = cut_lineage(df)
    return F.broadcast(out) if out.count() <= BROADCAST_ROWS else out


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the folder of ``cut_lineage``, for long frames of few bytes a value.

    A checkpoint is written as rows, uncompressed: a cell takes several times what its columns do. The files go with the
    application.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *keys: str, groups: int = 0) -> DataFrame:
    """``df`` dealt by ``keys`` to all shuffle partitions: for groups whose work outweighs their bytes.

    Adaptive execution merges small shuffle partitions by size, but not those asked for by number. ``groups`` that
    are known to be heavy get four partitions each, so that few of them share a task.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * groups)
    return df.repartition(n, *keys)


def rows_per_task(spark: SparkSession) -> int:
    """Largest number of rows of one ordered group that a single task may hold."""
    return int(spark.conf.get("sievework.rowsPerTask", str(ROWS_PER_TASK)))
