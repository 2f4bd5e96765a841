"""Registry of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.ordering import fits_one_task

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULES: dict[str, str] = {}

# Output kinds: s text, i integer, b boolean, f double to 6 places, g large double to 2 places,
# e rows-only double (kept as it is).
_SPARK = {"s": "string", "i": "bigint", "b": "boolean", "f": "double", "g": "double", "e": "double"}
_SQL = {"s": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN", "f": "DOUBLE", "g": "DOUBLE", "e": "DOUBLE"}
_PLACES = {"f": 6, "g": 2}


class Tables:
    """Lazy access to the test tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def fits(self, table: str, factor: int = 1) -> bool:
        """Whether ``factor`` rows per row of a table are few enough for one task.

        The row count comes from the Parquet footers.
        """
        return fits_one_task(getattr(self, table), factor)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _shape(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def _shaped(df: DataFrame, shape) -> DataFrame:
    out = []
    for name, kind in shape:
        col = F.col(name).cast(_SPARK[kind])
        if kind in _PLACES:
            r = F.round(col, _PLACES[kind])
            col = F.when(r == 0, F.lit(0.0)).otherwise(r)
        out.append(col.alias(name))
    return df.select(*out)


def _shaped_sql(sql: str, shape) -> str:
    out = []
    for name, kind in shape:
        expr = f"CAST({name} AS {_SQL[kind]})"
        if kind in _PLACES:
            r = f"round({expr}, {_PLACES[kind]})"
            expr = f"CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END"
        out.append(f"{expr} AS {name}")
    return f"SELECT {', '.join(out)} FROM ({sql}) q"


def query(name: str, out: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with output columns ``out``."""
    shape = _shape(out)

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _shaped(fn(Tables(spark, sf_dir)), shape)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        MODULES[name] = fn.__module__.split(".")[-1]
        if sql is not None:
            ORACLE[name] = _shaped_sql(sql, shape)
        return fn

    return register
