"""Column expressions used across operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(col: Column) -> Column:
    """NULL for NULL, NaN and infinities, else the value as a double."""
    x = col.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def no_nan(col: Column) -> Column:
    """NULL for NaN, else the value in its own type."""
    return F.when(~F.isnan(col), col)


def hash_order(seed: int | str, *cols: Column | str) -> Column:
    """Reproducible shuffle key: the same on any partitioning and in any engine with md5."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def literals(values: Iterable) -> Column:
    """Array literal, to be exploded instead of joining a small parameter table."""
    return F.array(*[F.lit(v) for v in values])


def each(df: DataFrame, name: str, values: Iterable) -> DataFrame:
    """One copy of every row per parameter value."""
    return df.withColumn(name, F.explode(literals(values)))


def numbered_copies(df: DataFrame, name: str, n: int, first: int = 1) -> DataFrame:
    """One copy of every row per integer ``first .. first+n-1``."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def clipped_ratio(ratio: Column, width: float) -> Column:
    """Ratio with its log2 clipped to +-width."""
    return F.pow(
        F.lit(2.0), F.greatest(F.least(F.log2(ratio), F.lit(float(width))), F.lit(-float(width)))
    )


def safe_div(a: Column, b: Column, empty: Column | None = None) -> Column:
    """a / b, and ``empty`` (NULL by default) when b is zero or NULL."""
    out = F.when(b != 0, a / b)
    return out if empty is None else F.coalesce(out, empty)


def quartiles(col: Column | str, prefix: str = "") -> list[Column]:
    """q1, median and q3 by linear interpolation (type 7)."""
    return [
        F.percentile(col, F.lit(p)).alias(f"{prefix}{n}")
        for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ]


def share(cond: Column) -> Column:
    """Fraction of rows where ``cond`` holds; NULL conditions are left out."""
    return F.avg(cond.cast("double"))
