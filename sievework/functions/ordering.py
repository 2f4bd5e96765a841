"""Exact ordering inside groups of any size.

A plain window sorts a whole group in one task. Here a group is first cut into slices of its
order, the slices are numbered on their own, and the rows before a slice come from a small table
of slice totals. The cuts are taken over the whole frame, not per group: a slice holds at most
about ``rows_per_task`` rows of *all* groups together, so no (group, slice) can hold more. The
cut points are literals in the plan, so a task that is run again slices its rows the same way.
Values are cut as their own type and NaN counts as missing, so cutting does not change the order.
Frames that fit one task are not cut at all and use the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.session import cut_lineage, rows_per_task

_SAMPLE_PER_SLICE = 60


def fits_one_task(df: DataFrame, factor: int = 1) -> bool:
    """Whether ``factor`` times the rows of the frame are few enough for one task.

    Operators count their own rows before they order them. A caller that knows a cheap upper bound
    (the rows of a source table, say) checks it here once and passes ``bounded=True``.
    """
    return df.count() * factor <= rows_per_task(df.sparkSession)


def _kind(df: DataFrame, value: str) -> str:
    kind = df.select(value).schema[0].dataType
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return "long"
    if isinstance(kind, T.FloatType | T.DoubleType):
        return "double"
    return kind.simpleString()


def _exact(df: DataFrame, value: str) -> Column:
    """The value as the type that it is cut by: no two different values fall together."""
    return F.col(value).cast(_kind(df, value))


def _without_nan(df: DataFrame, value: str) -> Column:
    """The value with NaN as NULL."""
    return F.when(~F.isnan(value), F.col(value)) if _kind(df, value) == "double" else F.col(value)


def order_cuts(
    df: DataFrame, value: str, tie: str | None, limit: int | None = None
) -> list[tuple]:
    """Cut points (value, tie) that split the frame into slices of about ``limit`` rows."""
    limit = limit or rows_per_task(df.sparkSession)
    n = df.count()
    if n <= limit:
        return []
    slices = -(-n // limit)
    fraction = min(1.0, _SAMPLE_PER_SLICE * slices / n)
    picked = (
        df.select(_exact(df, value).alias("v"), _tie(tie).alias("t"))
        .where(_without_nan(df, value).isNotNull())
        .sample(fraction, 17)
        .collect()
    )
    picked = sorted((r.v, r.t) for r in picked)
    step = max(1, len(picked) // slices)
    return sorted(set(picked[step::step]))


def _tie(tie: str | None) -> Column:
    return F.coalesce(F.col(tie).cast("string"), F.lit("")) if tie else F.lit("")


def slice_number(df: DataFrame, value: str, tie: str | None, cuts: list[tuple]) -> Column:
    """Number of cut points at or below the row; NULL and NaN come last."""
    if not cuts:
        return F.lit(0)
    kind = _kind(df, value)
    dtype = {"long": np.int64, "double": float}.get(kind, object)
    values = np.array([c[0] for c in cuts], dtype=dtype)
    ties = np.array([c[1] for c in cuts], dtype=object)

    @F.pandas_udf("int")
    def slice_of(v: pd.Series, t: pd.Series) -> pd.Series:
        x = v.to_numpy(dtype=dtype)
        lo = np.searchsorted(values, x, "left")
        hi = np.searchsorted(values, x, "right")
        out = lo.copy()
        for at in np.unique(lo[hi > lo]):
            rows = np.flatnonzero((lo == at) & (hi > lo))
            same = ties[at : hi[rows[0]]]
            out[rows] = at + np.searchsorted(same, t.to_numpy(dtype=object)[rows], "right")
        return pd.Series(out.astype("int32"))

    # NULL would make pandas read whole numbers as doubles; such rows are set apart below.
    filled = F.coalesce(_without_nan(df, value).cast(kind), F.lit(cuts[0][0]).cast(kind))
    return F.when(_without_nan(df, value).isNull(), len(cuts)).otherwise(slice_of(filled, _tie(tie)))


def _reversed(df: DataFrame, value: str) -> Column | None:
    """A number in the opposite order, or None if the value is no number."""
    kind = _kind(df, value)
    if kind == "long":
        return F.bitwise_not(F.col(value).cast("long"))
    return -F.col(value) if kind == "double" or kind.startswith("decimal") else None


def _before(df: DataFrame, keys: list[str], totals: dict[str, Column], how=F.sum) -> DataFrame:
    """Totals of all earlier slices of the same group: one small row per (group, slice)."""
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_slice").agg(*[c.alias(n) for n, c in totals.items()])
    return sums.select(*keys, "_slice", *[how(n).over(w).alias(n) for n in totals])


def numbered(
    df: DataFrame,
    keys: list[str],
    value: str,
    tie: str,
    name: str = "rank",
    descending: bool = True,
    then: Sequence[Column] = (),
    cumulate: str | None = None,
    limit: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Row number 1.. inside ``keys`` by ``value`` (NULL and NaN last), ties by ``tie`` as a string.

    ``then`` gives further orders between the two. ``cumulate`` names a column whose running sum in that order is added as ``cum_<column>``.
    ``bounded=True`` states that a group cannot outgrow a task (methods of one split, say).
    """
    clean = _without_nan(df, value)
    direction = clean.desc_nulls_last() if descending else clean.asc_nulls_last()
    by_tie = F.col(tie).cast("string").asc()
    totals = {"_n": F.count(F.lit(1))}
    if cumulate:
        totals["_c"] = F.sum(cumulate)
    span = (Window.unboundedPreceding, Window.currentRow)
    cuts: list = []
    if not bounded:
        turned = _reversed(df, value) if descending else F.col(value)
        plainly = turned is not None
        df = df.withColumn("_v", turned if plainly else F.col(value))
        cut_tie = tie if plainly and not then else None
        cuts = order_cuts(df, "_v", cut_tie, limit)
        at = slice_number(df, "_v", cut_tie, cuts)
        # What cannot be turned round is cut in ascending order, and the slices are counted from the end.
        at = at if plainly else F.when(F.col("_v").isNotNull(), -at).otherwise(at + 1)
        df = df.withColumn("_slice", at).drop("_v")
    part = [*keys, "_slice"] if cuts else keys
    w = Window.partitionBy(*part).orderBy(direction, *then, by_tie)
    out = df.withColumn(name, F.row_number().over(w))
    if cumulate:
        out = out.withColumn(f"cum_{cumulate}", F.sum(cumulate).over(w.rowsBetween(*span)))
    if not cuts:
        return out.drop("_slice")
    out = out.join(_before(df, keys, totals), [*keys, "_slice"])
    out = out.withColumn(name, (F.col(name) + F.coalesce("_n", F.lit(0))).cast("int"))
    if cumulate:
        out = out.withColumn(
            f"cum_{cumulate}", F.col(f"cum_{cumulate}") + F.coalesce("_c", F.lit(0))
        )
    return out.drop("_slice", *totals)


def leading(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The rows of a group that can be among its first ``k`` by ``value``, highest first: those and few more.

    The rows of a group are dealt to 4k buckets by the hash of ``tie``. The k-th best of the buckets' maxima is a
    value that at least k rows reach, so no lower row is needed. Only maxima are shuffled.
    """
    clean = _without_nan(df, value)
    bucket = F.pmod(F.xxhash64(tie), F.lit(4 * k))
    best = df.groupBy(*keys, bucket.alias("_bucket")).agg(F.max(clean).alias("_best"))
    w = Window.partitionBy(*keys).orderBy(F.col("_best").desc_nulls_last())
    cut = best.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == k)
    cut = cut.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("_best").alias("_cut"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    near = df.join(F.broadcast(cut), on, "left")  # one row a group
    return near.where(F.col("_cut").isNull() | (clean >= F.col("_cut"))).select(*df.columns)


def dealt(
    df: DataFrame, keys: list[str], hash_col: str, name: str, slices: int | None = None
) -> DataFrame:
    """Row number 1.. inside ``keys`` in hash order.

    md5 is uniform, so its leading hex digits are ready-made slices; no look at the data is needed.
    By default there are at least as many slices of a group as shuffle partitions.
    """
    if slices is None:
        slices = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    digits = max(1, int(np.ceil(np.log(max(slices, 2)) / np.log(16))))
    # As bytes the digits are half as long in the shuffle, and in the same order.
    sliced = df.withColumn("_slice", F.substring(hash_col, 1, digits)).withColumn(hash_col, F.unhex(hash_col))
    offsets = _before(sliced, keys, {"_n": F.count(F.lit(1))})
    w = Window.partitionBy(*keys, "_slice").orderBy(hash_col)
    return (
        sliced.withColumn(name, F.row_number().over(w))
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.col(name) + F.coalesce("_n", F.lit(0))).cast("long"))
        .drop("_n", "_slice")
    )


def running(
    df: DataFrame,
    keys: list[str],
    value: str,
    measures: list[str],
    descending: bool = False,
    how: str = "sum",
    cuts: list | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Running totals in the order of ``value``, which must be unique inside a group.

    ``sum`` adds ``before_<measure>`` over the earlier rows (0 for the first), ``min`` adds
    ``least_<measure>`` over the earlier rows and the row itself. ``cuts`` of an earlier call on
    the same rows may be given again.
    """
    if cuts is None:
        cuts = [] if bounded else order_cuts(df, value, None)
    fn = {"sum": F.sum, "min": F.min}[how]
    last = -1 if how == "sum" else 0
    label = "before" if how == "sum" else "least"
    if cuts:
        sign = -1 if descending else 1
        df = df.withColumn("_slice", sign * slice_number(df, value, None, cuts))
    order = F.col(value).desc() if descending else F.col(value).asc()
    part = [*keys, "_slice"] if cuts else keys
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    out = df.select("*", *[fn(m).over(w).alias(f"{label}_{m}") for m in measures])
    if cuts:
        offsets = _before(df, keys, {f"_off_{m}": fn(m) for m in measures}, fn)
        out = out.join(offsets, [*keys, "_slice"])
        for m in measures:
            here, off = F.col(f"{label}_{m}"), F.col(f"_off_{m}")
            both = here + off if how == "sum" else F.least(here, off)
            out = out.withColumn(f"{label}_{m}", F.coalesce(both, here, off)).drop(f"_off_{m}")
        out = out.drop("_slice")
    if how == "sum":
        out = out.fillna(0, subset=[f"before_{m}" for m in measures])
    return out


def average_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    name: str = "avg_rank",
    descending: bool = False,
    bounded: bool = False,
) -> DataFrame:
    """Average-tie rank of ``value`` inside ``keys``; rows with NULL get NULL.

    Equal values are counted once per group before anything is ordered, so a heavily tied value
    is one row of the ordering, however many rows carry it.
    """
    if bounded:
        w = Window.partitionBy(*keys)
        o = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
        ties = F.count(F.lit(1)).over(w.partitionBy(*keys, value))
        rank = F.rank().over(w.orderBy(o)) + (ties - 1) / 2.0
        return df.withColumn(name, F.when(F.col(value).isNotNull(), rank))
    return df.join(value_ranks(df, keys, value, name, descending), [*keys, value], "left")


def value_ranks(
    df: DataFrame, keys: list[str], value: str, name: str = "avg_rank", descending: bool = False, once: bool = False
) -> DataFrame:
    """Average-tie rank of every distinct ``value`` inside ``keys``; ``once`` writes the counts that are ordered."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_ties")
    )
    if once:
        distinct = cut_lineage(distinct)
    return running(distinct, keys, value, ["_ties"], descending).select(
        *keys, value, (F.col("before__ties") + (F.col("_ties") + 1) / 2.0).alias(name)
    )


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bounded: bool = False
) -> DataFrame:
    """Exact quantiles with linear interpolation (type 7) of groups of any size.

    Built on counts of distinct values and their running totals, not on one aggregation buffer
    per group.
    """
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_ties")
    )
    sizes = distinct.groupBy(*keys).agg(F.sum("_ties").alias("_n"))
    placed = running(distinct, keys, value, ["_ties"], bounded=bounded).join(sizes, keys)
    before, upto = F.col("before__ties"), F.col("before__ties") + F.col("_ties")
    picks = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when((before <= low) & (low < upto), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((before <= high) & (high < upto), F.col(value))).alias(f"_hi_{name}"),
        ]
    found = placed.groupBy(*keys, "_n").agg(*picks)
    out = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return found.select(*keys, *out)
