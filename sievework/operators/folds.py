"""Folds, resamples, label permutations and random panels.

Every draw is an order by md5 of (seed, replicate, id), so it does not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.columns import hash_order, numbered_copies
from sievework.functions.ordering import dealt
from sievework.session import cut_lineage


def _deal(df: DataFrame, keys: list[str], parts: list[Column | str], k: int, seed) -> DataFrame:
    """Add ``fold`` 1..k by dealing the rows of each group round-robin in hash order."""
    hashed = df.withColumn("_h", hash_order(seed, *parts))
    return (
        dealt(hashed, keys, "_h", "_pos")
        .withColumn("fold", ((F.col("_pos") - 1) % k + 1).cast("int"))
        .drop("_h", "_pos")
    )


def stratified_folds(
    samples: DataFrame, k: int, seed: int, by: Sequence[str] = ("dataset",), parts: Sequence = ()
) -> DataFrame:
    """Shuffle every class and deal it over k folds."""
    return _deal(samples, [*by, "label"], [*parts, "sample_id"], k, seed)


def paired_folds(
    samples: DataFrame, k: int, seed: int, by: Sequence[str] = ("dataset",), parts: Sequence = ()
) -> DataFrame:
    """Whole groups move together: deal distinct groups, then give each sample its group's fold."""
    groups = samples.select(*by, "group_id").distinct()
    dealt_groups = _deal(groups, list(by), [*parts, "group_id"], k, seed)
    return samples.join(dealt_groups, [*by, "group_id"])


def grouped_folds(
    samples: DataFrame, k: int, seed: int, by: Sequence[str] = ("dataset",), parts: Sequence = ()
) -> DataFrame:
    """Groups are first split into all-positive, all-negative and mixed, then dealt per stratum."""
    strata = (
        samples.groupBy(*by, "group_id")
        .agg(F.avg("label").alias("_share"))
        .withColumn(
            "stratum",
            F.when(F.col("_share") == 1, "positive")
            .when(F.col("_share") == 0, "negative")
            .otherwise("mixed"),
        )
        .drop("_share")
    )
    dealt_groups = _deal(strata, [*by, "stratum"], [*parts, "group_id"], k, seed)
    return samples.join(dealt_groups, [*by, "group_id"])


def repeated_cv(
    samples: DataFrame,
    k: int = 5,
    repeats: int = 3,
    seed: int = 42,
    scheme: str = "stratified",
    by: Sequence[str] = ("dataset",),
) -> DataFrame:
    """One fold number per sample and repeat: ``by, repeat_idx, sample_id, label, fold``."""
    deal = {
        "stratified": stratified_folds,
        "paired": paired_folds,
        "grouped": grouped_folds,
    }[scheme]
    copies = numbered_copies(samples, "repeat_idx", repeats)
    return deal(
        copies, k, seed, [*by, "repeat_idx"], parts=[F.lit(seed) + 1000 * F.col("repeat_idx")]
    )


def fold_roles(assigned: DataFrame, k: int, name: str = "fold_idx") -> DataFrame:
    """Spell out train and test membership: k rows per assigned sample."""
    return numbered_copies(assigned, name, k).withColumn(
        "role", F.when(F.col("fold") == F.col(name), "test").otherwise("train")
    )


def subsamples(
    samples: DataFrame,
    b: int = 50,
    k: int = 5,
    seed: int = 42,
    scheme: str = "kfold",
    by: Sequence[str] = ("dataset",),
) -> DataFrame:
    """``b`` train / out-of-bag sets: ``by, resample_id, sample_id, label, role``.

    ``kfold`` and ``paired`` flatten repeated folds; ``half`` trains on half of every class.
    """
    if scheme == "half":
        copies = numbered_copies(samples, "resample_id", b)
        hashed = copies.withColumn("_h", hash_order(seed, "resample_id", "sample_id"))
        placed = dealt(hashed, [*by, "resample_id", "label"], "_h", "_pos")
        sizes = samples.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_n"))
        return (
            placed.join(F.broadcast(sizes), [*by, "label"])  # one row a class
            .withColumn(
                "role", F.when(F.col("_pos") <= F.floor(F.col("_n") / 2), "train").otherwise("oob")
            )
            .drop("_h", "_pos", "_n")
        )
    # Own names for repeat and fold: a split may bring columns of these names along.
    deal = paired_folds if scheme == "paired" else stratified_folds
    copies = numbered_copies(samples, "_repeat", -(-b // k))
    cv = deal(copies, k, seed, [*by, "_repeat"], parts=[F.lit(seed) + 1000 * F.col("_repeat")])
    return (
        fold_roles(cv, k, "_fold")
        .withColumn("resample_id", (F.col("_repeat") - 1) * k + F.col("_fold"))
        .where(F.col("resample_id") <= b)
        .withColumn("role", F.when(F.col("role") == "test", "oob").otherwise("train"))
        .drop("_repeat", "_fold", "fold")
    )


def permute_labels(
    samples: DataFrame, m: int, seed: int, by: Sequence[str] = ("dataset",), first: int = 1
) -> DataFrame:
    """``m`` shuffles of the labels over the samples: ``by, perm_id, sample_id, label``.

    Position i of the id order receives the label that the shuffle put on position i.
    """
    base = samples.select(*by, "sample_id", "label").withColumn("_h", hash_order("base", "sample_id"))
    placed = dealt(base, list(by), "_h", "_pos")
    targets = numbered_copies(placed.select(*by, "sample_id", "_pos"), "perm_id", m, first)
    donors = numbered_copies(samples.select(*by, "sample_id", "label"), "perm_id", m, first)
    donors = dealt(
        donors.withColumn("_h", hash_order(seed, "perm_id", "sample_id")),
        [*by, "perm_id"],
        "_h",
        "_pos",
    ).select(*by, "perm_id", "_pos", "label")
    return targets.join(donors, [*by, "perm_id", "_pos"]).drop("_pos")


def _hash_places(prefix: str, ids: Sequence[bytes]) -> np.ndarray:
    """The order of ``ids`` by md5(prefix | id), as ``hash_order`` has it."""
    start = md5(f"{prefix}|".encode())
    digests = []
    for i in ids:
        one = start.copy()
        one.update(i)
        digests.append(one.digest())
    halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.lexsort((halves[:, 1], halves[:, 0]))


def _deal_places(order: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """Folds 1..k by dealing every class in the given order."""
    fold = np.zeros(len(label), np.int8)
    for c in np.unique(label):
        turn = order[label[order] == c]
        fold[turn] = np.arange(len(turn)) % k + 1
    return fold


def permuted_folds(
    ids: Sequence[str], label: np.ndarray, keys: Sequence, units: Sequence[tuple[int, int]], k: int, seed: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and folds of each (permutation, resample) of one split's samples: 0 held out, else the inner fold.

    Equal to ``permute_labels``, ``subsamples`` of its result and ``resample_members`` of those, whose rows are
    samples x permutations x resamples; here they are made where they are used. ``keys`` are the split's key texts.
    """
    ids = [i.encode() for i in ids]
    base = _hash_places("base", ids)
    outer: dict[int, np.ndarray] = {}
    known, shuffled = None, label
    for perm, resample in units:
        if perm != known:
            known, shuffled = perm, np.empty_like(label)
            shuffled[base] = label[_hash_places(f"{seed}|{perm}", ids)]
        repeat, part = (resample - 1) // k + 1, (resample - 1) % k + 1
        if repeat not in outer:
            outer[repeat] = _hash_places(f"{seed}|{seed + 1000 * repeat}", ids)
        train = np.flatnonzero(_deal_places(outer[repeat], shuffled, k) != part)
        within = "|".join([str(seed), *keys, str(perm), str(resample)])
        fold = np.zeros(len(ids), np.int8)
        fold[train] = _deal_places(_hash_places(within, [ids[i] for i in train]), shuffled[train], k)
        yield shuffled, fold


def random_panels(
    pools: DataFrame, k: int, draws: int, seed: int, by: Sequence[str]
) -> DataFrame:
    """``draws`` random panels of k features out of each pool, nested in k.

    Output ``by, draw_id, position, feature``. md5 is uniform, so about 2k + 64 rows of a panel's order lie under a
    share of the hash range that the pool's size gives; only those are kept, written once and ordered. Should a panel
    come out short (a pool that repeats its features can), all rows are ordered.
    """
    by = list(by)
    rows = pools.select(*by, "feature")
    n = cut_lineage(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    limit = F.lower(F.lpad(F.hex(F.floor(F.lit(float(1 << 60)) * (2 * k + 64) / F.col("_n"))), 15, "0"))
    cut = n.select(*[F.col(c).alias(f"_{c}") for c in by], "_n", F.when(F.col("_n") > 2 * k + 64, limit).alias("_cut"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    sized = rows.join(F.broadcast(cut), on).select(*by, "feature", "_n", "_cut")  # one row a pool
    hashed = numbered_copies(sized, "draw_id", draws).withColumn("_h", hash_order(seed, "draw_id", *by, "feature"))
    near = cut_lineage(hashed.where(F.col("_cut").isNull() | (F.col("_h") < F.col("_cut"))).drop("_cut"))
    found = near.groupBy(*by, "draw_id").agg(F.count(F.lit(1)).alias("c"), F.max("_n").alias("n"))
    whole = found.where(F.col("c") >= F.least(F.lit(k), F.col("n"))).count() == draws * n.count()
    w = Window.partitionBy(*by, "draw_id").orderBy("_h")
    ordered = (near if whole else hashed).withColumn("position", F.row_number().over(w))
    return ordered.where(f"position <= {k}").select(*by, "feature", "draw_id", "position")


def inner_folds(
    folds: DataFrame, outer: Sequence[str], k: int = 3, seed: int = 7, scheme: str = "stratified"
) -> DataFrame:
    """Folds inside each outer training half; adds ``inner_idx`` and ``inner_role``."""
    deal = {"stratified": stratified_folds, "paired": paired_folds}[scheme]
    train = folds.where("role = 'train'").drop("fold")
    assigned = deal(train, k, seed, list(outer), parts=list(outer))
    return (
        fold_roles(assigned.drop("role"), k, "inner_idx")
        .withColumnRenamed("role", "inner_role")
        .drop("fold")
    )


def check_fold_leakage(
    folds: DataFrame, samples: DataFrame, split: Sequence[str], by: Sequence[str] = ("dataset",)
) -> DataFrame:
    """Per split: samples in both halves, groups on both sides, samples in neither half."""
    per_sample = folds.groupBy(*split, "sample_id").agg(
        F.max((F.col("role") == "train").cast("int")).alias("tr"),
        F.max((F.col("role") == "test").cast("int")).alias("te"),
    )
    with_group = per_sample.join(samples.select(*by, "sample_id", "group_id"), [*by, "sample_id"])
    groups = with_group.groupBy(*split, "group_id").agg(
        F.max("tr").alias("tr"),
        F.max("te").alias("te"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("tr") * F.col("te")).alias("both"),
    )
    expected = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"))
    return (
        groups.groupBy(*split)
        .agg(
            F.sum("both").alias("samples_in_both"),
            F.sum(F.col("tr") * F.col("te")).alias("groups_in_both"),
            F.sum("n").alias("covered"),
        )
        .join(expected, list(by))
        .select(
            *split,
            "samples_in_both",
            "groups_in_both",
            (F.col("expected") - F.col("covered")).alias("uncovered"),
        )
    )
