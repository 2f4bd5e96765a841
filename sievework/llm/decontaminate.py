"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming join, exact check.

Words are runs of letters and digits, lower-cased; a shingle is a hash of five of them. Only a window that
holds a shingle of an item can be similar to it, so windows are laid where such a shingle stands: every
start at which the item's length covers it. Their 128-bit SimHash is summed in packed counters, 32 bits
a lane. Fingerprints within ``radius`` differ in at most that many of ``radius + 1`` blocks, so one block at
least is equal: the join on item and block finds all of them. What is found is compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import plain, stored

SIZE = 5
BITS = 128
RADIUS = 31
LANES = 0x0000000100000001
LANE_BITS = 32
HALF = 1 << 30
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of five words of a text, in order; empty if there are fewer words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # The array is bound once by transform over a one-element array.
    runs = F.transform(
        F.array(hashed),
        lambda a: F.when(
            F.size(a) >= SIZE,
            F.transform(
                F.sequence(F.lit(0), F.size(a) - SIZE),
                lambda i: F.xxhash64(*(F.get(a, i + j) for j in range(SIZE))),
            ),
        ).otherwise(F.array().cast("array<long>")),
    )
    return runs[0]


def _packed(h: Column) -> list[Column]:
    """The 64 bits of a hash as 32 numbers of two lanes of 32 bits."""
    return [F.shiftrightunsigned(h, b).bitwiseAND(F.lit(LANES)) for b in range(LANE_BITS)]


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n and the 128-bit majority fingerprint (f0, f1) of the hashes ``h`` of each key.

    A key has up to 2^30 hashes; each occurrence counts, so a shingle weighs as often as it stands.
    """
    wide = rows.select(*keys, *(c.alias(f"c{k}_{b}") for k, h in _two("h") for b, c in enumerate(_packed(h))))
    sums = wide.groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.sum(f"c{k}_{b}").alias(f"c{k}_{b}") for k in (0, 1) for b in range(LANE_BITS))
    )
    over = F.lit(LANES) * (F.lit(HALF - 1) - F.floor(F.col("n") / 2))
    out = []
    for k in (0, 1):
        bits = [
            F.shiftleft(F.shiftrightunsigned(F.col(f"c{k}_{b}") + over, 30).bitwiseAND(F.lit(LANES)), b)
            for b in range(LANE_BITS)
        ]
        word = bits[0]
        for more in bits[1:]:
            word = word.bitwiseOR(more)
        out.append(word.alias(f"f{k}"))
    return sums.select(*keys, "n", *out)


def _two(h: str) -> list[tuple[int, Column]]:
    return [(0, F.col(h)), (1, F.xxhash64(F.col(h), F.lit(1)))]


def _blocks() -> Column:
    """Block number and value, in one number, of each of the ``RADIUS + 1`` blocks of f0 and f1."""
    width = BITS // (RADIUS + 1)
    each = [
        F.shiftrightunsigned(F.col(f"f{k}"), at).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(1 << width) * (k * 64 + at)
        for k in (0, 1)
        for at in range(0, 64, width)
    ]
    return F.explode(F.array(*each))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, similarity): the most similar window of each document and item at or above
    ``threshold``; of equal ones the first. ``start`` counts shingles from 0.

    Similarity is weighted Jaccard on shingles of five words, each weighing as often as it occurs. A window
    has as many shingles as the item, or all of the document if that has fewer. At the threshold a fingerprint
    differs from the item's in 19 of 128 bits on average (standard deviation 4), so a radius of 31 loses about
    one in 500 windows that stand just there, and none of clearly similar ones.

    Items of fewer than five words have no shingle and match nothing, as do null and empty texts. Repeated rows count once; null ids are not looked for;
    an id with several texts is matched by each of them. Other columns are not read. Empty tables give an
    empty result.
    """
    item = ["item_id", "ikey"]
    bench = (
        plain(items, item_id="item_id:long", text="text:string")
        .where("item_id is not null")
        .distinct()
        .select("item_id", F.xxhash64("text").alias("ikey"), F.posexplode(shingle_hashes(F.col("text"))).alias("pos", "h"))
    )
    bench = stored(bench.groupBy(*item, "h").agg(F.count("*").alias("w")), "items")
    lengths = bench.groupBy(*item).agg(F.sum("w").alias("item_n"))
    known = bench.join(lengths, item).select("h", *item, "item_n")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)  # at most a million rows of four numbers

    texts = plain(docs, doc_id="doc_id:long", text="text:string").where("doc_id is not null")
    texts = texts.withColumn("tkey", F.xxhash64("text"))
    hits = (
        texts.select("doc_id", "tkey", F.posexplode(shingle_hashes(F.col("text"))).alias("pos", "h"))
        .join(known, "h")
        .select("doc_id", "tkey", *item, "item_n", "pos")
        .distinct()
    )
    hits = stored(hits, "hits")

    ids = hits.select("doc_id", "tkey").distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)  # so that texts without a hit are not shuffled
    held = texts.join(ids, ["doc_id", "tkey"], "left_semi").dropDuplicates(["doc_id", "tkey"])
    held = stored(held.select("doc_id", "tkey", shingle_hashes(F.col("text")).alias("hs")), "hit-texts")
    # Starts around a hit; a document shorter than the item has one window, itself.
    first = F.greatest(F.col("pos") - F.col("item_n") + 1, F.lit(0))
    starts = hits.join(held.select("doc_id", "tkey", F.size("hs").alias("doc_n")), ["doc_id", "tkey"])
    room = F.greatest(F.col("doc_n") - F.col("item_n"), F.lit(0))
    starts = starts.select(
        "doc_id", "tkey", *item, "item_n",
        F.explode(F.sequence(F.least(first, room), F.least(F.col("pos").cast("long"), room))).alias("start"),
    ).distinct()
    keys = ["doc_id", "tkey", *item, "start"]

    def opened(windows: DataFrame) -> DataFrame:
        cut = F.slice("hs", (F.col("start") + 1).cast("int"), F.col("item_n").cast("int"))
        return windows.join(held, ["doc_id", "tkey"]).select(*keys, "item_n", F.explode(cut).alias("h"))

    windows = fingerprints(opened(starts), keys)
    per_item = fingerprints(
        bench.select(*item, F.explode(F.expr("array_repeat(h, int(w))")).alias("h")), item
    )
    left = windows.select(*keys, F.col("f0").alias("x0"), F.col("f1").alias("x1"), _blocks().alias("block"))
    right = per_item.select(*item, F.col("f0").alias("y0"), F.col("f1").alias("y1"), _blocks().alias("block"))
    far = F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))) + F.bit_count(F.col("x1").bitwiseXOR(F.col("y1")))
    near = left.join(right, [*item, "block"]).where(far <= RADIUS).select(*keys).distinct()

    chosen = near.join(lengths, item)
    counts = opened(chosen).groupBy(*keys, "item_n", "h").agg(F.count("*").alias("n"))
    common = counts.join(bench, [*item, "h"], "left").groupBy(*keys, "item_n").agg(
        F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("w", F.lit(0)))).alias("both")
    )
    similarity = F.col("both") / (F.col("n") + F.col("item_n") - F.col("both"))
    found = common.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").alias("start"), (-F.col("b.s")).alias("similarity"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    bad = contaminated(docs, items, threshold).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
