"""Chat formatting: cumulative snapshots of a conversation are collapsed to the longest, then rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import plain, stored

SLICE = 256


def _positions(turns: DataFrame) -> DataFrame:
    """Position of each turn in its conversation, and two hashes of the turns up to it.

    A conversation may be of any length: its turns are numbered in slices of the turn number, and what
    comes before a slice is added from slice totals, themselves summed in blocks of slices.
    """
    # Hashes skip nulls, so these are marked.
    said = [F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit(""))]
    keys = ["conv_id", "slice"]
    order = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), *(c for c in said))
    numbered = turns.withColumn("slice", F.floor(F.coalesce("turn", F.lit(0)) / SLICE)).withColumn(
        "local", F.row_number().over(order) - 1
    )
    counts = numbered.groupBy(*keys).agg(F.count("*").alias("n"))
    start = _before(counts, F.sum("n"), F.lit(0))
    placed = numbered.join(start, keys).withColumn("pos", F.col("local") + F.col("before")).drop("before")
    for name in ("h1", "h2"):
        placed = placed.withColumn(name, F.xxhash64(F.lit(name), "pos", *said))
    for name in ("h1", "h2"):
        totals = placed.groupBy(*keys).agg(F.bit_xor(name).alias("n"))
        earlier = _before(totals, F.bit_xor("n"), F.lit(0).cast("long"))
        inside = Window.partitionBy(*keys).orderBy("local").rowsBetween(Window.unboundedPreceding, 0)
        running = F.bit_xor(name).over(inside)
        placed = placed.withColumn("running", running).join(earlier, keys)
        placed = placed.withColumn(name.replace("h", "p"), F.col("running").bitwiseXOR(F.col("before")))
        placed = placed.drop("running", "before")
    return placed.drop("slice", "local", "h1", "h2")


def _before(totals: DataFrame, total, none) -> DataFrame:
    """What the aggregate makes of all earlier slices of the conversation."""
    block = totals.withColumn("block", F.floor(F.col("slice") / SLICE))
    earlier = Window.partitionBy("conv_id", "block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = block.groupBy("conv_id", "block").agg(total.alias("n"))
    blocks = blocks.select("conv_id", "block", F.coalesce(total.over(outer), none).alias("far"))
    near = block.withColumn("near", F.coalesce(total.over(earlier), none)).drop("n")
    joined = near.join(blocks, ["conv_id", "block"])
    add = "near ^ far" if "bit_xor" in str(total) else "near + far"
    return joined.select("conv_id", "slice", F.expr(add).alias("before"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, pos, role, text) of conversations that no longer one begins with.

    A conversation whose turns, by role and text in turn order, are the first turns of a longer one is a
    snapshot and goes; of equal conversations the one with the least id stays. Two 64-bit hashes of a turn
    prefix and its length stand for the prefix; only hashes are joined.

    Repeated rows count once; turns with one number are ordered by role and text, null turns come first.
    Null roles and texts are values of their own. Rows without a conv_id are left out: they belong to no
    conversation. Other columns are not read; an empty table gives an empty result.
    """
    base = plain(turns, conv_id="conv_id:long", turn="turn:long", role="role:string", text="text:string")
    placed = stored(_positions(base.where("conv_id is not null").distinct()), "turns")
    lengths = placed.groupBy("conv_id").agg(F.max("pos").alias("pos"))
    whole = placed.join(lengths, ["conv_id", "pos"]).select("conv_id", "pos", "p1", "p2")
    inner = placed.join(lengths.withColumnRenamed("pos", "last"), "conv_id").where("pos < last")
    prefixes = inner.select("pos", "p1", "p2").distinct()
    # Equal conversations become one row before the join, so that a very common one is no hot key there.
    whole = whole.groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    kept = whole.join(prefixes, ["pos", "p1", "p2"], "left_anti").select("conv_id")
    return placed.join(kept, "conv_id").select("conv_id", "pos", "role", "text")


def render(turns: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>", part_turns: int = SLICE) -> DataFrame:
    """(conv_id, part, n_turns, text): turns (conv_id, pos, role, text) written out in order.

    A row holds at most ``part_turns`` turns, so a conversation of any length is never gathered in one
    place; the parts of a conversation on end are its text. A null role is written as ``unknown``, a null
    text as an empty one, and marks inside a text get a backslash.
    """
    body = F.coalesce("text", F.lit(""))
    for mark in (begin, end):
        body = F.replace(body, F.lit(mark), F.lit("\\" + mark))
    line = F.concat(F.lit(begin), F.coalesce("role", F.lit("unknown")), F.lit("\n"), body, F.lit(end + "\n"))
    parts = turns.select("conv_id", F.floor(F.col("pos") / part_turns).alias("part"), F.struct("pos", line.alias("line")).alias("t"))
    grouped = parts.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", "part", F.size("t").cast("long").alias("n_turns"), F.array_join("t.line", "").alias("text"))
