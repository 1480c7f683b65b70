"""Time segments of hot keys, for folds that must see a key's rows in order.

A key of more than ``ROWS`` rows is cut into segments of about that many, at minutes
that its counts give.  A fold over ordered rows then takes three steps: each segment is
reduced to what it does to the state, whatever the state was; a key's few such rows
are composed in order, which tells the state that each segment begins with; and all
segments run side by side.  Keys of fewer rows are one segment and skip the first two.

The cuts are kept by block of 64 minutes: how many lie before it, and a bit for each of
its minutes that ends a segment.  A row finds its segment by a join on its block and
one count of bits, whatever the number of cuts.  The blocks are a table in the shared
folder, which is broadcast only up to ``BROADCAST`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import delete, shared, written

ROWS = 1_000_000
BROADCAST = 100_000
MINUTE = 60_000_000
BLOCK = 64


def _place(us: str) -> tuple[Column, Column]:
    """A row's block, and its minute's number within it."""
    minute = F.floor(F.col(us) / MINUTE)
    block = F.floor(minute / BLOCK)
    return block, (minute - block * BLOCK).cast("int")


def _shift(bits: Column, by: Column) -> Column:
    return F.call_function("shiftleft", bits, by)


def hot(df: DataFrame, key: str, us: str = "us", rows: int = ROWS) -> DataFrame | None:
    """key, blocks: of the keys of more than rows rows the blocks, each with base, the cuts before it, and ends, its minutes that end a segment, as bits; None if there is no such key.

    A minute ends a segment where the running count passes a multiple of rows.
    """
    block, bit = _place(us)
    counts = df.groupBy(key, block.alias("block"), bit.alias("bit")).agg(F.count("*").alias("n"))  # a row a minute
    blocks = counts.groupBy(key, "block").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bit", "n"))).alias("minutes"))
    mine = Window.partitionBy(key)
    blocks = blocks.withColumns({"before": F.sum("n").over(mine.orderBy("block")) - F.col("n"), "whole": F.sum("n").over(mine)}).filter(F.col("whole") > rows)

    def passed(state: Column, minute: Column) -> Column:
        at = state["at"] + minute["n"]
        end = F.floor(at / rows) > F.floor(state["at"] / rows)
        return F.struct(at.alias("at"), F.when(end, state["ends"].bitwiseOR(_shift(F.lit(1).cast("long"), minute["bit"]))).otherwise(state["ends"]).alias("ends"))

    ends = F.aggregate("minutes", F.struct(F.col("before").alias("at"), F.lit(0).cast("long").alias("ends")), passed)["ends"]
    cell = F.struct("block", F.floor(F.col("before") / rows).alias("base"), ends.alias("ends"))
    folder = shared(df.sparkSession)
    cuts = written(blocks.groupBy(key).agg(F.collect_list(cell).alias("blocks")), folder, "cuts")
    size = cuts.agg(F.sum(F.size("blocks"))).first()[0]
    if not size:
        delete(df.sparkSession, folder)
        return None
    return F.broadcast(cuts) if size <= BROADCAST else cuts


def segmented(df: DataFrame, key: str, cuts: DataFrame | None, us: str = "us") -> DataFrame:
    """df with seg, the number of the row's segment within its key."""
    if cuts is None:
        return df.withColumn("seg", F.lit(0))
    block, bit = _place(us)
    joined = df.withColumn("block", block).join(cuts.select(key, F.inline("blocks")), [key, "block"], "left")
    earlier = F.bit_count(_shift(_shift(F.col("ends"), BLOCK - 1 - bit), F.lit(1)))  # the row's minute and later ones are shifted out
    return joined.withColumn("seg", F.coalesce(F.col("base") + earlier, F.lit(0)).cast("int")).drop("block", "base", "ends")


def carried(parts: DataFrame, key: str, values: dict[str, Column], forward: bool = True) -> DataFrame:
    """key, seg and values over the segments before (or after) each; parts has a row a segment.

    A value is an aggregate column, as F.sum("n") or F.last("x", ignorenulls=True); after a
    segment, rows come from the farthest to the next.
    """
    order = Window.partitionBy(key).orderBy("seg" if forward else F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(key, "seg", *[v.over(order).alias(n) for n, v in values.items()])
