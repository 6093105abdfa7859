"""Places in a total order over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.shared import stash

#: monotonically_increasing_id keeps the partition above this many bits, the row's place in it below.
PLACE_BITS = 33


def ranked(df: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """df with the column ``rank``: 1, 2, 3 ... in the order of the columns given.

    Two passes: rows are dealt to ranges of the order and sorted there, which gives
    a row's place in its range; the ranges' sizes, one row each, give what lies
    before it. Rows that tie in all columns get different ranks; which of them gets
    which isn't defined. A column named ``rank`` is replaced. No rows, no ranks.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c != rank]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*own).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = stash(dealt.select(F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("place")))
    part = F.shiftright("place", PLACE_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most a row for each range
    before, offsets = 0, []
    for size in sorted(sizes, key=lambda r: r.part):
        offsets.append((size.part, before))
        before += size.n
    starts = spark.createDataFrame(offsets, "part long, before long")
    place = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.join(F.broadcast(starts), part == F.col("part")).select("row.*", (F.col("before") + place + 1).alias(rank))
