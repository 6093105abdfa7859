"""Two tables walked together by a key: the small side's rows of a key come first, the large side's follow in any number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.shared import stash

#: A key that holds more than this share of the large side, one in so many rows, is dealt to several tasks. Fewer keys than that can.
SHARE = 1000
#: Of a batch as many rows are taken to Python at a time as hold so many bytes on the average.
PART_BYTES = 1 << 22


def cogrouped(small: DataFrame, large: DataFrame, key: str, *, share: int = SHARE) -> DataFrame:
    """(key, part, kind, s, l): rows of both sides, sorted so that a task sees a key's small rows (kind 0, in s) before its large ones (kind 1, in l).

    Only the small side of one key must fit in a task's memory. A key with more
    than a ``share``-th of all large rows is split into parts of about that size,
    each of which gets the key's small rows; these keys are fewer than ``share``, so
    that the table of them is broadcast. Rows with a null key are left out. The
    large side is read twice.
    """
    spark = large.sparkSession
    sizes = stash(large.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    most = F.lit(max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // share))
    parts = F.broadcast(stash(sizes.filter(F.col("n") > 2 * most).select("key", F.ceil(F.col("n") / most).cast("int").alias("parts"))))
    left = small.select(F.col(key).alias("key"), F.struct(*small.columns).alias("s")).filter("key IS NOT NULL").join(parts, "key", "left")
    right = large.select(F.col(key).alias("key"), F.struct(*large.columns).alias("l")).filter("key IS NOT NULL").join(parts, "key", "left")
    left = left.select("key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("kind"), "s", F.lit(None).cast(right.schema["l"].dataType).alias("l"))
    # the row's own place deals it out: rows that are equal in all columns go to all parts
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))
    right = right.select("key", F.when(F.col("parts").isNull(), 0).otherwise(place).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast(small.select(F.struct(*small.columns)).schema[0].dataType).alias("s"), "l")
    both = left.unionByName(right).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "part")
    return both.sortWithinPartitions("key", "part", "kind")


def walk(batches: Iterator, begin: Callable[[list], object], rows: int = 1000) -> Iterator[tuple[object, list]]:
    """(what ``begin`` made of a key's small rows, some of its large rows) over a stream of ``cogrouped``; a key without small rows begins with none. Python holds ``rows`` rows at a time, fewer where they are long."""
    at, fresh, state = None, [], None
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * PART_BYTES // max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step).to_pydict()
            some: list = []
            for key, of, kind, s, l in zip(part["key"], part["part"], part["kind"], part["s"], part["l"], strict=True):
                if (key, of) != at:
                    if some:
                        yield state, some
                    at, fresh, state, some = (key, of), [], None, []
                if kind == 0:
                    fresh.append(s)
                    continue
                if state is None:
                    state = begin(fresh)
                some.append(l)
            if some:
                yield state, some
