"""What the operators of this package share: tables, bounded broadcasts; the shared work folder is the engine's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.shared import remove, shared_dir, stash, unstash

__all__ = ["LOWER", "UPPER", "join_hot", "let", "lower_ascii", "remove", "shared_dir", "stash", "table", "unstash"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def let(value, body):
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, most: int = 1000) -> DataFrame:
    """left joined (left outer) to right, which has one row per key and the key's number of rows in weight.

    Keys that hold more than a 1/most share of all rows, fewer than ``most`` by
    construction, are joined by a broadcast, so that a hot key isn't dealt to
    one task; all other keys by a sort-merge join.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.filter(F.col(weight) * most > F.lit(total)).limit(most)
    cold = right.filter(F.col(weight) * most <= F.lit(total))
    marked = left.join(F.broadcast(hot.select(F.col(key).alias("_hot_key"), F.struct(*[c for c in right.columns if c != key]).alias("_hot"))), F.col(key) == F.col("_hot_key"), "left")
    rest = [c for c in right.columns if c != key]
    # a hot row gets no key for the second join, so it can't gather there
    out = marked.withColumn("_cold_key", F.when(F.col("_hot_key").isNull(), F.col(key)))
    hot_rows = out.filter(F.col("_hot_key").isNotNull()).select(*left.columns, *[F.col(f"_hot.{c}").alias(c) for c in rest])
    cold_rows = out.filter(F.col("_hot_key").isNull()).select(*left.columns).join(cold.hint("merge"), key, "left").select(*left.columns, *rest)
    return hot_rows.unionByName(cold_rows)
