"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

New documents are reduced to one row per digest, compared with the index by a
sort-merge anti-join (the index side is read in bucket order, without a
shuffle), and the digests that were not there are appended. A table is taken in
two batches, the larger ids first, so that the row that an earlier batch left in
the index is the one to stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import UPPER, LOWER, join_hot, lower_ascii, remove, shared_dir, stash, table, unstash


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("digest"))


def _digest(text_col: str):
    return F.unhex(F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256))


class DigestIndex:
    """The digests of all documents taken so far, one row each: (digest, keep_id, batch).

    A Spark table, bucketed and sorted by digest. ``buckets`` should be about
    the bytes of the index over 128 MB; it is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 16):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Each write adds files in bucket order; digests must not be in the index yet.

        A bucket goes to one task, so that it has one file of each write, to however
        many tasks the buckets are dealt.
        """
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))  # as Spark tells buckets
        writer = (
            fresh.select("digest", "keep_id", F.lit(batch).alias("batch"))
            .repartition(max(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), bucket)
            .write.mode("append" if self.exists() else "errorifexists")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
        )
        if self.path:
            writer = writer.option("path", self.path)
        writer.saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Removes the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.path:
            remove(self.spark, self.path)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of groups whose digest isn't in the index. Only groups is shuffled."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def decide(self, found: DataFrame, batch: str | None = None) -> DataFrame:
        """(digest, keep_id, group_size, old) of each digest in found (doc_id, digest); what is new is appended.

        keep_id is the index's row for a digest that another batch brought (old), and
        the largest doc_id of found for the rest. A batch that is taken again, after a
        job that died behind the append, gets the same answer: its own rows don't
        count as old. Without a name every batch is another one.
        """
        batch = batch or uuid.uuid4().hex
        groups = stash(found.groupBy("digest").agg(F.max("doc_id").alias("own_id"), F.count(F.lit(1)).alias("group_size")))
        new = groups.select("digest", F.col("own_id").alias("keep_id"), "group_size", F.lit(False).alias("old"))
        if not self.exists():
            self.append(new, batch)
            return new
        fresh = stash(self.unseen(groups).select("digest", F.col("own_id").alias("keep_id"), "group_size", F.lit(False).alias("old")))
        old = F.col("batch") != batch
        seen = groups.join(self.rows().hint("merge"), "digest").select("digest", F.when(old, F.col("keep_id")).otherwise(F.col("own_id")).alias("keep_id"), "group_size", old.alias("old"))
        seen = stash(seen)
        self.append(fresh, batch)
        unstash(groups)
        return fresh.unionByName(seen)

    def take(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Dedups docs against themselves and the index, appends what is new.

        Returns one row per row of docs: doc_id, keep_id, group_size, kept, digest.
        Of equal texts that are new the largest doc_id stays; a text that the index
        has already stays with the index's row and every new copy is dropped.
        group_size counts the copies in docs. Rows that repeat both text and doc_id
        are one document and share its decision; so do rows without doc_id, which
        count as less than any. No rows in, no rows out.
        """
        found = stash(digests(docs))
        out = join_hot(found, self.decide(found, batch), "digest", "group_size")
        return out.select("doc_id", "keep_id", "group_size", (~F.col("old") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest")

    def take_by_id(self, docs: DataFrame) -> DataFrame:
        """The rows of ``take`` for docs that are wholly new, in two batches: the upper half of the ids, then the rest against the index.

        The first batch leaves the largest doc_id of each text, so the result is that
        of one batch; group_size counts both.
        """
        found = stash(digests(docs))
        middle = found.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
        if middle is None:
            return self._placed(found, self.decide(found))
        upper = self.decide(found.filter(F.col("doc_id") >= middle))
        lower = self.decide(found.filter((F.col("doc_id") < middle) | F.col("doc_id").isNull()))
        return self._placed(found, upper.unionByName(lower))

    @staticmethod
    def _placed(found: DataFrame, decided: DataFrame) -> DataFrame:
        groups = stash(decided.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
        return join_hot(found, groups, "digest", "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    buckets = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", shared_dir(spark), buckets)


def largest_stay(docs: DataFrame) -> DataFrame:
    """``take_by_id`` through an index of its own, which goes when all is decided."""
    index = new_index(docs.sparkSession)
    out = index.take_by_id(docs)
    index.drop()
    return out


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: of equal texts those with the largest doc_id, of rows that repeat text and doc_id one."""
    gone = stash(largest_stay(docs).filter("NOT kept").select(_row_key(F.col("doc_id"), F.col("digest")).alias("key")).distinct())
    rows = docs.select(_row_key(F.col("doc_id"), _digest("text")).alias("key"), F.struct("*").alias("row"))  # whatever the columns' names
    return rows.join(gone.hint("merge"), "key", "left_anti").dropDuplicates(["key"]).select("row.*")


def _row_key(doc_id, digest):
    """Tells rows apart by text and doc_id; null is an id of its own."""
    return F.concat(digest, F.coalesce(F.encode(doc_id.cast("string"), "UTF-8"), F.lit(b"")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = largest_stay(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
