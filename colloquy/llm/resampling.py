"""Importance resampling towards a target distribution, counted by DuckDB in every partition.

A task hands its texts to a DuckDB connection of its own in pieces of bounded size.
SQL extracts the words, unnests them, pairs each with the next by a window, and
counts the n-grams' buckets; the bucket is zlib's CRC, registered as a function. The
bucket counts, of each document and of the task as a whole, go to Parquet in the
shared folder. Spark merges the tasks' counts, makes the gain of every bucket and
scores the documents from their counts: no text is read twice, and what is gathered
is one number per bucket.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import LOWER, UPPER, stash, table
from colloquy.llm.kernels import slices
from colloquy.operators.ordering import ranked

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text that DuckDB gets at once, characters at which a text is cut in pieces, memory of a connection.
RUN_BYTES, PIECE_CHARS, MEMORY = 2 << 20, 1 << 19, "384MB"
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

COUNTS = f"""
WITH texts AS (
  SELECT doc, piece, again, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM part
), words AS (SELECT doc, piece, again, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts
), pairs AS (SELECT doc, again AND place = 1 AS again, word, lead(word) OVER (PARTITION BY piece ORDER BY place) AS next FROM words
), grams AS (SELECT doc, unnest([CASE WHEN NOT again THEN word END, word || ' ' || next]) AS gram FROM pairs)
SELECT doc, crc_bucket(gram) AS bucket, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY ALL
"""


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """A text cut between words; a further piece begins with the last word before it, and says so."""
    begin, again = 0, False
    if len(text) > most:
        for m in _WORD.finditer(text):
            if m.end() - begin > most and m.start() > begin:
                yield text[begin : m.end()], again
                begin, again = m.start(), True
    yield text[begin:], again


class Counter:
    """A DuckDB connection that counts buckets of n-grams. It has no folder to spill to: runs are bounded instead."""

    def __init__(self, buckets: int):
        import duckdb

        self.buckets = buckets
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.con.create_function("crc_bucket", self._bucket, ["VARCHAR"], "INTEGER", type="arrow")

    def _bucket(self, grams: pa.Array) -> pa.Array:
        if isinstance(grams, pa.ChunkedArray):
            grams = grams.combine_chunks()
        wide = pa.types.is_large_string(grams.type)
        off = np.frombuffer(grams.buffers()[1], np.int64 if wide else np.int32)[grams.offset : grams.offset + len(grams) + 1].tolist()
        data, crc = memoryview(grams.buffers()[2] or b""), zlib.crc32
        return pa.array((np.array([crc(data[a:b]) for a, b in pairwise(off)], np.int64) % self.buckets).astype(np.int32))

    def run(self, rows: list[tuple[int, str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """(key, n): key is doc * buckets + bucket, for rows (doc, piece of its text, does it begin with a word already counted)."""
        docs, texts, again = zip(*rows, strict=True)
        part = pa.table({"doc": pa.array(docs, pa.int64()), "piece": pa.array(range(len(rows)), pa.int64()), "again": pa.array(again), "text": pa.array(texts, pa.large_string())})
        self.con.register("part", part)
        got = self.con.sql(COUNTS).to_arrow_table()
        self.con.unregister("part")
        return got.column("doc").to_numpy() * self.buckets + got.column("bucket").to_numpy(), got.column("n").to_numpy()

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same over whole texts, sorted by key."""
        keys, numbers, rows, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
        for i, text in enumerate(texts):
            for piece, again in pieces(text or ""):
                rows.append((i, piece, again))
                size += len(piece)
                if size >= RUN_BYTES:
                    got = self.run(rows)
                    keys.append(got[0])
                    numbers.append(got[1])
                    rows, size = [], 0
        if rows:
            got = self.run(rows)
            keys.append(got[0])
            numbers.append(got[1])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, np.concatenate(numbers), len(key)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """(id, buckets array<int>, counts array<long>, of_task): a row for each document, and one for each task with the sums of its documents (of_task, null id)."""

    def run(batches):
        counter, sums, kind = Counter(buckets), np.zeros(buckets, np.int64), None
        try:
            for batch in batches:
                kind = batch.schema.field(0).type
                for a, b in slices(batch.column(1), RUN_BYTES):
                    key, n = counter.counts(batch.column(1).slice(a, b - a).to_pylist())
                    doc, bucket = np.divmod(key, buckets)
                    sums += np.bincount(bucket, n, buckets).astype(np.int64)
                    off = pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32())
                    yield _rows(batch.column(0).slice(a, b - a), off, bucket, n, False)
        finally:
            counter.con.close()
        if kind is not None:
            bucket = np.flatnonzero(sums)
            yield _rows(pa.nulls(1, kind), pa.array([0, len(bucket)], pa.int32()), bucket, sums[bucket], True)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, buckets array<int>, counts array<long>, of_task boolean")


def _rows(ids: pa.Array, off: pa.Array, bucket: np.ndarray, n: np.ndarray, of_task: bool) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(off, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(off, pa.array(n, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, *lists, pa.array([of_task] * len(ids), pa.bool_())], ["id", "buckets", "counts", "of_task"])


def totals(counted: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``): the tasks' sums, merged."""
    each = counted.filter("of_task").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), a row for each bucket: by how much its n-grams speak for the target, in thousandths."""
    both = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(totals(source, "s"), "bucket", "left").join(totals(target, "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    odds = (F.col("t") + 1) * F.lit(all_s + buckets) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(odds)).alias("gain"))


def gumbel(id_col: str, seed: int) -> Column:
    """A draw from the Gumbel distribution, in thousandths, that the id and the seed fix. A null id counts as the empty string."""
    hash_ = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((hash_ + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, least_words: int = LEAST_WORDS, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_features, weight, score, rank (long).

    Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond
    ASCII; features are all runs of one and two words, with repeats. Of the N rows with
    at least ``least_words`` words the floor(percent * N / 100) of highest score are
    drawn and ranked, ties to the smaller doc_id; all others have a null rank. Null,
    empty and wordless texts have no features and weight 0. Every row is a document of
    its own; which of two rows equal in score and doc_id is ranked first isn't
    defined. An empty target has no features: all counts of it are 0. Columns other
    than doc_id and text (of target: text) take no part, whatever their names.
    """
    counted = stash(bucket_counts(docs, buckets=buckets))
    wanted = stash(bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), buckets=buckets))
    gain = [r.gain for r in sorted(gains(counted, wanted, buckets).collect(), key=lambda r: r.bucket)]  # ``buckets`` rows, at any size
    gain = F.from_json(F.lit(json.dumps(gain)), "array<long>")  # a constant of the plan
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    own = counted.filter("NOT of_task").select("id", n.alias("n"), F.aggregate(F.zip_with("buckets", "counts", lambda b, k: k * F.get(gain, b)), F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"))
    weight = F.when(F.col("n") > 0, F.expr("(sum - pmod(sum, n)) DIV n")).otherwise(F.lit(0).cast("long"))
    scored = own.select("id", F.col("n").alias("n_features"), weight.alias("weight"), (F.col("n") >= 2 * least_words - 1).alias("fits"))
    scored = stash(scored.withColumn("score", F.col("weight") + gumbel("id", seed)))
    drawn = scored.filter("fits").count() * percent // 100
    rank = F.when(F.col("fits") & (F.col("place") <= drawn), F.col("place"))
    return ranked(scored, F.desc("fits"), F.desc("score"), F.asc_nulls_last("id"), rank="place").select(F.col("id").alias("doc_id"), "n_features", "weight", "score", rank.alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
