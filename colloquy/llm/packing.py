"""Packing: best-fit decreasing, planned over counts of lengths.

Documents are tokenised and cut into full windows and a rest. Best-fit
decreasing looks at lengths only, and there are at most ``window`` of them, so
the plan is made over how many pieces have each length: a segment tree over
remaining capacities finds the tightest open windows, and a whole run of equal
pieces goes into a run of equally filled windows at once. The plan's size depends
on the window alone, never on the corpus. Each piece then finds its place from
its rank among pieces of its length, counted per task and summed over tasks.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import stash, table
from colloquy.llm.encoders import encoder

WINDOW = 1024
END = 0
PIECES = "struct<start:long,length:int,crc:long,rank:long>"


def cut(docs: DataFrame, window: int, tokenizer: str | None, ranks: str | None) -> DataFrame:
    """(doc_id, chunk, doc_tokens, pieces): rank counts the pieces of one length within the chunk, which is a task."""
    def run(batches):
        encode = encoder(tokenizer, ranks)
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64).tolist()
        for batch in batches:
            totals, pieces = [], []
            for text in batch.column("text").to_pylist():
                ids = np.array([*encode(text or ""), END], "<u4")
                own = []
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    own.append({"start": start, "length": len(piece), "crc": zlib.crc32(piece.tobytes()), "rank": seen[len(piece)]})
                    seen[len(piece)] += 1
                totals.append(len(ids))
                pieces.append(own)
            n = batch.num_rows
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()), ("rank", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([chunk] * n, pa.int32()), pa.array(totals, pa.int64()), pa.array(pieces, kind)], ["doc_id", "chunk", "doc_tokens", "pieces"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk int, doc_tokens long, pieces array<{PIECES}>")


class Capacities:
    """A segment tree over remaining capacities 0..window: the tightest open one that still takes a length."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset): best-fit decreasing of that many pieces of each length."""
    tree, open_, out, sequences = Capacities(window), [deque() for _ in range(window + 1)], [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            new = capacity is None
            if new:
                capacity, first, there = window, sequences, left
            else:
                first, there = open_[capacity].popleft()
            # a window that has taken one piece is now the tightest for the next, until it is full
            each = capacity // length
            n = min(there, left // each)
            if not n:
                n, each = 1, left
            if new:
                sequences += n
            else:
                if there > n:
                    open_[capacity].appendleft((first + n, there - n))
                tree.add(capacity, -n)
            for layer in range(each):
                out.append((length, rank, n, first, window - capacity + layer * length))
                rank += n
            left -= n * each
            if rest := capacity - each * length:
                open_[rest].append((first, n))
                tree.add(rest, n)
    return out


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs is a document of its own, also if ids or texts repeat. A
    null or empty text is the end id alone. Columns of docs other than doc_id and
    text take no part. No rows in, no rows out.
    """
    spark = docs.sparkSession
    done = stash(cut(docs, window, tokenizer, ranks))
    pieces = done.select("doc_id", "chunk", "doc_tokens", F.explode("pieces").alias("p")).select("doc_id", "chunk", "doc_tokens", "p.*")
    # a row for each task and length at most
    per_chunk = stash(pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {length: n for length, n in per_chunk.groupBy("length").agg(F.sum("n")).collect()}  # at most window rows
    steps = plan(counts, window)
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    for length in counts:
        own = [s for s in steps if s[0] == length]
        by_length[length] = tuple(np.array([s[k] for s in own], np.int64) for k in (1, 3, 4))
    sent = spark.sparkContext.broadcast(by_length)  # bounded by the window
    before = per_chunk.select("chunk", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["chunk", "length"]).select("doc_id", "start", "length", "crc", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                first, to, at = sent.value[int(x)]
                own = np.flatnonzero(length == x)
                step = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = to[step] + rank[own] - first[step], at[step]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(length.astype(np.int64)), batch.column("crc"), batch.column("doc_tokens"), pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
