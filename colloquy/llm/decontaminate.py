"""Benchmark decontamination: an FM-index per shard of documents.

A shard is a few megabytes of an Arrow batch. Its words become symbols: one for
each of the shard's words that stands in the benchmark, one for all other words; runs
of other words are cut to one symbol and runs of benchmark words too short for any
window are left out, which loses no occurrence. Over the shard's symbols stand the
Burrows-Wheeler transform of their suffix array in a wavelet matrix, and every eighth
suffix position. All windows are searched backward at once, occurrences are located by
walking to the next sampled position, and the hits of a document are merged into spans.

The benchmark is dealt to blocks of bounded size in the shared folder. A task takes a
few shards at a time. The blocks pass by twice, first to mark the words they know, then
with their windows; in between each shard is indexed, once. Neither the driver nor a
task ever has all of the benchmark. The documents are not shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import UPPER, LOWER, shared_dir, table
from colloquy.llm.kernels import ALNUM, Words, fewer, slices
from colloquy.llm.warc import open_dir

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Shards whose indexes a task holds while the blocks pass by.
GROUP_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
SAMPLE = 8
HIT = "struct<word_start:int,word_end:int,char_start:int,char_end:int>"


class FMIndex:
    """Backward search and location over an array of symbols from 1 to ``largest``; 0 ends it. Patterns have no larger symbols."""

    def __init__(self, symbols: np.ndarray, largest: int):
        s = np.append(symbols, 0).astype(np.int64)
        self.n = n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.levels = max(1, int(largest).bit_length())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << self.levels))])
        self.bwt, self.ones, self.zeros = bwt, [], []
        for level in reversed(range(self.levels)):
            bit = (bwt >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.sampled = sa % SAMPLE == 0
        self.before, self.sample = np.cumsum(self.sampled) - 1, sa[self.sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before at in the transform."""
        low, high = np.zeros_like(at), at
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            bit = ((symbol >> level) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(bit, zeros + low_ones, low - low_ones)
            high = np.where(bit, zeros + high_ones, high - high_ones)
        return high - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [low, high) of each pattern; a row of patterns holds its symbols from the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - back]
            low[live] = self.smaller[c] + self.rank(c, low[live])
            high[live] = self.smaller[c] + self.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these places of the suffix array."""
        out, open_, steps = np.full(len(at), -1), np.arange(len(at)), 0
        at = at.copy()
        while len(open_):
            got = self.sampled[at[open_]]
            out[open_[got]] = self.sample[self.before[at[open_[got]]]] + steps
            open_ = open_[~got]
            c = self.bwt[at[open_]]
            at[open_] = self.smaller[c] + self.rank(c, at[open_])
            steps += 1
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; s ends with its only 0."""
    rank, k, n = s.copy(), 1, len(s)
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1:
            return order
        rank, k = new, k * 2


class Phrases:
    """The windows of a block of benchmark items, as numbers of their words in the block; -1 pads a short one."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        words = Words(pa.array([text for _, text in items], pa.large_string()), ALNUM)
        self.vocabulary, symbol = np.unique(words.hash, return_inverse=True)
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for i, (item, _) in enumerate(items):
            own = symbol[words.first[i] : words.first[i + 1]].tolist()
            for j in range(max(0, len(own) - window) + 1 if own else 0):
                owners[tuple(own[j : j + window])].update([] if item is None else [item])
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.patterns = np.full((len(owners), int(self.lengths.max(initial=1))), -1)
        for i, p in enumerate(owners):
            self.patterns[i, : len(p)] = p
        self.owners = [sorted(x) for x in owners.values()]
        self.least = int(self.lengths.min(initial=1 << 30))

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        """Which are words of these phrases."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return self.vocabulary[at] == hashes


class Shard:
    """The words of some texts and, once all blocks have marked theirs, one index of the words that any block knows."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts, ALNUM)
        self.counts = np.diff(self.words.first)
        self.known = np.zeros(len(self.words), bool)
        self.cover = np.zeros(len(self.words) + 1, np.int64)
        self.items: dict[int, set[str]] = defaultdict(set)
        self.least, self.index = 1 << 30, None

    def mark(self, phrases: Phrases) -> None:
        """These phrases are to be searched."""
        self.known |= phrases.knows(self.words.hash)
        self.least = min(self.least, phrases.least)

    def build(self) -> None:
        words, known = self.words, self.known
        if not known.any():
            return
        # runs of known words within a text
        begins = known.copy()
        begins[1:] &= ~(known[:-1] & (words.row[1:] == words.row[:-1]))
        run = np.cumsum(begins) - 1
        long = np.bincount(run[known], minlength=int(run[-1]) + 1) >= self.least
        at = np.flatnonzero(known & long[np.maximum(run, 0)])
        if not len(at):
            return
        self.vocabulary, symbol = np.unique(words.hash[at], return_inverse=True)
        # each run after one symbol for whatever stood before it
        gap = np.cumsum(begins[at])
        text = np.ones(len(at) + int(gap[-1]) + 1, np.int64)
        place = np.arange(len(at)) + gap
        text[place] = symbol + 2
        self.word_at = np.full(len(text), -1)
        self.word_at[place] = at
        self.index = FMIndex(text, len(self.vocabulary) + 1)

    def search(self, phrases: Phrases) -> None:
        """Covers the words of every occurrence and notes the items."""
        if self.index is None or not len(phrases.lengths):
            return
        symbol = np.searchsorted(self.vocabulary, phrases.vocabulary)
        symbol[symbol == len(self.vocabulary)] = 0
        symbol = np.where(self.vocabulary[symbol] == phrases.vocabulary, symbol + 2, 0)
        patterns = np.append(symbol, 1)[phrases.patterns]  # what pads a short phrase is never read
        there = np.flatnonzero((patterns > 0).all(1))
        low, high = self.index.search(patterns[there], phrases.lengths[there])
        found = np.flatnonzero(high > low)
        if not len(found):
            return
        times = high[found] - low[found]
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
        where = self.word_at[self.index.locate(rows)]
        which = np.repeat(there[found], times)
        np.add.at(self.cover, where, 1)
        np.add.at(self.cover, where + phrases.lengths[which], -1)
        for r, w in set(zip(self.words.row[where].tolist(), which.tolist(), strict=True)):
            self.items[r].update(phrases.owners[w])

    def spans(self) -> dict[int, list[tuple[int, int, int, int]]]:
        """The maximal runs of covered words of each text that has any, by word and by code point."""
        words, out = self.words, {}
        hit = np.cumsum(self.cover[:-1]) > 0
        edge, ends = hit.copy(), hit.copy()
        edge[1:] &= ~(hit[:-1] & (words.row[1:] == words.row[:-1]))
        ends[:-1] &= ~(hit[1:] & (words.row[1:] == words.row[:-1]))
        first, last = np.flatnonzero(edge), np.flatnonzero(ends)
        if not len(first):
            return out
        char = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            r = int(words.row[a])
            base, zero = int(words.first[r]), int(char[words.off[r]])
            out.setdefault(r, []).append((a - base, b + 1 - base, int(char[words.start[a]]) - zero, int(char[words.end[b]]) - zero))
        return out


def write_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> tuple[str, int]:
    """A folder with the items in blocks of about ``most`` bytes, and how many blocks there are; an item lies in one."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = max(1, -(-size // most))
    uri = shared_dir(spark)
    rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")).repartition(n, "block").write.partitionBy("block").parquet(uri)
    return uri, n


def read_block(uri: str, block: int) -> list[tuple[str | None, str | None]]:
    fs, base = open_dir(uri)
    folder = f"{base}/block={block}"
    if fs.get_file_info(folder).type == pyarrow.fs.FileType.NotFound:
        return []
    files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if f.path.endswith(".parquet")]
    tables = [pyarrow.parquet.read_table(f, filesystem=fs, columns=["item", "text"], partitioning=None) for f in sorted(files)]
    return [row for t in tables for row in zip(t.column("item").to_pylist(), t.column("text").to_pylist(), strict=True)]


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the columns dec_words (int), dec_hits (array of spans) and dec_items (array<string>) after its own.

    Words are the runs of digits, ASCII letters (A-Z lower-cased) and characters
    beyond ASCII. A window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window. A span is a maximal run of words
    inside occurrences, by word and by code point, end exclusive: cutting the
    spans removes what leaked. Null and empty texts have no words and no hits;
    items without words never occur; equal items each count; an item whose id is
    null marks words but isn't listed. Columns of docs that bear the three names
    are replaced. Words are compared by 64-bit hashes.
    """
    own = [c for c in docs.columns if c not in ("dec_words", "dec_hits", "dec_items")]
    out = docs.select(*own, F.lit(0).alias("dec_words"), F.array().cast(f"array<{HIT}>").alias("dec_hits"), F.array().cast("array<string>").alias("dec_items"))
    uri, n = write_blocks(benchmark, block_bytes)

    def run(batches):
        held: dict[int, Phrases] = {}  # the last one read: a single block is read once a task

        def block(k: int) -> Phrases:
            if k not in held:
                held.clear()
                held[k] = Phrases(read_block(uri, k), window)
            return held[k]

        for batch in fewer(batches, 4000):
            for begin, end in slices(batch.column(text_col), GROUP_BYTES):
                group = batch.slice(begin, end - begin)
                cuts = list(slices(group.column(text_col), SHARD_BYTES))
                group_shards = [Shard(group.column(text_col).slice(a, b - a)) for a, b in cuts]
                for k in range(n):
                    for shard in group_shards:
                        shard.mark(block(k))
                for shard in group_shards:
                    shard.build()
                for k in reversed(range(n)):
                    for shard in group_shards:
                        shard.search(block(k))
                for (a, b), shard in zip(cuts, group_shards, strict=True):
                    yield _with_hits(group.slice(a, b - a), shard)

    return out.mapInArrow(run, out.schema)


def _with_hits(part: pa.RecordBatch, shard: Shard) -> pa.RecordBatch:
    spans, names = shard.spans(), ("word_start", "word_end", "char_start", "char_end")
    hits = [[dict(zip(names, x, strict=True)) for x in spans.get(r, ())] for r in range(part.num_rows)]
    items = [sorted(shard.items.get(r, ())) for r in range(part.num_rows)]
    columns, at = list(part.columns), {c: i for i, c in enumerate(part.schema.names)}
    for c, values in (("dec_words", shard.counts), ("dec_hits", hits), ("dec_items", items)):
        columns[at[c]] = pa.array(values, part.schema.field(c).type)
    return pa.RecordBatch.from_arrays(columns, schema=part.schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any hit, with the columns of docs."""
    # whatever the columns' names; the text goes to Python once
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    clean_ = find(rows, benchmark).filter(F.size("dec_hits") == 0)
    return clean_.select(*[(F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c)) for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("dec_hits", F.lit(0).cast("long"), lambda a, x: a + x["word_end"] - x["word_start"])
    return found.select(
        "doc_id",
        F.col("dec_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("dec_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dec_items", ","), 256).alias("items_sha256"),
        (F.size("dec_hits") > 0).alias("contaminated"),
    )


OP10_SQL = f"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, translate(text, '{UPPER}', '{LOWER}') AS text FROM documents
  UNION ALL SELECT 'b', item_id, translate(text, '{UPPER}', '{LOWER}') FROM benchmark
), w AS (
  SELECT kind, id, list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS words FROM t
), windows AS (
  SELECT DISTINCT id AS item_id, least(len(words), {WINDOW}) AS size, array_to_string(list_slice(words, i, i + least(len(words), {WINDOW}) - 1), ' ') AS phrase
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - {WINDOW} + 1, 1) + 1)) AS i) WHERE kind = 'b' AND len(words) > 0
), sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT id AS doc_id, i, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS phrase
  FROM (SELECT * FROM w WHERE kind = 'd') d, sizes, LATERAL (SELECT unnest(range(1, len(words) - size + 2)) AS i)
), hits AS (SELECT g.doc_id, g.i, g.size, item_id FROM grams g JOIN windows USING (size, phrase)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT w.id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered c ON c.doc_id = w.id LEFT JOIN items i ON i.doc_id = w.id WHERE kind = 'd'
"""
