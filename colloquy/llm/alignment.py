"""Cross-tokenizer alignment, and how corpus-wide each aligned pair of ids is.

Both tokenizers cut the same bytes. A task encodes the texts of a bounded slice,
aligns their token ends by array arithmetic, and makes of each side id (the first
tokenizer's) one postings row: the ids that it overlaps, in how many of the slice's
documents, and for every document how often. Spark shuffles these rows by side id,
sorted, together with the pairs' document counts; one walk over the stream holds the
counts of one id at a time, finds their maximum and passes over the id's postings,
however many there are, for the contributions to each document. These are summed by
document. Ids with very many postings are dealt to several tasks, each of which gets
the id's counts. What a task has for the documents of one slice is one row, and these
rows are summed by slice.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import stash, table
from colloquy.llm.encoders import encoder
from colloquy.llm.kernels import slices

SLICE_BYTES, SLICE_DOCS = 4 << 20, 1 << 15
#: Postings of a side id above which it is dealt to several tasks.
HOT = 1 << 18
#: Contributions that a task adds up before it passes them on.
HELD = 1 << 20


class Side:
    """A tokenizer's ids and the bytes of each."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        #: The id in decimals with what follows it: nothing, the same side's next, the other side, the next group.
        self.text = [f"{i}{end}" for end in ("", ",", "|", ";") for i in range(len(tokens))]

    def whole(self, ids: list[int], target: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids)) == target


class Pair:
    """Both tokenizers. The first is byte-level BPE, the second a piece model that adds the space itself."""

    def __init__(self, byte_level: str | None, ranks: str | None, pieces: str | None):
        import public_tokenizers
        import sentencepiece

        from colloquy.llm.bpe import byte_of

        self.encode_a = encoder(byte_level, ranks, False)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path("piece_bpe_32k.model"))
        byte, known = byte_of(), self.encode_a.exact.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(known.values()) + 1)
        for t, i in known.items():
            tokens[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.a = Side(tokens)
        name = self.pieces.id_to_piece
        self.b = Side([bytes([int(name(i)[3:-1], 16)]) if self.pieces.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.pieces.get_piece_size())])

        texts = [t.encode() for t in self.a.text + self.b.text]
        self.text_length = np.array([len(t) for t in texts], np.int64)
        self.text = np.zeros((len(texts), int(self.text_length.max())), np.uint8)
        for i, t in enumerate(texts):
            self.text[i, : len(t)] = np.frombuffer(t, np.uint8)

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both over space+text; none if the text is empty or either side's bytes aren't those of space+text."""
        if not text:
            return [], []
        target = f" {text}"
        a, b = self.encode_a(target), self.pieces.encode(text, num_threads=1)
        if self.a.whole(a, target.encode()) and self.b.whole(b, target.encode()):
            return a, b
        return [], []


@lru_cache(2)
def loaded(byte_level: str | None, ranks: str | None, pieces: str | None) -> Pair:
    """A worker reads its tokenizers once for all its tasks."""
    return Pair(byte_level, ranks, pieces)


class Alignment:
    """Some texts' tokens, laid end to end: both sides have the same bytes of every text, so one pass aligns all of them.

    A group ends where tokens of both sides end, as a text does. Links are the pairs of
    tokens whose byte ranges overlap: both sides' ends together cut the bytes into one
    stretch for each.
    """

    def __init__(self, pair: Pair, a: list[list[int]], b: list[list[int]]):
        self.pair, self.n_a, self.n_b = pair, np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a, self.b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, self.n_a), (b, self.n_b)))
        self.end_a, self.end_b = np.cumsum(pair.a.length[self.a]), np.cumsum(pair.b.length[self.b])
        size = int(self.end_a[-1]) + 1 if len(self.end_a) else 1
        self.at_a, self.at_b = np.zeros(size, bool), np.zeros(size, bool)
        self.at_a[self.end_a] = self.at_b[self.end_b] = True
        #: How many tokens of a side have ended by each byte.
        self.done_a, self.done_b = np.cumsum(self.at_a, dtype=np.int32), np.cumsum(self.at_b, dtype=np.int32)
        self.both = self.at_a & self.at_b
        self.common = np.flatnonzero(self.both)
        of_doc = lambda n: np.concatenate([[0], np.cumsum(n)])
        self.first_a, self.first_b = of_doc(self.n_a), of_doc(self.n_b)

    def n_groups(self) -> np.ndarray:
        ends = np.concatenate([[0], self.end_a])[self.first_a]
        return np.diff(np.searchsorted(self.common, ends, "right"))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, id, id) of every link, in order."""
        ends = np.flatnonzero(self.at_a | self.at_b)
        in_a, in_b = self.done_a[ends - 1], self.done_b[ends - 1]
        text = np.repeat(np.arange(len(self.n_a)), self.n_a)
        return text[in_a], self.a[in_a], self.b[in_b]

    def groups(self) -> list[bytes]:
        """Of each text, in ASCII, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        done = np.cumsum(self.both, dtype=np.int32)
        in_a, in_b = done[self.end_a - 1], done[self.end_b - 1]
        size_a, size_b = len(self.pair.a.tokens), len(self.pair.b.tokens)
        code_a = self.a + size_a * np.where(self.both[self.end_a], 2, 1)
        code_b = self.b + size_b * np.where(self.both[self.end_b], 3, 1)
        last = self.first_b[1:][self.n_b > 0] - 1
        code_b[last] = self.b[last]
        # before a token of the first side stand all of the second in earlier groups; before one of the second all of the first up to its own
        before_a = np.concatenate([[0], self.done_b[self.common]])[in_a]
        before_b = self.done_a[self.common][in_b]
        codes = np.empty(len(code_a) + len(code_b), np.int64)
        codes[np.arange(len(code_a)) + before_a] = code_a
        codes[np.arange(len(code_b)) + before_b] = code_b + len(self.pair.a.text)
        length = self.pair.text_length[codes]
        there = np.arange(self.pair.text.shape[1]) < length[:, None]
        data = self.pair.text[codes][there].tobytes()
        cut = np.concatenate([[0], np.cumsum(length)])[self.first_a + self.first_b].tolist()
        return [data[x:y] for x, y in zip(cut, cut[1:])]


DOC = "doc struct<row:long,id:{id},n_a:long,n_b:long,n_groups:long,n_links:long,groups:string>"
POSTINGS = "slice long, a int, b array<int>, n array<int>, docs array<short>, times array<int>"


def postings(docs: DataFrame, byte_level: str | None, ranks: str | None, pieces: str | None, hashed: bool) -> DataFrame:
    """A row for each document (doc) and, with a null doc, for each slice and side id.

    Of these: b has the ids that a overlaps in the slice, n in how many documents each;
    docs lists those documents by their place in the slice, b by b, times how often.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    kind = f"{DOC.format(id=rows.schema['id'].dataType.simpleString())}, {POSTINGS}"

    def run(batches):
        pair, done = loaded(byte_level, ranks, pieces), 0
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                for first in range(begin, end, SLICE_DOCS):
                    part = batch.slice(first, min(SLICE_DOCS, end - first))
                    slice_ = (TaskContext.get().partitionId() << 24) + done
                    done += 1
                    yield from _slice(pair, part, slice_, hashed)

    return rows.mapInArrow(run, kind)


def _slice(pair: Pair, part: pa.RecordBatch, slice_: int, hashed: bool):
    n = part.num_rows
    encoded = [pair.encode(text) for text in part.column("text").to_pylist()]
    own = Alignment(pair, [a for a, _ in encoded], [b for _, b in encoded])
    groups = own.groups()
    text, left, right = own.links()
    groups = [sha256(g).hexdigest() if g else "" for g in groups] if hashed else [g.decode() for g in groups]
    counts = own.n_a, own.n_b, own.n_groups(), np.bincount(text, minlength=n)
    doc = pa.StructArray.from_arrays(
        [pa.array((slice_ << 15) + np.arange(n)), part.column("id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(groups, pa.string())],
        ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups"],
    )
    empty = [pa.nulls(n, t) for t in _TYPES]
    yield pa.RecordBatch.from_arrays([doc, *empty], ["doc", *_NAMES])
    if not len(text):
        return
    key, _, times = _runs(np.sort((left << 40) | (right << 15) | text))  # ids under 2**23 and 2**25
    which, at_pair, per_pair = _runs(key >> 15)
    side, at_a, _ = _runs(which >> 25)
    by_pair = pa.array(np.append(at_a, len(which)), pa.int32())
    by_doc = pa.array(np.append(at_pair[at_a], len(key)), pa.int32())
    lists = lambda off, x, t: pa.ListArray.from_arrays(off, pa.array(x, t))
    columns = [
        pa.array(np.full(len(side), slice_)), pa.array(side, pa.int32()), lists(by_pair, which & ((1 << 25) - 1), pa.int32()), lists(by_pair, per_pair, pa.int32()),
        lists(by_doc, key & 0x7FFF, pa.int16()), lists(by_doc, times, pa.int32()),
    ]
    yield pa.RecordBatch.from_arrays([pa.nulls(len(side), doc.type), *columns], ["doc", *_NAMES])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of the runs of a sorted array."""
    starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    return x[starts], starts, np.diff(np.append(starts, len(x)))


_NAMES = ["slice", "a", "b", "n", "docs", "times"]
_TYPES = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.int32())]


def contributions(found: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, n_best, count_sum) of every document with links, from postings: the cogroup by side id."""
    spark = found.sparkSession
    posts = found.filter("a IS NOT NULL").drop("doc")
    pairs = stash(posts.select("a", F.explode(F.arrays_zip("b", "n")).alias("x")).groupBy("a", F.col("x.b").alias("b")).agg(F.sum("x.n").alias("n")))
    # a row for each side id at most, and no more than a hundredth of all postings over ``hot``
    parts = pairs.groupBy("a").agg(F.sum("n").alias("all")).filter(F.col("all") > hot).select("a", F.ceil(F.col("all") / hot).cast("int").alias("parts"))
    parts = F.broadcast(stash(parts))
    count = F.col("parts")
    spread = F.explode(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1))
    counts = pairs.join(parts, "a", "left").select("a", spread.alias("part"), F.lit(0).alias("kind"), F.array("b").alias("b"), F.array(F.col("n")).alias("n"), *[F.lit(None).cast(t).alias(c) for c, t in (("slice", "long"), ("docs", "array<short>"), ("times", "array<int>"))])
    own = posts.join(parts, "a", "left").select("a", F.when(count.isNull(), 0).otherwise(F.pmod(F.xxhash64("slice"), count)).cast("int").alias("part"), F.lit(1).alias("kind"), "b", F.transform("n", lambda x: x.cast("long")).alias("n"), "slice", "docs", "times")
    streams = counts.unionByName(own).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "part").sortWithinPartitions("a", "part", "kind")
    each = streams.mapInArrow(_merge, "slice long, docs array<short>, n_best array<long>, count_sum array<long>")
    by_slice = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice").sortWithinPartitions("slice")
    return by_slice.mapInArrow(_sum, "row long, n_best long, count_sum long")


def _merge(batches):
    """Over a stream sorted by side id, counts before postings: each document's share, added up within bounded memory."""
    at, known, count, best = None, None, None, 0
    fresh: list[tuple[int, int]] = []
    rows, shares, held = [], [], 0
    for batch in batches:
        a, part, kind = (batch.column(c).to_numpy() for c in ("a", "part", "kind"))
        slice_ = batch.column("slice").to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            if (a[i], part[i]) != at:
                at, fresh = (a[i], part[i]), []
                known = None
            value = lambda c: batch.column(c)[i].values.to_numpy()  # noqa: B023, E731
            if kind[i] == 0:
                fresh.append((value("b")[0], value("n")[0]))
                continue
            if known is None:
                known, count = (np.array(x) for x in zip(*sorted(fresh), strict=True))
                best = count.max()
            pair = np.repeat(count[np.searchsorted(known, value("b"))], value("n"))
            times = value("times").astype(np.int64)
            rows.append((int(slice_[i]) << 15) + value("docs").astype(np.int64))
            shares.append(np.stack([np.where(pair == best, times, 0), pair * times]))
            held += len(times)
            if held >= HELD:
                yield _added(rows, shares)
                rows, shares, held = [], [], 0
    if rows:
        yield _added(rows, shares)


def _added(rows: list[np.ndarray], shares: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each slice: its documents and their shares, each document once."""
    row, at = np.unique(np.concatenate(rows), return_inverse=True)
    both = np.zeros((2, len(row)), np.int64)
    for out, own in zip(both, np.concatenate(shares, axis=1), strict=True):
        np.add.at(out, at, own)
    slice_, first = np.unique(row >> 15, return_index=True)
    off = pa.array(np.append(first, len(row)), pa.int32())
    lists = [pa.ListArray.from_arrays(off, x) for x in (pa.array(row & 0x7FFF, pa.int16()), pa.array(both[0]), pa.array(both[1]))]
    return pa.RecordBatch.from_arrays([pa.array(slice_), *lists], ["slice", "docs", "n_best", "count_sum"])


def _sum(batches):
    """The shares of each document, summed over a stream sorted by slice; a slice has at most SLICE_DOCS documents."""

    def out(slice_: int, sums: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
        docs = np.flatnonzero(there)
        return pa.RecordBatch.from_arrays([pa.array((slice_ << 15) + docs), pa.array(sums[0, docs]), pa.array(sums[1, docs])], ["row", "n_best", "count_sum"])

    at, sums, there = None, None, None
    for batch in batches:
        slices_ = batch.column("slice").to_numpy()
        for i in range(batch.num_rows):
            if slices_[i] != at:
                if at is not None:
                    yield out(at, sums, there)
                at, sums, there = int(slices_[i]), np.zeros((2, SLICE_DOCS), np.int64), np.zeros(SLICE_DOCS, bool)
            docs = batch.column("docs")[i].values.to_numpy()
            there[docs] = True
            for k, c in enumerate(("n_best", "count_sum")):
                sums[k, docs] += batch.column(c)[i].values.to_numpy()
    if at is not None:
        yield out(at, sums, there)


def align(docs: DataFrame, *, byte_level: str | None = None, ranks: str | None = None, pieces: str | None = None, hashed: bool = False, hot: int = HOT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups.

    A group ends where tokens of both sides end; groups has the ids of each as
    ``a1,a2|b1;a3|b2,b3``, or with ``hashed`` its SHA-256, which a task makes so that the
    strings needn't be kept. A link is a pair of occurrences whose byte ranges overlap;
    a pair's count is in how many rows of docs it is linked; n_best counts the links
    whose count is the highest of their first id, ties included, and count_sum adds
    the counts of all. Null and empty texts, and those whose tokens' bytes aren't
    space+text (a text with U+2581), have no tokens: zeros and empty groups. Every row is
    a document of its own, repeated ones too. Other columns, whatever their names,
    take no part; no rows in, no rows out. A text is encoded whole in one task.
    """
    found = stash(postings(docs, byte_level, ranks, pieces, hashed))
    shares = contributions(found, hot)
    own = found.filter("doc IS NOT NULL").select("doc.*")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.join(shares, "row", "left").select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), hashed=True).withColumnRenamed("groups", "groups_sha256")
