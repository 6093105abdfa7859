"""Byte-level BPE by a priority queue of merge ranks over a doubly linked list of symbols.

A text is cut at its special tokens, then into words; a word starts as the symbols
of its bytes. Every neighbouring pair with a merge waits in a heap by (rank, place).
The least is taken: if the pair at its place is no longer the one of that rank, the
entry is stale and skipped, else the pair becomes one symbol, its right half leaves
the list, and the pairs with the new neighbours join the heap. A word of n bytes
costs n log n, however long it is. Decoding joins the tokens' byte strings.

Texts are encoded where they lie: nothing is shuffled. A task keeps the ids of the
words it has met, up to a fixed number.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import table
from colloquy.llm.kernels import slices

TOKENIZER = "byte_bpe_50k.json"
SLICE_BYTES = 8 << 20
#: Words that a task keeps with their ids, and the longest of them in characters.
KEPT_WORDS, KEPT_CHARS = 800_000, 40

# How a byte-level tokenizer splits a text into words.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# Letters and numbers younger than the tables of the tokenizers library (Unicode 16), first and last.
YOUNGER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


def _split(letter: str, number: str, neither: str) -> str:
    return rf"{CONTRACTIONS}| ?{letter}+| ?{number}+| ?{neither}+|\s+(?!\S)|\s+"


_YOUNGER = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in YOUNGER)
_ASCII = re.compile(_split("[A-Za-z]", "[0-9]", r"[^\sA-Za-z0-9]"), re.ASCII)
_ANY = regex.compile(_split(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))
_HAS_YOUNGER = regex.compile(f"[{_YOUNGER}]")
_EXACT = regex.compile(_split(rf"[\p{{L}}--[{_YOUNGER}]]", rf"[\p{{N}}--[{_YOUNGER}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{_YOUNGER}]]"), regex.V1)


def words(text: str) -> list[str]:
    """The words of a text; joined they are the text."""
    if text.isascii():
        return _ASCII.findall(text)
    return (_EXACT if _HAS_YOUNGER.search(text) else _ANY).findall(text)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Tokens(dict):
    """The bytes of each id; an id that the vocabulary lacks has none."""

    def __missing__(self, i: int) -> bytes:
        return b""


class Known(dict):
    """The packed ids of words that a task has met; it starts anew when it is full."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        found = self.bpe.merged(word.encode())
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """A tokenizer file's vocabulary and merges. Only byte-level BPE without a normaliser is read."""

    def __init__(self, path: str | None = None, specials: bool = True):
        """specials: the strings of special tokens inside a text become their ids; otherwise they are plain text."""
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = file["model"]["type"], file["normalizer"], file["pre_tokenizer"]["type"], file["pre_tokenizer"]["add_prefix_space"]
        if kind != ("BPE", None, "ByteLevel", False):
            raise ValueError(f"{path} isn't byte-level BPE without a normaliser: {kind}")
        vocabulary, byte = file["model"]["vocab"], byte_of()
        self.symbol = [vocabulary[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.rank = {vocabulary[a] << 20 | vocabulary[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        self.tokens = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in vocabulary.items()}
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = Tokens(self.tokens | {i: t.encode() for t, i in added.items()})
        self.specials = added if specials else {}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._known = Known(self)

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [*map(self.symbol.__getitem__, word), -1]  # no pair with -1 has a rank: it ends the list, and stands where a symbol left it
        n, rank_of, made = len(ids) - 1, self.rank.get, self.made
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = right[i] if ids[i] >= 0 else n
            if rank_of(ids[i] << 20 | ids[j]) != rank:
                continue  # stale: one of the two has merged meanwhile
            ids[i], ids[j] = made[rank], -1
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (r := rank_of(ids[i] << 20 | ids[after])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            before = left[i]
            if before >= 0 and (r := rank_of(ids[before] << 20 | ids[i])) is not None:
                heapq.heappush(queue, r << 32 | before)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for k, part in enumerate(self._cut.split(text) if self._cut else (text,)):
            if k % 2:
                out.append(struct.pack("<I", self.specials[part]))
            else:
                out.extend(map(self._known.__getitem__, words(part)))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids. What isn't UTF-8 becomes U+FFFD, ids that the vocabulary lacks are left out."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str | None, specials: bool) -> Bpe:
    """A worker reads a tokenizer once for all its tasks."""
    return Bpe(path, specials)


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return pa.RecordBatch.from_arrays([*batch.columns[:at], values.cast(batch.schema.field(at).type), *batch.columns[at + 1 :]], schema=batch.schema)


def encode_batches(batches: Iterator[pa.RecordBatch], text_col: str, ids_col: str, tokenizer: str | None, specials: bool) -> Iterator[pa.RecordBatch]:
    """Fills ids_col from text_col, in slices of bounded bytes."""
    bpe = loaded(tokenizer, specials)
    for batch in batches:
        for a, b in slices(batch.column(text_col), SLICE_BYTES):
            part = batch.slice(a, b - a)
            ids = [bpe.encode(t or "") for t in part.column(text_col).to_pylist()]
            off = pa.array([0, *accumulate(map(len, ids))], pa.int32())
            yield _replaced(part, ids_col, pa.ListArray.from_arrays(off, pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))))


def decode_batches(batches: Iterator[pa.RecordBatch], ids_col: str, text_col: str, tokenizer: str | None) -> Iterator[pa.RecordBatch]:
    """Fills text_col from ids_col."""
    bpe = loaded(tokenizer, True)
    for batch in batches:
        ids = batch.column(ids_col)
        texts = [None if not x.is_valid else bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in ids]
        yield _replaced(batch, text_col, pa.array(texts, pa.string()))


def _with_null(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], F.lit(None).cast(kind).alias(name))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "bpe_ids", tokenizer: str | None = None, *, specials: bool = True) -> DataFrame:
    """docs with the column ids_col (array<int>) after its own.

    A null or empty text has no ids. Every row is encoded for itself, repeated ones
    too; columns of docs keep their names and values, but one named ids_col is
    replaced. No rows in, no rows out. ``tokenizer`` is a path that every executor
    can open; the public byte-level vocabulary if None.
    """
    rows = _with_null(docs, ids_col, "array<int>")
    return rows.mapInArrow(lambda batches: encode_batches(batches, text_col, ids_col, tokenizer, specials), rows.schema)


def decode(df: DataFrame, ids_col: str = "bpe_ids", text_col: str = "bpe_text", tokenizer: str | None = None) -> DataFrame:
    """df with the column text_col (string) after its own; one of that name is replaced. Null ids give null, no ids the empty text."""
    rows = _with_null(df, text_col, "string")
    return rows.mapInArrow(lambda batches: decode_batches(batches, ids_col, text_col, tokenizer), rows.schema)


def op13_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass over the texts; only the digests leave the task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = _with_null(_with_null(docs, "bpe_ids", "array<int>"), "bpe_text", "string")

    def run(batches):
        for part in decode_batches(encode_batches(batches, "text", "bpe_ids", tokenizer, True), "bpe_ids", "bpe_text", tokenizer):
            ids = [x.values.to_numpy().astype("<u4") for x in part.column("bpe_ids")]
            texts = part.column("bpe_text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([sha256(t.encode()).hexdigest() for t in texts])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
