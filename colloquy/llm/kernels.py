"""Array work on Arrow text batches: words, hashes, shingle sets. Used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes that belong to a word when words are split at ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that belong to a word of digits, ASCII letters and all that isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2**64 for i under n at least."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        out = np.full(size, base, U64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of x over all 64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fewer(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, which Spark bounds by bytes, in parts of at most so many rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text is a range of its own."""
    size = np.diff(offsets(texts)[1])
    at = np.cumsum(size)
    begin = 0
    while begin < len(size):
        before = at[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(at, before + most, "right")))
        yield begin, end
        begin = end


def offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """The words of a batch of texts: start, end (bytes), row, first (of each row, one more at the end), hash."""

    def __init__(self, texts: pa.Array, members: np.ndarray, *, hashed: bool = True):
        self.data, self.off = data, off = offsets(texts)
        n = len(data)
        inside = members[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[edge[:n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edge[1:]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        if hashed:
            sums = np.zeros(n + 1, U64)
            np.cumsum((LOWERED[data].astype(U64) + U64(1)) * powers(_MULTIPLIER, n + 1)[:n], out=sums[1:])
            self.hash = mixed((sums[self.end] - sums[self.start]) * powers(_INVERSE, n + 1)[self.start])

    def __len__(self) -> int:
        return len(self.start)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words inside a row; a row of fewer words, but not none, has one of them all."""
    h, per_row = words.hash, np.diff(words.first)
    n = len(h)
    out = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        out = out * U64(_MULTIPLIER) + h[j : j + len(out)]
    whole = (words.row[: len(out)] == words.row[k - 1 :]) if len(out) else np.zeros(0, bool)
    found, rows = mixed(out[whole]), words.row[: len(out)][whole]
    short = np.flatnonzero((per_row > 0) & (per_row < k))
    if len(short):
        extra = np.array([int(_run(h[words.first[r] : words.first[r + 1]])) for r in short], U64)
        found, rows = np.concatenate([found, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        found, rows = found[order], rows[order]
    return found, rows


def _run(h: np.ndarray) -> np.ndarray:
    out = np.zeros(1, U64)
    for x in h:
        out = out * U64(_MULTIPLIER) + x
    return mixed(out + U64(len(h)))[0]
