"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of whole texts are transformed so that they lie more evenly. Each
class gets a mean and a covariance, summed up by Spark over all labelled
documents of the training part; the covariance is shrunk toward its diagonal.
Log densities come from Mahalanobis distances with Cholesky factors that are
inverted once; their difference, compressed by asinh, is turned into a
probability by a logistic curve fitted to counts of the training documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import stash, table
from colloquy.llm.kernels import NOT_SPACE, Words, fewer, slices

BATCH_BYTES = 2 << 20
SHRINKAGE = 0.1
RIDGE = 1.0
BINS = 50  # of asinh of the difference, to 1
THRESHOLD = 0.3
STATISTICS = ["chars", "words", "word_length", "upper", "digits", "marks", "symbols", "bars", "shouts", "stops", "lines", "same_as_last", "distinct", "short_words"]


def _members(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SETS = {
    "upper": _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _members("0123456789"),
    "marks": _members("!\"'(),-./:;?[]"),
    "symbols": _members("#$%&*+<=>@\\^_`{|}~"),
    "bars": _members("|"),
    "shouts": _members("!?"),
    "stops": _members("."),
    "lines": _members("\n"),
}


def statistics(texts: pa.Array) -> np.ndarray:
    """A row per text: the transformed STATISTICS. A text without words has zeros for shares."""
    words = Words(texts, NOT_SPACE)
    off, data = words.off, words.data
    n_bytes, n_words = np.diff(off), np.diff(words.first)
    chars = np.diff(np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), off))
    per = {k: np.diff(np.searchsorted(np.flatnonzero(m[data]), off)) for k, m in _SETS.items()}
    length = words.end - words.start
    w = np.maximum(n_words, 1)
    b = np.maximum(n_bytes, 1)

    def by_row(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[words.first[1:]] - sums[words.first[:-1]]

    same = np.zeros(len(words), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    # distinct words: sorted by row and hash, each first one counts
    order = np.lexsort((words.hash, words.row))
    h, r = words.hash[order], words.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=len(n_words))
    share = lambda x, n: np.sqrt(x / n)
    return np.column_stack([
        np.log1p(chars), np.log1p(n_words), np.log1p(by_row(length) / w),
        share(per["upper"], b), share(per["digits"], b), share(per["marks"], b), share(per["symbols"], b), share(per["bars"], b), share(per["shouts"], b),
        share(per["stops"], w), share(per["lines"], w), share(by_row(same), w), np.log(np.maximum(distinct, 1)) / np.log1p(w), share(by_row(length <= 3), w),
    ])


def _of_batch(texts: pa.Array) -> np.ndarray:
    parts = [statistics(texts.slice(a, b - a)) for a, b in slices(texts, BATCH_BYTES)]
    return np.vstack(parts) if parts else np.zeros((0, len(STATISTICS)))


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "qda_x") -> DataFrame:
    """docs with the statistics of each text as an array; null counts as empty."""
    own = [c for c in docs.columns if c != name]

    def run(batches):
        for batch in fewer(batches, 1000):
            x = _of_batch(batch.column(text_col))
            values = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    base = docs.select(*own)
    return base.mapInArrow(run, base.withColumn(name, F.array(F.lit(0.0))).schema)


@dataclass
class Discriminant:
    """What scoring needs: means, inverse Cholesky factors and constants of classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0
    only: float | None = None  # the score of everything, if there weren't two classes to learn

    def margin(self, x: np.ndarray) -> np.ndarray:
        """asinh of the log density of class 1 less that of class 0."""
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(self.constants[k] - 0.5 * (z * z).sum(1))
        return np.arcsinh(density[1] - density[0])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.intercept, -500, 500)))

    def calibrate(self, margins: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
        """Newton's method for the logistic curve, with a ridge so that separable classes end too."""
        w, x = np.zeros(2), np.column_stack([margins, np.ones(len(margins))])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            gradient = x.T @ (counts * (p - labels)) + RIDGE * w
            step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2), gradient)
            w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        self.slope, self.intercept = float(w[0]), float(w[1])


def fit(rows: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """rows: label (0 or 1) and qda_x. All of them count; a row of sums per class and counts of margins reach the driver."""
    d = len(STATISTICS)
    x = lambda i: F.col("qda_x")[i]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = {r["label"]: r for r in rows.filter("label IN (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x(i)) for i in range(d)]).alias("s"), F.array(*[F.sum(x(i) * x(j)) for i, j in pairs]).alias("q")).collect()}
    if len(sums) < 2:
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), only=float(next(iter(sums))) if sums else 0.5)
    means, factors, constants = [], [], []
    n_all = sum(r["n"] for r in sums.values())
    for k in (0, 1):
        n, mean = sums[k]["n"], np.array(sums[k]["s"]) / sums[k]["n"]
        cov = np.zeros((d, d))
        for (i, j), q in zip(pairs, sums[k]["q"], strict=True):
            cov[i, j] = cov[j, i] = q / n - mean[i] * mean[j]
        a = max(shrinkage, d / (n + d))
        cov = (1 - a) * cov + a * np.diag(np.diag(cov)) + 1e-4 * np.eye(d)
        lower = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n / n_all) - np.log(np.diag(lower)).sum())
    model = Discriminant(np.array(means), np.array(factors), np.array(constants))

    def bins(batches):
        for batch in batches:
            margin = model.margin(batch.column("qda_x").flatten().to_numpy().reshape(-1, d))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.round(margin * BINS).astype(np.int32))], ["label", "bin"])

    # asinh of any double is under 711, so the bins are bounded
    counted = rows.filter("label IN (0, 1)").select(F.col("label").cast("int").alias("label"), "qda_x").mapInArrow(bins, "label int, bin int").groupBy("label", "bin").count().collect()
    model.calibrate(np.array([r["bin"] / BINS for r in counted]), np.array([r["label"] for r in counted]), np.array([float(r["count"]) for r in counted]))
    return model


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids, by crc32 of the id as text; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, qda_x) of labelled documents that aren't held out; ids with two different labels don't count."""
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other").select("doc_id", "label")
    return stats.select("doc_id", "qda_x").join(known, "doc_id").select("label", "qda_x")


def with_score(docs: DataFrame, model: Discriminant, x_col: str | None = None) -> DataFrame:
    """docs with qda_score (double): from x_col, or from the texts."""
    own = [c for c in docs.columns if c != "qda_score"]
    base = docs.select(*own)
    d = len(STATISTICS)

    def run(batches):
        for batch in batches:
            if x_col:
                x = batch.column(x_col).flatten().to_numpy().reshape(-1, d)
            else:
                x = _of_batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x))], [*batch.schema.names, "qda_score"])

    return base.mapInArrow(run, base.withColumn("qda_score", F.lit(0.0)).schema)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Discriminant, DataFrame]:
    """The model and (doc_id, qda_x) of all documents, as written to the shared folder."""
    stats = stash(with_statistics(docs.select("doc_id", "text")).select("doc_id", "qda_x"))
    return fit(training_rows(stats, labels)), stats


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with the columns of docs."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))  # whatever the columns' names
    # the rows go with their statistics, so that no text is read twice
    stats = stash(with_statistics(rows).select("row", "doc_id", "qda_x"))
    model = fit(training_rows(stats, labels))
    return with_score(stats.select("row", "qda_x"), model, "qda_x").filter(F.col("qda_score") >= threshold).select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents is scored, repeated ids each by their own text; null and empty texts too."""
    model, stats = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return with_score(stats, model, "qda_x").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("qda_score").alias("score"), (F.col("qda_score") >= THRESHOLD).cast("int").alias("predicted"))
