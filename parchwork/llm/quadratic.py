"""Quality classifier: regularised quadratic discriminant analysis.

A document becomes a short vector of transformed statistics. Each class is a
normal distribution of such vectors. Its covariance is shrunk towards the
pooled one and the pooled one towards its diagonal, which keeps both well
conditioned when a class has few rows. The score is the probability that Bayes'
rule gives label 1, from the difference of Mahalanobis log densities, computed
with Cholesky factors inverted once.

Statistics are computed once for each document and kept in a narrow table.
Fitting needs sums of them and of their products by class: one row for each
class, whatever the number of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.llm.shingles import text_buffers, word_hashes
from parchwork.session import cut

NAMES = ("words", "word_length", "symbols", "upper", "digits", "stops", "other", "distinct", "top", "pairs", "lines", "marks")
#: Imagined usual text, in bytes and words, added to each document: short ones have erratic shares.
USUAL_BYTES, USUAL_WORDS = 100, 20
#: Bytes of text handled at a time; a longer text is a step of its own.
STEP = 2_000_000

_CLASS = np.full(256, 6, dtype=np.int8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 symbol, 5 stop, 6 other, 7 newline, 8 exclamation and question mark
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[list(b"#*$%&|<>")] = 4
_CLASS[list(b".,;:'\"()-")] = 5
_CLASS[10] = 7
_CLASS[list(b"!?")] = 8
_CLASS[128:] = 0  # bytes of letters outside ASCII, for the most part


def _one(counts: np.ndarray, words: np.ndarray) -> list[float]:
    n, size = len(words), max(1, int(counts.sum()))
    share = lambda x, total, usual, weight: float(np.log((x + usual * weight + 0.05) / (total + weight + 1)))
    if n:
        times = np.unique(words, return_counts=True)[1]
        distinct, top = len(times), int(times.max())
        pairs = words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1]
        twice = len(pairs) - len(np.unique(pairs))
    else:
        distinct = top = twice = 0
    in_words = size - int(counts[3] + counts[7])
    return [
        float(np.log1p(n)),
        float(np.log((in_words + 5 * USUAL_WORDS) / (n + USUAL_WORDS))),
        share(counts[4], size, 0.0005, USUAL_BYTES),
        share(counts[1], size, 0.03, USUAL_BYTES),
        share(counts[2], size, 0.003, USUAL_BYTES),
        share(counts[5], size, 0.02, USUAL_BYTES),
        share(counts[6], size, 0.0005, USUAL_BYTES),
        # against what a text of this length tends to have
        float(np.log((distinct + 1) / (n + 1)) + 0.1 * np.log1p(n)),
        share(top, n, 0.06, USUAL_WORDS),
        share(twice, n, 0.01, USUAL_WORDS),
        share(counts[7], n, 0.05, USUAL_WORDS),
        share(counts[8], size, 0.0005, USUAL_BYTES),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for each row; a null text has the statistics of an empty one.

    Texts are counted whole, however long; equal rows have equal statistics, an
    empty table gives no rows, and other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            rows: list[list[float]] = []
            lo, n = 0, batch.num_rows
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP, side="right")) - 1)
                words, at = word_hashes(data, offsets[lo : hi + 1])
                kinds = _CLASS[data[offsets[lo] : offsets[hi]]]
                edges = offsets[lo : hi + 1] - offsets[lo]
                for i in range(hi - lo):
                    rows.append(_one(np.bincount(kinds[edges[i] : edges[i + 1]], minlength=9), words[at[i] : at[i + 1]]))
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>"))


@dataclass(frozen=True)
class QuadraticModel:
    """For each class: log prior minus half the log determinant, mean, and inverse Cholesky factor. ``constant`` where no classes could be learned."""

    bias: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constant: float | None = None


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.1, diagonal: float = 0.05) -> QuadraticModel:
    """Learn from the documents of ``stats`` that ``labels`` (doc_id, label) marks 0 or 1.

    Other labels and nulls teach nothing; a document marked several times
    counts each time. With rows of one class only, or none, the score is that
    class's smoothed frequency.
    """
    d = len(NAMES)
    marked = stats.join(labels.where(F.col("label").isin(0, 1)), "doc_id")
    x = [F.col("stats")[i] for i in range(d)]
    sums = [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(d)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]]
    rows = {r["label"]: r for r in marked.groupBy(F.col("label").cast("int").alias("label")).agg(*sums).collect()}
    n = np.array([rows[k]["n"] if k in rows else 0 for k in (0, 1)], dtype=float)
    if n.min() < 2:
        return QuadraticModel(np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d)), float((n[1] + 1) / (n.sum() + 2)))
    means = np.array([[rows[k][f"s{i}"] / n[k] for i in range(d)] for k in (0, 1)])
    scatter = np.zeros((2, d, d))
    for k in (0, 1):
        for i in range(d):
            for j in range(i, d):
                scatter[k, i, j] = scatter[k, j, i] = rows[k][f"p{i}_{j}"] - n[k] * means[k, i] * means[k, j]
    pooled = scatter.sum(axis=0) / n.sum()
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
    factors, bias = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - shrink) * scatter[k] / n[k] + shrink * pooled)
        factors[k] = np.linalg.inv(lower)
        bias[k] = np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum()
    return QuadraticModel(bias, means, factors)


def score(stats: Column, model: QuadraticModel) -> Column:
    """Probability of label 1."""
    if model.constant is not None:
        return F.when(stats.isNotNull(), F.lit(model.constant)).otherwise(F.lit(model.constant))

    @F.arrow_udf("double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            x = np.asarray(rows.flatten()).reshape(len(rows), len(NAMES))
            density = [model.bias[k] - 0.5 * (((x - model.means[k]) @ model.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
            yield pa.array(1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700))))

    return udf(stats)
