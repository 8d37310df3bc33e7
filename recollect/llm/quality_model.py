"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (lengths, shares of byte classes, repetition, common words) are binned by
quantiles; complete trees of fixed depth are grown level by level from gradient histograms with the logistic
loss. A grown forest is a few flat arrays (feature, threshold, leaf value), and a text walks all levels by
array arithmetic: ``node = 2 * node + 1 + (x[feature[node]] > threshold[node])``.

It is fitted on a bounded sample of labelled rows, weighted back to the classes' true shares. Null texts count as
empty and get a score like any other; without labels of both classes every score is the share of class 1,
or 0.5. Texts count whole, however long. Repeated rows are scored alike, ties between cuts go to the first statistic and least cut; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, steps, table
from .quality_rules import CLASSES, common_hashes, features

#: Labelled documents a class that the trees are fitted on, at most.
SAMPLE_PER_CLASS = 3000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 60, 4, 64, 0.15, 1.0, 5.0


def statistics(texts: list[str], common: np.ndarray) -> np.ndarray:
    """One row of document statistics per text."""
    f = features(texts, common)
    words = np.maximum(f["n_words"], 1)
    chars = np.maximum(f["classes"].sum(1), 1)
    hits = f["words"][:, :-1]
    lines = np.array([t.count("\n") + 1 for t in texts])
    return np.column_stack([
        np.log1p(f["n_words"]), f["word_chars"] / words, f["n_symbols"] / words, f["n_dup_lines"] / lines, f["n_repeat_words"] / words,
        words / lines, hits.sum(1) / words, (hits > 0).sum(1) / np.sqrt(words), hits.max(1) / words, f["classes"] / chars[:, None],
    ])


class Forest:
    """Complete trees as arrays: inner nodes (feature, threshold) and leaf values."""

    def __init__(self, prior: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.prior, self.feature, self.threshold, self.value = prior, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Forest:
    """Fit to rows x with labels y (0 or 1) and weights w."""
    share = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    trees: tuple[list, list, list] = ([], [], [])
    if len(np.unique(y)) == 2:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])  # x > cut k <=> bin > k
        out = np.full(len(y), prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-out))
            g, h = w * (p - y), w * p * (1 - p)
            feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                at = node - first
                best = np.full(width, 1e-9)
                cut_bin = np.full(width, BINS)
                for j, c in enumerate(cuts):
                    key = at * BINS + bins[:, j]
                    hist = [np.bincount(key, weights=v, minlength=width * BINS).reshape(width, BINS) for v in (g, h, w)]
                    left = [np.cumsum(v, 1)[:, :-1] for v in hist]
                    total = [v.sum(1, keepdims=True) for v in hist]
                    right = [t - v for t, v in zip(total, left, strict=True)]
                    gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
                    gain[(left[2] < LEAST) | (right[2] < LEAST)] = -1
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    for n in np.flatnonzero((top > best) & (k < len(c))):
                        best[n], feature[first + n], threshold[first + n], cut_bin[n] = top[n], j, c[k[n]], k[n]
                node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut_bin[at])
            leaf = node - inner
            value = -RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + RIDGE)
            out += value[leaf]
            for part, a in zip(trees, (feature, threshold, value), strict=True):
                part.append(a)
    return Forest(prior, *(np.array(a).reshape(len(a), n) for a, n in zip(trees, (inner, inner, leaves), strict=True)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Forest:
    """Statistics are taken where the texts lie; the driver gets ``9 + CLASSES`` numbers of each sampled document."""

    def reduce(texts: list[str]) -> list[list[float]]:
        return statistics(texts, common_hashes()).tolist()

    sample, counts = labelled_sample(docs, labels, label, per_class, reduce, "array<double>", id_col, text_col)
    rows = sorted((r["id"], r["label"], r["x"]) for r in sample.collect())
    x = np.array([r[2] for r in rows], np.float64).reshape(len(rows), 9 + CLASSES)
    y = np.array([r[1] for r in rows], np.int64)
    got = np.bincount(y, minlength=2)
    w = np.array([counts.get(c, 0) / max(got[c], 1) for c in (0, 1)])[y] if len(y) else np.zeros(0)
    return grow(x, y, w / max(w.mean(), 1e-9) if len(w) else w)


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row per row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = common_hashes()
        for batch, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(statistics(texts, common)))], names=[id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 3) == 1
    forest = fit(docs, labels.where(~held))
    return score(docs, forest).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
