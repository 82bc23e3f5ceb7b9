"""Quality score by histogram gradient-boosted trees over document statistics.

The statistics are shares and ratios of the whole text, computed over Arrow
batches in numpy. The trees are grown level by level from histograms of
gradients over quantile bins, and kept as flat arrays of a full binary tree,
so a batch of documents walks all trees in DEPTH array steps.

The sample: of each label the ``SAMPLE_PER_LABEL`` ids with the smallest hash.
Only their statistics reach the driver, whatever the corpus.

Defined cases: a null or empty text has statistics of zero and a score as any
other; several labels of one id count as their smallest; null labels and ids are
no examples; without examples the score is 0.5, with one label only its share;
repeated rows get the same score; an input column named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depsignal.llm.textarrays import column_bytes, shingles, slices, words

SAMPLE_PER_LABEL = 4000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
#: Least sum of second derivatives in a leaf, and weight of the penalty on leaf values.
LEAST_WEIGHT, PENALTY = 2.0, 1.0

#: Byte classes whose share of the text is a statistic.
_CLASSES = {
    "symbols": b"#*$%&|<>",
    "bars": b"|",
    "bangs": b"!?",
    "stops": b".,;:",
    "capitals": bytes(range(65, 91)),
    "digits": bytes(range(48, 58)),
    "line_ends": b"\n",
    "wide": bytes(range(128, 256)),
    "marks": b"@_=~^\\/{}[]()\"'+-",
}
_LOOKUP = np.stack([np.isin(np.arange(256), list(group)) for group in _CLASSES.values()], axis=1)

STATISTICS = [
    *_CLASSES, "log_words", "word_bytes", "longest_word", "distinct_words", "distinct_shingles", "distinct_lines", "line_words",
]


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of different values of each text; sorts the values of each in place."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), np.int64)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][first[:-1] < len(values)]] = 1
    return np.diff(np.concatenate([[0], np.cumsum(new)])[first])


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    raw, offsets = column_bytes(column)
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((len(column), len(STATISTICS)))
    for k in range(len(_CLASSES)):
        seen = np.concatenate([[0], np.cumsum(_LOOKUP[:, k][raw])])
        out[:, k] = (seen[offsets[1:]] - seen[offsets[:-1]]) / size
    found = words(column)
    first, count = found.first, np.diff(found.first)
    some = np.maximum(count, 1)
    lengths = found.ends - found.starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    k = len(_CLASSES)
    out[:, k] = np.log1p(count)
    out[:, k + 1] = (total[first[1:]] - total[first[:-1]]) / some
    full = np.flatnonzero(count)
    if len(full):
        out[full, k + 2] = np.maximum.reduceat(lengths, first[:-1][full])
    runs, run_first = shingles(found)
    out[:, k + 3] = _distinct(found.hashes.copy(), first) / some
    out[:, k + 4] = _distinct(runs, run_first) / np.maximum(np.diff(run_first), 1)
    lines, line_first = _line_keys(found, raw, offsets)
    out[:, k + 5] = _distinct(lines, line_first) / np.maximum(np.diff(line_first), 1)
    out[:, k + 6] = count / np.maximum(np.diff(line_first), 1)
    return out


def _line_keys(found, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of the words of each line that has some, and the first line of each text."""
    if not len(found.starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    line = np.cumsum(raw == 10)[found.starts]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
    begins = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])]))
    weight = np.arange(len(line)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(line)]])))
    keys = np.add.reduceat(found.hashes * (2 * weight.astype(np.uint64) + np.uint64(1)), begins)
    return keys, np.searchsorted(text[begins], np.arange(len(offsets)))


@dataclass
class Forest:
    """Trees as arrays (tree, inner node) of statistic and threshold, and (tree, leaf) of values."""

    base: float
    statistic: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees = len(self.statistic)
        node = np.zeros((len(x), trees), np.int64)
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.statistic[tree, node]] > self.threshold[tree, node])
        margin = self.base + self.value[tree, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost trees on the logistic loss; the same input gives the same forest."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    statistic, threshold, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    if len(set(y.tolist())) < 2:
        return Forest(base, statistic, threshold, value)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    margin = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            local = node - first
            best = np.full(count, 1e-6)
            pick, at = np.zeros(count, np.int64), np.full(count, BINS)
            g_all, h_all = np.bincount(local, slope, count), np.bincount(local, curve, count)
            whole = g_all**2 / (h_all + PENALTY)
            for k in range(width):
                key = local * BINS + binned[:, k]
                g = np.bincount(key, slope, count * BINS).reshape(count, BINS).cumsum(1)[:, :-1]
                h = np.bincount(key, curve, count * BINS).reshape(count, BINS).cumsum(1)[:, :-1]
                rest_g, rest_h = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + PENALTY) + rest_g**2 / (rest_h + PENALTY) - whole[:, None]
                gain[(h < LEAST_WEIGHT) | (rest_h < LEAST_WEIGHT)] = -np.inf
                top = gain.argmax(1)
                high = gain[np.arange(count), top]
                better = high > best
                best[better], pick[better], at[better] = high[better], k, top[better]
            for m in np.flatnonzero(at < BINS).tolist():
                statistic[t, first + m], threshold[t, first + m] = pick[m], cuts[pick[m]][min(at[m], len(cuts[pick[m]]) - 1)]
            node = 2 * node + 1 + (x[np.arange(n), statistic[t, node]] > threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        value[t] = RATE * g / (h + PENALTY)
        margin += value[t][leaf]
    return Forest(base, statistic, threshold, value)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Forest:
    """Grow the forest from the bounded sample of labelled documents."""
    one = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .filter("id is not null and label is not null")
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    sample = one.withColumn("place", place).filter(F.col("place") <= SAMPLE_PER_LABEL).select("id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.slice(low, high - low)
                values = statistics(part.column(2))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "label", "x"])

    # at most SAMPLE_PER_LABEL rows for each of the labels, so this side may be sent to all tasks
    joined = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "id")
    rows = joined.select(F.col("id").cast("long").alias("id"), "label", "text").mapInArrow(run, "id long, label int, x array<double>")
    found = sorted(rows.dropDuplicates(["id"]).collect(), key=lambda r: r.id)
    return grow(np.array([r.x for r in found]).reshape(len(found), len(STATISTICS)), np.array([float(r.label) for r in found]))


def score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """All columns and the score. One pass without a shuffle."""
    names = [c for c in docs.columns if c.lower() != "score"]
    place = [c.lower() for c in names].index(text.lower())
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(place)):
                part = batch.slice(low, high - low)
                found = forest.score(statistics(part.column(place)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*names, "score"])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{kinds}, score double")
