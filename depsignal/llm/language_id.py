"""Language identification by a byte convolutional network.

Filters of several widths slide over windows of WINDOW bytes; each filter's
largest answer in the window goes through a softmax layer. The network is
trained here in numpy, by Adam on windows of a bounded sample of labelled
texts. A document's windows together cover its whole text; its language is
the one with the largest mean log-probability over them.

A filter is a sum of one table per byte position. Two neighbouring positions
are joined into one table over byte pairs before prediction, so that a filter
of width 2 needs one look-up a byte, and one of width 3 or 4 two.

The sample: of each language the ``SAMPLE_PER_LANGUAGE`` labelled rows with the
smallest hash of their id and text, and of each such text up to
``WINDOWS_PER_TEXT`` windows spread over the whole of it. This bounds the data
on the driver, whatever the corpus.

The network must answer with a language it knows, also for a text in none of
them. ``predict`` can therefore also say how familiar a text is: the share of its groups of three
letters that the sample of its language holds, by a bit for each of 2^18 hashes
of groups. In held-out texts nearly all are known, of random letters or of other languages few.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any labelled row every text is; a label without a sample row cannot be
predicted; repeated rows get the same answer; input columns named lang_pred or
score are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsignal.llm.textarrays import column_bytes, slices

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 256
#: Neighbouring windows share this many bytes, so that no filter position is lost between them.
OVERLAP = max(WIDTHS) - 1
SAMPLE_PER_LANGUAGE = 600
WINDOWS_PER_TEXT = 4
EPOCHS, BATCH, RATE = 8, 64, 0.01
UNDETERMINED = "und"
#: Windows that are predicted at once.
_CHUNK = 1024
_LETTER = re.compile(r"[^\W\d_]")
#: Bits of the hash of a group of letters.
GROUP_BITS = 18
#: Letters in lower case; all other bytes below 128 are blanks.
_LETTERS = np.full(256, 32, np.uint8)
for _from, _to in ((97, 123), (128, 256)):
    _LETTERS[_from:_to] = np.arange(_from, _to)
_LETTERS[65:91] = _LETTERS[97:123]


@dataclass
class Network:
    """Filter tables by width (position, byte, filter) and the softmax layer."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    #: a row of packed bits for each language: the groups of letters in its sample
    seen: np.ndarray

    def paired(self) -> list[list[np.ndarray]]:
        """Tables by width, with positions joined two by two as (byte pair, filter)."""
        out = []
        for table in self.tables:
            width, joined = len(table), []
            for at in range(0, width - 1, 2):
                joined.append((table[at][:, None, :] + table[at + 1][None, :, :]).reshape(65536, -1).astype(np.float32))
            if width % 2:
                joined.append(table[-1].astype(np.float32))
            out.append(joined)
        return out


def _scores(windows: np.ndarray, paired: list[list[np.ndarray]], network: Network) -> np.ndarray:
    """Log-probabilities of each language for windows of bytes, a row each."""
    pair = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
    pooled = []
    for width, tables in zip(WIDTHS, paired, strict=True):
        n = windows.shape[1] - width + 1
        total = tables[0][pair[:, :n]]
        for k, table in enumerate(tables[1:], 1):
            at = 2 * k
            total += table[pair[:, at : at + n]] if len(table) == 65536 else table[windows[:, at : at + n]]
        pooled.append(total.max(1))
    hidden = np.maximum(np.concatenate(pooled, 1) + network.bias, 0)
    logits = hidden @ network.weights + network.offset
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def windows_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, filled up with zero bytes, and the text of each."""
    sizes = np.diff(offsets)
    step = WINDOW - OVERLAP
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // step)), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][text] + number * step
    place = start[:, None] + np.arange(WINDOW)
    inside = place < offsets[1:][text][:, None]
    return np.where(inside, raw[np.minimum(place, max(len(raw) - 1, 0))], 0).astype(np.uint8), text


def letter_groups(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the groups of three bytes around a letter in each text, and the text of each."""
    plain = _LETTERS[raw].astype(np.uint32)
    key = (((plain[:-2] << 16) | (plain[1:-1] << 8) | plain[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - GROUP_BITS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (plain[1:-1] != 32) & (text[:-2] == text[2:])
    return key[inside], text[:-2][inside]


def train(texts: list[str], languages: list[str], seed: int = 7) -> Network:
    """Fit the network on windows of the texts; the same input gives the same network."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    inputs, targets = [], []
    for text, language in zip(texts, languages, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        found, _ = windows_of(raw, np.array([0, len(raw)]))
        if len(found):
            found = found[np.unique(np.linspace(0, len(found) - 1, WINDOWS_PER_TEXT).astype(int))]
            inputs.append(found)
            targets += [names.index(language)] * len(found)
    x, y = np.concatenate(inputs), np.array(targets)
    seen = np.zeros((len(names), 1 << GROUP_BITS), bool)
    for text, language in zip(texts, languages, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        seen[names.index(language), letter_groups(raw, np.array([0, len(raw)]))[0]] = True
    hidden = FILTERS * len(WIDTHS)
    parameters = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS]
    parameters += [np.zeros(hidden), rng.normal(0, 0.3, (hidden, len(names))), np.zeros(len(names))]
    first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            step += 1
            for k, slope in enumerate(_slopes(parameters, x[rows], y[rows])):
                first[k] += 0.1 * (slope - first[k])
                second[k] += 0.001 * (slope**2 - second[k])
                parameters[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    *tables, bias, weights, offset = parameters
    return Network(names, tables, bias, weights, offset, np.packbits(seen, axis=1))


def _slopes(parameters: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Slopes of the mean cross-entropy; only each filter's largest answer passes one back."""
    *tables, bias, weights, offset = parameters
    n, pooled, best = len(x), [], []
    for table in tables:
        width, count = len(table), x.shape[1] - len(table) + 1
        total = sum(table[k][x[:, k : k + count]] for k in range(width))
        best.append(total.argmax(1))
        pooled.append(total.max(1))
    raw = np.concatenate(pooled, 1) + bias
    hidden = np.maximum(raw, 0)
    logits = hidden @ weights + offset
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(n), y] -= 1
    p /= n
    back = (p @ weights.T) * (raw > 0)
    slopes, rows, filters = [], np.arange(n)[:, None], np.arange(FILTERS)
    for k, table in enumerate(tables):
        slope = np.zeros_like(table)
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        for position in range(len(table)):
            np.add.at(slope[position], (x[rows, best[k] + position], np.broadcast_to(filters, part.shape)), part)
        slopes.append(slope)
    return [*slopes, back.sum(0), hidden.T @ p, p.sum(0)]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network | None:
    """Train on the bounded sample of the rows that have a text and a label; None if there are none."""
    rows = docs.select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(doc_id).cast("string").alias("id")
    ).filter("text is not null and lang is not null and length(text) > 0")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.substring("text", 1, 64)), "id")
    sample = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_PER_LANGUAGE)
    # a training text of many windows is thinned here, so that very long ones don't reach the driver
    step = F.greatest(F.floor(F.length("text") / WINDOWS_PER_TEXT), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_TEXT - 1)), lambda k: F.substring(F.col("text"), (k * step + 1).cast("int"), F.lit(WINDOW)))
    thinned = F.when(F.length("text") > WINDOWS_PER_TEXT * WINDOW, F.array_join(parts, " ")).otherwise(F.col("text"))
    found = sorted(sample.select("lang", thinned.alias("text")).collect(), key=lambda r: (r.lang, r.text))
    return train([r.text for r in found], [r.lang for r in found]) if found else None


def predicted(column: pa.Array, network: Network | None, paired: list[list[np.ndarray]]) -> tuple[list[str], list[float]]:
    texts = column.to_pylist()
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
    if network is None or not lettered.any():
        return names, scores
    raw, offsets = column_bytes(column)
    windows, text = windows_of(raw, offsets)
    total = np.zeros((len(texts), len(network.languages)))
    for at in range(0, len(windows), _CHUNK):
        np.add.at(total, text[at : at + _CHUNK], _scores(windows[at : at + _CHUNK], paired, network))
    mean = total / np.maximum(np.bincount(text, minlength=len(texts)), 1)[:, None]
    share = np.exp(mean - mean.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    for i in np.flatnonzero(lettered).tolist():
        best = int(share[i].argmax())
        names[i], scores[i] = network.languages[best], float(share[i, best])
    return names, scores


def familiarity(column: pa.Array, languages: list[str], network: Network | None) -> np.ndarray:
    """The share of known groups of letters of each text in its language; 1 where there are none to judge, 0 where no language is."""
    found = np.array([network.languages.index(x) if network is not None and x != UNDETERMINED else -1 for x in languages], int)
    if network is None:
        return np.zeros(len(found))
    key, text = letter_groups(*column_bytes(column))
    known = (network.seen[found[text], key >> 3] >> (7 - (key & 7)).astype(np.uint8)) & 1
    count = np.bincount(text, minlength=len(found))
    share = np.bincount(text, known, len(found)) / np.maximum(count, 1)
    return np.where(found < 0, 0.0, np.where(count > 0, share, 1.0))


def predict(docs: DataFrame, network: Network | None, text: str = "text", familiar: str | None = None) -> DataFrame:
    """All columns, lang_pred and score, and under the name ``familiar`` how familiar the text is.

    One pass without a shuffle; the network has well under a megabyte, and 32 KB for each language.
    """
    added = ["lang_pred", "score", *([familiar] if familiar else [])]
    names = [c for c in docs.columns if c.lower() not in added]
    place = [c.lower() for c in names].index(text.lower())
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paired = network.paired() if network is not None else []
        for batch in batches:
            for low, high in slices(batch.column(place)):
                part = batch.slice(low, high - low)
                found, scores = predicted(part.column(place), network, paired)
                columns = [*part.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())]
                if familiar:
                    columns.append(pa.array(familiarity(part.column(place), found, network)))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    schema = f"{kinds}, lang_pred string, score double" + (f", `{familiar}` double" if familiar else "")
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)


def fold(doc_id: str, parts: int) -> Column:
    """The remainder of the crc32 of the id as text, by which rows are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))
