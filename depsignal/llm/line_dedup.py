"""Recurring lines by a log-template tree.

The tree has a fixed depth: token count, then the first LEADING tokens. A
token with a digit, ``@`` or ``://`` is a variable field and stands for any
other. A leaf holds templates: a line's whole token sequence, and for lines of
at least GENERAL tokens also the sequence with one of its four quarters left
free, so that lines which agree in the other three meet in one template.

A template found in enough rows recurs: ``min_docs``, or ``short_docs`` for
lines of fewer than ``min_tokens`` tokens, which also meet by chance, or
``long_docs`` for lines of LONG_TOKENS tokens or more, which do not. A template
with a free quarter needs ``min_docs`` at any length. A line
with a recurring template is dropped, but for the row with the smallest id that
has this template; of lines that agree but for a quarter, that quarter goes with them. Blank lines are
kept. A limit of None exempts the short lines, or counts the long ones as others.
In a line of fewer than MIN_TOKENS tokens no token is a variable field.

Tokens are runs of characters other than blank and 0x09-0x0D, A-Z lower-cased.
Leaves met in fewer rows than that cannot hold a recurring template
and are pruned before any template is made. Keys are only counted and
minimised, so a hot line is pre-aggregated by task.

Defined cases: a null text stays null with no lines; a null id counts as the
largest; rows that repeat an id count each and get the same decision; an input
column named n_lines or n_dropped is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsignal.llm import textarrays
from depsignal.llm.storage import written

LEADING = 3
QUARTERS = 4
GENERAL = 8
MIN_DOCS, MIN_TOKENS = 10, 5
SHORT_DOCS = 30
LONG_DOCS, LONG_TOKENS = 2, 20

_VARIABLE = np.uint64(0x5851F42D4C957F2D)
_LAST_ID = 2**63 - 1
_SALT = np.random.Generator(np.random.PCG64(31)).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Lines:
    """Lines of some texts; ``text`` is the index of each line's text, keys are per line."""

    text: np.ndarray
    tokens: np.ndarray
    leaf: np.ndarray
    whole: np.ndarray
    general: np.ndarray


def _cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every line as a text of its own, and the text it belongs to."""
    raw, offsets = textarrays.column_bytes(column)
    breaks = np.flatnonzero(raw == 10) + 1
    # each text begins a line and so does what follows a line end
    begin = np.concatenate([offsets[:-1], breaks])
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks - 1, "right") - 1])
    order = np.lexsort((begin, text))
    begin, text = begin[order], text[order]
    places = np.concatenate([begin, [len(raw)]]).astype(np.int64)
    data = pa.py_buffer(np.ascontiguousarray(raw))
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(places), data), text


def parse(column: pa.Array) -> Lines:
    """Tree path and template keys of every line of the texts."""
    lines, text = _cut(column)
    found = textarrays.words(lines)
    raw, _ = textarrays.column_bytes(lines)
    flags = ((raw >= 48) & (raw <= 57)) | (raw == 64)
    if len(raw) > 2:
        flags[:-2] |= (raw[:-2] == 58) & (raw[1:-1] == 47) & (raw[2:] == 47)
    seen = np.concatenate([[0], np.cumsum(flags)])
    first, count = found.first[:-1], np.diff(found.first)
    variable = (seen[found.ends] > seen[found.starts]) & np.repeat(count >= MIN_TOKENS, count)
    hashes = np.where(variable, _VARIABLE, found.hashes)

    place = (np.arange(len(hashes)) - np.repeat(first, count)).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textarrays.mix(hashes + place * _SALT[2]))])
    part = lambda a, b: textarrays.mix(total[b] - total[a])

    size = count.astype(np.uint64)
    leaf = textarrays.mix(part(first, first + np.minimum(count, LEADING)) ^ (size * _SALT[0]))
    whole = textarrays.mix(part(first, first + count) * _SALT[1] + leaf)
    cuts = [first + count * k // QUARTERS for k in range(QUARTERS + 1)]
    quarters = [part(cuts[k], cuts[k + 1]) * _SALT[4 + k] for k in range(QUARTERS)]
    everything = np.sum(quarters, axis=0, dtype=np.uint64)
    general = np.stack([textarrays.mix((everything - q) ^ (leaf * _SALT[10 + k])) for k, q in enumerate(quarters)], axis=1)
    return Lines(text, count, leaf, whole, general)


@dataclass(frozen=True)
class Limits:
    """How many rows make a template recur, by the tokens of its line; 0: never."""

    min_docs: int = MIN_DOCS
    min_tokens: int = MIN_TOKENS
    short_docs: int | None = SHORT_DOCS
    long_docs: int | None = LONG_DOCS

    def of(self, tokens: np.ndarray) -> np.ndarray:
        least = np.where(tokens < self.min_tokens, self.short_docs or 0, self.min_docs)
        if self.long_docs is not None:
            least = np.where(tokens >= max(LONG_TOKENS, self.min_tokens), self.long_docs, least)
        return np.where(tokens > 0, least, 0).astype(np.int32)


def _leaves(docs: DataFrame, limits: Limits) -> DataFrame:
    """Each leaf once for every row that has it, with the rows that it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in textarrays.slices(batch.column(0)):
                lines = parse(batch.column(0).slice(low, high - low))
                least = limits.of(lines.tokens)
                used = np.flatnonzero(least)
                used = used[_first_of_text(lines.leaf[used], lines.text[used])]
                yield pa.RecordBatch.from_arrays([pa.array(lines.leaf[used].view(np.int64)), pa.array(least[used])], names=["leaf", "least"])

    return docs.select("text").mapInArrow(run, "leaf long, least int")


def _templates(docs: DataFrame, limits: Limits) -> DataFrame:
    """(doc, leaf, least, line, general, fresh) of each different line of every row.

    ``fresh`` marks the general templates that no earlier line of the row has, so that a row counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in textarrays.slices(batch.column(1)):
                lines = parse(batch.column(1).slice(low, high - low))
                doc = batch.column(0).slice(low, high - low).to_numpy(zero_copy_only=False)
                least = limits.of(lines.tokens)
                used = np.flatnonzero(least)
                at = used[_first_of_text(lines.whole[used], lines.text[used])]
                wide = lines.tokens[at] >= GENERAL
                ends = np.concatenate([[0], np.cumsum(np.where(wide, QUARTERS, 0))]).astype(np.int32)
                general = lines.general[at][wide].ravel()
                fresh = _first_of_text(general, np.repeat(lines.text[at][wide], QUARTERS))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[lines.text[at]]),
                        pa.array(lines.leaf[at].view(np.int64)),
                        pa.array(least[at]),
                        pa.array(lines.whole[at].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(general.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(fresh)),
                    ],
                    names=["doc", "leaf", "least", "line", "general", "fresh"],
                )

    return docs.select("doc", "text").mapInArrow(run, "doc long, leaf long, least int, line long, general array<long>, fresh array<boolean>")


def _first_of_text(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its value in its text."""
    order = np.lexsort((keys, text))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (text[order][1:] != text[order][:-1])
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def recurring(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc, lines): the keys of the lines to drop for each id. ``docs`` has the columns doc and text."""
    busy = _leaves(docs, limits).groupBy("leaf", "least").count().filter("count >= least").select("leaf")
    lines = _templates(docs, limits).join(busy, "leaf", "left_semi")
    own = F.struct(F.col("line").alias("template"), F.lit(True).alias("fresh"), "least")
    pairs = F.arrays_zip(F.col("general").alias("template"), F.col("fresh"))
    wider = F.transform(pairs, lambda k: F.struct(k["template"].alias("template"), k["fresh"].alias("fresh"), F.lit(limits.min_docs).alias("least")))
    keys = written(lines.select("doc", "line", F.explode(F.concat(F.array(own), wider)).alias("key")).select("doc", "line", "key.*"), "templates")
    found = (
        keys.groupBy("template", "least")
        .agg(F.count_if("fresh").alias("rows"), F.min("doc").alias("first_doc"))
        .filter("rows >= least")
    )
    return (
        keys.join(found.select("template", "first_doc"), "template")
        .filter("doc <> first_doc")
        .groupBy("doc")
        .agg(F.collect_set("line").alias("lines"))
    )


def drop_recurring(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    short_docs: int | None = SHORT_DOCS,
    long_docs: int | None = LONG_DOCS,
) -> DataFrame:
    """All columns with the recurring lines taken out of the text, and the numbers n_lines and n_dropped."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST_ID))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    inner = [f"c{k}" for k in range(len(names))]
    marked = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)], key.alias("doc"))
    gone = recurring(docs.select(key.alias("doc"), F.col(text).cast("string").alias("text")), Limits(min_docs, min_tokens, short_docs, long_docs))
    joined = marked.join(gone, "doc", "left").select(*inner, "lines")
    place = [c.lower() for c in names].index(text.lower())
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in textarrays.slices(batch.column(place)):
                part = batch.slice(low, high - low)
                texts, n_lines, n_dropped = _without(part.column(place), part.column(len(names)))
                columns = [texts if k == place else c for k, c in enumerate(part.columns[: len(names)])]
                yield pa.RecordBatch.from_arrays([*columns, n_lines, n_dropped], names=[*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, f"{schema}, n_lines long, n_dropped long")


def _without(column: pa.Array, gone: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Texts without their dropped lines; the line ends of the others stay as they were."""
    lines = parse(column)
    keys, first = lines.whole.view(np.int64), np.searchsorted(lines.text, np.arange(len(column) + 1))
    out, dropped = column.to_pylist(), np.zeros(len(column), np.int64)
    for i, drop in enumerate(gone.to_pylist()):
        if drop:
            stay = ~np.isin(keys[first[i] : first[i + 1]], drop)
            dropped[i] = (~stay).sum()
            if dropped[i]:
                out[i] = "\n".join(line for line, keep in zip(out[i].split("\n"), stay, strict=True) if keep)
    counts = np.where(np.array(column.is_null()), 0, np.diff(first))
    return pa.array(out, column.type), pa.array(counts), pa.array(dropped)
