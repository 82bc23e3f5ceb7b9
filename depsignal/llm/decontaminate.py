"""Benchmark decontamination by SimHash windows of the items' own sizes.

A document is contaminated by an item if one of its windows of as many words
as the item has a weighted similarity of 0.75 or more with it: the sum over
five-word shingles of the smaller number of occurrences, divided by the sum of
the larger. A document shorter than the item is one window.

1. Only windows that hold a shingle of the benchmark can be similar at all, so
   windows are laid around such shingles: every start from which a window
   of an item's size covers one of the item's shingles.
2. Each window and item has a 64-bit SimHash, to which a shingle adds as often
   as it occurs. The items' fingerprints are indexed in RADIUS + 1 blocks of
   bits: two fingerprints within the radius agree in a block at least, so
   every item within the radius is found. Pairs beyond the radius are left.
3. The exact similarity of the remaining pairs decides.

At a similarity of 0.75 about 11 of 64 bits differ, with a deviation of 3; the
radius of 23 leaves a miss of about 3e-5 there and far less above.

Items travel to the tasks in parts of at most ITEM_BYTES of text; a larger
benchmark is worked off in several passes over the documents.

Defined cases: null texts and items match nothing; items or documents of fewer
than five words have their whole sequence as the one shingle and match only
the same sequence; an item with a null id is listed as null; equal items are
all listed; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsignal.llm.textarrays import shingles, slices, words

THRESHOLD = 0.75
RADIUS = 23
ITEM_BYTES = 16 << 20
_BITS = 64
_PROBE_BITS = 22


def fingerprints(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the windows of ``length`` shingles at the given starts."""
    low, high = int(starts.min()), int(starts.max()) + length
    bits = np.unpackbits(values[low:high].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((high - low + 1, _BITS), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = total[starts - low + length] - total[starts - low]
    return np.packbits(2 * ones > length, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingles; a shingle weighs as often as it occurs."""
    left, right = Counter(a.tolist()), Counter(b.tolist())
    common = sum((left & right).values())
    return common / (len(a) + len(b) - common) if common else 0.0


class HammingIndex:
    """Fingerprints by blocks of bits: all within ``radius`` of a query share a block with it."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        edges = np.arange(radius + 2) * _BITS // (radius + 1)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.tables: list[dict[int, np.ndarray]] = []
        for shift, mask in self.blocks:
            value = (prints >> shift) & mask
            self.tables.append({int(v): np.flatnonzero(value == v) for v in np.unique(value)})

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) with at most ``radius`` different bits."""
        hit = np.zeros((len(queries), len(self.prints)), bool)
        for (shift, mask), table in zip(self.blocks, self.tables, strict=True):
            value = (queries >> shift) & mask
            for v in np.unique(value):
                if (members := table.get(int(v))) is not None:
                    hit[np.ix_(value == v, members)] = True
        query, member = np.nonzero(hit)
        near = np.bitwise_count(queries[query] ^ self.prints[member]) <= self.radius
        return query[near], member[near]


class Items:
    """The items of one pass, by size."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        found = words(pa.array(texts, pa.string()))
        values, first = shingles(found)
        sizes = np.diff(first)
        self.ids = ids
        self.shingles = [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        #: items of each number of shingles, with their index
        self.by_size: dict[int, tuple[np.ndarray, HammingIndex]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            members = np.flatnonzero(sizes == size)
            prints = np.concatenate([fingerprints(self.shingles[m], np.zeros(1, np.int64), size) for m in members])
            self.by_size[size] = (members, HammingIndex(prints))
        # which item sizes hold a shingle
        owner = np.repeat(sizes, sizes)
        pairs = np.unique(np.stack([values, owner.astype(np.uint64)]), axis=1) if len(values) else np.zeros((2, 0), np.uint64)
        self.known, at = np.unique(pairs[0], return_index=True)
        self.sizes_of = np.split(pairs[1].astype(np.int64), at[1:])
        self.probe = np.zeros(1 << _PROBE_BITS, bool)
        self.probe[self.known >> np.uint64(64 - _PROBE_BITS)] = True

    def matches(self, values: np.ndarray) -> dict[int, float]:
        """Best similarity of each item that a document with these shingles holds."""
        best: dict[int, float] = {}
        maybe = np.flatnonzero(self.probe[values >> np.uint64(64 - _PROBE_BITS)])
        if not len(maybe):
            return best
        place = np.minimum(np.searchsorted(self.known, values[maybe]), len(self.known) - 1)
        real = self.known[place] == values[maybe]
        anchors: dict[int, list[int]] = {}
        for p, k in zip(maybe[real].tolist(), place[real].tolist(), strict=True):
            for size in self.sizes_of[k].tolist():
                anchors.setdefault(size, []).append(p)
        for size, held in anchors.items():
            length = min(size, len(values))
            starts = np.unique((np.array(held)[:, None] - np.arange(length)).ravel())
            starts = starts[(starts >= 0) & (starts <= len(values) - length)]
            members, index = self.by_size[size]
            # spans are cut where windows no longer meet, so that a long text is not summed between far windows
            for span in np.split(starts, np.flatnonzero(np.diff(starts) > length) + 1):
                window, member = index.within(fingerprints(values, span, length))
                for w, m in zip(span[window].tolist(), members[member].tolist(), strict=True):
                    score = similarity(values[w : w + length], self.shingles[m])
                    if score >= THRESHOLD and score > best.get(m, 0.0):
                        best[m] = score
        return best


def _parts(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The benchmark in parts of bounded size."""
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = int(total // ITEM_BYTES) + 1
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).collect() if total else []
        part.sort(key=lambda r: (r.id is None, r.id or 0, r.text))
        yield Items([r.id for r in part], [r.text for r in part])


def find_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """All columns, item_ids (those found, ascending), similarity (the best, else 0) and contaminated.

    One pass without a shuffle for each part of the benchmark.
    """
    taken = ("item_ids", "similarity", "contaminated")
    names = [c for c in docs.columns if c.lower() not in taken]
    place = [c.lower() for c in names].index(text.lower())
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    schema = f"{kinds}, item_ids array<long>, similarity double"
    out = docs.select(*[f"`{c}`" for c in names], F.expr("cast(array() as array<long>)").alias("item_ids"), F.lit(0.0).alias("similarity"))
    for part in _parts(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], part: Items = part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high in slices(batch.column(place)):
                    rows = batch.slice(low, high - low)
                    values, first = shingles(words(rows.column(place)))
                    found_ids, best = rows.column(len(names)).to_pylist(), rows.column(len(names) + 1).to_pylist()
                    # one look at all shingles tells the texts that can match at all
                    probe = np.concatenate([[0], np.cumsum(part.probe[values >> np.uint64(64 - _PROBE_BITS)])])
                    for i in np.flatnonzero(probe[first[1:]] > probe[first[:-1]]).tolist():
                        if hits := part.matches(values[first[i] : first[i + 1]]):
                            known = [*found_ids[i], *(part.ids[m] for m in hits)]
                            found_ids[i] = sorted(known, key=lambda x: (x is None, x or 0))
                            best[i] = max(best[i], *hits.values())
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns[: len(names)], pa.array(found_ids, pa.list_(pa.int64())), pa.array(best, pa.float64())],
                        names=[*names, "item_ids", "similarity"],
                    )

        out = out.mapInArrow(run, schema)
    return out.withColumn("contaminated", F.size("item_ids") > 0)
