"""Whole Arrow text columns as numpy arrays of words and shingles.

Words are runs of bytes other than blank and 0x09-0x0D, with A-Z lower-cased.
These bytes never occur inside a multi-byte character, so UTF-8 is cut right.
Every word and shingle is a 64-bit hash; equal hashes are taken as equal text,
which among n different words is wrong with a probability of n^2 / 2^65.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5
#: Text bytes that are turned into arrays at once; a longer text is taken whole.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C55
_RANDOM = np.random.Generator(np.random.PCG64(20240611))
#: Places in a word that have a table of their own; later ones are mixed with their number.
_PLACES = 64
_LOWERED = np.arange(256)
_LOWERED[65:91] = _LOWERED[97:123]
_EXACT_VALUE = _RANDOM.integers(1, 2**64 - 1, (_PLACES, 256), dtype=np.uint64)
_BYTE_VALUE = np.ascontiguousarray(_EXACT_VALUE[:, _LOWERED])
_STEP = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each span the sum of a random value for every byte and its place in the span.

    Values of different places have nothing in common, so no arrangement of the
    same bytes makes two sums equal but by chance.
    """
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    if not len(starts):
        return total[:0]
    # every byte belongs to the last span that begins at it or before; places are needed modulo _PLACES only
    reach = np.diff(starts, append=n)
    place = np.arange(n - starts[0], dtype=np.uint32).astype(np.uint8)
    place -= np.repeat((starts - starts[0]).astype(np.uint8), reach)
    place &= _PLACES - 1
    index = place.astype(np.uint16)
    index <<= 8
    index |= raw[starts[0] :]
    terms = values.ravel().take(index)
    for k in np.flatnonzero(ends - starts > _PLACES).tolist():
        low, high = starts[k] + _PLACES - starts[0], ends[k] - starts[0]
        rounds = np.arange(_PLACES, ends[k] - starts[k]) // _PLACES
        terms[low:high] = mix(terms[low:high] + rounds.astype(np.uint64) * np.uint64(_BASE))
    np.cumsum(terms, out=total[starts[0] + 1 :])
    return total[ends] - total[starts]


@dataclass
class Words:
    """The words of some texts: text i has words ``first[i]`` up to ``first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's offset in them; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES of text, or of one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


def words(column: pa.Array) -> Words:
    raw, offsets = column_bytes(column)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none)
    inside = ~_IS_BLANK[raw]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = mix(_sums(raw, starts, ends, _BYTE_VALUE))
    return Words(hashes, np.searchsorted(starts, offsets).astype(np.int64), starts, ends)


def combine(hashes: np.ndarray, count: int) -> np.ndarray:
    """The hash of every run of ``count`` words."""
    n = len(hashes) - count + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, count, np.uint64) * np.uint64(_BASE)
    for k in range(count):
        total += hashes[k : k + n] * _STEP[k]
    return mix(total)


def shingles(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """All shingles in order, and the first one of each text (one offset more than texts).

    A text of fewer words than a shingle has its whole sequence as the only one.
    """
    counts = np.diff(found.first)
    sizes = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(first[-1], np.uint64)
    runs = combine(found.hashes, SHINGLE_WORDS)
    long = counts >= SHINGLE_WORDS
    if long.any():
        text = np.repeat(np.flatnonzero(long), sizes[long])
        at = np.arange(len(text)) - np.repeat(np.cumsum(sizes[long]) - sizes[long], sizes[long])
        out[first[text] + at] = runs[found.first[text] + at]
    for count in range(1, SHINGLE_WORDS):
        short = np.flatnonzero(counts == count)
        if len(short):
            out[first[short]] = combine(found.hashes, count)[found.first[short]]
    return out, first


def distinct_sorted(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    return values, np.searchsorted(text, np.arange(len(first))).astype(np.int64)



def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each span, in exact spelling; spans of other flags differ.

    Spans are in order, and what stands between two is not longer than a byte.
    """
    return mix(_sums(raw, starts, ends, _EXACT_VALUE) + flag.astype(np.uint64) * np.uint64(_BASE))
