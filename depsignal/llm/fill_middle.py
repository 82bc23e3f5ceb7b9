"""Fill-in-middle: texts cut in three at line ends and written in another order, as streams of pieces.

Method: secondary-sort assembly. Every text becomes pieces of whole lines
(units), keyed by document and by the place they take in the output. One
exchange on the key brings them to a task and a sort inside the partition
(``repartition`` with ``sortWithinPartitions``) puts them in order, so that each
task feeds an incremental digest and holds one piece at a time, however long a
document is. The output pieces are then read for their sentinels, get their
place in the original and are sorted once more in the same partition, which
restores the text.

Defined cases: a null text is an empty one; a null id is hashed as an empty
name. Rows that repeat an id and a text each give their row; rows that repeat
an id with other texts are kept apart. Columns other than id and text are not
read, so their names cannot clash. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depsignal.llm.storage import width

#: Sentinels of the three parts (fixed values).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: The order in which the parts stand in the output of each form, and where each belongs in the text.
ORDER = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}
BELONGS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: A piece holds units up to so many bytes; a longer unit is cut between characters.
PIECE_BYTES = 1 << 16
#: Place of the row that closes a document; parts are laid 2^40 places apart.
LAST = 1 << 62
PART_PLACES = 1 << 40

_DRAWS = ("h1", "h2", "h3", "h4")
_KEY = ("doc_id", "mark", "part")
_FACTS = ("n", "form", "prefix_chars", "middle_chars")


def _schema(kind: T.DataType, *more: T.StructField) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("mark", T.BinaryType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            *more,
        ]
    )


def _with_piece(kind: T.DataType, *more: T.StructField) -> T.StructType:
    return _schema(kind, T.StructField("place", T.LongType()), T.StructField("piece", T.StringType()), *more)


def cuts(raw: bytes, from_: int, to: int, ends: np.ndarray) -> Iterator[bytes]:
    """The bytes between two places as pieces that end with a unit, at least one; ``ends`` are the places after newlines."""
    if from_ >= to:
        yield b""
    while from_ < to:
        stop = min(from_ + PIECE_BYTES, to)
        if stop < to:
            k = int(np.searchsorted(ends, stop, "right")) - 1
            if k >= 0 and ends[k] > from_:
                stop = int(ends[k])
            else:
                while raw[stop] & 0xC0 == 0x80:
                    stop -= 1
        yield raw[from_:stop]
        from_ = stop


def _length(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    values = np.frombuffer(raw, np.uint8)
    return len(raw) - int(np.count_nonzero(values & 0xC0 == 0x80))


def arrange(raw: bytes, draws: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple[tuple, Iterator[bytes]]:
    """(n, form, prefix_chars, middle_chars) and the output pieces in order."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    n = len(ends) + (len(raw) > 0 and raw[-1] != 10)
    h1, h2, h3, h4 = draws
    if not raw or any(s in raw for s in SENTINELS) or h3 % 100 >= rate:
        return (n, PLAIN, None, None), cuts(raw, 0, len(raw), ends)
    place = lambda units: 0 if not units else int(ends[units - 1]) if units <= len(ends) else len(raw)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = place(first), place(second)
    spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(raw))}
    form = SPM if h4 % 100 < spm_rate else PSM

    def output():
        for sentinel in ORDER[form]:
            lead = sentinel
            for piece in cuts(raw, *spans[sentinel], ends):
                yield lead + piece
                lead = b""

    return (n, form, _length(raw[:a]), _length(raw[a:b])), output()


def _cutter(rate: int, spm_rate: int, schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, size = [[] for _ in schema], 0
            keys = zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True)
            draws = zip(*(batch.column(c).to_pylist() for c in _DRAWS), strict=True)
            for key, draw, text in zip(keys, draws, batch.column("text").cast(pa.large_binary()), strict=True):
                facts, pieces = arrange(text.as_py(), draw, rate, spm_rate)
                for place, piece in enumerate(pieces):
                    for column, value in zip(columns, (*key, *facts, place, piece), strict=True):
                        column.append(value)
                    size += len(piece)
                    if size > 1 << 24:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                        columns, size = [[] for _ in schema], 0
            if columns[0]:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return cut


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """The output of every document as pieces: joined by ``place`` they are the output text.

    A row has the key (doc_id, mark, part), n units, form, prefix_chars and
    middle_chars of its document, its place and the piece. ``rate`` of 100 texts
    are rearranged and ``spm_rate`` of 100 of those are of form spm. The key
    holds the map partition, so copies of one row spread over tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.md5(body)).alias("mark"),
        F.spark_partition_id().alias("part"),
        *[F.conv(F.substr(hashed, F.lit(1 + 8 * k), F.lit(8)), 16, 10).cast("long").alias(h) for k, h in enumerate(_DRAWS)],
        body.alias("text"),
    )
    schema = _with_piece(docs.schema[doc_id].dataType)
    return rows.mapInArrow(_cutter(rate, spm_rate, to_arrow_schema(schema)), schema)


class _Sentinels:
    """Strips the sentinels from output pieces in order and says where each rest belongs in the text."""

    def __init__(self, form: str):
        self.wanted = list(ORDER.get(form, ()))
        self.at = 0

    def take(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        # the writer never splits a sentinel over two pieces
        while self.wanted and self.wanted[0] in piece:
            sentinel = self.wanted.pop(0)
            before, _, piece = piece.partition(sentinel)
            if before:
                yield self._next(), before
            self.at = BELONGS[sentinel] * PART_PLACES
        if piece:
            yield self._next(), piece

    def _next(self) -> int:
        self.at += 1
        return self.at


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple, int, bytes | None, dict]]:
    """Rows of a sorted partition as (key, facts, place, bytes, other columns)."""
    for batch in batches:
        data = batch.column("piece").cast(pa.binary()).to_pylist()
        place = batch.column("place").to_pylist()
        key = zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True)
        facts = zip(*(batch.column(c).to_pylist() for c in _FACTS), strict=True)
        more = batch.select([c for c in batch.schema.names if c in ("output_sha256", "copies")]).to_pylist()
        yield from zip(key, facts, place, data, more or [{}] * len(data), strict=True)


def _rows_out(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of at most 10,000 rows or about 16 MB."""
    columns, size = [[] for _ in schema], 0
    for row in rows:
        for column, value in zip(columns, row, strict=True):
            column.append(value)
            size += len(value) if isinstance(value, bytes) else 16
        if len(columns[0]) >= 10_000 or size > 1 << 24:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            columns, size = [[] for _ in schema], 0
    if columns[0]:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _read_output(schema: pa.Schema):
    """Output pieces in order to pieces of the text and one closing row with the digest of the output."""

    def rows(batches):
        last, facts, digest, reader, copies, at = None, (), None, None, 0, -1
        for key, these, place, piece, _ in _documents(batches):
            if key != last:
                if last is not None:
                    yield (*last, *facts, LAST, None, digest.hexdigest(), copies)
                last, facts, digest, reader, copies, at = key, these, hashlib.sha256(), _Sentinels(these[1]), 0, -1
            if place == 0:
                copies += 1
            if place == at:
                continue  # the same piece of a repeated row
            at = place
            digest.update(piece)
            for belongs, part in reader.take(piece):
                yield (*key, *facts, belongs, part, None, None)
        if last is not None:
            yield (*last, *facts, LAST, None, digest.hexdigest(), copies)

    return lambda batches: _rows_out(rows(batches), schema)


def _read_text(schema: pa.Schema, whole: bool):
    """Pieces of the text in order to one row for each document, or for each repeated row."""

    def rows(batches):
        digest, held = hashlib.sha256(), []
        for key, facts, place, piece, more in _documents(batches):
            if place != LAST:
                digest.update(piece)
                if whole:
                    held.append(piece)
                continue
            found = (key[0], *facts, more["output_sha256"], digest.hexdigest())
            for _ in range(more["copies"]):
                yield (*found, b"".join(held)) if whole else found
            digest, held = hashlib.sha256(), []

    return lambda batches: _rows_out(rows(batches), schema)


def restore(found: DataFrame, whole: bool = False) -> DataFrame:
    """One row per document from its output pieces: the facts, the digest of the output and that of the restored text.

    ``whole`` adds the restored text itself, for which a task holds one document.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = found.schema["doc_id"].dataType
    dealt = found.repartition(width(found.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "place")
    parts = _with_piece(kind, T.StructField("output_sha256", T.StringType()), T.StructField("copies", T.LongType()))
    again = dealt.mapInArrow(_read_output(to_arrow_schema(parts)), parts).sortWithinPartitions(*_KEY, "place")
    shape = T.StructType([f for f in _schema(kind) if f.name not in ("mark", "part")])
    shape = shape.add("output_sha256", "string").add("restored_sha256", "string")
    if whole:
        shape = shape.add("text", "string")
    return again.mapInArrow(_read_text(to_arrow_schema(shape), whole), shape)


def outputs(found: DataFrame) -> DataFrame:
    """One row per document with its whole output text, which a task must be able to hold.

    A row that is repeated within one map partition gives one output row here.
    """
    gathered = found.groupBy(*_KEY, *_FACTS).agg(F.sort_array(F.collect_set(F.struct("place", "piece"))).alias("_pieces"))
    return gathered.select("doc_id", *_FACTS, F.array_join("_pieces.piece", "").alias("output"))
