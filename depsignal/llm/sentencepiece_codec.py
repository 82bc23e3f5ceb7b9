"""SentencePiece models on the tokenizers library, checked against sentencepiece itself.

The model file is parsed here; normaliser, metaspace marker, scores and byte
fallback are rebuilt as a tokenizers pipeline. Both model kinds are covered:
unigram takes the scores as they are, BPE takes them as merge priorities.

Defined cases: a null text is an empty one, which has no ids; control symbols
written in a text are ordinary text; repeated rows are encoded each; columns
named like an output column are not passed on, since only the id is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsignal.llm.encoding import PieceEncoder, WordEncoder
from depsignal.llm.textarrays import slices

#: The visible stand-in for a blank, a fixed value of the format.
MARK = "▁"
#: Numbers of the model format (fixed values).
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    """What the codec needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    escape_blanks: bool = True

    @property
    def unknown_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each entry of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        match key & 7:
            case 0:
                yield key >> 3, varint()
            case 1:
                yield key >> 3, data[at : at + 8]
                at += 8
            case 2:
                size = varint()
                yield key >> 3, data[at : at + size]
                at += size
            case 5:
                yield key >> 3, data[at : at + 4]
                at += 4
            case kind:
                raise ValueError(f"wire type {kind} in a model file")


def parse_model(data: bytes) -> Model:
    """Pieces and settings of a serialised model; absent fields have the format's defaults."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.suffix_mark = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.squeeze_blanks = bool(v)
                elif n == 5:
                    model.escape_blanks = bool(v)
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    if model.suffix_mark or not model.escape_blanks:
        raise ValueError("models with a trailing marker or plain blanks are not supported")
    if any(kind == USER_DEFINED for _, _, kind in model.pieces):
        raise ValueError("models with user-defined symbols are not supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs in the order in which BPE joins them: by the score of the joined piece, then by their own ids."""
    ids = {piece: i for i, (piece, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    found.append((-score, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


class Codec:
    """Encoder and decoder of one model.

    ``threads`` bounds the library's own threads in this process. If no piece
    of the vocabulary holds the marker after another character, no token can
    span the cut before a marker, and texts are encoded by word.
    """

    def __init__(self, path: str, threads: int = 1):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        with open(path, "rb") as f:
            self.model = model = parse_model(f.read())
        self.path, self.threads = path, threads
        vocabulary = [(piece, score) for piece, score, _ in model.pieces]
        if model.kind == UNIGRAM:
            core = models.Unigram(vocabulary, unk_id=model.unknown_id, byte_fallback=model.byte_fallback)
        else:
            core = models.BPE(
                {piece: i for i, (piece, _) in enumerate(vocabulary)},
                merges(model),
                unk_token=model.pieces[model.unknown_id][0],
                fuse_unk=True,
                byte_fallback=model.byte_fallback,
            )
        self.tokenizer = Tokenizer(core)
        self.tokenizer.decoder = decoders.Sequence(
            [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
            + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])
        )
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze_blanks:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self._normaliser = normalizers.Sequence(steps) if steps else None
        by_word = model.dummy_prefix and not any(
            MARK in piece.lstrip(MARK) for piece, _, kind in model.pieces if kind in (NORMAL, UNUSED)
        )
        sizes = np.array([1 if kind == BYTE else len(piece.encode()) for piece, _, kind in model.pieces])
        self._piece_bytes = [
            bytes([int(piece[1:-1], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode() for piece, _, kind in model.pieces
        ]
        self._split = self._words if by_word and model.byte_fallback else lambda text: [text]
        cut = by_word and model.byte_fallback
        plain = lambda t: cut and MARK not in t and "  " not in t and t[:1] != " " and t[-1:] != " "
        self._encoder = WordEncoder(PieceEncoder(self._encode_batch, self._split, MARK, sizes), plain, self._mark)

    def _encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _words(text: str) -> list[str]:
        """Cut before each marker that stands between two other characters; the marker is left out."""
        if MARK * 2 not in text and not text.endswith(MARK):
            return ["", *text.split(MARK)[1:]] if text.startswith(MARK) else text.split(MARK)
        out, glue = [], True
        for piece in text.split(MARK):
            if out and (glue or not piece):
                out[-1] += MARK + piece
            else:
                out.append(piece)
            glue = not piece
        return out

    def normalised(self, text: str) -> str:
        return text if self._normaliser is None else self._normaliser.normalize_str(text)

    def _mark(self, text: str) -> str:
        """A normalised text as the model sees it."""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK) if text else ""

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_normalised([self.normalised(text) for text in texts])

    def encode_normalised(self, texts: list[str]) -> list[np.ndarray]:
        return self._encoder.encode(pa.array(texts, pa.string()))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids: the bytes of all pieces in a row. Bytes that are no text are left to the library's decoder."""
        out = []
        for one in ids:
            one = one.tolist()
            try:
                text = b"".join(map(self._piece_bytes.__getitem__, one)).decode()
            except UnicodeDecodeError:
                text = self.tokenizer.decode(one, skip_special_tokens=False)
            else:
                text = text[self.model.dummy_prefix and text.startswith(" ") :]
            out.append(text)
        return out

    @staticmethod
    def plain(normalised: str) -> str:
        """What decoding must give back for a normalised text: a marker in it is a blank to the model."""
        return normalised.replace(MARK, " ")


class Parity:
    """Compares the rebuilt codec with sentencepiece on each text."""

    def __init__(self, codec: Codec):
        import sentencepiece

        self.reference = sentencepiece.SentencePieceProcessor(model_file=codec.path)
        self.threads = codec.threads

    def same(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        expected = self.reference.encode(texts, num_threads=self.threads)
        return [len(a) == len(b) and a == b.tolist() for a, b in zip(expected, ids, strict=True)]


ENCODED = "ids array<int>, decoded string, round_trip boolean, parity boolean"
DIGESTS = "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean"


def _coded(codec: Codec, parity: Parity, texts: list[str]) -> tuple[list[np.ndarray], list[str], list[bool], list[bool]]:
    normalised = [codec.normalised(t) for t in texts]
    ids = codec.encode_normalised(normalised)
    decoded = codec.decode(ids)
    return ids, decoded, [codec.plain(m) == d for m, d in zip(normalised, decoded, strict=True)], parity.same(texts, ids)


def encode_texts(docs: DataFrame, model: str, text: str = "text", threads: int = 1) -> DataFrame:
    """All columns, and the ids, the text decoded from them, whether it is the normalised text, and parity.

    ``threads`` should be spark.task.cpus. One pass without a shuffle.
    """
    taken = ("ids", "decoded", "round_trip", "parity")
    names = [c for c in docs.columns if c.lower() not in taken]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, threads)
        parity = Parity(codec)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for low, high in slices(column):
                ids, decoded, whole, same = _coded(codec, parity, [t or "" for t in column.slice(low, high - low).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(low, high - low) for c in batch.columns[:-1]], pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(whole), pa.array(same)],
                    names=[*names, *taken],
                )

    return rows.mapInArrow(run, ", ".join(filter(None, [schema, ENCODED])))


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", threads: int = 1) -> DataFrame:
    """Per row: number of ids, crc32 of the ids as little-endian 32-bit integers and of the decoded text, round trip and parity."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, threads)
        parity = Parity(codec)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                ids, decoded, whole, same = _coded(codec, parity, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low).cast(pa.int64()),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                        pa.array([zlib.crc32(d.encode()) for d in decoded], pa.int64()),
                        pa.array(whole),
                        pa.array(same),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip", "parity"],
                )

    return rows.mapInArrow(run, DIGESTS)
