"""Token ids in bit-packed binary shards.

A shard holds whole documents in ascending id order::

    "TOKB", version, bits per id, ids per block           4 x 4 bytes
    documents, ids, blocks                                 3 x 8 bytes
    document ids (8 bytes each), flags of null ids (1 bit each)
    first id of each document, and the end                 8 bytes each
    first byte of each block in the payload, and the end   8 bytes each
    payload: blocks of ids, each id in ``bits`` bits, lowest bit first

``bits`` is the fewest that hold the vocabulary. A block begins at a whole
byte, so any id range is read by unpacking only the blocks it touches.

Defined cases: a null text is an empty one and has only the end id; a null
document id sorts first and is kept as null; repeated rows are stored each.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depsignal.llm import storage
from depsignal.llm.encoding import PieceEncoder, WordEncoder
from depsignal.llm.textarrays import slices

MAGIC, VERSION = b"TOKB", 1
BLOCK_IDS = 4096
#: Ids after which a task begins another shard.
SHARD_IDS = 4 << 20

_HEAD = struct.Struct("<4sIIIQQQ")
SHARD = "part int, shard int, uri string, n_docs long, n_ids long"
STORED = "doc_id long, start long, ids array<long>"


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first, filled up to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(flags, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flags.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def encode_shard(doc_ids: list[int | None], parts: list[np.ndarray], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype("<u8")
    blocks = [pack(ids[at : at + block_ids], bits) for at in range(0, len(ids), block_ids)]
    places = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<u8")
    return b"".join(
        [
            _HEAD.pack(MAGIC, VERSION, bits, block_ids, len(doc_ids), len(ids), len(blocks)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.packbits([d is None for d in doc_ids]).tobytes() if doc_ids else b"",
            first.tobytes(),
            places.tobytes(),
            *blocks,
        ]
    )


class ShardReader:
    """Random access to a shard: the header and tables are read at once, ids by block."""

    def __init__(self, uri: str):
        store, path = storage.opened(uri)
        self.file = store.open_input_file(path)
        magic, version, self.bits, self.block_ids, self.n_docs, self.n_ids, blocks = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{uri} is no token shard")
        null_bytes = (self.n_docs + 7) // 8
        size = 8 * self.n_docs + null_bytes + 8 * (self.n_docs + 1) + 8 * (blocks + 1)
        table = self.file.read_at(size, _HEAD.size)
        at = 8 * self.n_docs
        nulls = np.unpackbits(np.frombuffer(table, np.uint8, null_bytes, at), count=self.n_docs)
        self.doc_ids = [None if null else d for d, null in zip(np.frombuffer(table, "<i8", self.n_docs).tolist(), nulls, strict=True)]
        self.first = np.frombuffer(table, "<u8", self.n_docs + 1, at + null_bytes).astype(np.int64)
        self.places = np.frombuffer(table, "<u8", blocks + 1, at + null_bytes + 8 * (self.n_docs + 1)).astype(np.int64)
        self.payload = _HEAD.size + size

    def __enter__(self) -> ShardReader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start up to stop, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        low, high = start // self.block_ids, -(-stop // self.block_ids)
        data = self.file.read_at(int(self.places[high] - self.places[low]), self.payload + int(self.places[low]))
        base = self.places[low]
        found = [
            unpack(data[self.places[b] - base : self.places[b + 1] - base], min(self.block_ids, self.n_ids - b * self.block_ids), self.bits)
            for b in range(low, high)
        ]
        return np.concatenate(found)[start - low * self.block_ids : stop - low * self.block_ids]

    def document(self, index: int) -> np.ndarray:
        return self.ids(int(self.first[index]), int(self.first[index + 1]))


#: Characters that count as blanks for the byte-level pattern, and some that only might.
_BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS_ASCII = "".join(c for c in _BLANKS if c.isascii())


def _single_blanks(text: str) -> bool:
    """Whether no blank of the text stands beside another one."""
    if "  " in text:
        return False
    # one character is found far faster than two, and most of them are in no text
    met = [c for c in (_BLANKS_ASCII if text.isascii() else _BLANKS) if c in text]
    return not any(" " + c in text or c + " " in text for c in met)


def _split_words(text: str) -> list[str]:
    """Cut at each blank between two other characters: there the byte-level pattern begins a new match.

    A text with blanks side by side is cut into larger pieces, whose runs stay whole.
    """
    pieces = text.split(" ")
    if _single_blanks(text):
        return pieces if pieces[-1] or len(pieces) == 1 else [*pieces[:-2], pieces[-2] + " "]
    out, glue = [pieces[0]], not pieces[0] or pieces[0][-1].isspace()
    for piece in pieces[1:]:
        if glue or not piece or piece[0].isspace():
            out[-1] += " " + piece
        else:
            out.append(piece)
        glue = not piece or piece[-1].isspace()
    return out


def byte_level_encoder(path: str) -> tuple[WordEncoder, int]:
    """Encoder of a tokenizers file, and its vocabulary size.

    Strings of special tokens in a text are ordinary text. Texts are cut at
    words if the file is plain byte-level BPE, otherwise taken whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    spec = json.loads(tokenizer.to_str())
    before = spec.get("pre_tokenizer") or {}
    by_word = (
        spec.get("normalizer") is None
        and spec["model"]["type"] == "BPE"
        and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
        and not spec["model"].get("continuing_subword_prefix")
        and all(t["special"] for t in spec["added_tokens"])
    )
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    # a byte-level token has one character for each byte
    names = sorted(tokenizer.get_vocab().items(), key=lambda item: item[1])
    sizes = np.zeros(names[-1][1] + 1, np.int64)
    sizes[[i for _, i in names]] = [len(name) for name, _ in names]
    pieces = PieceEncoder(encode, _split_words if by_word else lambda text: [text], " ", sizes)
    return WordEncoder(pieces, _single_blanks if by_word else lambda text: False), tokenizer.get_vocab_size()


@lru_cache(1)
def _worker_encoder(path: str) -> tuple[WordEncoder, int]:
    """The encoder that a Python worker keeps from task to task, with the pieces it knows."""
    return byte_level_encoder(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts, each followed by the end id, into shards; returns the list of shards.

    Documents are dealt out by id range, so part and shard number ascend with
    the ids. Shard names are unique to the attempt and count only if the
    returned table, written to the shared folder, lists them.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # the hash divides documents that share one id
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = _worker_encoder(tokenizer)
        bits = bits_for(max(vocabulary, end_id + 1))
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids, found, size = [], [], 0
        end = np.array([end_id], "<u4")

        def closed() -> pa.RecordBatch:
            uri = storage.commit_file(folder, f"{part:06d}-{shard:04d}-{uuid.uuid4().hex}.tokb", encode_shard(doc_ids, found, bits))
            values = (part, shard, uri, len(doc_ids), size)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _SHARD_TYPES, strict=True)], names=_SHARD_NAMES)

        for batch in batches:
            for low, high in slices(batch.column(1)):
                for one in encoder.encode(batch.column(1).slice(low, high - low).fill_null("")):
                    found += [one, end]
                    size += len(one) + 1
                doc_ids += batch.column(0).slice(low, high - low).to_pylist()
                if size >= SHARD_IDS:
                    found = [np.concatenate(found[k : k + 2]) for k in range(0, len(found), 2)]
                    yield closed()
                    doc_ids, found, size, shard = [], [], 0, shard + 1
        if doc_ids:
            found = [np.concatenate(found[k : k + 2]) for k in range(0, len(found), 2)]
            yield closed()

    return storage.written(dealt.mapInArrow(write, SHARD), "token-shards")


_SHARD_NAMES = ["part", "shard", "uri", "n_docs", "n_ids"]
_SHARD_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]


def placed(shards: DataFrame) -> DataFrame:
    """The shards with the number of ids in all shards before; one row a shard goes through the window."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _spread(shards: DataFrame) -> DataFrame:
    """Shards over tasks. The number is given, since by the size of this list one task would read them all."""
    return placed(shards).select("uri", "base").repartition(storage.width(shards.sparkSession), "uri")


def read_digests(shards: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens and the crc32 of its ids as little-endian 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with ShardReader(uri) as shard:
                    all_ids = shard.ids(0, shard.n_ids)
                    crcs = [zlib.crc32(all_ids[a:b].tobytes()) for a, b in zip(shard.first[:-1], shard.first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids, pa.int64()),
                            pa.array(shard.first[:-1] + base),
                            pa.array(np.diff(shard.first)),
                            pa.array(crcs, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return _spread(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Per stored document its id, the number of ids before it and its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with ShardReader(uri) as shard:
                    ids = shard.ids(0, shard.n_ids).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids, pa.int64()),
                            pa.array(shard.first[:-1] + base),
                            pa.ListArray.from_arrays(pa.array(shard.first.astype(np.int32)), pa.array(ids)),
                        ],
                        names=["doc_id", "start", "ids"],
                    )

    return _spread(shards).mapInArrow(read, STORED)
