"""Encoding with the tokenizers library, once for each distinct piece of text."""

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from depsignal.llm.textarrays import column_bytes, span_hashes

#: Distinct pieces that a Python worker keeps, and the longest kept piece.
CACHED_PIECES = 800_000
CACHED_CHARS = 64
#: Pieces that are handed to the library as one text, and such texts in one call: its results take much memory.
JOINED_PIECES, JOINED_TEXTS = 256, 16


class PieceEncoder:
    """Encodes texts by pieces that the tokenizer treats independently.

    ``split`` must cut a text only where no token can span the cut; ``lead`` is
    what stood before each piece but the first and was cut off. Since pieces
    are independent, many are encoded in one call and told apart by the bytes
    that each id stands for (``id_bytes``). Known pieces are looked up.
    """

    def __init__(
        self,
        encode_batch: Callable[[list[str]], list[list[int]]],
        split: Callable[[str], list[str]],
        lead: str,
        id_bytes: np.ndarray,
    ):
        self.encode_batch, self.split, self.lead, self.id_bytes = encode_batch, split, lead, id_bytes
        self.inner: dict[str, bytes] = {}
        #: known pieces that came again; these outlast the next clearing
        self.again: set[str] = set()

    def encode_inner(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that follow another one, as bytes."""
        lead, known = self.lead, {}
        # a piece that ends like the next one begins could grow together with it
        open_ended = [p for p in pieces if p.endswith(lead)]
        closed = [p for p in pieces if not p.endswith(lead)]
        groups = [closed[k : k + JOINED_PIECES] for k in range(0, len(closed), JOINED_PIECES)]
        groups += [[p] for p in open_ended]
        for group, ids in self._joined(groups):
            ends = np.cumsum([len(p.encode()) for p in group]) + len(lead.encode()) * np.arange(1, len(group) + 1)
            cuts = np.searchsorted(np.cumsum(self.id_bytes[ids]), ends) + 1
            raw, at = ids.tobytes(), 0
            for piece, cut in zip(group, cuts.tolist(), strict=True):
                known[piece] = raw[4 * at : 4 * cut]
                at = cut
        return known

    def encode_spans(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that follow another one, given as spans of bytes, and how many ids each has.

        No piece is empty or ends like ``lead``, and all are taken in array steps.
        """
        lead = np.frombuffer(self.lead.encode(), np.uint8)
        sizes = ends - starts + len(lead)
        to = np.append(0, np.cumsum(sizes))
        joined = raw.take(np.repeat(ends - to[1:], sizes) + np.arange(to[-1]), mode="clip")
        joined[to[:-1, None] + np.arange(len(lead))] = lead
        data, flat, counts = joined.tobytes(), [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(starts), JOINED_PIECES * JOINED_TEXTS):
            cuts = [to[k : k + JOINED_PIECES + 1] for k in range(at, min(at + JOINED_PIECES * JOINED_TEXTS, len(starts)), JOINED_PIECES)]
            for cut, ids in zip(cuts, self.encode_batch([data[c[0] : c[-1]].decode() for c in cuts]), strict=True):
                flat.append(np.array(ids, "<u4"))
                counts.append(np.diff(np.searchsorted(np.cumsum(self.id_bytes[flat[-1]]), cut[1:] - cut[0]) + 1, prepend=0))
        return np.concatenate(flat), np.concatenate(counts)

    def _joined(self, groups: list[list[str]]) -> Iterator[tuple[list[str], np.ndarray]]:
        for at in range(0, len(groups), JOINED_TEXTS):
            some = groups[at : at + JOINED_TEXTS]
            found = self.encode_batch([self.lead + self.lead.join(g) for g in some])
            yield from ((group, np.array(ids, "<u4")) for group, ids in zip(some, found, strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        pieces = [self.split(text) for text in texts]
        heads = [array("I", ids).tobytes() for ids in self.encode_batch([p[0] for p in pieces])]
        if len(self.inner) > CACHED_PIECES:
            self.inner = {p: self.inner[p] for p in self.again if p in self.inner} if len(self.again) < CACHED_PIECES else {}
            self.again = set()
        known = self.inner
        for p in pieces:
            p[0] = ""
        found = set().union(*pieces)
        self.again |= found & known.keys()
        missing = list(found - known.keys() - {""})
        known |= self.encode_inner(missing)
        known[""] = b""
        out = [np.frombuffer(head + b"".join(map(known.__getitem__, p)), "<u4") for head, p in zip(heads, pieces, strict=True)]
        for piece in missing:
            if len(piece) > CACHED_CHARS:
                del known[piece]
        return out


class WordEncoder:
    """The same over whole Arrow columns, for pieces that are cut at single blanks.

    Pieces are told apart by 64-bit hashes of their bytes, so that a batch is
    looked up, and its ids are put together, in array steps. Pieces not met
    before become strings by the hundred, joined for the library. Texts that ``plain`` refuses, because blanks
    stand side by side in them, go through a ``PieceEncoder``. ``mark`` makes of
    a text, or of its first piece, what the model sees of it.
    """

    def __init__(self, other: PieceEncoder, plain: Callable[[str], bool], mark: Callable[[str], str] = str):
        self.other, self.plain, self.mark = other, plain, mark
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _learn(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> None:
        """Encode pieces and keep their ids; the first of a text has no blank before it."""
        lead = np.frombuffer(self.other.lead.encode(), np.uint8)
        # a piece that ends like the next one begins could grow together with it, and an empty one is the lone blank at the end of a text
        alone = ends - starts >= len(lead)
        alone[alone] = (raw[ends[alone, None] - len(lead) + np.arange(len(lead))] == lead).all(axis=1)
        alone |= first | (starts == ends)
        inner, rest = np.flatnonzero(~alone), np.flatnonzero(alone).tolist()
        flat, count = self.other.encode_spans(raw, starts[inner], ends[inner])
        texts = [raw[starts[k] : ends[k]].tobytes().decode() for k in rest]
        found = self.other.encode_batch([self.mark(text) if first[k] else self.other.lead + text for k, text in zip(rest, texts, strict=True)])
        at = np.empty(len(hashes), np.int64)
        at[np.append(inner, np.array(rest, np.int64))] = len(self.begin) - 1 + np.arange(len(hashes))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([*count, *map(len, found)], dtype=np.int64)])
        self.flat = np.concatenate([self.flat, flat, *[np.array(ids, "<u4") for ids in found]])
        every, place = np.concatenate([self.hashes, hashes]), np.concatenate([self.entry, at])
        order = np.argsort(every, kind="stable")
        self.hashes, self.entry = every[order], place[order]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column without nulls."""
        texts = column.to_pylist()
        plain = np.array([self.plain(t) for t in texts], bool)
        out: list = [None] * len(texts)
        odd = np.flatnonzero(~plain).tolist()
        for k, ids in zip(odd, self.other.encode([self.mark(texts[k]) for k in odd]), strict=True):
            out[k] = ids
        even = np.flatnonzero(plain)
        if len(even):
            for k, ids in zip(even.tolist(), self._encode_plain(column.filter(pa.array(plain))), strict=True):
                out[k] = ids
        return out

    def _encode_plain(self, column: pa.Array) -> list[np.ndarray]:
        raw, offsets = column_bytes(column)
        blank = np.flatnonzero(raw == 32)
        # a piece begins each text and follows each blank; it ends at the next blank or the end of its text
        text = np.concatenate([np.arange(len(column)), np.searchsorted(offsets, blank, "right") - 1])
        starts = np.concatenate([offsets[:-1], blank + 1])
        order = np.argsort(starts + text, kind="stable")  # an empty text begins where the next one does
        text, starts = text[order], starts[order]
        ends = np.append(starts[1:] - 1, len(raw))
        last = np.append(text[1:] != text[:-1], True)
        ends[last] = offsets[1:][text[last]]
        first = np.append(True, text[1:] != text[:-1])
        hashes = span_hashes(raw, starts, ends, first)
        different, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHED_PIECES:
            self._forget()
        place = np.searchsorted(self.hashes, different)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == different[known]
        if not known.all():
            new = at[~known]
            self._learn(different[~known], raw, starts[new], ends[new], first[new])
        entry = self.entry[np.searchsorted(self.hashes, different)][inverse]
        begin, count = self.begin[entry], self.begin[entry + 1] - self.begin[entry]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        cuts = total[np.searchsorted(text, np.arange(len(column) + 1))]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
