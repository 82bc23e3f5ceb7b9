"""WARC archives of pages, and their index merged by URL key and time.

Writing tasks produce archive files and, per file, a run of index entries
sorted by (URL key, timestamp). The runs are merged in key ranges by a
loser tree, which gives every URL's capture history in global order.

Defined cases: a null URL is archived under an empty target; a null payload
is empty; of pages with equal payloads of at least ``MIN_REVISIT`` bytes the
one with the largest id is the response and the others revisit it, rows that
repeat this largest id are responses too; a null id is older than all others.
An empty table gives empty archives and results.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsignal.llm import storage

MIN_REVISIT = 1000
#: Compressed bytes after which a task begins another archive file.
ARCHIVE_BYTES = 64 << 20
#: Captures without a time column get this time plus their id in seconds.
FIRST_CAPTURE = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)

ENTRY = "url_key string, captured string, page_id long, file string, offset long, length long"
RECORD = (
    "page_id long, url string, captured string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, payload binary"
)


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then the rest: ``com,example)/a?b``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return url or ""
    cut = min((rest.find(c) % (len(rest) + 1) for c in "/?#"), default=len(rest))
    host = rest[:cut].lower().rpartition("@")[2]
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:].partition("#")[0] or "/")


class LoserTree:
    """k-way merge of sorted runs: each step replays one path of the tree.

    ``runs`` are iterators of (key, value) in ascending key order. An inner
    node keeps the loser of its match, so the next winner costs one
    comparison a level.
    """

    def __init__(self, runs: Iterable[Iterator[tuple[Any, Any]]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.size = max(1, len(self.runs))
        self.losers = [-1] * self.size
        for run in range(len(self.runs)):
            self._play(run)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; a run at its end goes last, ties go by run."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _play(self, run: int) -> None:
        node = (run + self.size) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = run
                return
            if self._less(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple[Any, Any]]:
        while self.runs and (head := self.heads[winner := self.losers[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def _header(fields: dict[str, str]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def _one_line(text: str) -> str:
    """Line ends cannot stand in a header field."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(
    page_id: int | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One WARC record as a gzip member of its own, so that it can be read alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": captured,
        "WARC-Target-URI": _one_line(url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_header(fields) + block + b"\r\n\r\n") + packer.flush()


def decode_record(member: bytes) -> dict[str, Any]:
    """Fields of a record; the digest of a response is taken from its payload and compared."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its record")
    number = lambda text: int(n) if (n := text.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "captured": fields["WARC-Date"],
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def with_revisits(pages: DataFrame, page_id: str, url: str, payload: str, captured: str | None) -> DataFrame:
    """What the writer needs of each page, with the id that a revisit refers to.

    Only digests are shuffled for the decision, pre-aggregated by task; the
    payloads themselves are joined with the few digests that occur twice.
    """
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    time = (
        F.date_format(F.col(captured), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        if captured
        else F.date_format(
            F.timestamp_seconds(F.lit(int(FIRST_CAPTURE.timestamp())) + F.coalesce(F.col(page_id), F.lit(0))),
            "yyyy-MM-dd'T'HH:mm:ss'Z'",
        )
    )
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(time, F.lit("")).alias("captured"),
        body.alias("payload"),
        F.sha1(body).alias("digest"),
    )
    again = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy(F.col("digest").alias("shared_digest"))
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("response_id"))
        .filter("copies > 1 and response_id is not null")
        .select("shared_digest", "response_id")
    )
    return rows.join(again, rows.digest == again.shared_digest, "left").drop("shared_digest")


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    captured: str | None = None,
) -> DataFrame:
    """Write one record a row and return the index entries, in runs sorted by (URL key, time).

    A task begins another archive at ``ARCHIVE_BYTES``. Archive names are
    unique to the attempt and count only if the returned table, which is
    written to the shared folder, lists them.
    """
    rows = with_revisits(pages, page_id, url, payload, captured)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, entries = [], 0, []

        def closed() -> pa.RecordBatch:
            name = f"pages-{uuid.uuid4().hex}.warc.gz"
            uri = storage.commit_file(folder, name, parts)
            entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))
            columns = list(zip(*[(key, time, page, uri, at, length) for key, time, page, at, length in entries], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ENTRY_TYPES, strict=True)], names=_ENTRY_NAMES)

        for batch in batches:
            for row in batch.to_pylist():
                page, answer = row["page_id"], row["response_id"]
                revisit = answer is not None and page != answer
                record = encode_record(page, row["url"], row["captured"], row["payload"], row["digest"], answer, revisit)
                entries.append((url_key(row["url"]), row["captured"], page, size, len(record)))
                parts.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    parts, size, entries = [], 0, []
        if entries:
            yield closed()

    return storage.written(rows.mapInArrow(run, ENTRY), "warc-runs")


_ENTRY_NAMES = ["url_key", "captured", "page_id", "file", "offset", "length"]
_ENTRY_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def merge_runs(entries: DataFrame) -> DataFrame:
    """All entries in global order of (URL key, time, id): every URL's captures stand together, oldest first.

    Runs are dealt out by key range; file and offset are part of the range
    key, so a URL with very many captures spreads over several tasks. Each
    task merges the pieces of the runs that fall in its range; the order of
    the frame's partitions is the order of the ranges.
    """
    order = ["url_key", "captured", "page_id", "file", "offset"]
    dealt = entries.repartitionByRange(*order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                runs.setdefault(row[3], []).append(row)
        key = lambda row: (row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4])
        # pieces of a run arrive in the order of the map task; sorted() is one pass over sorted input
        tree = LoserTree(((key(r), r) for r in sorted(rows, key=key)) for _, rows in sorted(runs.items()))
        out = []
        for _, row in tree:
            out.append(row)
            if len(out) == 8192:
                yield _entries(out)
                out = []
        if out:
            yield _entries(out)

    return dealt.mapInArrow(merge, ENTRY)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ENTRY_TYPES, strict=True)], names=_ENTRY_NAMES)


def read_records(entries: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that index entries point to; each archive is read by one task in the order of its records."""
    located = entries.select("file", "offset", "length").repartition(storage.width(entries.sparkSession), "file").sortWithinPartitions("file", "offset")
    names = ["page_id", "url", "captured", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = source = None
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                if row["file"] != current:
                    if source is not None:
                        source.close()
                    store, path = storage.opened(current := row["file"])
                    source = store.open_input_file(path)
                found = decode_record(source.read_at(row["length"], row["offset"]))
                if not with_payload:
                    found["payload"] = None
                out.append(found)
                size += len(found["payload"] or b"")
                if size > 4 << 20 or len(out) == 4096:
                    yield _records(out, names, types)
                    out, size = [], 0
            if out:
                yield _records(out, names, types)

    return located.mapInArrow(read, RECORD)


def _records(rows: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
