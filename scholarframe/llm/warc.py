"""WARC archives: records are written by tasks, indexed, and read back by byte ranges.

The index comes first: writing yields, per record, its file, offset, length, URL, and payload
digest.  Reading sorts the wanted records by file and offset, coalesces neighbours into one range, and
cuts the records out of each range.  Files go through Arrow's file systems, so the folder may be local,
HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.plans.tables import settle

#: A file is closed once it has so many bytes.
FILE_BYTES = 64 << 20
#: Records less than `GAP` bytes apart are read in one range of at most `RANGE` bytes.
GAP, RANGE = 64 << 10, 8 << 20
#: Bytes of archives that one task reads, more or less; a file is shared out in stretches of so many.
TASK_BYTES = 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, url string, file string, offset long, length long, record_type string, digest string, refers_to long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _one_line(value: str) -> str:
    return "".join("%%%02X" % ord(c) if ord(c) < 33 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One gzip member that holds one WARC record; a revisit has the HTTP head alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []
    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if kind == "revisit" else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda key: int(fields[key][10:-1]) if fields.get(key, "<urn:page:>") != "<urn:page:>" else None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != int(said["Content-Length"]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: its payload doesn't match its head")
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), int(said["Content-Length"]), digest, kind, number("WARC-Refers-To")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes a task's records; its files have names of their own on every attempt, and only those
    of the attempt that succeeds are in the index."""
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    out = path = None
    at, number = 0, 0
    stem = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
    try:
        for batch in batches:
            rows = []
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    path, at = f"part-of-crawl-{stem}-{number:04d}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{path}", compression=None)
                payload, kind = (html or "").encode(), "response" if refers is None else "revisit"
                member = record(page, url, payload, kind, refers)
                out.write(member)
                rows.append((page, url, path, at, len(member), kind, hashlib.sha1(payload).hexdigest(), refers))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out, number = None, number + 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _INDEX.split(", ")])
    finally:
        if out is not None:
            out.close()


def _ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Coalesced (start, stop, records) of places sorted by offset."""
    own: list[int] = []
    start = stop = 0
    for k, (offset, length) in enumerate(places):
        if own and (offset - stop > GAP or offset + length - start > RANGE):
            yield start, stop, own
            own = []
        start = start if own else offset
        stop = max(stop, offset + length) if own else offset + length
        own.append(k)
    if own:
        yield start, stop, own


def _fetch(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = _open(folder)
    for batch in batches:
        names, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
        rows, a = [], 0
        while a < len(names):
            b = a
            while b < len(names) and names[b] == names[a]:
                b += 1
            with files.open_input_file(f"{root}/{names[a]}") as source:
                for start, stop, own in _ranges(list(zip(offsets[a:b], lengths[a:b], strict=True))):
                    data = source.read_at(stop - start, start)
                    rows += [parse(data[offsets[a + k] - start : offsets[a + k] - start + lengths[a + k]]) for k in own]
            a = b
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 1000) -> DataFrame:
    """Writes one record per row and returns the index, a settled table.

    pages has page_id (long), url and html; other columns are ignored.  A null html is an empty payload; a
    null url writes no target.  Of equal payloads of at least `revisit_bytes`, the row of the largest
    page_id is the response and rows of other page_ids revisit it; rows that repeat that page_id
    are responses too, and a null page_id revisits or, alone, responds.  A record's id is its page_id's, so rows
    that repeat one share it.  An empty table writes nothing.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= revisit_bytes, F.sha1(F.col("html").cast("binary")))
    # Digests of one page only need no partner, so only repeated ones are joined.
    last = pages.select("page_id", digest.alias("same")).where("same is not null").groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("times")).where("times > 1 and last is not null")
    known = pages.withColumn("same", F.coalesce(digest, F.concat(F.lit("-"), F.xxhash64("page_id").cast("string"))))
    marked = known.join(last, "same", "left").select("page_id", "url", "html", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))
    return settle(marked.mapInArrow(lambda it: _write(it, folder), _INDEX), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads the index's records back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Stretches of files are dealt to as many tasks as the records' bytes ask for; within a task they are read in order."""
    total = index.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / TASK_BYTES).alias("stretch")
    dealt = index.select("file", "offset", "length", stretch).repartition(max(1, -(-total // TASK_BYTES)), "file", "stretch")
    return dealt.sortWithinPartitions("file", "offset").drop("stretch").mapInArrow(lambda it: _fetch(it, folder), _READ)
