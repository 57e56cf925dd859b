"""WARC archives of web pages, index first: records are written, indexed, and read back by sorted, coalesced byte ranges.

write_archives() makes one archive per task in a folder that all executors share, each record a gzip member of its
own, and returns the index: one row per record with url, digest, archive, offset and length. A retried or speculative
task writes a file of another name and only the rows of the attempt that succeeded get into the index. read_records()
deals the wanted index rows out by archive and offset, joins neighbouring ranges up to RANGE_BYTES with gaps up to
GAP_BYTES into one read, and checks each record's digest.

Of records with equal payloads of at least LEAST_BYTES bytes, that with the largest page_id is a response, the others
are revisit records that refer to it and hold only the HTTP head. Defined results: null html is an empty payload; null
url an empty address; a null page_id is less than all others; if the largest page_id of equal payloads stands in several
rows, all of these are responses; pages without rows give no archive and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.scratch import Scratch

LEAST_BYTES = 1000
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
READ_BYTES = 64 << 20  # of archive to a reading task
BROADCAST_ROWS = 200_000  # digests of repeated payloads of about 60 bytes
DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id long, url string, payload_bytes long, digest string, record_type string, archive string, offset long, length long"
_SAFE = {i: f"%{i:02X}" for i in (*range(33), 127)}


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. refers_to: the page whose response holds the payload, else None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url.translate(_SAFE)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """page_id, url, record_type, refers_to, digest (hexadecimal), payload_bytes and payload (None in a revisit) of one record; ValueError if it is broken."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("a broken WARC record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": page(fields["WARC-Refers-To"]) if revisit else None, "digest": digest, "payload_bytes": size, "payload": None if revisit else payload}


def _rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("payload")).withColumn("digest", F.sha1("payload"))


def write_archives(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write all of pages and return the index, itself written."""
    folder = scratch.path("archives")
    same = _rows(pages).filter(F.length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.count("*").alias("rows"), F.max("page_id").alias("first")).filter("rows > 1 and first is not null").select("digest", "first")
    same = scratch.keep(same, "repeated")
    if same.count() <= BROADCAST_ROWS:
        same = F.broadcast(same)
    rows = _rows(pages).join(same, "digest", "left").withColumn("refers_to", F.expr("if(first is null or page_id <=> first, null, first)")).select("page_id", "url", "payload", "digest", "refers_to")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        try:
            for batch in batches:
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                index = []
                for page_id, url, payload, digest, refers_to in zip(*(batch[k] for k in range(5)), strict=True):
                    body = payload.as_py()
                    packed = record(page_id.as_py(), url.as_py(), body, digest.as_py(), refers_to.as_py())
                    out.write(packed)
                    index.append((page_id.as_py(), url.as_py(), len(body), digest.as_py(), "response" if refers_to.as_py() is None else "revisit", name, offset, len(packed)))
                    offset += len(packed)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in index], kind) for k, kind in enumerate(kinds)], ["page_id", "url", "payload_bytes", "digest", "record_type", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    index = scratch.keep(rows.mapInArrow(written, _INDEX), "index")
    index.archives = folder
    return index


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """Archive, first byte, end and positions in rows of each read; rows: sorted archive, offset and length."""
    at: list | None = None
    for k, (archive, offset, length) in enumerate(rows):
        if at and at[0] == archive and offset - at[2] <= GAP_BYTES and max(at[2], offset + length) - at[1] <= RANGE_BYTES:
            at[2] = max(at[2], offset + length)
            at[3].append(k)
        else:
            if at:
                yield tuple(at)
            at = [archive, offset, offset + length, [k]]
    if at:
        yield tuple(at)


def read_records(selected: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the selected index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if wanted."""
    n = selected.agg(F.sum("length")).head()[0] or 0
    parts = max(selected.sparkSession.sparkContext.defaultParallelism, -(-n // READ_BYTES))
    rows = selected.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        name, opened = None, None
        for batch in batches:
            index = list(zip(*(batch[k].to_pylist() for k in range(3)), strict=True))
            for archive, first, end, own in ranges(index):
                if archive != name:
                    name, opened = archive, store.open_input_file(f"{base}/{archive}")
                data = opened.read_at(end - first, first)
                found = [parse(data[index[k][1] - first : index[k][1] - first + index[k][2]]) for k in own]
                columns = [pa.array([x[k] for x in found], kind) for k, kind in (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else []))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])])

    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return rows.mapInArrow(read, kind + ", payload binary" * payloads)
