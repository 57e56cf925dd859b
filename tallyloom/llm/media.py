"""Payloads in PNG images in a binary column, read back chunk by chunk, with a low-frequency cosine-transform hash.

write_png() stores bytes as the 8-bit grey samples of an image WIDTH wide. Each row has the filter (none, left or up)
whose differences are least in sum, the usual rule of encoders; in text nearly every row has left or up. read_png()
checks the signature and the CRC-32 of every chunk, inflates the image data and undoes the five row filters with numpy:
left, and runs of up, by running sums; average and Paeth, which only other encoders write, diagonal by diagonal, as the
samples of a diagonal do not depend on each other. The hash of an image: its samples averaged down to 32 x 32, the
two-dimensional type-II cosine transform of these, the 8 x 8 lowest frequencies but the constant one, each compared with
their median.

Defined results: null text counts as empty. The payload is the UTF-8 text and zero bytes up to the next positive
multiple of 64, so an empty text has 64 of them. Equal texts have equal values; doc_id, null or repeated, only passes.
A text of any length is one image. No documents, no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.shingles import buffers

WIDTH = 64
LEVEL = 1
SIDE, LOW = 32, 8
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(payload: bytes, filter_type: int | None = None) -> bytes:
    """payload (a positive multiple of WIDTH bytes) as a grey image; filter_type 0 (none), 1 (left) or 2 (up) for all rows, else for each row the best of these."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    stored = np.zeros((len(rows), WIDTH + 1), np.uint8)
    found = [rows, rows.copy(), rows.copy()]
    found[1][:, 1:] -= rows[:, :-1]
    found[2][1:] -= rows[:-1]
    if filter_type is None:
        # bytes above 127 are small differences downwards
        cost = np.stack([np.minimum(x, -x).sum(axis=1, dtype=np.int64) for x in found])
        stored[:, 0] = cost.argmin(axis=0)
        stored[:, 1:] = np.stack(found)[stored[:, 0], np.arange(len(rows))]
    else:
        stored[:, 0] = filter_type
        stored[:, 1:] = found[filter_type]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(stored.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each chunk; ValueError if the file is cut off or a checksum is wrong."""
    if png[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(png):
            raise ValueError("the PNG file is cut off")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"wrong checksum of chunk {kind!r}")
        yield kind, body
        at += 12 + n


def _by_diagonals(kinds: np.ndarray, stored: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """The samples of rows of any filters. Those of a diagonal from right above to left below depend on earlier diagonals only."""
    n, width = len(stored), stored.shape[1] // step
    given = stored.reshape(n, width, step).astype(np.int32)
    out = np.zeros((n + 1, width + 1, step), np.int32)  # one row above, one pixel to the left
    out[0, 1:] = above.reshape(width, step)
    for d in range(n + width - 1):
        i = np.arange(max(0, d - width + 1), min(n, d + 1))
        j = d - i
        left, up, corner = out[i + 1, j], out[i, j + 1], out[i, j]
        by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        paeth = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        guess = np.choose(kinds[i][:, None], [np.zeros_like(left), left, up, (left + up) >> 1, paeth])
        out[i + 1, j + 1] = (given[i, j] + guess) & 255
    return out[1:, 1:].reshape(n, width * step).astype(np.uint8)


def _by_sums(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray, step: int) -> None:
    """Undoes filters 0 to 2 in place: left by sums along the row; up by sums down the columns, which begin anew after each other row."""
    side = kinds == 1
    for lane in range(step):
        rows[side, lane::step] = np.cumsum(rows[side, lane::step], axis=1, dtype=np.uint8)
    if kinds[0] == 2:
        rows[0] += above
    sums = np.vstack([np.zeros((1, rows.shape[1]), np.uint8), np.cumsum(rows, axis=0, dtype=np.uint8)])
    begins = np.maximum.accumulate(np.where(kinds == 2, 0, np.arange(len(rows))))
    rows[:] = sums[1:] - sums[begins]


def unfilter(stored: np.ndarray, step: int) -> np.ndarray:
    """The samples of rows whose first byte names the filter; step: bytes a pixel."""
    kinds, rows = stored[:, 0], stored[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError(f"no such filter: {kinds.max()}")
    hard = kinds > 2
    bounds = [0, *(np.flatnonzero(np.diff(hard)) + 1).tolist(), len(rows)]
    for first, last in zip(bounds, bounds[1:], strict=False):
        above = rows[first - 1] if first else np.zeros(rows.shape[1], np.uint8)
        if first < last and hard[first]:
            rows[first:last] = _by_diagonals(kinds[first:last], rows[first:last], above, step)
        elif first < last:
            _by_sums(kinds[first:last], rows[first:last], above, step)
    return rows


def read_png(png: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit image without interlacing."""
    head, packed = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[4:] != (0, 0, 0) or head[3] not in (0, 2, 4, 6):
        raise ValueError("an 8-bit image without interlacing or palette is needed")
    step = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != head[1] * (head[0] * step + 1):
        raise ValueError("the image data has a wrong length")
    return unfilter(raw.reshape(head[1], head[0] * step + 1), step)


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


_DCT = _cosines(SIDE)


def dct_hash(samples: np.ndarray) -> str:
    """16 hexadecimal digits."""
    small = samples.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        edges = np.arange(SIDE) * n // SIDE
        if n >= SIDE:
            counts = np.diff(np.append(edges, n))
            small = np.add.reduceat(small, edges, axis=axis) / (counts[:, None] if axis == 0 else counts)
        else:
            small = small.take(edges, axis=axis)
    low = np.rint(_DCT @ small @ _DCT.T * 1e6).ravel()[1:]
    return np.packbits(np.append(low > np.median(low), False)).tobytes().hex()


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch["text"])
        for first in range(0, len(batch), 500):
            rows = []
            for i in range(first, min(first + 500, len(batch))):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                rows.append((len(text), write_png(text.ljust(max(1, -(-len(text) // 64)) * 64, b"\0"))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, 500), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, the PNG file that holds it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        out = []
        for media in batch["media"]:
            png = media.as_buffer().to_pybytes()
            samples = read_png(png)
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), dct_hash(samples)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored images hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
