"""Binary media columns: PNG images written and read in numpy, with a low-frequency cosine-transform hash."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHUNK = 1 << 16
SIDE, LOW = 32, 8
#: Scaled to integers, so that a hash is the same on every machine.
COSINES = np.rint(4096 * np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE))).astype(np.int64)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: np.ndarray, filter: int = 2, level: int = 6) -> bytes:
    """An 8-bit grey image of rows by columns; filter 0 (none), 1 (left) or 2 (up) for all its rows."""
    rows, columns = samples.shape
    lines = np.empty((rows, columns + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = filter, samples
    if filter == 1:
        lines[:, 2:] -= samples[:, :-1]
    elif filter == 2:
        lines[1:, 1:] -= samples[:-1]
    packed = zlib.compress(lines.tobytes(), level)
    parts = [chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return b"".join([SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)), *parts, chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples of filtered rows; runs of rows with one filter at a time, rows of filters 3 and 4 one by one."""
    out = np.empty_like(lines)
    above = np.zeros(lines.shape[1], np.uint8)
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    for a, b in zip(starts, [*starts[1:], len(kinds)], strict=True):
        kind, run = kinds[a], lines[a:b]
        if kind == 0:
            out[a:b] = run
        elif kind == 1:
            np.cumsum(run, axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.cumsum(run, axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        elif kind in (3, 4):
            for i in range(a, b):
                left = corner = 0
                up = out[i - 1] if i else above
                for j, x in enumerate(lines[i].tolist()):
                    u = int(up[j])
                    if kind == 3:
                        guess = (left + u) >> 1
                    else:
                        p = left + u - corner
                        guess = min((abs(p - left), 0, left), (abs(p - u), 1, u), (abs(p - corner), 2, corner))[2]
                    left, corner = (x + guess) & 255, u
                    out[i, j] = left
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[b - 1]
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image. Raises ValueError where the signature, a length or a checksum is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head, kind = 8, [], None, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("the file ends early")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing are read")
    columns, rows = head[:2]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if lines.size != rows * (columns + 1):
        raise ValueError("the image has another size than its header says")
    lines = lines.reshape(rows, columns + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which low frequencies of the image, scaled to 32 by 32, lie above their median."""
    rows, columns = samples.shape

    def scaled(x: np.ndarray, n: int) -> np.ndarray:
        if n < SIDE:
            return x[(np.arange(SIDE) * n) // SIDE]
        edges = (np.arange(SIDE + 1) * n) // SIDE
        return np.add.reduceat(x, edges[:-1], axis=0) // np.diff(edges)[:, None]

    small = scaled(scaled(samples.astype(np.int64) * 256, rows).T, columns).T
    low = (COSINES @ small @ COSINES.T).ravel()
    bits = low > np.partition(low[1:], 31)[31]
    return np.packbits(bits).tobytes().hex()


def to_samples(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)


def write_media(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a PNG.

    Null counts as empty. Every row gives a row, repeats too; other columns are left out. A text may be as long as a
    PNG may be high: 2^31 rows of 64 bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for x in batch.column(1):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                sizes.append(len(raw))
                media.append(write_png(to_samples(raw + bytes(max(64, -len(raw) % 64 + len(raw)) - len(raw)))))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(write, f"doc_id {kind}, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and the cosine hash of each stored image, computed from the bytes read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                data = x.as_py()
                samples = read_png(data)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", *NAMES])

    NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
