"""Media columns: payloads as greyscale PNG in binary columns, read back with all checks, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import small_batches

#: Fixed value: the eight bytes that a PNG starts with.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of compressed data in an IDAT chunk.
CHUNK = 1 << 16
#: Rows whose filters are weighed at a time.
ROWS = 1 << 14
SIDE, LOW = 32, 8
#: Fixed value: no byte of compressed data stands for more than this many; a header that claims more is wrong.
MOST_EACH = 1032


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """Payload as rows of 64 samples, 8 bits each; its size is a positive multiple of 64.

    Rows are filtered as they are, by their left or by their upper neighbour, whichever sum of differences is least.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    votes = np.zeros(3, np.int64)
    for a in range(0, len(image), ROWS):
        own = image[a : a + ROWS]
        up = np.vstack([image[a - 1 : a] if a else np.zeros((1, WIDTH), np.uint8), own[:-1]])
        left = np.hstack([np.zeros((len(own), 1), np.uint8), own[:, :-1]])
        cost = np.abs(np.stack([own - left, own - up]).view(np.int8).astype(np.int16)).sum(axis=2)
        votes += np.bincount(np.argmin(np.stack([own.sum(axis=1, dtype=np.int64), *cost]), axis=0), minlength=3)
    best = int(votes.argmax())  # one filter for an image: it can be undone for all rows at once
    raw = np.empty((len(image), WIDTH + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = best, image
    if best == 1:
        raw[:, 2:] -= image[:, :-1]
    elif best == 2:
        raw[1:, 1:] -= image[:-1]
    packed = zlib.compress(raw.data, level)
    head = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    near = min(abs(p - a), abs(p - b), abs(p - c))
    return a if near == abs(p - a) else b if near == abs(p - b) else c


def unfilter(kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the filters of greyscale rows; runs of rows with the same filter are undone together where that is possible."""
    out = rows.copy()
    edges = np.flatnonzero(np.diff(kind)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(kind)]):
        above = out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind[a] == 1:
            out[a:b] = np.cumsum(rows[a:b], axis=1, dtype=np.uint8)
        elif kind[a] == 2:
            out[a:b] = np.cumsum(np.vstack([above[None], rows[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind[a] in (3, 4):
            for y in range(a, b):
                up, own, left = (out[y - 1] if y else above).tolist(), rows[y].tolist(), 0
                for x, value in enumerate(own):
                    guess = (left + up[x]) // 2 if kind[a] == 3 else _paeth(left, up[x], up[x - 1] if x else 0)
                    own[x] = left = (value + guess) & 255
                out[y] = own
        elif kind[a] != 0:
            raise ValueError(f"unknown filter {kind[a]}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale PNG. ValueError if the signature, a checksum, the order or a size is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", data.ljust(at + 12 + size, b"\0"), at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in {kind!r}")
        if (kind == b"IHDR") != (at == 8):
            raise ValueError("the header is missing, or stands twice")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("a header of the wrong size")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not header or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("cut off, or not 8-bit greyscale")
    width, height = header[:2]
    if not packed:
        raise ValueError("no data")
    if not width or not height or height * (width + 1) > MOST_EACH * sum(map(len, packed)):
        raise ValueError("no samples, or more than its data can hold")
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(packed), height * (width + 1) + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width + 1) or not unpack.eof:
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))


COSINES = _cosines()


def _means(image: np.ndarray) -> np.ndarray:
    """The rows averaged, or repeated, to SIDE rows."""
    n = len(image)
    if n < SIDE:
        return image[np.arange(SIDE) * n // SIDE].astype(np.float64)
    edge = np.arange(SIDE) * n // SIDE
    return np.add.reduceat(image, edge, axis=0, dtype=np.float64) / np.diff([*edge, n])[:, None]


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: which low-frequency coefficients of the cosine transform exceed their median."""
    small = _means(_means(image).T).T
    low = (COSINES @ small @ COSINES.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the text's UTF-8, padded with zero bytes to a positive multiple of 64, as a PNG.

    Null texts are empty, and an empty text is one row of zeros. Equal texts give equal media, repeated rows repeated
    ones; a text of any length is one image, and its memory a few times its size. An empty table gives no rows; further
    columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            media = [encode_png(x.ljust(max(1, -(-len(x) // WIDTH)) * WIDTH, b"\0")) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Decode a media column: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error.

    A medium that fails a check (signature, order, checksum, size, filter) gives its error and nulls for what can't be
    known; a null one gives nulls.
    """
    small_batches(stored.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"

    def row(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 7
        own = len(media), hashlib.sha256(media).hexdigest()
        try:
            image = decode_png(media)
        except ValueError as e:
            return None, None, None, *own, None, str(e)
        payload = image.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, cosine_hash(image), None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            columns = list(zip(*map(row, batch.column(2).to_pylist()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], names=[x.split()[0] for x in schema.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(work, schema)
