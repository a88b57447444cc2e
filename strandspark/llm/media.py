"""Media columns: texts as PNG images in a binary column, read back with checksum tests, and hashed.

The payload is the text's UTF-8 bytes, padded with zeros to a positive multiple of 64; row i of the
8-bit grey image holds payload bytes 64 i to 64 i + 63. The image is stored losslessly as PNG: rows are
filtered (none, sub or up, whichever has the least sum of signed bytes), compressed by zlib and cut into
IDAT chunks with CRC-32. The reader tests every chunk's CRC and zlib's own checksum, undoes all five
filters in numpy and takes the sign of low-frequency cosine coefficients as a 63-bit perceptual hash.

Null text: empty. Empty text: one row of zeros. Very long texts: one image each, memory in proportion to
the text. Repeated rows: one result each. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.common import blocks, read_table

WIDTH, CHUNK = 64, 1 << 16
_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """Lossless PNG of an 8-bit grey image."""
    rows, width = image.shape
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    above = np.zeros_like(image)
    above[1:] = image[:-1]
    forms = np.stack([image, image - left, image - above])
    best = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    raw = np.empty((rows, width + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = best, forms[best, np.arange(rows)]
    packed = zlib.compress(raw.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)
    parts = [_MAGIC, _chunk(b"IHDR", head)]
    parts += [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def unfilter(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Undoes PNG's row filters for one byte a pixel; raw: rows x width, kinds: each row's filter."""
    out = raw.copy()
    sub = kinds == 1
    if sub.any():
        out[sub] = np.cumsum(raw[sub], axis=1, dtype=np.uint8)
    if not (kinds > 2).any():
        up = kinds == 2
        if up.any():
            total = np.cumsum(out, axis=0, dtype=np.uint8)
            first = np.maximum.accumulate(np.where(up, 0, np.arange(len(raw))))
            base = np.where((first > 0)[:, None], total[np.maximum(first - 1, 0)], np.uint8(0))
            out = np.where(up[:, None], total - base, out)
        return out
    above = np.zeros(raw.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        if kind == 2:
            out[y] = raw[y] + above
        elif kind > 2:
            a = c = 0
            row, line = raw[y].tolist(), []
            for x, b in enumerate(above.tolist()):
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    near = (abs(p - a), abs(p - b), abs(p - c))
                    guess = a if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else c
                a, c = (row[x] + guess) & 255, b
                line.append(a)
            out[y] = line
        above = out[y]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The image of an 8-bit grey PNG without interlacing; ValueError where a checksum fails."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, shape, inflate, body = 8, None, zlib.decompressobj(), []
    while True:
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + length]
        if zlib.crc32(part, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError(f"checksum of {kind!r} at {at}")
        at += 12 + length
        if kind == b"IHDR":
            width, rows, *rest = struct.unpack(">IIBBBBB", part)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError(f"unsupported form {rest}")
            shape = (rows, width + 1)
        elif kind == b"IDAT":
            body.append(inflate.decompress(part))
        elif kind == b"IEND":
            break
    body.append(inflate.flush())
    if not inflate.eof:
        raise ValueError("the image data end early")
    raw = np.frombuffer(b"".join(body), np.uint8).reshape(shape)
    return unfilter(raw[:, 1:], raw[:, 0])


_SIDE, _LOW = 32, 8
_COS = np.cos(np.pi * (2 * np.arange(_SIDE) + 1)[None, :] * np.arange(_LOW)[:, None] / (2 * _SIDE))


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine coefficients (the mean's bit is 0) exceed their median."""
    small = image.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        cuts = np.arange(_SIDE) * n // _SIDE
        if n >= _SIDE:
            width = np.diff(np.append(cuts, n)).reshape((-1, 1) if axis == 0 else (1, -1))
            small = np.add.reduceat(small, cuts, axis=axis) / width
        else:
            small = np.take(small, cuts, axis=axis)
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch], media: bool) -> Iterator[pa.RecordBatch]:
    for batch, body, offsets in blocks(batches, "text"):
        rows = []
        for i in range(batch.num_rows):
            text = body[offsets[i] : offsets[i + 1]]
            image = np.zeros((max(1, -(-len(text) // WIDTH)), WIDTH), np.uint8)
            image.ravel()[: len(text)] = text
            png = encode_png(image)
            back = decode_png(png)
            payload = back.tobytes()
            row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(back))
            rows.append((*row, png) if media else row)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * media
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * media
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=names)


def media_columns(docs: DataFrame, media: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): its digests, its cosine hash and, with `media`, the PNG itself."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _digests(it, media), _OUT + ", media binary" * media)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"), media=False)
