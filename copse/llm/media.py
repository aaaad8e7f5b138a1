"""Media columns: Netpbm and BMP images in binary columns, NPY tiles and difference hashes.

decode() turns a PBM, PGM or PPM (P1-P6) or an uncompressed BMP (8, 24 or 32 bits) into a numpy array;
resize() averages areas by integral images; tiles() cuts an array into NPY tiles. For texts, the UTF-8
bytes, padded with 255 to a positive multiple of 576, are the samples of a PGM 64 wide; its tiles are
written to a table in the shared folder, and everything that is reported is computed from the tiles as
read back.

Defined results: a null text is empty and becomes one padded block; equal texts give equal values; an
image that cannot be decoded raises ValueError in decode() and gives null features in image_features().
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, WIDTH, FILL = 576, 64, 255
#: Rows of a tile; a multiple of BLOCK / WIDTH.
TILE_ROWS = 4608
HASH_ROWS, HASH_COLUMNS = 8, 9


def decode(data: bytes) -> np.ndarray:
    """Samples as (rows, columns) or (rows, columns, 3), 8 or 16 bits."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    if re.match(rb"P[1-6]\s", data):
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, found = data[1] - 48, 2, []
    token = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")
    while len(found) < (2 if kind in (1, 4) else 3):
        m = token.match(data, at)
        if not m:
            raise ValueError("Netpbm header cut short")
        found.append(int(m[1]))
        at = m.end()
    columns, rows, most = *found, *([1] if kind in (1, 4) else [])
    depth = 3 if kind in (3, 6) else 1
    n = rows * columns * depth
    if kind == 1:
        flat = np.array([c - 48 for c in re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n]], np.uint8)
    elif kind < 4:
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], np.uint16 if most > 255 else np.uint8)
    elif kind == 4:
        packed = np.frombuffer(data, np.uint8, rows * -(-columns // 8), at + 1)
        flat = np.unpackbits(packed.reshape(rows, -1), axis=1)[:, :columns].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(flat) != n:
        raise ValueError("Netpbm samples cut short")
    if kind in (1, 4):
        flat = (1 - flat) * 255  # in bitmaps 1 is black
    return flat.reshape((rows, columns, 3) if depth == 3 else (rows, columns))


def encode_pgm(samples: np.ndarray) -> bytes:
    rows, columns = samples.shape
    return b"P5\n%d %d\n255\n" % (columns, rows) + np.ascontiguousarray(samples, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    start, header, columns, rows, _, bits, packing = struct.unpack_from("<4xIIiiHHI", data, 6)
    if bits not in (8, 24, 32) or packing not in (0, 3 if bits == 32 else 0):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    stride, height = -(-columns * bits // 32) * 4, abs(rows)
    lines = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    if rows > 0:
        lines = lines[::-1]  # stored from the bottom
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)[:, 2::-1]
        return palette[lines[:, :columns]]
    return lines[:, : columns * bits // 8].reshape(height, columns, bits // 8)[:, :, 2::-1].copy()


def encode_bmp(samples: np.ndarray) -> bytes:
    """24 bits a pixel, from (rows, columns, 3)."""
    rows, columns, _ = samples.shape
    stride = -(-columns * 3 // 4) * 4
    lines = np.zeros((rows, stride), np.uint8)
    lines[:, : columns * 3] = samples[::-1, :, ::-1].reshape(rows, -1)
    size = stride * rows
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + size, 0, 54, 40, columns, rows, 1, 24, 0, size, 2835, 2835, 0, 0) + lines.tobytes()


def grey(samples: np.ndarray) -> np.ndarray:
    """Luma of a colour image in whole numbers; grey images as they are."""
    if samples.ndim == 2:
        return samples
    s = samples.astype(np.int64)
    return (299 * s[:, :, 0] + 587 * s[:, :, 1] + 114 * s[:, :, 2]) // 1000


def resize(samples: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Exact area means of rows x columns equal cells, by an integral image.

    A cell's edge may cut a pixel; the integral image is linear inside a pixel, so it is interpolated
    there. An image of no pixels gives zeros.
    """
    h, w = samples.shape
    if not h or not w:
        return np.zeros((rows, columns))

    def sums(table: np.ndarray, n: int, parts: int) -> np.ndarray:
        edge = np.arange(parts + 1) * n
        low, part = edge // parts, (edge % parts) / parts
        high = np.minimum(low + 1, n)
        return table[low] * (1 - part)[:, None] + table[high] * part[:, None]

    # Rows first: an integral over rows, then over the few columns left, so the image is read once.
    down = np.zeros((h + 1, w))
    np.cumsum(samples, axis=0, out=down[1:])
    strips = np.diff(sums(down, h, rows), axis=0)
    across = np.zeros((w + 1, rows))
    np.cumsum(strips.T, axis=0, out=across[1:])
    return np.diff(sums(across, w, columns), axis=0).T / (h / rows * w / columns)


def difference_hash(samples: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 cells is brighter than its right neighbour."""
    cells = resize(grey(samples), HASH_ROWS, HASH_COLUMNS)
    return np.packbits(cells[:, :-1] > cells[:, 1:] + 1e-9).tobytes().hex()


def tiles(samples: np.ndarray, rows: int = TILE_ROWS) -> bytes:
    """NPY files of strips of at most so many rows, one after the other."""
    out = io.BytesIO()
    for at in range(0, max(1, len(samples)), rows):
        np.lib.format.write_array(out, np.ascontiguousarray(samples[at : at + rows]), allow_pickle=False)
    return out.getvalue()


def untile(data: bytes) -> np.ndarray:
    f, found = io.BytesIO(data), []
    while f.tell() < len(data):
        found.append(np.lib.format.read_array(f, allow_pickle=False))
    return np.concatenate(found)


STORED = "doc_id bigint, n_bytes bigint, media binary"
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def by_row(df: DataFrame, ddl: str, row) -> DataFrame:
    """mapInArrow of row(doc_id, ...) -> tuple, a few rows to an output batch so that long ones don't add up."""
    schema = common.arrow_schema(ddl)

    def make():
        def step(batch):
            for at in range(0, batch.num_rows, 256):
                got = [row(*x) for x in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

        return step

    return common.map_batches(df, make, ddl)


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as the NPY tiles of its image: doc_id, n_bytes, media."""

    def row(doc, text):
        raw = text or b""
        size = max(BLOCK, -(-len(raw) // BLOCK) * BLOCK)
        image = encode_pgm(np.frombuffer(raw + bytes([FILL]) * (size - len(raw)), np.uint8).reshape(-1, WIDTH))
        return doc, len(raw), tiles(decode(image))

    return by_row(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")), STORED, row)


def media_features(stored: DataFrame) -> DataFrame:
    """Sizes, digests and difference hash of stored tiles."""

    def row(doc, n_bytes, media):
        samples = untile(media)
        payload = samples.tobytes()
        return (doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(samples))

    return by_row(stored.select("doc_id", "n_bytes", "media"), FEATURES, row)


def image_features(images: DataFrame, key: str, image: str) -> DataFrame:
    """For a table of encoded images: doc_id (the key), rows, columns, NPY tiles and difference hash."""

    def row(doc, data):
        try:
            samples = decode(data or b"")
        except (ValueError, struct.error, IndexError):
            return doc, None, None, None, None
        return doc, samples.shape[0], samples.shape[1], tiles(samples), difference_hash(samples)

    return by_row(images.select(F.col(key).cast("bigint"), F.col(image)), "doc_id bigint, rows bigint, columns bigint, media binary, feature string", row)


def text_features(docs: DataFrame) -> DataFrame:
    return media_features(common.materialise(text_media(docs), "media"))
