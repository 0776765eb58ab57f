"""Media columns: Netpbm and BMP bytes decoded to arrays, area-resized by integral images, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.shared import text_bytes

_HEAD = re.compile(rb"(?:\s*(?:#[^\n]*\n)?)*(\d+)")


def decode(data: bytes) -> np.ndarray:
    """Samples as (height, width, channels): uint8, or uint16 for Netpbm with a maximum above 255. ValueError if it isn't whole Netpbm (P1-P6) or an uncompressed 8, 24 or 32 bit BMP."""
    if data[:2] == b"BM":
        return _bmp(data)
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("neither Netpbm nor BMP")
    at, numbers = 2, []
    for _ in range(2 if kind in b"14" else 3):
        m = _HEAD.match(data, at)
        if not m:
            raise ValueError("broken header")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, most = (*numbers, 1)[:3]
    channels = 3 if kind in b"36" else 1
    n = width * height * channels
    if kind == b"1":
        flat = np.array([c - 48 for c in data[at:] if c in b"01"][:n], np.uint8)
    elif kind in b"23":
        flat = np.array(data[at:].split()[:n], dtype=np.int64).astype(np.uint8 if most < 256 else np.uint16)
    elif kind == b"4":
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, min(row * height, len(data) - at - 1), at + 1))
        flat = bits[: row * 8 * height].reshape(-1, row * 8)[:, :width].ravel() if row else bits[:0]
    else:
        size = 1 if most < 256 else 2
        flat = np.frombuffer(data, np.uint8 if size == 1 else ">u2", min(n, max(0, len(data) - at - 1) // size), at + 1)
    if len(flat) < n or not 0 < most < 65536:
        raise ValueError("too few samples")
    return (1 - flat if kind in b"14" else flat).reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("broken header")
    start, size, width, height = struct.unpack_from("<IIii", data, 10)
    bits, packed = struct.unpack_from("<HI", data, 28)
    if packed or bits not in (8, 24, 32) or width < 0:
        raise ValueError("a kind of BMP that is not read")
    row = (width * bits // 8 + 3) // 4 * 4
    if len(data) < start + row * abs(height):
        raise ValueError("too few samples")
    rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, 1024, 14 + size).reshape(256, 4) if start - 14 - size >= 1024 else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
        return colours[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def encode_pgm(samples: bytes, width: int) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def area_sums(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact sums over the cells of a grid laid on the image, times height * width of the grid, from its integral image.

    image: (h, w) integers. All cells have one area, h * w / (height * width), so sums compare as means do.
    """
    h, w = image.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(image, 0, dtype=np.int64), 1, out=total[1:, 1:])

    def at(whole: np.ndarray, n: int, parts: int) -> np.ndarray:
        low, rest = np.divmod(np.arange(parts + 1) * n, parts)
        return whole[low] * parts + (whole[np.minimum(low + 1, n)] - whole[low]) * rest[:, None]

    grid = at(at(total, h, height).T, w, width).T
    return np.diff(np.diff(grid, axis=0), axis=1)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image's (h, w, channels) means over a grid of cells, rounded, in its own type."""
    h, w, channels = image.shape
    if not h or not w:
        return np.zeros((height, width, channels), image.dtype)
    sums = np.stack([area_sums(image[:, :, c], height, width) for c in range(channels)], 2)
    return ((2 * sums + h * w) // (2 * h * w)).astype(image.dtype)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each cell of an 8 by 9 grid is brighter than its right neighbour; channels count alike."""
    grey = image.sum(2, dtype=np.int64)
    if not grey.size:
        return "0" * 16
    sums = area_sums(grey, 8, 9)
    return np.packbits(sums[:, :-1] > sums[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tiles(media: DataFrame, height: int = 32, width: int = 32, column: str = "media") -> DataFrame:
    """All columns of media but `column`, and tile (NPY bytes of the resized image), difference_hash, media_error.

    Null media gives null in all three; bytes that can't be decoded give the reason in media_error and null in the
    others. Columns of media that have these names are replaced. No shuffle.
    """
    rest = [c for c in media.columns if c not in (column, "tile", "difference_hash", "media_error")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(len(rest)).to_pylist():
                try:
                    image = None if data is None else decode(bytes(data))
                    out.append((None, None, None) if image is None else (npy(resize(image, height, width)), difference_hash(image), None))
                except ValueError as e:
                    out.append((None, None, str(e)))
            made = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.string(), pa.string()))]
            yield pa.record_batch([*batch.columns[: len(rest)], *made], names=[*rest, "tile", "difference_hash", "media_error"])

    kept = media.select(*(F.col(f"`{c}`") for c in [*rest, column]))
    schema = kept.select(*(F.col(f"`{c}`") for c in rest), F.lit(None).cast("binary").alias("tile"), F.lit(None).cast("string").alias("difference_hash"), F.lit(None).cast("string").alias("media_error")).schema
    return kept.mapInArrow(rows, schema)


def text_media(docs: DataFrame, width: int = 64, with_media: bool = False, with_digest: bool = False) -> DataFrame:
    """Texts as grey images: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The text's UTF-8, padded with zero bytes to a positive multiple of `width`, is stored as a binary PGM of that width;
    the other values come from the samples decoded from those bytes, feature is their difference hash. Null text
    counts as empty: one row of zeros. Null doc_ids stay, repeated rows repeat, other columns are left. with_media: also
    the PGM bytes and their 32 by 32 NPY tile; with_digest: also tile_sha256, that of the tile's bytes. One pass, no shuffle.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields + [("media", pa.binary()), ("tile", pa.binary())] * with_media + [("tile_sha256", pa.string())] * with_digest)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for doc, text in zip(part["doc_id"].to_pylist(), text_bytes(part["text"])):
                    media = encode_pgm(text + bytes(-len(text) % width or width * (not text)), width)
                    image = decode(media)
                    payload = image.tobytes()
                    own = (doc, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-width:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image))
                    if with_media or with_digest:
                        tile = npy(resize(image, 32, 32))
                        own += (media, tile) * with_media + (hashlib.sha256(tile).hexdigest(),) * with_digest
                    out.append(own)
                yield pa.record_batch([list(c) for c in zip(*out)] if out else [[] for _ in schema], schema=schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(rows, kind + ", media binary, tile binary" * with_media + ", tile_sha256 string" * with_digest)
