"""Operator 7, media columns: Netpbm and BMP decoded to numpy arrays, area-resized with integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, importable, slices, two, unused

WIDTH = 64
TILE = (16, 16)


def _header(buf: bytes, n: int, at: int = 2) -> tuple[list[int], int]:
    """n whitespace-separated numbers of a Netpbm header, comments skipped; the place after the last one."""
    out: list[int] = []
    while len(out) < n:
        while buf[at : at + 1].isspace():
            at += 1
        if buf[at : at + 1] == b"#":
            while at < len(buf) and buf[at] not in (10, 13):
                at += 1
            continue
        end = at
        while buf[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        out.append(int(buf[at:end]))
        at = end
    return out, at


def decode_netpbm(buf: bytes) -> np.ndarray:
    """P1 to P6 as (h, w) or (h, w, 3) arrays of uint8, or uint16 where maxval is over 255. Bitmaps give 0 for black, 255 for white."""
    kind = buf[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bits, depth = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    (w, h, *top), at = _header(buf, 2 if bits else 3)
    shape = (h, w, 3) if depth == 3 else (h, w)
    n = w * h * depth
    wide = bool(top) and top[0] > 255
    if kind == b"P4":
        rows = np.frombuffer(buf, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        return ((1 - np.unpackbits(rows, axis=1)[:, :w]) * 255).astype(np.uint8)
    if kind in (b"P5", b"P6"):
        return np.frombuffer(buf, ">u2" if wide else np.uint8, n, at + 1).reshape(shape).astype(np.uint16 if wide else np.uint8)
    body = b"\n".join(line.partition(b"#")[0] for line in buf[at:].split(b"\n"))
    if bits:
        cells = np.frombuffer(bytes(c for c in body if c in b"01"), np.uint8, n)
        return ((49 - cells) * 255).astype(np.uint8).reshape(shape)
    return np.array(body.split()[:n], dtype=np.uint16 if wide else np.uint8).reshape(shape)


def decode_bmp(buf: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (h, w) grey-palette or (h, w, 3) RGB arrays."""
    if buf[:2] != b"BM":
        raise ValueError("not BMP")
    start, head = struct.unpack_from("<II", buf, 10)
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", buf, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("BMP kind not supported")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(buf, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()
    used = struct.unpack_from("<I", buf, 46)[0] or 1 << bits
    palette = np.frombuffer(buf, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
    index = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(abs(h), -1)
    out = palette[index[:, :w]]
    return out[:, :, 0].copy() if (out[:, :, :1] == out).all() else out.copy()


def decode(buf: bytes) -> np.ndarray:
    return decode_bmp(buf) if buf[:2] == b"BM" else decode_netpbm(buf)


def encode_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Box means in float64 over equal real-valued cells, read from one integral image (linear between its points)."""
    a = a.reshape(a.shape[0], a.shape[1], -1).astype(np.float64)
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1, a.shape[2]))
    s[1:, 1:] = a.cumsum(0).cumsum(1)

    def along(x: np.ndarray, n: int) -> np.ndarray:
        at = np.arange(n + 1) * ((x.shape[0] - 1) / n)
        low = np.minimum(at.astype(int), x.shape[0] - 2)
        part = (at - low)[:, None, None]
        return x[low] * (1 - part) + x[low + 1] * part

    s = along(s, h)
    s = along(s.transpose(1, 0, 2), w).transpose(1, 0, 2)
    cell = (s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]) * (h * w / (a.shape[0] * a.shape[1]))
    return cell if cell.shape[2] > 1 else cell[:, :, 0]


def dhash(a: np.ndarray) -> str:
    """64-bit difference hash of the 8 x 9 area-resized grey image: is a cell brighter than the one to its left."""
    g = area_resize(a if a.ndim == 2 else a.mean(2), 8, 9)
    return np.packbits(g[:, 1:] > g[:, :-1] + 1e-9).tobytes().hex()


def to_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def from_npy(b: bytes) -> np.ndarray:
    return np.load(io.BytesIO(b), allow_pickle=False)


def media_columns(df: DataFrame, column: str, tile: tuple[int, int] = TILE) -> DataFrame:
    """Adds to a binary column of Netpbm or BMP images: npy (the whole array), tile_npy (area-resized uint8), dhash, height, width.

    Null or undecodable media give null in all of these. Rows, repeated ones too, are kept as they are; an empty
    table stays empty. Any other columns pass through; a new column whose name is taken gets an underscore more.
    """
    importable(df.sparkSession)
    kinds = {"npy": T.BinaryType(), "tile_npy": T.BinaryType(), "dhash": T.StringType(), "height": T.IntegerType(), "width": T.IntegerType()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in zip(unused(df, *kinds), kinds.values(), strict=True))])

    def one(buf: bytes | None) -> tuple:
        try:
            a = decode(buf) if buf is not None else None
        except (ValueError, struct.error, IndexError):
            a = None
        if a is None or 0 in a.shape:
            return (None,) * 5
        small = np.clip(np.rint(area_resize(a, *tile)), 0, 65535 if a.dtype == np.uint16 else 255).astype(a.dtype)
        return to_npy(a), to_npy(small), dhash(a), a.shape[0], a.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                made = list(zip(*[one(x.as_py()) for x in part.column(part.schema.get_field_index(column))], strict=True))
                kinds = (pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m, t) for m, t in zip(made, kinds, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema)


def payload_images(docs: DataFrame) -> DataFrame:
    """Each text (null: empty) as UTF-8, zero-padded to a positive multiple of 64 bytes, as a P5 image 64 samples wide."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            out = []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                raw = data[a:b].tobytes()
                raw += bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
                out.append(encode_pgm(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs)), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "image"])

    return two(docs).mapInArrow(run, "doc_id long, n_bytes long, image binary")


def text_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores all texts as NPY media in the shared folder, reads the stored bytes back and derives digests and features.

    One row per input row: null text counts as empty, an empty text is one row of 64 zero samples, repeated rows
    repeat their values, and an empty table gives no rows.
    """
    stored = Table(media_columns(payload_images(docs), "image").select("doc_id", "n_bytes", "npy", "tile_npy", "dhash"), "media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[] for _ in range(6)]
            for npy, tile in zip(batch.column(2), batch.column(3), strict=True):
                npy = npy.as_py()
                raw = from_npy(npy).tobytes()
                for c, v in zip(cols, (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(npy), hashlib.sha256(npy).hexdigest(), hashlib.sha256(tile.as_py()).hexdigest()), strict=True):
                    c.append(v)
            n, sha, crc, size, media, tile_sha = cols
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(media, pa.string()), batch.column(4), pa.array(tile_sha, pa.string())], names=[f.split()[0] for f in schema.split(", ")])

    return stored.read().select("doc_id", "n_bytes", "npy", "tile_npy", F.col("dhash")).mapInArrow(run, schema)
