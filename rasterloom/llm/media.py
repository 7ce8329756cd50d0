"""Operator 7: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as NPY tiles.

Bytes that are no such image decode to null columns with the reason in ``error``; a null stays null. Images of
any height are resized in bands of rows, so memory follows one row band, not the image. Repeated rows are rows like
any other, equal bytes give equal values, an empty table gives an empty result; columns with an output's name give
way to it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts, tidy

BAND = 2048


def encode_pgm(samples: bytes, width: int) -> bytes:
    """8-bit grey Netpbm (P5) of rows of ``width`` samples."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit bottom-up BMP of an (h, w, 3) RGB array."""
    h, w, _ = image.shape
    row = -(-3 * w // 4) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : 3 * w] = image[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + row * h, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, row * h, 2835, 2835, 0, 0) + body.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    need = 2 if kind in (1, 4) else 3
    fields, at = [], 2
    token = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")
    for _ in range(need):
        m = token.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = fields[0], fields[1], fields[2] if need == 3 else 1
    if not 0 < top < 65536 or w <= 0 or h <= 0:
        raise ValueError("bad Netpbm size or depth")
    channels = 3 if kind in (3, 6) else 1
    count = w * h * channels
    if kind == 1:
        a = np.array([c == 49 for c in data[at:] if c in (48, 49)][:count], np.int64)
        a = 1 - a
    elif kind in (2, 3):
        a = np.array(data[at:].split()[:count], np.int64)
    elif kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * (-(-w // 8)), at + 1).reshape(h, -1), axis=1)[:, :w]
        a = 1 - bits.reshape(-1).astype(np.int64)
    else:
        a = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at + 1)
    if a.size != count:
        raise ValueError("short Netpbm data")
    if top != 255:
        a = (a.astype(np.int64) * 255 + top // 2) // top
    a = a.astype(np.uint8, copy=False).reshape(h, w, channels)
    return a[:, :, 0] if channels == 1 else a


def _bmp(data: bytes) -> np.ndarray:
    start, head, w, h, _, bits, packing = struct.unpack("<4xI I ii HHI", data[6:10] + data[10:14] + data[14:34])
    flip, h = h > 0, abs(h)
    if packing or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("unsupported BMP")
    row = -(-w * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, row * h, start).reshape(h, row)
    if bits >= 24:
        a = raw[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
    else:
        index = np.unpackbits(raw, axis=1).reshape(h, -1, bits)[:, :w] @ (1 << np.arange(bits)[::-1])
        colours = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        a = colours[index][:, :, 2::-1]
    return a[::-1] if flip else a


def decode(data: bytes) -> np.ndarray:
    """(h, w) grey or (h, w, 3) RGB array of 8-bit samples of a Netpbm (P1 to P6) or uncompressed BMP file."""
    if len(data) > 2 and data[:1] == b"P" and 49 <= data[1] <= 54:
        return _netpbm(data)
    if data[:2] == b"BM" and len(data) >= 54:
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of the (fractional) source area under each target cell, from an integral image kept band by band."""
    src = image if image.ndim == 3 else image[:, :, None]
    h, w, c = src.shape
    xs, ys = np.linspace(0, w, width + 1), np.linspace(0, h, height + 1)
    x0 = np.minimum(xs.astype(np.int64), w - 1)
    xf = (xs - x0)[None, :, None]
    lines = np.empty((height + 1, width + 1, c))  # the integral image at every corner of the target grid
    lines[0] = 0
    done, carry = 1, np.zeros((1, width + 1, c))
    for top in range(0, h, BAND):
        rows = src[top : top + BAND].astype(np.float64)
        across = np.zeros((len(rows), w + 1, c))
        np.cumsum(rows, axis=1, out=across[:, 1:])
        at = across[:, x0] * (1 - xf) + across[:, x0 + 1] * xf
        down = np.concatenate([carry, carry + np.cumsum(at, axis=0)])
        while done <= height and ys[done] <= top + len(rows):
            y = ys[done] - top
            k = min(int(y), len(rows) - 1)
            lines[done] = down[k] * (1 - (y - k)) + down[k + 1] * (y - k)
            done += 1
        carry = down[-1:]
    area = (w / width) * (h / height)
    out = np.diff(np.diff(lines, axis=0), axis=1) / area
    out = np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)
    return out if image.ndim == 3 else out[:, :, 0]


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.floor(image @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Hex bits that tell, for a (side + 1) x side reduction, whether grey rises from each cell to the next."""
    small = area_resize(grey(image), side + 1, side).astype(np.int16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    """The array as an NPY file (version 1.0)."""
    head = f"{{'descr': '{np.lib.format.dtype_to_descr(array.dtype)}', 'fortran_order': False, 'shape': {array.shape}, }}".encode()
    head += b" " * (-(len(head) + 11) % 64) + b"\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head + np.ascontiguousarray(array).tobytes()


def media_columns(df: DataFrame, column: str, tile: int = 32) -> DataFrame:
    """``df`` with height, width, channels, tile (NPY of a ``tile`` x ``tile`` reduction), dhash and error."""
    kept = [f for f in df.schema.fields if f.name not in ("height", "width", "channels", "tile", "dhash", "error")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", height int, width int, channels int, tile binary, dhash string, error string"
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                found = []
                for data in batch.column(column).to_pylist():
                    row = [None] * 6
                    if data is not None:
                        try:
                            image = decode(data)
                            row = [image.shape[0], image.shape[1], 1 if image.ndim == 2 else image.shape[2], npy(area_resize(image, tile, tile)), difference_hash(image), None]
                        except (ValueError, IndexError, struct.error) as e:
                            row[5] = str(e)
                    found.append(row)
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
                cols = [pa.array(list(x), k) for x, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + cols, names=[*names, "height", "width", "channels", "tile", "dhash", "error"])

    return df.mapInArrow(tidy(run), schema)


def text_as_media(df: DataFrame, key: str = "doc_id", column: str = "text", width: int = 64, tile: int = 16) -> DataFrame:
    """Texts as grey Netpbm images of ``width`` samples a row, read back, and described.

    The payload is the UTF-8 text (null: empty) with zero bytes up to a positive multiple of ``width``. Digests
    and the feature come from what ``decode`` finds in the stored bytes.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                out = []
                for raw in texts(batch.column(column)):
                    stored = encode_pgm(raw + bytes(-len(raw) % width or (0 if raw else width)), width)
                    image = decode(stored)
                    payload = image.tobytes()
                    out.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), zlib.crc32(npy(area_resize(image, tile, tile)))))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                cols = [pa.array(list(x), k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([batch.column(key), *cols], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_crc32"])

    return df.select(key, column).mapInArrow(tidy(run), schema)
