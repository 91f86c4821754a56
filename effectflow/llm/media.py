"""Media columns: Netpbm and BMP to numpy arrays, area resize by integral images, NPY tiles, difference hashes.

A media column is a binary column. ``decode`` reads the stored bytes, ``area_resize`` averages over exact
(fractional) boxes with a summed-area table, ``difference_hash`` compares neighbours of a 9 x 8 grey tile and
``npy_tile`` writes an array in the NPY format. The file headers are the formats' own.

Read are Netpbm P1 to P6 (one-byte and two-byte samples of any maximum, scaled to 8 bits) and uncompressed BMP of 1, 4, 8,
24 and 32 bits, bottom-up or top-down. Anything else, and any picture whose bytes don't fill its size, is a ValueError
in ``decode`` and null in a column: one bad picture costs its own row only.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from effectflow.llm.common import per_row, plain_text, read

#: Samples of a row of the picture that a text is stored as: 64 pixels of three bytes.
ROW_BYTES = 192
#: The formats that texts are stored in, in turn by their bytes.
FORMATS = ("P6", "BMP", "P5")

_GAP = rb"(?:\s|#[^\n]*\n)+"
_SIZE = _GAP + rb"(\d{1,9})"
_HEADER = re.compile(rb"P([1-6])" + _SIZE + _SIZE)
_MAXIMUM = re.compile(_SIZE)


def encode_ppm(pixels: np.ndarray) -> bytes:
    """P6 for (height, width, 3), P5 for (height, width); 8-bit samples."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP, rows from the bottom, padded to four bytes."""
    height, width = pixels.shape[:2]
    stride = -(-3 * width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack(
        "<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0,
    ) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    m = _HEADER.match(data)
    if not m:
        raise ValueError("not a Netpbm or BMP header")
    kind, width, height, at = int(m[1]), int(m[2]), int(m[3]), m.end()
    if not width or not height:
        raise ValueError("a picture without pixels")
    most = 1
    if kind not in (1, 4):
        top = _MAXIMUM.match(data, at)
        if not top or not 0 < int(top[1]) < 65536:
            raise ValueError("no maximum of samples")
        most, at = int(top[1]), top.end()
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = width * height * (3 if kind in (3, 6) else 1)
    if kind > 3:
        at += 1  # one white space ends the header
        stride = -(-width // 8)
        size = height * stride if kind == 4 else n * (2 if most > 255 else 1)
        if len(data) - at < size:
            raise ValueError("bytes are missing")
        flat = np.frombuffer(data, ">u2" if kind > 4 and most > 255 else np.uint8, size // (2 if kind > 4 and most > 255 else 1), at)
        values = np.unpackbits(flat.reshape(height, stride), axis=1)[:, :width] if kind == 4 else flat.reshape(shape)
    else:
        if len(data) - at < n:  # a sample takes a byte at least
            raise ValueError("samples are missing")
        body = re.sub(rb"#[^\n]*", b" ", data[at:])
        found = re.findall(rb"[01]", body) if kind == 1 else body.split()
        if len(found) < n or any(len(x) > 5 or not x.isdigit() for x in found[:n]):
            raise ValueError("samples are missing")
        values = np.array([int(x) for x in found[:n]], np.int64).reshape(shape)
    if kind in (1, 4):
        return ((1 - values) * 255).astype(np.uint8)  # 1 is black
    if most == 255 and values.dtype == np.uint8:
        return values
    return ((np.minimum(values, most).astype(np.int64) * 510 + most) // (2 * most)).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("a BMP header is 54 bytes")
    start, header = struct.unpack_from("<II", data, 10)
    width, signed, planes, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    height = abs(signed)
    if header < 40 or bits not in (1, 4, 8, 24, 32) or packed or planes != 1 or width <= 0 or not height:
        raise ValueError("only uncompressed BMP of 1, 4, 8, 24 or 32 bits")
    stride = -(-width * bits // 32) * 4
    if len(data) - start < height * stride:
        raise ValueError("bytes are missing")
    rows = np.frombuffer(data, np.uint8, height * stride, start).reshape(height, stride)
    rows = rows if signed < 0 else rows[::-1]
    if bits >= 24:
        each = bits // 8
        return rows[:, : each * width].reshape(height, width, each)[:, :, 2::-1]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    if used > 1 << bits or len(data) < 14 + header + 4 * used:
        raise ValueError("no palette")
    palette = np.zeros((1 << bits, 3), np.uint8)
    palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(used, 4)[:, 2::-1]
    places = np.unpackbits(rows, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])
    return palette[places[:, :width]]


def decode(data: bytes) -> np.ndarray:
    """Pixels of a stored picture, (height, width) or (height, width, 3), 8 bits; ValueError where it can't be read."""
    return _bmp(data) if data[:2] == b"BM" else _netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    """The mean of the channels as float."""
    return pixels.mean(axis=2, dtype=np.float64) if pixels.ndim == 3 else pixels.astype(np.float64)


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact box, from a summed-area table read at fractional corners."""
    table = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1))
    np.cumsum(np.cumsum(plane, axis=0), axis=1, out=table[1:, 1:])

    def at(table: np.ndarray, n: int, cells: int) -> np.ndarray:
        edge = np.linspace(0, n, cells + 1)
        low = np.minimum(edge.astype(int), n - 1)
        part = (edge - low).reshape(-1, 1)
        return table[low] * (1 - part) + table[low + 1] * part

    corners = at(at(table, plane.shape[0], height).T, plane.shape[1], width).T
    boxes = np.diff(np.diff(corners, axis=0), axis=1)
    return boxes * (height * width / (plane.shape[0] * plane.shape[1]))


def difference_hash(plane: np.ndarray) -> str:
    """64 bits, hex: whether each cell of an 8 x 9 tile is darker than its right neighbour."""
    tile = np.rint(area_resize(plane, 8, 9) * 16)
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy_tile(plane: np.ndarray, side: int = 16) -> bytes:
    """A side x side tile of 8-bit means, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(plane, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def text_payload(text: str) -> bytes:
    """UTF-8, padded with spaces to a positive multiple of 192."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW_BYTES if raw else ROW_BYTES)


def text_to_media(text: str) -> tuple[int, bytes]:
    """Unpadded bytes of the text, and the payload stored losslessly as a picture.

    Rows have 192 samples: 64 columns of P6 or BMP, 192 of P5. The checksum of the payload says which, so equal texts have
    equal pictures.
    """
    payload = text_payload(text)
    kind = FORMATS[zlib.crc32(payload) % len(FORMATS)]
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    pixels = samples if kind == "P5" else samples.reshape(-1, ROW_BYTES // 3, 3)
    return len(text.encode("utf-8", "surrogatepass")), encode_bmp(pixels) if kind == "BMP" else encode_ppm(pixels)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: every whole text stored as a picture, a row each.

    Null and empty texts are one row of spaces, very long ones a tall picture; repeated rows stay repeated, ties have
    nothing to decide, extra columns fall away, an empty table gives an empty result. No shuffle.
    """
    return per_row(
        docs.select(id_col, plain_text(text_col).alias("text")), lambda i, t: (i, *text_to_media(t)),
        f"{id_col} long, n_bytes long, media binary",
    )


def _described(media: bytes | None) -> tuple[np.ndarray | None, bytes | None, str | None]:
    """Pixels, NPY tile and difference hash; nulls for null or unreadable bytes."""
    try:
        pixels = decode(media or b"")
    except ValueError:
        return None, None, None
    plane = grey(pixels)
    return pixels, npy_tile(plane), difference_hash(plane)


def tiles(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, height, width, tile (NPY), dhash for every row of a media column; nulls where it can't be read.

    Null and empty bytes can't be read; repeated rows stay repeated, further columns fall away, an empty table gives an
    empty result. A picture of any size is one row in memory. No shuffle.
    """

    def row(key: int, data: bytes | None) -> tuple:
        pixels, tile, dhash = _described(data)
        return key, *(pixels.shape[:2] if pixels is not None else (None, None)), tile, dhash

    return per_row(media.select(id_col, media_col), row, f"{id_col} long, height long, width long, tile binary, dhash string")


def digest(media: DataFrame) -> DataFrame:
    """The contract's columns, from the stored bytes read back, and the tile as it is written. A picture that can't be
    read has nulls."""

    def row(key: int, n_bytes: int, data: bytes | None) -> tuple:
        pixels, tile, dhash = _described(data)
        if pixels is None:
            return key, n_bytes, None, None, None, len(data or b""), hashlib.sha256(data or b"").hexdigest(), None, None
        payload = pixels.tobytes()
        feature = f"{dhash}:{zlib.crc32(tile):08x}"
        said = hashlib.sha256(payload).hexdigest()
        return key, n_bytes, len(payload), said, zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, tile

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return per_row(media.select("doc_id", "n_bytes", "media"), row, kinds)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a picture, read back and described."""
    return digest(store_texts(read(spark, sf_dir, "documents")))
