"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, kept as NPY tiles.

``decode_image`` reads PBM, PGM, PPM (plain and raw, 8 or 16 bit) and uncompressed BMP (1, 4, 8, 24, 32 bit).
``media_columns`` turns a binary column into tiles and difference hashes; ``payload_media`` stores texts as
raw PGM images, reads them back and computes the same features.

Null, empty or undecodable images give null tiles and hashes and ``error`` says why; nothing is dropped.
Memory follows the largest image of a batch.  Very long texts are long images; repeated rows and ties (equal images)
get equal values; an empty table gives no row; only the id and the image or text are read, so other columns,
whatever their names, do not matter and are not passed on.
"""

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

from .textarrays import arrow_map, slices

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


class ImageError(ValueError):
    pass


def _small(digits: bytes) -> bool:
    """Whether these bytes are a number below 10 ** 10: more digits are no size or sample, whatever they say."""
    return digits.isdigit() and len(digits.lstrip(b"0")) <= 10 and len(digits) <= 1000


def decode_netpbm(raw: bytes) -> np.ndarray:
    """(height, width, channels) array of uint8 or uint16; P1 and P4 give 0 for black, 255 for white."""
    kind = raw[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ImageError("not Netpbm")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(raw, at)
        if not m or not _small(m[1]):
            raise ImageError("bad Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    most = head[2] if len(head) == 3 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not width or not height or not 0 < most < 65536:
        raise ImageError("bad Netpbm size")
    n = width * height * channels
    wide = np.dtype(">u2") if most > 255 else np.dtype("u1")
    if kind == b"P4":
        row = (width + 7) // 8
        if len(raw) - at - 1 < row * height:
            raise ImageError("short Netpbm body")
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)[..., None]
    if kind == b"P1":
        digits = re.sub(rb"#[^\n\r]*|\s", b"", raw[at:])[:n]
        if len(digits) < n or digits.strip(b"01"):
            raise ImageError("bad Netpbm body")
        return ((49 - np.frombuffer(digits, np.uint8)) * 255).astype(np.uint8).reshape(height, width, 1)
    if kind in (b"P2", b"P3"):
        numbers = re.sub(rb"#[^\n\r]*", b"", raw[at:]).split()[:n]
        if len(numbers) < n or not all(_small(x) and int(x) <= most for x in numbers):
            raise ImageError("bad Netpbm body")
        flat = np.array([int(x) for x in numbers], np.uint16 if most > 255 else np.uint8)
    else:
        if len(raw) - at - 1 < n * wide.itemsize:
            raise ImageError("short Netpbm body")
        flat = np.frombuffer(raw, wide, n, at + 1)
        flat = flat.astype(np.uint16) if most > 255 else flat
    return flat.reshape(height, width, channels)


def decode_bmp(raw: bytes) -> np.ndarray:
    """(height, width, 1 or 3) array of uint8 from an uncompressed bitmap; alpha is left out."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ImageError("not BMP")
    body, head, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", raw, 10)
    if packing != 0 or depth not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ImageError("unsupported BMP")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if len(raw) < body + stride * rows:
        raise ImageError("short BMP body")
    lines = np.frombuffer(raw, np.uint8, stride * rows, body).reshape(rows, stride)
    if height > 0:
        lines = lines[::-1]
    if depth >= 24:
        step = depth // 8
        return lines[:, : width * step].reshape(rows, width, step)[..., 2::-1]
    if depth == 8:
        index = lines[:, :width]
    elif depth == 4:
        index = np.stack([lines >> 4, lines & 15], axis=2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(lines, axis=1)[:, :width]
    start = 14 + head
    colours = np.zeros((256, 4), np.uint8)
    have = np.frombuffer(raw[start:body], np.uint8)
    have = have[: min(len(have) // 4, 1 << depth) * 4].reshape(-1, 4)
    colours[: len(have)] = have
    if int(index.max(initial=0)) >= len(have):
        raise ImageError("BMP colour outside its table")
    picture = colours[index][..., 2::-1]
    grey = (picture[..., 0] == picture[..., 1]).all() and (picture[..., 1] == picture[..., 2]).all()
    return picture[..., :1] if grey else picture


def decode_image(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples).tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each output pixel's exact area, from one integral image; fractional edges are interpolated."""
    h, w, c = image.shape

    def edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(np.int64), n)
        return low, at - low

    (y, fy), (x, fx) = edges(h, height), edges(w, width)
    total = np.zeros((h + 2, w + 2, c))  # one more row and column, so that an edge at the end can be read
    np.cumsum(image, axis=0, out=total[1:-1, 1:-1], dtype=np.float64)
    np.cumsum(total[1:-1, 1:-1], axis=1, out=total[1:-1, 1:-1])
    total[-1], total[:, -1] = total[-2], total[:, -2]
    rows = total[y] * (1 - fy)[:, None, None] + total[y + 1] * fy[:, None, None]
    both = rows[:, x] * (1 - fx)[None, :, None] + rows[:, x + 1] * fx[None, :, None]
    sums = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return sums / ((h / height) * (w / width))


def to_grey(image: np.ndarray) -> np.ndarray:
    wide = image.astype(np.float64) / (257 if image.dtype == np.uint16 else 1)
    return wide[..., 0] if image.shape[2] == 1 else wide @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """side * side bits in hexadecimal: is each cell of a (side, side + 1) grid darker than its right neighbour?"""
    grid = np.round(area_resize(to_grey(image)[..., None], side, side + 1)[..., 0], 6)
    return np.packbits(grid[:, :-1] < grid[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The image resized to side x side as an NPY file of uint8."""
    eight = image // 257 if image.dtype == np.uint16 else image
    tile = np.clip(np.rint(np.round(area_resize(eight, side, side), 6)), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, version=(1, 0))
    return out.getvalue()


def read_tile(raw: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(raw), allow_pickle=False)


def media_columns(df: DataFrame, id_col: str, image_col: str, side: int = 32) -> DataFrame:
    """One row per row of df: id, height, width, channels, tile (NPY), dhash, error."""
    schema = pa.schema([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                try:
                    if raw is None:
                        raise ImageError("null")
                    image = decode_image(bytes(raw))
                    rows.append((*image.shape, npy_tile(image, side), difference_hash(image), None))
                except ImageError as e:
                    rows.append((None, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names=["id", *schema.names])

    kind = df.schema[id_col].dataType.simpleString()
    out = f"`id` {kind}, height int, width int, channels int, tile binary, dhash string, error string"
    return df.select(df[id_col].alias("id"), df[image_col].alias("image")).transform(arrow_map, run, out).withColumnRenamed("id", id_col)


#: Payloads are images of this width, so that every multiple of it has a whole number of rows.
WIDTH = 64
PAYLOAD_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def payload_row(text: bytes, side: int = 32) -> tuple:
    n = len(text)
    padded = text + bytes(-n % WIDTH if n else WIDTH)
    stored = encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))
    image = decode_image(stored)  # from here on only what was read back counts
    payload = image.tobytes()
    tile = npy_tile(image, side)
    return (
        n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(),
        difference_hash(image), hashlib.sha256(tile).hexdigest(), stored, tile,
    )


def payload_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Every text (null: empty) as a raw PGM image of 64 columns, read back: digests, difference hash and tile digest.

    Bytes 0 fill the last row; an empty text is one row of them.  Equal texts give equal values.  With ``keep``
    the image file and its NPY tile are columns too (media, tile).
    """
    schema = PAYLOAD_SCHEMA + (", media binary, tile binary" if keep else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                rows = [payload_row(data[a:b].tobytes())[: len(names)] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *arrays], names=["id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).transform(arrow_map, run, f"`id` {kind}, {schema}").withColumnRenamed("id", id_col)
