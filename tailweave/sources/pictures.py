"""Files of one picture or film, written without further libraries: GeoTIFF rasters, GIF films, PNG plots of scores.

Tables of pictures (``film_frames``, ``tiff_bands``) are encoded by the tasks that hold a frame or band, and scale with the rows.  A single file, as
``write_film`` and ``write_tiff`` make it, goes through the driver frame by frame or band by band, to any file system Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import raster_metadata


def write_bytes(spark: SparkSession, path: str, pieces: Iterable[bytes]) -> None:
    """One file of the pieces; folders are made, a file that is there is replaced."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for piece in pieces:
            out.write(bytearray(piece))
    finally:
        out.close()


def planes(df: DataFrame, key: str, value: str, kind: str) -> Iterator[tuple[object, np.ndarray]]:
    """(key, values by cell) in order of the key, one at a time; absent and NULL values are NaN, or 0 for whole numbers."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("cell", F.col(value).cast(kind).alias("v")))).alias("x"), F.max("cell").alias("last")).orderBy(key)
    for row in rows.toLocalIterator():
        out = np.full(row["last"] + 1, 0 if kind == "int" else np.nan, np.int64 if kind == "int" else np.float64)
        for x in row["x"]:
            if x["v"] is not None:
                out[x["cell"]] = x["v"]
        yield row[key], out


def geotiff_bytes(bands: list[np.ndarray], lat: list[float], lon: list[float]) -> bytes:
    """Uncompressed float32 bands (height x width, north first) with pixel scale, tie point and EPSG:4326."""
    m = raster_metadata(lat, lon)
    height, width = m["height"], m["width"]
    body = b"".join(np.asarray(b, "<f4").reshape(height, width).tobytes() for b in bands)
    doubles = struct.pack("<3d", m["pixel_x"], m["pixel_y"], 0.0) + struct.pack("<6d", 0, 0, 0, m["west"], m["north"], 0)
    #: GeoTIFF keys of a geographic raster with area pixels in EPSG:4326.
    keys = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
    n, size = len(bands), height * width * 4

    def block(at: int, kind: str, values: list[int]) -> tuple[bytes, bytes]:
        """(the entry's value field, what has to stand at ``at``)."""
        raw = struct.pack(f"<{len(values)}{kind}", *values)
        return (raw.ljust(4, b"\0"), b"") if len(raw) <= 4 else (struct.pack("<I", at), raw)

    entries, extra = [], b""
    first = 8 + 2 + 15 * 12 + 4  # after the header and a directory of 15 entries
    start = first + 4 * 8 * n + len(doubles) + len(keys)  # of the pixels; room for four lists of n numbers
    short, long_, double = 3, 4, 12
    lists = [
        (256, long_, "I", [width]), (257, long_, "I", [height]), (258, short, "H", [32] * n), (259, short, "H", [1]), (262, short, "H", [1]), (273, long_, "I", [start + k * size for k in range(n)]),
        (277, short, "H", [n]), (278, long_, "I", [height]), (279, long_, "I", [size] * n), (284, short, "H", [2]), (338, short, "H", [0] * max(1, n - 1)), (339, short, "H", [3] * n),
    ]
    for tag, kind, letter, values in lists:
        field, raw = block(first + len(extra), letter, values)
        entries.append(struct.pack("<HHI", tag, kind, len(values)) + field)
        extra += raw
    for tag, kind, count, raw in ((33550, double, 3, doubles[:24]), (33922, double, 6, doubles[24:]), (34735, short, 16, keys)):
        entries.append(struct.pack("<HHII", tag, kind, count, first + len(extra)))
        extra += raw
    directory = struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8) + directory + extra.ljust(start - first, b"\0") + body


def write_tiff(bands: DataFrame, path: str, lat: list[float], lon: list[float]) -> None:
    """bands(band, cell, value) as one GeoTIFF; its bands have to fit the driver, as any one file has to fit a machine."""
    own = [values for _, values in planes(bands, "band", "value", "double")]
    size = len(lat) * len(lon)
    full = [np.concatenate([b, np.full(size - len(b), np.nan)]) for b in own]
    write_bytes(bands.sparkSession, path, [geotiff_bytes(full, lat, lon)])


def gif_frame(pixels: np.ndarray, width: int, height: int, delay: int) -> bytes:
    """One frame of bytes: 9-bit codes, with a clear code before the table could grow past them."""
    codes = []
    for a in range(0, pixels.size, 254):
        codes += [256, *pixels[a : a + 254].tolist()]
    codes.append(257)
    bits = (np.array(codes, np.uint16)[:, None] >> np.arange(9, dtype=np.uint16)) & 1
    raw = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    blocks = b"".join(bytes([len(raw[k : k + 255])]) + raw[k : k + 255] for k in range(0, len(raw), 255))
    return b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0" + b"\x2c" + struct.pack("<4H", 0, 0, width, height) + b"\0\x08" + blocks + b"\0"


def gif_pieces(frames: Iterable[np.ndarray], width: int, height: int, fps: int = 10) -> Iterator[bytes]:
    """A looping film of 8-bit frames in shades of grey."""
    yield b"GIF89a" + struct.pack("<2H", width, height) + b"\xf7\0\0" + bytes(k for v in range(256) for k in (v, v, v)) + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    for pixels in frames:
        flat = np.zeros(width * height, np.uint8)
        flat[: pixels.size] = pixels
        yield gif_frame(flat, width, height, max(1, round(100 / fps)))
    yield b"\x3b"


def write_film(frames: DataFrame, path: str, height: int, width: int, fps: int = 10) -> None:
    """frames(t, cell, pixel) as a GIF film; one frame at a time goes through the driver."""
    write_bytes(frames.sparkSession, path, gif_pieces((p for _, p in planes(frames, "t", "pixel", "int")), width, height, fps))


def film_frames(frames: DataFrame, height: int, width: int, fps: int = 10) -> DataFrame:
    """(t, frame): each frame of frames(t, cell, pixel) as the bytes it has in a GIF film, encoded where it lies; a film is its header, these in order, and 0x3B."""
    import pandas as pd

    def encoded(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = np.zeros(width * height, np.uint8)
        flat[pdf["cell"].to_numpy()] = pdf["pixel"].fillna(0).to_numpy()
        return pd.DataFrame({"t": pdf["t"].iloc[:1], "frame": [gif_frame(flat, width, height, max(1, round(100 / fps)))]})

    return frames.select("t", "cell", "pixel").groupBy("t").applyInPandas(encoded, f"t {frames.schema['t'].dataType.simpleString()}, frame binary")


def frame_pixels(frame: bytes) -> np.ndarray:
    """The pixels of a frame that ``gif_frame`` made."""
    at, raw = 8 + 10 + 1, b""
    while frame[at]:
        raw += frame[at + 1 : at + 1 + frame[at]]
        at += frame[at] + 1
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    codes = bits[: len(bits) // 9 * 9].reshape(-1, 9).astype(np.int64) @ (1 << np.arange(9))
    return codes[: np.flatnonzero(codes == 257)[0]][codes[: np.flatnonzero(codes == 257)[0]] < 256]


def read_frames(table: DataFrame) -> DataFrame:
    """(t, cell, pixel) of a stored table of frames."""
    import pandas as pd

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, frame in zip(batch["t"], batch["frame"], strict=True):
                pixels = frame_pixels(frame)
                yield pd.DataFrame({"t": t, "cell": np.arange(len(pixels)), "pixel": pixels})

    return table.select("t", "frame").mapInPandas(decoded, f"t {table.schema['t'].dataType.simpleString()}, cell long, pixel int")


def tiff_bands(bands: DataFrame, lat: list[float], lon: list[float]) -> DataFrame:
    """(band, tiff): each band of bands(band, cell, value) as a GeoTIFF of its own, encoded where it lies; absent and NULL values are NaN."""
    import pandas as pd

    def encoded(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = np.full(len(lat) * len(lon), np.nan)
        flat[pdf["cell"].to_numpy()] = pdf["value"].to_numpy(float, na_value=np.nan)
        return pd.DataFrame({"band": pdf["band"].iloc[:1], "tiff": [geotiff_bytes([flat], lat, lon)]})

    return bands.select("band", "cell", "value").groupBy("band").applyInPandas(encoded, f"band {bands.schema['band'].dataType.simpleString()}, tiff binary")


def tiff_pixels(raw: bytes) -> np.ndarray:
    """The float32 pixels of a GeoTIFF of one band in one strip."""
    at = struct.unpack_from("<I", raw, 4)[0]
    tags = {}
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        tag, kind, _, value = struct.unpack_from("<HHI4s", raw, at + 2 + 12 * k)
        tags[tag] = struct.unpack("<I" if kind == 4 else "<Hxx", value)[0]
    return np.frombuffer(raw, "<f4", tags[256] * tags[257], tags[273])


def read_tiffs(table: DataFrame) -> DataFrame:
    """(band, cell, value) of a stored table of GeoTIFFs; NaN is NULL."""
    import pandas as pd

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for band, raw in zip(batch["band"], batch["tiff"], strict=True):
                pixels = tiff_pixels(raw)
                yield pd.DataFrame({"band": band, "cell": np.arange(len(pixels)), "value": pixels})

    kind = table.schema["band"].dataType.simpleString()
    return table.select("band", "tiff").mapInPandas(decoded, f"band {kind}, cell long, value float").withColumn("value", F.nanvl("value", F.lit(None).cast("float")))


def png_bytes(image: np.ndarray) -> bytes:
    """An 8-bit picture: height x width grey, or height x width x 3."""
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, -1)], axis=1)

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">2I5B", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def curve(x: list[float], y: list[float], height: int = 240, width: int = 360, margin: int = 24) -> np.ndarray:
    """A grey picture of one curve: axes, the line, and a square at each point; points without a value are left out."""
    image = np.full((height, width), 255, np.uint8)
    image[margin:-margin, margin] = image[-margin, margin:-margin] = 120
    known = [(float(a), float(b)) for a, b in zip(x, y, strict=True) if a is not None and b is not None and np.isfinite(b)]
    if not known:
        return image
    at = np.array(known)

    def placed(v: np.ndarray, low: int, high: int) -> np.ndarray:
        span = v.max() - v.min()
        return np.rint(low + (high - low) * ((v - v.min()) / span if span else np.full(len(v), 0.5))).astype(int)

    column, row = placed(at[:, 0], margin + 8, width - margin - 8), placed(at[:, 1], height - margin - 8, margin + 8)
    for k in range(len(at) - 1):
        n = max(abs(column[k + 1] - column[k]), abs(row[k + 1] - row[k]), 1) + 1
        image[np.linspace(row[k], row[k + 1], n).round().astype(int), np.linspace(column[k], column[k + 1], n).round().astype(int)] = 60
    for r, c in zip(row, column, strict=True):
        image[r - 2 : r + 3, c - 2 : c + 3] = 0
    return image


#: The panels of a sweep over numbers of clusters.
PANELS = ("inertia", "silhouette", "calinski", "davies", "sdw", "sdb")


def write_score_plots(scores: DataFrame, folder: str, panels: Iterable[str] = PANELS) -> list[str]:
    """One PNG for each score of a sweep (one row a number of clusters); returns the paths."""
    rows = sorted(scores.collect(), key=lambda r: r["k"])
    paths = []
    for name in panels:
        paths.append(f"{folder}/{name}.png")
        write_bytes(scores.sparkSession, paths[-1], [png_bytes(curve([r["k"] for r in rows], [r[name] for r in rows]))])
    return paths
