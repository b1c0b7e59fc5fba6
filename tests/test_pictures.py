"""Files of pictures and films, read back by plain readers of their formats."""

import struct
import zlib

import numpy as np
import pytest

from tailweave.sources import pictures


def read_gif(raw):
    """Frames by a general LZW reader."""
    assert raw[:6] == b"GIF89a"
    width, height, flags = struct.unpack_from("<2HB", raw, 6)
    at, frames, delays = 13 + 3 * (2 << (flags & 7)), [], []
    while raw[at] != 0x3B:
        if raw[at] == 0x21:
            if raw[at + 1] == 0xF9:
                delays.append(struct.unpack_from("<H", raw, at + 4)[0])
            at += 2
            while raw[at]:
                at += raw[at] + 1
            at += 1
            continue
        assert raw[at] == 0x2C
        least, at, data = raw[at + 10], at + 11, b""
        while raw[at]:
            data += raw[at + 1 : at + 1 + raw[at]]
            at += raw[at] + 1
        at += 1
        bits = int.from_bytes(data, "little")
        clear, size, out, table, before = 1 << least, least + 1, [], [], None
        while True:
            code = bits & (1 << size) - 1
            bits >>= size
            if code == clear:
                table, size, before = [[k] for k in range(clear)] + [None, None], least + 1, None
            elif code == clear + 1:
                break
            else:
                entry = table[code] if code < len(table) else before + before[:1]
                out += entry
                if before is not None:
                    table.append(before + entry[:1])
                    if len(table) == 1 << size and size < 12:
                        size += 1
                before = entry
        frames.append(np.array(out, np.uint8).reshape(height, width))
    return frames, delays


@pytest.mark.parametrize("height,width", [(1, 1), (3, 5), (40, 37)])
def test_films(spark, tmp_path, height, width):
    x = np.random.default_rng(1).integers(0, 256, (4, height * width))
    rows = [(t, c, int(x[t, c])) for t in range(4) for c in range(height * width)]
    df = spark.createDataFrame(rows, "t long, cell long, pixel int").repartition(3)
    pictures.write_film(df, f"file://{tmp_path}/deep/film.gif", height, width, fps=20)
    frames, delays = read_gif((tmp_path / "deep/film.gif").read_bytes())
    assert delays == [5] * 4 and all((f.ravel() == v).all() for f, v in zip(frames, x, strict=True))


def read_tiff(raw):
    assert raw[:4] == b"II*\0"
    at = struct.unpack_from("<I", raw, 4)[0]
    tags = {}
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        tag, kind, n = struct.unpack_from("<HHI", raw, at + 2 + 12 * k)
        letter = {3: "H", 4: "I", 12: "d"}[kind]
        size = struct.calcsize(f"<{n}{letter}")
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from("<I", raw, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(f"<{n}{letter}", raw, place)
    return tags, [np.frombuffer(raw, "<f4", n // 4, a).reshape(tags[257][0], tags[256][0]) for a, n in zip(tags[273], tags[279], strict=True)]


@pytest.mark.parametrize("bands", [1, 2, 3, 5])
def test_rasters(spark, tmp_path, bands):
    x = np.random.default_rng(bands).standard_normal((bands, 3, 4)).astype(np.float32)
    rows = [(b + 1, i * 4 + j, float(x[b, i, j])) for b in range(bands) for i in range(3) for j in range(4) if (i, j) != (2, 3)]
    pictures.write_tiff(spark.createDataFrame(rows, "band int, cell long, value double"), f"file://{tmp_path}/r.tif", [30.0, 29.5, 29.0], [100.0, 100.25, 100.5, 100.75])
    tags, found = read_tiff((tmp_path / "r.tif").read_bytes())
    want = x.copy()
    want[:, 2, 3] = np.nan
    assert np.array_equal(np.stack(found), want, equal_nan=True)
    assert tags[33550] == (0.25, 0.5, 0.0) and tags[33922] == (0, 0, 0, 99.875, 30.25, 0) and 4326 in tags[34735] and tags[277] == (bands,) and tags[339] == (3,) * bands
    assert sorted(tags) == list(tags)


def read_png(raw):
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, head = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        data = raw[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", raw, at + 8 + n)[0] == zlib.crc32(kind + data)
        head, body = (struct.unpack(">2I5B", data) if kind == b"IHDR" else head), body + (data if kind == b"IDAT" else b"")
        at += 12 + n
    channels = 3 if head[3] == 2 else 1
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(head[1], head[0] * channels + 1)[:, 1:].reshape(head[1], head[0], channels)


def test_plots(spark, tmp_path):
    rgb = np.random.default_rng(2).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (read_png(pictures.png_bytes(rgb)) == rgb).all() and (read_png(pictures.png_bytes(rgb[..., 0]))[..., 0] == rgb[..., 0]).all()
    scores = spark.createDataFrame([(k, 100.0 / k, 0.1 * k, None if k == 3 else 5.0, 1.0, 2.0, float(k)) for k in (4, 2, 3)], "k int, inertia double, silhouette double, calinski double, davies double, sdw double, sdb double")
    paths = pictures.write_score_plots(scores, f"file://{tmp_path}/plots")
    assert len(paths) == 6
    falling = read_png((tmp_path / "plots/inertia.png").read_bytes())[..., 0]
    rising = read_png((tmp_path / "plots/silhouette.png").read_bytes())[..., 0]
    corner = lambda image, left: (image[24:60, 25:60] if left else image[24:60, -60:-25]).min()
    assert corner(falling, True) == 0 and corner(falling, False) == 255 and corner(rising, False) == 0 and corner(rising, True) == 255
    assert (pictures.curve([1], [float("nan")]) == pictures.curve([], [])).all()
