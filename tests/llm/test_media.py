import hashlib
import struct
import zlib

import numpy as np
import pytest

from tailweave.llm import media


def bmp(pixels, depth, palette=None, top_down=False):
    """Write a bitmap by hand."""
    h, w = pixels.shape[:2]
    stride = (w * depth + 31) // 32 * 4
    lines = []
    for row in pixels:
        if depth == 24:
            raw = row[:, ::-1].tobytes()
        elif depth == 32:
            raw = np.concatenate([row[:, ::-1], np.full((w, 1), 9, np.uint8)], axis=1).tobytes()
        elif depth == 8:
            raw = row.tobytes()
        elif depth == 4:
            padded = np.append(row, [0] * (w % 2)).astype(np.uint8)
            raw = (padded[::2] << 4 | padded[1::2]).tobytes()
        else:
            raw = np.packbits(row.astype(np.uint8)).tobytes()
        lines.append(raw.ljust(stride, b"\0"))
    table = b"".join(bytes((*c[::-1], 0)) for c in palette) if palette is not None else b""
    body = b"".join(lines if top_down else lines[::-1])
    head = struct.pack("<2sIHHI", b"BM", 54 + len(table) + len(body), 0, 0, 54 + len(table)) + struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, depth, 0, len(body), 0, 0, len(table) // 4, 0)
    return head + table + body


@pytest.mark.parametrize("depth", [24, 32])
@pytest.mark.parametrize("top_down", [False, True])
def test_true_colour_bitmaps(depth, top_down):
    x = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode_image(bmp(x, depth, top_down=top_down)) == x).all()


@pytest.mark.parametrize("depth", [1, 4, 8])
def test_bitmaps_with_palettes(depth):
    rng = np.random.default_rng(2)
    palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
    index = rng.integers(0, 1 << depth, (6, 11)).astype(np.uint8)
    assert (media.decode_image(bmp(index, depth, palette)) == palette[index]).all()
    grey = np.repeat(np.arange(1 << depth, dtype=np.uint8)[:, None], 3, axis=1)
    assert media.decode_image(bmp(index, depth, grey)).shape == (6, 11, 1)


def test_netpbm():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (4, 11)).astype(np.uint8)
    want = ((1 - bits) * 255)[..., None]
    assert (media.decode_image(b"P4 # c\n11 4\n" + np.packbits(bits, axis=1).tobytes()) == want).all()
    assert (media.decode_image(b"P1\n11 4\n" + "\n".join("".join(map(str, r)) for r in bits).encode()) == want).all()
    rgb = rng.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    assert (media.decode_image(b"P6\n5 3\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode_image(b"P3\n#x\n5 3 255\n" + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    deep = rng.integers(0, 65536, (3, 4)).astype(np.uint16)
    assert (media.decode_image(b"P5\n4 3\n65535\n" + deep.astype(">u2").tobytes())[..., 0] == deep).all()
    assert (media.decode_image(b"P2\n4 3\n65535\n" + " ".join(map(str, deep.ravel())).encode())[..., 0] == deep).all()
    assert (media.decode_image(media.encode_pgm(rgb[..., 0]))[..., 0] == rgb[..., 0]).all()


@pytest.mark.parametrize("raw", [b"", b"P5", b"P5\n0 3\n255\n", b"P5\n9 9\n255\nxx", b"P7\n", b"BM", b"BM" + b"\0" * 60, b"P1\n2 2\n1 0 2 1", b"P3\n1 1 255\n1 2", b"P2\n1 1 5\n9", b"\xff\xd8\xff", b"P4\n8 1", b"P4\n8 1\n", b"P5\n" + b"9" * 5000 + b" 1\n255\n", b"P2\n1 1\n255\n" + b"7" * 5000, b"P2\n1 1\n" + b"0" * 5000 + b"9\n1"])
def test_broken_images(raw):
    with pytest.raises(media.ImageError):
        media.decode_image(raw)


def test_area_resize_like_brute_force():
    rng = np.random.default_rng(4)
    for h, w, a, b in [(5, 7, 3, 2), (8, 8, 8, 8), (3, 2, 5, 9), (1, 1, 4, 3), (64, 10, 8, 9)]:
        x = rng.integers(0, 256, (h, w, 2)).astype(float)
        fine = np.kron(x, np.ones((a, b, 1)))  # h*a by w*b small cells of equal area
        want = fine.reshape(a, h, b, w, 2).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(x, a, b), want)


def test_columns(spark):
    x = np.arange(48, dtype=np.uint8).reshape(6, 8)
    df = spark.createDataFrame([(1, media.encode_pgm(x), 0), (2, None, 0), (3, b"nonsense", 0), (4, bmp(np.stack([x] * 3, axis=2), 24), 0)], "k long, picture binary, dhash int")
    got = {r["k"]: r for r in media.media_columns(df, "k", "picture", 4).collect()}
    assert (media.read_tile(got[1]["tile"])[..., 0] == np.rint(np.round(media.area_resize(x[..., None], 4, 4)[..., 0], 6))).all()
    assert got[1]["dhash"] == "ff" * 8 and got[2]["error"] == "null" and got[3]["tile"] is None and got[4]["channels"] == 3
    assert media.media_columns(df.limit(0), "k", "picture").count() == 0


def test_payloads_round_trip(awkward, clashing, nothing):
    for docs in (awkward, clashing):
        got = media.payload_media(docs).collect()
        for r, t in zip(got, [x["text"] for x in docs.collect()], strict=True):
            raw = (t or "").encode()
            padded = raw + bytes(-len(raw) % 64 if raw else 64)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r["feature"] for r in got if r["doc_id"] in (1, 11)}) == 1
    assert media.payload_media(nothing).count() == 0
    for r in media.payload_media(awkward, keep=True).collect():
        assert hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(media.decode_image(bytes(r["media"])).tobytes()) == r["payload_bytes"]
        assert media.read_tile(r["tile"]).shape == (32, 32, 1)


def test_damaged_images_raise_image_errors_only(spark):
    """Truncations, changed and inserted bytes of valid files, and noise: an image or an ImageError."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, (5, 9)).astype(np.uint8)
    rgb = rng.integers(0, 256, (5, 9, 3)).astype(np.uint8)
    whole = [
        b"P4 9 5\n" + np.packbits(x, axis=1).tobytes(), b"P1\n9 5\n" + " ".join(map(str, x.ravel())).encode(), b"P2 9 5 255 " + " ".join(map(str, rgb[..., 0].ravel())).encode(),
        b"P3\n#c\n9 5 65535\n" + " ".join(map(str, rgb.ravel())).encode(), media.encode_pgm(rgb[..., 0]), b"P6 9 5 255\n" + rgb.tobytes(), b"P5 9 5 65535\n" + rgb[..., :2].tobytes(),
        bmp(rgb, 24), bmp(rgb, 32), bmp(x, 1, rgb[0, :2]), bmp(x, 4, rgb[0, :2]), bmp(x, 8, rgb[0, :2], top_down=True),
    ]
    damaged = []
    for k in range(10_000):
        raw = bytearray(whole[k % len(whole)])
        for _ in range(rng.integers(0, 4)):
            raw[rng.integers(0, min(len(raw), 60))] = rng.choice([0, 9, 32, 35, 48, 49, 57, 255, rng.integers(0, 256)])
        if k % 3 == 0:
            del raw[rng.integers(0, len(raw) + 1) :]
        if k % 5 == 0:
            at = rng.integers(0, min(len(raw), 30) + 1)
            raw[at:at] = bytes(rng.integers(48, 58, rng.integers(0, 30)).astype(np.uint8))
        damaged.append(bytes(raw))
    decoded = 0
    for raw in damaged:
        try:
            image = media.decode_image(raw)
            decoded += 1
            assert image.ndim == 3 and image.size and image.dtype in (np.uint8, np.uint16)
        except media.ImageError:
            pass
    assert 100 < decoded < 9_900
    some = damaged[:500]
    got = media.media_columns(spark.createDataFrame(list(enumerate(some)), "k long, picture binary"), "k", "picture", 4).collect()
    assert len(got) == 500 and all((r["tile"] is None) == (r["error"] is not None) for r in got)
