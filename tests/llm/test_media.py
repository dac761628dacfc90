import struct
import zlib

import numpy as np
from common import rows

from ripplemark.llm import media, queries


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width, height, depth, color, lines, palette=None, interlace=0):
    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace)
    body = chunk(b"PLTE", palette) if palette else b""
    data = zlib.compress(lines)
    return media.SIGNATURE + chunk(b"IHDR", head) + body + chunk(b"IDAT", data[:5]) + chunk(b"IDAT", data[5:]) + chunk(b"IEND", b"")


def pixels(blob):
    status, raw = media.parse_png(blob)
    assert status == "ok"
    return media.samples(raw, media.unfilter(raw.lines[None], raw.pixel)[0])


def slow_unfilter(lines, pixel):
    """One byte after another."""
    out = np.zeros((lines.shape[0] + 1, lines.shape[1] - 1), int)
    for r, line in enumerate(lines.astype(int)):
        for i, x in enumerate(line[1:]):
            a = out[r + 1, i - pixel] if i >= pixel else 0
            b, c = out[r, i], out[r, i - pixel] if i >= pixel else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[r + 1, i] = (x + [0, a, b, (a + b) // 2, near][line[0]]) % 256
    return out[1:]


def test_round_trip_with_all_filters():
    rng = np.random.default_rng(0)
    for channels in (1, 2, 3, 4):
        image = rng.integers(0, 256, (13, 7, channels), np.uint8)
        assert (pixels(media.encode_png(image, (0, 1, 2, 3, 4))) == image).all()


def test_unfiltering_against_one_byte_at_a_time():
    rng = np.random.default_rng(1)
    for pixel, stride in ((1, 9), (3, 12), (4, 16), (6, 15)):
        lines = rng.integers(0, 256, (3, 11, stride + 1), np.uint8)
        lines[:, :, 0] = rng.integers(0, 5, (3, 11))
        got = media.unfilter(lines, pixel)
        assert all((got[i] == slow_unfilter(lines[i], pixel)).all() for i in range(3))


def test_depths_and_palettes():
    assert pixels(png(5, 1, 1, 0, b"\x00\xa8"))[0, :, 0].tolist() == [255, 0, 255, 0, 255]
    assert pixels(png(3, 1, 4, 0, b"\x00\x0f\x80"))[0, :, 0].tolist() == [0, 255, 136]
    assert pixels(png(1, 1, 16, 2, b"\x00\x12\x34\x56\x78\x9a\xbc"))[0, 0].tolist() == [0x12, 0x56, 0x9A]
    assert pixels(png(2, 1, 2, 3, b"\x00\x40", palette=bytes([1, 2, 3, 9, 8, 7])))[0].tolist() == [[9, 8, 7], [1, 2, 3]]


def test_statuses():
    good = media.encode_png(np.zeros((4, 4), np.uint8))
    said = lambda b: media.parse_png(b)[0]
    assert said(None) == "missing" and said(b"") == said(b"GIF89a") == "not a png"
    assert said(good[:-1]) == said(good[:40]) == said(good[:8]) == "truncated"
    bad = bytearray(good)
    bad[45] ^= 1
    assert said(bytes(bad)) == "bad checksum"
    assert said(png(4, 1, 8, 0, b"\x09abcd")) == "bad data"
    assert said(png(4, 2, 8, 0, b"\x00abcd")) == "bad data"
    assert said(png(4, 1, 8, 0, b"\x00abcdefgh")) == "bad data"
    assert said(png(4, 1, 8, 3, b"\x00abcd")) == "bad data"
    assert said(png(4, 1, 7, 0, b"\x00abcd")) == said(png(0, 1, 8, 0, b"\x00")) == "bad header"
    assert said(png(4, 1, 8, 0, b"\x00abcd", interlace=2)) == "bad header"
    assert media.describe([png(4, 1, 8, 0, b"\x00abc", interlace=1), png(4, 1, 8, 0, b"\x00abcd" * 9, interlace=1)]) == [("bad data", None, None, None, None)] * 2


def interlaced(image, filters=(0,)):
    """An 8-bit interlaced PNG, its passes filtered as images of their own."""
    image = image[:, :, None] if image.ndim == 2 else image
    lines = b""
    for x, y, dx, dy in media.PASSES:
        part = image[y::dy, x::dx]
        if part.size:
            lines += media.parse_png(media.encode_png(part, filters))[1].lines.tobytes()
    return png(image.shape[1], image.shape[0], 8, {1: 0, 2: 4, 3: 2, 4: 6}[image.shape[2]], lines, interlace=1)


def test_interlaced_and_large_images_hash_like_whole_ones(monkeypatch):
    rng = np.random.default_rng(7)
    images = [rng.integers(0, 256, shape, np.uint8) for shape in ((1, 1), (3, 5), (8, 8, 3), (33, 70, 4), (64, 40, 2), (5, 90), (90, 5), (100, 100))]
    images.append(np.kron(rng.integers(0, 256, (8, 8)), np.ones((40, 30))).astype(np.uint8))
    whole = media.describe([media.encode_png(x, (0, 1, 2, 3, 4)) for x in images])
    assert all(r[0] == "ok" for r in whole)
    assert media.describe([interlaced(x, (0, 1, 2, 3, 4)) for x in images]) == whole
    monkeypatch.setattr(media, "BATCH_BYTES", 600)
    assert media.describe([media.encode_png(x, (0, 1, 2, 3, 4)) for x in images]) == whole
    tall = np.zeros((3000, 40), np.uint8)
    short = bytearray(media.encode_png(tall))
    assert media.parse_png(bytes(short))[1].lines is None
    assert media.describe([png(40, 3000, 8, 0, bytes(41 * 2999)), png(40, 3000, 8, 0, bytes(41 * 3000 + 1)), png(40, 3000, 8, 0, b"\x07" * 41 * 3000)]) == [("bad data", None, None, None, None)] * 3


def slow_hash(pixels):
    """The definition: means over the grid, cosine sums, signs against the median of all but the mean."""
    h, w = pixels.shape
    cell = lambda n, i: range(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) if n >= 32 else (i * n // 32,)
    small = [[np.mean([pixels[y, x] for y in cell(h, i) for x in cell(w, j)]) for j in range(32)] for i in range(32)]
    cos = [[np.cos(np.pi * (i + 0.5) * k / 32) for i in range(32)] for k in range(8)]
    low = [round(sum(cos[k][i] * cos[m][j] * small[i][j] for i in range(32) for j in range(32)), 6) for k in range(8) for m in range(8)]
    middle = np.median(low[1:])
    return bytes(int("".join("1" if n and v > middle else "0" for n, v in list(enumerate(low))[s : s + 8]), 2) for s in range(0, 64, 8))


def test_the_query_against_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["vec_id"]: r for r in queries.QUERIES["op6_media"](spark, sf).collect()}
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert got.keys() == vectors.keys() and all((r["status"], r["width"], r["height"], r["channels"]) == ("ok", 32, 32, 1) for r in got.values())
    for k in sorted(vectors)[::25]:
        x = np.clip(np.round(np.clip(np.array(vectors[k], float), -1, 1) * 255 + 127.5), 0, 255)
        assert bytes(got[k]["phash"]) == slow_hash(np.kron(x.reshape(8, 8), np.ones((4, 4))))


def test_hash_survives_scaling_and_noise_and_tells_images_apart():
    rng = np.random.default_rng(3)
    small = rng.random((8, 8))
    image = np.clip(np.kron(small, np.ones((16, 16))) * 255, 0, 255).astype(np.uint8)
    noisy = np.clip(image + rng.normal(0, 6, image.shape), 0, 255).astype(np.uint8)
    other = np.clip(np.kron(rng.random((8, 8)), np.ones((16, 16))) * 255, 0, 255).astype(np.uint8)
    blobs = [media.encode_png(x, (4,)) for x in (image, noisy, image[::2, ::2], np.stack([image] * 3, 2), other)]
    hashes = [np.unpackbits(np.frombuffer(r[4], np.uint8)) for r in media.describe(blobs)]
    distance = [(hashes[0] != h).sum() for h in hashes]
    assert max(distance[1:4]) <= 6 and distance[4] >= 16


def test_odd_rows(spark):
    good = media.encode_png(np.arange(12, dtype=np.uint8).reshape(3, 4))
    df = spark.createDataFrame([(1, good), (1, good), (None, good), (2, None), (3, bytearray())], "vec_id bigint, image binary").selectExpr("*", "1 as id", "2 as status", "3 as phash")
    got = rows(media.describe_images(df, "vec_id").drop("phash"))
    assert got == sorted([(1, "ok", 4, 3, 1)] * 2 + [(None, "ok", 4, 3, 1), (2, "missing", None, None, None), (3, "not a png", None, None, None)], key=repr)
    assert rows(media.describe_images(df.limit(0), "vec_id")) == []


def test_vectors_as_images(spark):
    data = [(1, [0.1, -0.5, None]), (2, None), (3, []), (4, [float("nan"), float("inf")]), (None, [1.0] * 5000)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as id", "2 as v")
    got = {r["vec_id"]: r for r in media.describe_images(media.vector_images(df), "vec_id").collect()}
    assert [got[k]["status"] for k in (1, 2, 3, 4, None)] == ["ok", "missing", "missing", "ok", "ok"]
    assert got[None]["width"] == 284 and len(got[1]["phash"]) == 8
