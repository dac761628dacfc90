"""Media columns: PNG images in binary columns, read with zlib and numpy, and perceptual hashes of them.

Images of one geometry are unfiltered together: each step works on a row, or for the averaging and Paeth
filters on a pixel, of all of them. Large and interlaced images are read a band of rows at a time, so an image of any size needs the memory of
a band (one row at least). The hash is the sign pattern of the low frequencies of the
cosine transform, against their median: 8 bytes in a binary column.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
SIDE, LOW = 32, 8
#: Decoded bytes of the images unfiltered together; a larger one is read in bands of so many.
BATCH_BYTES = 1 << 24
#: First column and row, and steps, of the passes of an interlaced image.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


@dataclass
class Raw:
    """An image's header and filtered scanlines (a filter byte before each row)."""

    width: int
    height: int
    depth: int
    color: int
    palette: np.ndarray | None
    #: None for an image that is read in bands, from ``parts``.
    lines: np.ndarray | None
    parts: tuple[bytes, ...] = ()
    interlaced: bool = False

    @property
    def pixel(self) -> int:
        return max(1, CHANNELS[self.color] * self.depth // 8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(pixels: np.ndarray, filters: tuple[int, ...] = (0,), level: int = 6) -> bytes:
    """An 8-bit PNG of ``(height, width)`` or ``(height, width, 1..4)`` pixels; row r has the filter r modulo their number."""
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    h, w, c = pixels.shape
    row = pixels.reshape(h, w * c).astype(np.int16)
    left, up = np.zeros_like(row), np.zeros_like(row)
    left[:, c:], up[1:] = row[:, :-c], row[:-1]
    corner = np.zeros_like(row)
    corner[1:, c:] = row[:-1, :-c]
    kinds = np.resize(np.array(filters, np.uint8), h)
    guess = np.stack((np.zeros_like(row), left, up, (left + up) // 2, _paeth(left, up, corner)))
    lines = np.concatenate((kinds[:, None], ((row - guess[kinds, np.arange(h)]) & 255).astype(np.uint8)), axis=1)
    color = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    head = struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def parse_png(data: bytes | None) -> tuple[str, Raw | None]:
    """A status and, where it is ``ok``, the image. Every chunk's checksum is tested."""
    if data is None:
        return "missing", None
    if data[:8] != SIGNATURE:
        return "not a png", None
    at, head, palette, ended = 8, None, None, False
    inflate, parts, packed = zlib.decompressobj(), [], []
    room, whole = 0, True
    try:
        while at < len(data) and not ended:
            if at + 12 > len(data):
                return "truncated", None
            (size,) = struct.unpack_from(">I", data, at)
            kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
            if at + 12 + size > len(data):
                return "truncated", None
            if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
                return "bad checksum", None
            at += 12 + size
            if kind == b"IHDR":
                if size != 13 or head:
                    return "bad header", None
                head = struct.unpack(">IIBBBBB", body)
                w, h, depth, color, method, filtering, interlace = head
                if not w or not h or depth not in DEPTHS.get(color, ()) or method or filtering or interlace > 1:
                    return "bad header", None
                stride = (w * CHANNELS[color] * depth + 7) // 8
                room = h * (stride + 1)
                whole = not interlace and room <= BATCH_BYTES
            elif not head:
                return "bad header", None
            elif kind == b"PLTE":
                palette = np.frombuffer(body[: size // 3 * 3], np.uint8).reshape(-1, 3)
            elif kind == b"IDAT" and not whole:
                packed.append(body)
            elif kind == b"IDAT":
                parts.append(inflate.decompress(body, room + 1))
                room -= len(parts[-1])
                if room < 0:
                    return "bad data", None
            elif kind == b"IEND":
                ended = True
    except zlib.error:
        return "bad data", None
    if not ended or not head:
        return "truncated", None
    if color == 3 and palette is None:
        return "bad data", None
    if not whole:
        return "ok", Raw(w, h, depth, color, palette, None, tuple(packed), bool(interlace))
    lines = np.frombuffer(b"".join(parts), np.uint8)
    if room or not inflate.eof:
        return "bad data", None
    lines = lines.reshape(h, stride + 1)
    return ("ok", Raw(w, h, depth, color, palette, lines)) if lines[:, 0].max() <= 4 else ("bad data", None)


class Inflater:
    """The bytes behind an image's compressed parts, so many at a time."""

    def __init__(self, parts: tuple[bytes, ...]):
        self.parts, self.engine, self.held = iter(parts), zlib.decompressobj(), b""

    def take(self, n: int) -> bytes:
        out = []
        while n > 0:
            if not self.held and (part := next(self.parts, None)) is None:
                raise zlib.error("too little data")
            elif not self.held:
                self.held = part
            got = self.engine.decompress(self.held, n)
            self.held = self.engine.unconsumed_tail
            if self.engine.eof and len(got) < n:
                raise zlib.error("too little data")
            out.append(got)
            n -= len(got)
        return b"".join(out)

    def finish(self) -> None:
        """The stream has to end here."""
        for part in (self.held, *self.parts):
            if not self.engine.eof and self.engine.decompress(part, 1):
                raise zlib.error("too much data")
        if not self.engine.eof:
            raise zlib.error("no end")


class Grid:
    """Gray values of an image that comes in parts, summed over SIDE x SIDE cells (fewer where it has fewer pixels)."""

    def __init__(self, width: int, height: int):
        self.size = height, width
        self.edges = [np.arange(min(n, SIDE)) * n // min(n, SIDE) for n in self.size]
        self.sums = np.zeros([len(e) for e in self.edges])

    def add(self, ys: np.ndarray, xs: np.ndarray, values: np.ndarray) -> None:
        y, x = (np.searchsorted(e, at, "right") - 1 for e, at in zip(self.edges, (ys, xs)))
        first = [np.flatnonzero(np.diff(c, prepend=-1)) for c in (y, x)]
        part = np.add.reduceat(np.add.reduceat(values, first[1], axis=1), first[0], axis=0)
        self.sums[np.ix_(y[first[0]], x[first[1]])] += part

    def image(self) -> np.ndarray:
        """What ``shrink`` makes of the whole image."""
        lens = [np.diff(np.append(e, n)) for e, n in zip(self.edges, self.size)]
        return shrink(self.sums / np.outer(*lens))


def banded(image: Raw) -> np.ndarray:
    """The SIDE x SIDE gray image of one that is read in bands; zlib.error where its data don't fit."""
    source, grid = Inflater(image.parts), Grid(image.width, image.height)
    for x0, y0, dx, dy in PASSES if image.interlaced else ((0, 0, 1, 1),):
        w, h = -(-(image.width - x0) // dx), -(-(image.height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = (w * CHANNELS[image.color] * image.depth + 7) // 8
        step = max(1, BATCH_BYTES // (8 * (stride + 1)))
        above = np.zeros((1, stride), np.uint8)
        for y in range(0, h, step):
            n = min(step, h - y)
            lines = np.frombuffer(source.take(n * (stride + 1)), np.uint8).reshape(1, n, stride + 1)
            if lines[0, :, 0].max() > 4:
                raise zlib.error("unknown filter")
            rows = unfilter(lines, image.pixel, above)[0]
            above = rows[-1:]
            pixels = samples(Raw(w, n, image.depth, image.color, image.palette, None), rows)
            grid.add(y0 + dy * np.arange(y, y + n), x0 + dx * np.arange(w), gray(pixels))
    source.finish()
    return grid.image()


def unfilter(lines: np.ndarray, pixel: int, above: np.ndarray | None = None) -> np.ndarray:
    """Bytes ``(images, height, stride)`` of filtered scanlines ``(images, height, stride + 1)``; ``pixel``: bytes a pixel, ``above``: the rows before."""
    kinds, data = lines[:, :, 0], lines[:, :, 1:]
    n, h, stride = data.shape
    out = np.zeros((n, h + 1, stride), np.uint8)
    if above is not None:
        out[:, 0] = above
    for r in range(h):
        up, line, row = out[:, r], data[:, r], out[:, r + 1]
        kind = kinds[:, r]
        row[:] = line
        if (s := np.flatnonzero(kind == 1)).size:
            wide = np.zeros((len(s), -(-stride // pixel) * pixel), np.uint8)
            wide[:, :stride] = line[s]
            row[s] = np.cumsum(wide.reshape(len(s), -1, pixel), axis=1, dtype=np.uint8).reshape(len(s), -1)[:, :stride]
        if (s := np.flatnonzero(kind == 2)).size:
            row[s] = line[s] + up[s]
        for k in (3, 4):
            if not (s := np.flatnonzero(kind == k)).size:
                continue
            x, b = line[s].astype(np.int16), up[s].astype(np.int16)
            done = np.zeros((len(s), stride + pixel), np.int16)
            above = np.zeros((len(s), stride + pixel), np.int16)
            above[:, pixel:] = b
            for i in range(0, stride, pixel):
                j = slice(i, min(i + pixel, stride))
                left = done[:, j]
                guess = (left + b[:, j]) >> 1 if k == 3 else _paeth(left, b[:, j], above[:, j])
                done[:, i + pixel : j.stop + pixel] = (x[:, j] + guess) & 255
            row[s] = done[:, pixel:]
    return out[:, 1:]


def samples(image: Raw, rows: np.ndarray) -> np.ndarray:
    """``(height, width, channels)`` samples of 8 bits from unfiltered bytes; palettes are looked up, 16 bits cut to the upper 8."""
    c = CHANNELS[image.color]
    if image.depth == 16:
        rows = rows[:, ::2]
    elif image.depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(image.height, -1, image.depth)
        rows = (bits @ (1 << np.arange(image.depth)[::-1])).astype(np.uint8)
        if image.color == 0:
            rows = rows * np.uint8(255 // ((1 << image.depth) - 1))
    rows = rows[:, : image.width * c]
    if image.color == 3:
        table = np.zeros((256, 3), np.uint8)
        table[: min(256, len(image.palette))] = image.palette[:256]
        return table[rows]
    return rows.reshape(image.height, image.width, c)


def gray(pixels: np.ndarray) -> np.ndarray:
    color = pixels[:, :, : 3 if pixels.shape[2] > 2 else 1].astype(float)
    return color @ np.array([0.299, 0.587, 0.114]) if color.shape[2] == 3 else color[:, :, 0]


def shrink(image: np.ndarray) -> np.ndarray:
    """Means over a SIDE x SIDE grid (nearest pixels where the image is smaller)."""
    for axis in (0, 1):
        n = image.shape[axis]
        if n < SIDE:
            image = np.take(image, np.arange(SIDE) * n // SIDE, axis)
        else:
            edges = np.arange(SIDE) * n // SIDE
            lens = np.diff(np.append(edges, n)).reshape((-1, 1) if axis == 0 else (1, -1))
            image = np.add.reduceat(image, edges, axis) / lens
    return image


_COS = np.cos(np.pi * (np.arange(SIDE) + 0.5)[None, :] * np.arange(LOW)[:, None] / SIDE)


def phash(images: np.ndarray) -> list[bytes]:
    """Hashes of ``(n, SIDE, SIDE)`` gray images: bits of the LOW x LOW lowest frequencies over the median of all but the mean."""
    low = np.round(_COS @ images @ _COS.T, 6).reshape(len(images), -1)
    bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
    bits[:, 0] = False
    return [b.tobytes() for b in np.packbits(bits, axis=1)]


def describe(blobs: list[bytes | None]) -> list[tuple[str, int | None, int | None, int | None, bytes | None]]:
    """Status, width, height, channels and hash of each image; images of one geometry are unfiltered together."""
    parsed = [parse_png(b) for b in blobs]
    out = [(status, None, None, None, None) for status, _ in parsed]
    alike: dict[tuple, list[int]] = {}
    for i, (_, image) in enumerate(parsed):
        if image and image.lines is None:
            try:
                out[i] = ("ok", image.width, image.height, 3 if image.color == 3 else CHANNELS[image.color], phash(banded(image)[None])[0])
            except zlib.error:
                out[i] = ("bad data", None, None, None, None)
        elif image:
            alike.setdefault((image.lines.shape, image.pixel), []).append(i)
    for (shape, pixel), members in alike.items():
        step = max(1, BATCH_BYTES // (shape[0] * shape[1]))
        for s in range(0, len(members), step):
            part = members[s : s + step]
            rows = unfilter(np.stack([parsed[i][1].lines for i in part]), pixel)
            small = []
            for i, r in zip(part, rows):
                pixels = samples(parsed[i][1], r)
                out[i] = ("ok", parsed[i][1].width, parsed[i][1].height, pixels.shape[2])
                small.append(shrink(gray(pixels)))
            for i, h in zip(part, phash(np.stack(small))):
                out[i] += (h,)
    return out


def describe_images(images: DataFrame, id_col: str, image_col: str = "image") -> DataFrame:
    """``(<id>, status, width, height, channels, phash)`` for each row of a binary column of PNG images.

    ``status`` says why an image can't be read (missing, not a png, truncated, bad checksum, bad header, bad
    data); the rest is then null. Images of any size, interlaced or not, are read. Rows are read each, repeated or not;
    null ids stay; other columns aren't carried; empty in, empty out.
    """
    data = images.select(images[id_col].alias("id"), images[image_col].cast("binary").alias("image"))
    kind = data.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 1024):
                part = batch.slice(s, 1024)
                rows = list(zip(*describe([b.as_py() for b in part["image"]])))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.record_batch([part["id"], *[pa.array(c, k) for c, k in zip(rows, kinds)]], names=["id", "status", "width", "height", "channels", "phash"])

    return data.mapInArrow(run, f"id {kind}, status string, width int, height int, channels int, phash binary").withColumnRenamed("id", id_col)


def vector_image(vector: list[float] | None) -> bytes | None:
    """A heat map of a vector as PNG: its elements in rows of a square, each 4 x 4 pixels, all five filters in turn.

    None for a null or empty vector; null and NaN elements are black.
    """
    if not vector:
        return None
    x = np.nan_to_num(np.array([np.nan if v is None else v for v in vector], float), nan=-1, posinf=1, neginf=-1)
    side = int(np.ceil(np.sqrt(len(x))))
    square = np.zeros(side * side)
    square[: len(x)] = np.clip(np.round(np.clip(x, -1, 1) * 255 + 127.5), 0, 255)
    pixels = np.kron(square.reshape(side, side), np.ones((4, 4))).astype(np.uint8)
    return encode_png(pixels, (0, 1, 2, 3, 4))


def vector_images(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(<id>, image)``: each vector's heat map in a binary column."""
    data = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].alias("v"))
    kind = data.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["id"], pa.array([vector_image(v) for v in batch["v"].to_pylist()], pa.binary())], names=["id", "image"])

    return data.mapInArrow(run, f"id {kind}, image binary").withColumnRenamed("id", id_col)
