"""Payload decoders: bytes of one member in, bytes of one artifact out. Pure functions; the plans wrap them for Arrow."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np


from ..sources.cursor import Cursor

#: Large images are scored and drawn in parts of about so many pixels.
BAND = 1 << 20
_ALIGN = {1: 16, 2: 2, 4: 4, 8: 2, 16: 1, 32: 4}


def unpack_bits(data: bytes, limit: int | None = None) -> bytes:
    """PackBits: n copies n + 1 bytes, -n repeats the next byte n + 1 times, -128 does nothing; ends with the data or a told limit."""
    out, at = bytearray(), 0
    while at < len(data) and (limit is None or len(out) < limit):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128 and at < len(data):
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:limit])


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
        else:
            end = at + 1
            while end < len(data) and end - at < 128 and data[end : end + 1] != data[end - 1 : end]:
                end += 1
            out += bytes((end - at - 1,)) + data[at:end]
            at = end
    return bytes(out)


def unpack_rows(data: bytes, row: int, height: int) -> bytes | None:
    """Rows packed one by one behind their lengths (a byte from 121 to 254, else two bytes); None unless all are full."""
    out, at = bytearray(), 0
    for _ in range(height):
        if at >= len(data):
            return None
        if 120 < data[at] < 255:
            size, at = data[at], at + 1
        elif at + 2 <= len(data):
            size, at = data[at] << 8 | data[at + 1], at + 2
        else:
            return None
        line = unpack_bits(data[at : at + size], row)
        if len(line) != row:
            return None
        out += line
        at += size
    return bytes(out)


def lenient_inflate(data: bytes) -> bytes | None:
    """A zlib stream at the start, else at the first header within 128 bytes that works."""
    for i in range(min(len(data), 128)):
        if i == 0 or (data[i] == 0x78 and data[i + 1 : i + 2] in (b"\x01", b"\x9c", b"\xda")):
            try:
                engine = zlib.decompressobj()
                out = engine.decompress(data[i:])
                if engine.eof:
                    return out
            except zlib.error:
                pass
    return None


def palette(data: bytes | None) -> np.ndarray | None:
    """256 colours of a lookup table with 6, 4 or 3 bytes an entry; None where it is too short."""
    n = len(data or b"")
    for width, least in ((6, 1536), (4, 1024), (3, 768)):
        if n >= least:
            table = np.frombuffer(data, np.uint8, 256 * width).reshape(256, width)
            return table[:, [0, 2, 4]] if width == 6 else table[:, :3]
    return None


def _mac() -> np.ndarray:
    """The classic system palette: a 6 x 6 x 6 cube from white down without black, ramps of red, green, blue and gray, black."""
    level = [255, 204, 153, 102, 51, 0]
    cube = [(r, g, b) for r in level for g in level for b in level][:-1]
    ramp = [238, 221, 187, 170, 136, 119, 85, 68, 34, 17]
    colors = cube + [(v, 0, 0) for v in ramp] + [(0, v, 0) for v in ramp] + [(0, 0, v) for v in ramp] + [(v, v, v) for v in ramp] + [(0, 0, 0)]
    return np.array(colors, np.uint8)


MAC = _mac()
#: The 216 colours that browsers share, the last channel fastest, then black.
WEB = np.concatenate((51 * np.stack(np.unravel_index(np.arange(216), (6, 6, 6)), axis=1), np.zeros((40, 3), int))).astype(np.uint8)
GRAY = np.repeat((255 - np.arange(256, dtype=np.uint8))[:, None], 3, axis=1)
INDEX_GRAY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
#: Built-in palettes by id; the others are drawn with the classic one.
BUILT_IN = {-1: MAC, 1: MAC, -3: GRAY, 3: GRAY, -8: WEB, 9: WEB}


def jasc(colors: np.ndarray) -> bytes:
    return b"JASC-PAL\r\n0100\r\n256\r\n" + b"%d %d %d\r\n" * len(colors) % tuple(colors.ravel().tolist()) + b"0 0 0\r\n" * (256 - len(colors))


def png(pixels: np.ndarray) -> bytes:
    """An RGBA image of 8 bits a channel, all rows unfiltered."""
    return png_of(pixels.shape[1], pixels.shape[0], [pixels])


def png_of(w: int, h: int, bands: Iterable[np.ndarray]) -> bytes:
    """The same of an image whose rows come in parts."""
    squeeze, body = zlib.compressobj(), bytearray()
    for pixels in bands:
        n = len(pixels)
        body += squeeze.compress(np.concatenate((np.zeros((n, 1), np.uint8), pixels.reshape(n, w * 4)), axis=1).tobytes())
    body += squeeze.flush()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", bytes(body)) + part(b"IEND", b"")


def row_sizes(width: int, depth: int, pitch: int = 0) -> list[int]:
    """Bytes a row may have: the told pitch, aligned, tight."""
    step = _ALIGN.get(depth, 2)
    found = [pitch, -(-width // step) * step * depth // 8 + (-(-width // step) * step * depth % 8 > 0), -(-width * depth // 8)]
    return [x for i, x in enumerate(found) if x > 0 and x not in found[:i]]


def roughness(rows: np.ndarray) -> float:
    """The mean absolute difference of horizontal and vertical neighbours."""
    x = rows.astype(np.int16)
    across, down = np.abs(np.diff(x, axis=1)), np.abs(np.diff(x, axis=0))
    n = across.size + down.size
    return float(across.sum(dtype=np.int64) + down.sum(dtype=np.int64)) / max(1, n)


def _indices(data: bytes, w: int, h: int, depth: int, row: int) -> np.ndarray:
    rows = np.frombuffer(data[: row * h].ljust(row * h, b"\0"), np.uint8).reshape(h, row)
    if depth == 8:
        return rows[:, :w]
    bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, :w]
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)


def _bands(w: int, h: int) -> Iterator[tuple[int, int]]:
    step = max(1, BAND // max(1, w))
    return ((y, min(h, y + step)) for y in range(0, h, step))


def _told_roughness(data: bytes, w: int, h: int, depth: int, row: int) -> float:
    """``roughness`` of indexed pixels, a part at a time; rows behind the data are blank and add nothing."""
    total = 0
    for y, end in _bands(w, min(h, -(-len(data) // row) + 1)):
        low = max(0, y - 1)
        x = _indices(data[low * row : end * row], w, end - low, depth, row).astype(np.int16)
        total += int(np.abs(np.diff(x[y - low :], axis=1)).sum(dtype=np.int64) + np.abs(np.diff(x, axis=0)).sum(dtype=np.int64))
    return total / max(1, h * (w - 1) + (h - 1) * w)


def _similar_halves(x: np.ndarray) -> float:
    half = x.shape[1] // 2
    return float((x[:, :half] == x[:, half:]).mean()) if half and half * 2 == x.shape[1] else 0.0


def _guesses(data: bytes, depth: int) -> Iterator[tuple[float, int, int, int]]:
    """``(score, width, height, row)`` of every geometry that divides the data."""
    for h in range(2, min(512, len(data)) + 1):
        row, rest = divmod(len(data), h)
        if rest or row > 512:
            continue
        widest = row * 8 // depth
        for w in range(widest, max(1, widest - 31) - 1, -1):
            tight = -(-w * depth // 8)
            if any(-(-tight // a) * a == row for a in (1, 2, 4, 8, 16)) and max(w, h) <= 8 * min(w, h):
                yield roughness(_indices(data, w, h, depth, row)) + row - tight, w, h, row


def inferred(sources: list[bytes], depth: int) -> tuple[float, bytes, int, int, int] | None:
    """The smoothest geometry of indexed pixels; an image beside its own copy gives way to a squarer one nearly as smooth."""
    found = [(s, i, w, h, row) for i, d in enumerate(sources) if len(d) >= 64 for s, w, h, row in _guesses(d, depth)]
    if depth > 8 or not found:
        return None
    found.sort(key=lambda x: x[0])
    best = found[0]
    ratio = lambda w, h: max(w, h) / max(1, min(w, h))
    if ratio(best[2], best[3]) >= 2.5 and _similar_halves(_indices(sources[best[1]], best[2], best[3], depth, best[4])) >= 0.45:
        best = next((x for x in found[1:] if x[2] * x[3] == best[2] * best[3] and ratio(x[2], x[3]) <= 1.25 and x[0] <= best[0] + 15), best)
    return best[0], sources[best[1]], best[2], best[3], best[4]


def _stride(w: int, depth: int, row: int) -> int:
    return w + w % 2 if depth == 8 and row >= w + w % 2 else row


def render(data: bytes, w: int, h: int, depth: int, row: int, colors: np.ndarray | None = None, alpha: bytes | None = None, own_alpha: bool = False) -> np.ndarray:
    """RGBA pixels. 32 bits: each row has its alpha, red, green and blue one after another; alpha counts only where the flag says so."""
    out = np.full((h, w, 4), 255, np.uint8)
    if depth == 32:
        planes = np.frombuffer(data[: row * h].ljust(row * h, b"\0"), np.uint8).reshape(h, row)[:, : row // 4 * 4].reshape(h, 4, -1)[:, :, :w]
        out[:, :, :3] = np.moveaxis(planes[:, 1:], 1, 2)
        if own_alpha:
            out[:, :, 3] = planes[:, 0]
        return out
    if depth == 16:
        v = np.frombuffer(data[: row * h].ljust(row * h, b"\0"), np.uint8).reshape(h, row)[:, : w * 2].reshape(h, w, 2)
        v = v[:, :, 0].astype(np.uint16) << 8 | v[:, :, 1]
        for c, shift in enumerate((10, 5, 0)):
            out[:, :, c] = (v >> shift & 31) << 3
    else:
        row = _stride(w, depth, row)
        table = np.array([[255] * 3, [0] * 3], np.uint8) if depth == 1 else INDEX_GRAY if colors is None else colors
        wide = np.zeros((256, 3), np.uint8)
        wide[: len(table)] = table[:256]
        out[:, :, :3] = wide[_indices(data, w, h, depth, row)]
    if alpha is not None and len(alpha) == w * h:
        out[:, :, 3] = np.frombuffer(alpha, np.uint8).reshape(h, w)
    return out


class _Readings:
    """The bytes as they are, unpacked, inflated, and inflated and unpacked, each made when it is first asked for."""

    def __init__(self, data: bytes):
        self.made: list[bytes | None] = [data]

    def __iter__(self) -> Iterator[bytes]:
        for i in range(4):
            if i == len(self.made):
                before = self.made[i - 1]
                self.made.append(lenient_inflate(self.made[0]) if i == 2 else None if before is None else unpack_bits(before))
            if self.made[i] is not None:
                yield self.made[i]

    def plain(self) -> list[bytes]:
        """The readings that aren't unpacked."""
        list(self)
        return [d for d in self.made[::2] if d is not None]


def bitmap(data: bytes | None, width: int, height: int, depth: int, pitch: int = 0, colors: np.ndarray | None = None, alpha: bytes | None = None, flags: int = 0) -> tuple[str, bytes | None, int, int]:
    """``(format or reason, artifact, width, height)``: depths, encodings and row sizes are tried in order until a length fits.

    Nothing fits: rows packed one by one, then indexed pixels padded, cut or of an inferred geometry. No size and no
    guess: the bytes as they are, as ``dat``.
    """
    if not data:
        return "empty_asset", None, 0, 0
    sources = _Readings(data)
    depth = depth or 8
    own_alpha = bool(flags & 0x4000)

    def done(d: bytes, w: int, h: int, bits: int, row: int) -> tuple[str, bytes, int, int]:
        step = _stride(w, bits, row)
        mask = alpha if alpha is not None and len(alpha) == w * h else None
        parts = (render(d[y * step : end * step], w, end - y, bits, step, colors, mask and mask[y * w : end * w], own_alpha) for y, end in _bands(w, h))
        return "png", png_of(w, h, parts), w, h

    if width <= 0 or height <= 0:
        guess = inferred(list(sources), depth) if depth in (1, 2, 4, 8) else None
        return done(guess[1], guess[2], guess[3], depth, guess[4]) if guess else ("dat", data, 0, 0)
    depths = [depth, *(d for d in (32, 16, 8, 4, 1, 2) if d != depth)]
    for bits in depths:
        for d in sources:
            for row in row_sizes(width, bits, pitch):
                if d and (row * height == len(d) or (bits == 8 and 0 < len(d) - row * height <= row)):
                    return done(d, width, height, bits, row)
    for bits in depths:
        for row in row_sizes(width, bits, pitch):
            for d in sources.plain():
                if (rows := unpack_rows(d, row, height)) is not None:
                    return done(rows, width, height, bits, row)
    if depth in (1, 2, 4, 8):
        told = []
        sources = list(sources)
        for i, d in enumerate(sources):
            if len(d) >= 32:
                for row in row_sizes(width, depth, pitch):
                    miss = row * height - len(d)
                    told.append((_told_roughness(d, width, height, depth, row) + max(0, miss) / height + max(0, -miss) / row, i, row))
        best = min(told, default=None)
        guess = None if best and pitch > 0 else inferred(sources, depth)
        if best and (guess is None or best[0] <= guess[0]):
            return done(sources[best[1]], width, height, depth, best[2])
        if guess:
            return done(guess[1], guess[2], guess[3], depth, guess[4])
    return ("empty_asset" if len(data) <= 16 else "unsupported_content"), None, 0, 0


def stxt(data: bytes) -> str:
    """The text behind a styled text's header, or all of it."""
    if len(data) >= 12:
        head, size = struct.unpack_from(">II", data)
        if head == 12 and 12 + size <= len(data):
            data = data[12 : 12 + size]
    return data.decode("utf-8", "replace")


def wav(samples: bytes, rate: int, channels: int = 1, bits: int = 8) -> bytes:
    step = channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * step, step, bits) + b"data" + struct.pack("<I", len(samples)) + samples


def _sync(data: bytes, at: int, span: int | None = None) -> int:
    end = len(data) if span is None else min(len(data), at + span)
    return next((i for i in range(at, end - 1) if data[i] == 0xFF and data[i + 1] & 0xE0 == 0xE0), -1)


def sound(data: bytes) -> tuple[str, bytes]:
    """``(format, artifact)``: MP3 cut to its first frame, RIFF as it is, samples of a sound resource as WAV, else ``snd``."""
    if len(data) < 32:
        return "snd", data
    if data[:4] in (b"PTVw", b"\x00\x00\x01\x40"):
        at = _sync(data, 0)
        return "mp3", data[at:] if at >= 0 else data
    if data[:4] == b"RIFF":
        return "wav", data
    if data[:3] == b"ID3" or _sync(data, 0, 2) == 0:
        return "mp3", data
    at = Cursor(data)
    codec = None
    try:
        form = at.u16()
        if form == 1:
            kinds = at.u16()
            if not 1 <= kinds <= 10:
                return "snd", data
            for _ in range(kinds):
                codec = {b"ima4": "ima4", b"MAC3": "mace", b"MAC6": "mace"}.get(at.take(4), codec)
                at.u32()
        elif form == 2:
            at.u16()
        else:
            return "snd", data
        commands = at.u16()
        at.take(8 * commands + 4)
        channels, rate = at.u32(), at.u16()
        at.take(10)
        kind = at.u8()
        at.u8()
        bits = 8
        if kind in (0xFF, 0xFD):
            at.take(26)
            bits = at.u16()
            at.take(18)
        elif kind == 0:
            channels = 1
        else:
            return "snd", data
    except EOFError:
        return "snd", data
    frame = _sync(data, at.at, 128) if kind else -1
    if frame >= 0 and codec in (None, "ima4"):
        return "mp3", data[frame:]
    if codec or not rate or not 1 <= channels <= 8 or bits not in (8, 16):
        return "snd", data
    samples = data[at.at :]
    if bits == 16:
        samples = np.frombuffer(samples[: len(samples) // 2 * 2], ">i2").astype("<i2").tobytes()
    return "wav", wav(samples, rate, channels, bits)


def font(data: bytes) -> tuple[str, bytes]:
    found = [(i, ext) for sign, ext in ((b"\0\1\0\0", "ttf"), (b"OTTO", "otf")) if 0 <= (i := data.find(sign, 0, 515)) < len(data) - 4]
    return (min(found)[1], data[min(found)[0] :]) if len(data) >= 12 and found else ("font", data)


def flash(data: bytes) -> tuple[str, bytes]:
    found = [i for sign in (b"FWS", b"CWS") if (i := data.find(sign)) >= 0]
    return ("swf", data[min(found) :]) if found else ("dat", data)


def video(data: bytes) -> tuple[str, bytes]:
    found = [(i, ext) for sign, ext in ((b"moov", "mov"), (b"mdat", "mov"), (b"RIFF", "avi")) if (i := data.find(sign)) >= 0]
    if not found:
        return "dat", data
    at, ext = min(found)
    return ext, data[max(0, at - 4) if ext == "mov" else at :]


def xtra(data: bytes) -> tuple[str, bytes]:
    if data[:2] == b"MZ":
        return "x32", data
    return ("bundle" if data[:4] in (b"\xfe\xed\xfa\xce", b"\xce\xfa\xed\xfe") else "dat"), data


def _film(data: bytes) -> tuple[int, int, list[tuple[int, int, dict]]]:
    """The told frame count, the frames that are there, and ``(frame, channel, what changes)``."""
    out, count, read = [], 0, 0
    at = Cursor(data)
    try:
        at.take(12)
        at.u32(), at.u16()
        count = at.u32()
        for frame in range(count):
            size = at.u16()
            end = at.at + size
            read = frame + 1
            while at.at < end:
                channel = at.u8()
                if channel == 0xFF:
                    continue
                out.append((frame, channel, {"member": at.u16(), "ink": at.u8(), "blend": at.u8()} | at.rect()))
            at.at = end
    except EOFError:
        pass
    return (count if len(data) >= 22 else 0), read, out


def film_deltas(data: bytes) -> tuple[int, list[tuple[int, int, dict]]]:
    """Frame count and ``(frame, channel, what changes)`` of a film loop; ``forward_fill_state`` makes the frames' states of it."""
    count, _, out = _film(data)
    return count, out


def film_loop(data: bytes) -> bytes:
    """All frames that are there as JSON, each with the state that the frames up to it leave; a frame without a change repeats it."""
    count, read, deltas = _film(data)
    state: dict[str, dict] = {}
    frames, k = [], 0
    for frame in range(read):
        while k < len(deltas) and deltas[k][0] == frame:
            state[str(deltas[k][1])] = deltas[k][2]
            k += 1
        frames.append({"channels": dict(state)})
    return json.dumps({"frame_count": count, "frames": frames}).encode()


def shape(kind: int, width: int, height: int, line: int, filled: bool, fore: str) -> bytes:
    """A rectangle (1), rounded one (2), ellipse (3) or line (4) as SVG."""
    w, h = abs(width) or line or 1, abs(height) or line or 1
    num = lambda v: f"{v:g}"
    paint = f'fill="{fore if filled else "none"}" stroke="{fore}" stroke-width="{line}"'
    if kind in (1, 2):
        body = f'<rect x="{num(line / 2)}" y="{num(line / 2)}" width="{w - line}" height="{h - line}" rx="{5 if kind == 2 else 0}" {paint}/>'
    elif kind == 3:
        body = f'<ellipse cx="{num(w / 2)}" cy="{num(h / 2)}" rx="{num((w - line) / 2)}" ry="{num((h - line) / 2)}" {paint}/>'
    elif kind == 4:
        body = f'<line x1="0" y1="0" x2="{w}" y2="{h}" stroke="{fore}" stroke-width="{line}"/>'
    else:
        body = ""
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}">{body}</svg>'.encode()


