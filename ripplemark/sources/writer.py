"""A writer of memory-mapped and compressed containers, for round trips."""

from __future__ import annotations

import struct
import zlib
from functools import cache


def key_table(entries: list[tuple[int, int, str]], big: bool = True) -> bytes:
    e = ">" if big else "<"
    tag = lambda t: t.encode("latin-1") if big else t.encode("latin-1")[::-1]
    return struct.pack(e + "HHII", 12, 12, len(entries), len(entries)) + b"".join(struct.pack(e + "ii", s, o) + tag(t) for s, o, t in entries)


def property_table(parts: list[bytes], big: bool = True) -> bytes:
    e = ">" if big else "<"
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    return struct.pack(f"{e}H{len(parts)}II", len(parts), *starts, sum(map(len, parts))) + b"".join(parts)


def member(kind: int, name: str = "", spec: bytes = b"", script_id: int = 0, big: bool = True) -> bytes:
    e = ">" if big else "<"
    raw = name.encode()[:255]
    info = struct.pack(e + "5I", 20, 0, 0, 0, script_id) + property_table([b"", bytes([len(raw)]) + raw if raw else b""], big)
    return struct.pack(e + "III", kind, len(info), len(spec)) + info + spec


def stxt(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">III", 12, len(raw), 0) + raw


def container(chunks: list[tuple[str, bytes]], big: bool = True, subtype: str = "MV93") -> bytes:
    """Chunk i of the list gets the id i + 3: the map itself has the first three."""
    e = ">" if big else "<"
    tag = lambda t: t.encode("latin-1") if big else t.encode("latin-1")[::-1]
    at = 12 + 16
    rows = [("RIFX", 0, 0), ("imap", 8, 12)]
    size = 24 + 20 * (len(chunks) + 3)
    rows.append(("mmap", size, at))
    at += 8 + size
    body = b""
    for t, data in chunks:
        rows.append((t, len(data), at))
        part = tag(t) + struct.pack(e + "I", len(data)) + data + b"\0" * (len(data) % 2)
        body += part
        at += len(part)
    table = struct.pack(e + "HHII", 24, 20, len(rows), len(rows)) + b"\0" * 12
    table += b"".join(tag(t) + struct.pack(e + "IIIi", n, o, 0, 0) for t, n, o in rows)
    imap = tag("imap") + struct.pack(e + "III", 8, 1, 28)
    return tag("RIFX") + struct.pack(e + "I", at - 8) + tag(subtype) + imap + tag("mmap") + struct.pack(e + "I", size) + table + body


def varint(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def packed(chunks: list[tuple[int, str, bytes, bool]], fmap: dict[int, int] | None = None) -> bytes:
    """``(id, tag, data, inline)``: inline chunks lie in the compressed stream (resource 2), the others behind it."""
    inline = b"".join(varint(i) + d for i, _, d, own in chunks if own)
    stream = zlib.compress(inline)
    rows = [varint(2) + varint(0) + varint(len(stream)) + varint(len(inline)) + varint(0) + b"ILS "]
    tail = stream
    for i, t, d, own in chunks:
        data = d if own else zlib.compress(d)
        rows.append(varint(i) + varint(0 if own else len(tail)) + varint(len(data)) + varint(len(d)) + varint(0) + t.encode("latin-1"))
        tail += b"" if own else data
    table = varint(0) + varint(0) + varint(len(rows)) + b"".join(rows)
    abmp = varint(0) + varint(len(table)) + zlib.compress(table)
    section = lambda t, d: t + varint(len(d)) + d
    maps = section(b"Fmap", b"".join(varint(a) + varint(b) for a, b in fmap.items())) if fmap else b""
    out = section(b"Fver", b"\x01") + maps + section(b"Abmp", abmp) + b"FGEI" + varint(2) + tail
    return b"RIFX" + struct.pack(">I", len(out) + 4) + b"FGDC" + out


def bitmap_spec(width: int, height: int, depth: int = 8, palette: int = 0) -> bytes:
    return struct.pack(">H4h8x", 0x8000 | width * depth // 8, 0, 0, height, width) + struct.pack(">hhBBhh", 0, 0, 0, depth, 0, palette)


def shape_spec(kind: int, width: int, height: int, line: int, pattern: int = 0, fore: int = 0) -> bytes:
    return struct.pack(">H4hhhHHhh", 0, 0, 0, height, width, kind, pattern, fore, 0, line, 0)


def sound(samples: bytes, rate: int, channels: int = 1) -> bytes:
    """A sound resource of the second form with an extended header."""
    return struct.pack(">HHH8s4xIH10xBB", 2, 0, 1, b"", channels, rate, 0xFF, 0) + struct.pack(">26xH18x", 8) + samples


def film_loop(frames: list[dict[int, tuple[int, ...]]]) -> bytes:
    """``{channel: (member, ink, blend, top, left, bottom, right)}`` of what changes in each frame."""
    body = b""
    for changes in frames:
        part = b"".join(struct.pack(">BHBB4h", c, *v) for c, v in changes.items())
        body += struct.pack(">H", len(part)) + part
    return bytes(12) + struct.pack(">IHI", 0, 0, len(frames)) + body


def config(low: int, high: int, version: int, depth: int, rate: int) -> bytes:
    out = bytearray(68)
    for at, value in ((12, low), (14, high), (28, depth), (36, version), (54, rate), (56, 1024), (58, 1)):
        struct.pack_into(">h", out, at, value)
    return bytes(out)


def timeline(frames: int, markers: list[tuple[int, str]]) -> bytes:
    labels = b"".join(struct.pack(">HB", f, len(n.encode())) + n.encode() for f, n in markers)
    return struct.pack(">III", 0, frames, 12) + struct.pack(">H", len(markers)) + labels


def name_table(names: list[str]) -> bytes:
    raw = [n.encode()[:255] for n in names]
    return struct.pack(">iiIIHH", 0, 0, 0, 0, 20, len(raw)) + b"".join(bytes([len(r)]) + r for r in raw)


def script_context(sections: list[int], names: int = -1) -> bytes:
    """Slot i + 1 holds section i."""
    return struct.pack(">8xIIHH12xi", len(sections), len(sections), 36, 8, names) + b"".join(struct.pack(">ii", 0, s) for s in sections)


@cache
def _operations() -> tuple[dict[str, int], dict[str, int]]:
    from ..functions.scripts import _PLAIN, _WIDE

    plain, wide = ({n: i for i, n in t.items()} for t in (_PLAIN, _WIDE))
    return plain, wide


def assemble(*codes: tuple) -> bytes:
    """Instructions ``(operation, operand)``, each operand in as few bytes as it needs; a third item tells their number."""
    plain, wide = _operations()
    out = b""
    for op, *rest in codes:
        if op in plain:
            out += bytes([plain[op]])
            continue
        value = rest[0]
        size = rest[1] if len(rest) > 1 else 4 if isinstance(value, float) else 1 if 0 <= value < 128 else 2 if 0 <= value < 32768 else 4
        base = {1: 0x40, 2: 0x80, 4: 0xC0}[size]
        out += bytes([base + wide[op]]) + (struct.pack(">f", value) if isinstance(value, float) else (value & (256**size - 1)).to_bytes(size, "big"))
    return out


def script(names: list[str], handlers: list[tuple[str, list[str], list[str], bytes]], literals: list[str | int | float] = (), properties: list[str] = (), kind: int = 0) -> bytes:
    """A script chunk of the older form: handlers are ``(name, arguments, locals, code)``."""
    number = {n: i for i, n in enumerate(names)}
    ids = lambda told: b"".join(struct.pack(">H", number[n]) for n in told)
    body, at, rows = b"", 92, []

    def place(data: bytes) -> int:
        nonlocal body, at
        start = at
        body, at = body + data, at + len(data)
        return start

    props = place(ids(properties))
    for name, args, local, code in handlers:
        start, args_at, local_at = place(code), place(ids(args)), place(ids(local))
        rows.append(struct.pack(">HHIIHIHI22x", number[name], 0, len(code), start, len(args), args_at, len(local), local_at))
    table = place(b"".join(rows))
    told, data = b"", b""
    for x in literals:
        kind_, raw = (1, struct.pack(">I", len(x.encode()) + 1) + x.encode() + b"\0") if isinstance(x, str) else (2, struct.pack(">i", x)) if isinstance(x, int) else (9, struct.pack(">Id", 8, x))
        told += struct.pack(">II", kind_, len(data))
        data += raw
    where, stored = place(told), place(data)
    head = bytearray(92)
    struct.pack_into(">HH", head, 16, 92, kind)
    struct.pack_into(">h", head, 48, -1)
    struct.pack_into(">HI", head, 60, len(properties), props)
    struct.pack_into(">HI", head, 72, len(rows), table)
    struct.pack_into(">HI", head, 78, len(literals), where)
    struct.pack_into(">II", head, 84, len(data), stored)
    return bytes(head) + body.ljust(40, b"\0")
