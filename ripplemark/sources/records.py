"""Records inside chunks: ownership keys, script contexts, orders, names, members and settings."""

from __future__ import annotations

import struct

from .cursor import Cursor
from .tags import canonical


def _layouts(data: bytes, big: bool):
    """Every reading of a key table's header that fits its length: (header size, entry size, entries, used, big)."""

    def fits(head: int, entry: int, count: int, used: int) -> bool:
        return entry >= 8 and 0 < count and 0 <= used <= count and head + count * entry <= len(data)

    def words(order: bool, at: int) -> tuple[int, int]:
        return struct.unpack_from(">II" if order else "<II", data, at)

    for order in (big, not big):
        entry = struct.unpack_from(">H" if order else "<H", data)[0]
        if fits(12, entry, *words(order, 4)):
            yield 12, entry, *words(order, 4), order
    for order in (big, not big):
        short = [(12, 8, 4)]
        long = [(20, 12, 12)] if len(data) >= 20 else []
        first = struct.unpack_from(">H" if order else "<H", data)[0]
        for head, entry, at in short + long if first == 12 else long + short:
            if fits(head, entry, *words(order, at)):
                yield head, entry, *words(order, at), order
                break


def key_table(data: bytes, big: bool = True) -> list[tuple[int, int, int, str]]:
    """``(index, section, owner, tag)`` of each used entry; of several readings the one with most used entries, most entries, least header."""
    if len(data) < 12:
        return []
    best = min(_layouts(data, big), key=lambda x: (-x[3], -x[2], x[0]), default=None)
    if best is None:
        return []
    head, size, _, used, order = best
    out = []
    row = struct.Struct((">" if order else "<") + ("ii4s" if size >= 12 else "i4s"))
    for i in range(used):
        section, *owner, tag = row.unpack_from(data, head + i * size)
        out.append((i, section, owner[0] if owner else i + 1, canonical(tag.decode("latin-1"))))
    return out


def script_context(data: bytes, big: bool = True) -> list[tuple[int, int, int]]:
    """``(slot, section, name table's section)`` for each slot that has a section; -1 where no name table is told."""
    if len(data) < 20:
        return []
    for order in (big, not big):
        at = Cursor(data, order, 8)
        count, _, start, size = at.u32(), at.u32(), at.u16(), at.u16()
        if count <= 0xFFFF and start <= len(data) and size <= 1024:
            break
    names = Cursor(data, order, 32).i32() if len(data) >= 36 else -1
    out = []
    for i in range(count):
        at = Cursor(data, order, start + i * size)
        if size < 8 or at.at + size > len(data):
            break
        at.i32()
        section = at.i32()
        if section > -1:
            out.append((i + 1, section, names))
    return out


def member_order(data: bytes, wide: bool = False) -> list[tuple[int, int]]:
    """``(slot, resource)`` from slot 1; zeros are empty slots."""
    n = 4 if wide and len(data) % 4 == 0 else 2
    ids = struct.unpack(f">{len(data) // n}{'I' if n == 4 else 'H'}", data[: len(data) // n * n])
    return [(i + 1, x) for i, x in enumerate(ids) if x]


def name_table(data: bytes) -> list[str]:
    """Names in order; an empty or overlong one is ''."""
    if len(data) < 20:
        return []
    at = Cursor(data, True, 16)
    at.at, count = at.u16(), at.u16()
    out = []
    for _ in range(count):
        if at.at >= len(data):
            break
        n = at.u8()
        part = data[at.at : at.at + n]
        out.append(part.decode("utf-8", "replace") if len(part) == n else "")
        at.at += n
    return out


def items(data: bytes, at: Cursor) -> list[bytes]:
    """The items behind an offset table: each ends where the next begins, the last at the total."""
    count = at.u16()
    starts = at.numbers(f"{count + 1}I")
    base = at.at
    return [data[base + a : base + b] if a < b and base + b <= len(data) else b"" for a, b in zip(starts, starts[1:])]


def palette_id(raw: int) -> int:
    """Built-in palettes count down from -1."""
    return raw - 1 if raw <= 0 else raw


def _text(item: bytes) -> str | None:
    return item.decode("utf-8", "replace").strip() or None


def _spec(kind: int, data: bytes, big: bool) -> dict:
    at = Cursor(data, big)
    n = len(data)
    if kind == 1 and n >= 10:
        pitch = at.u16()
        box = at.rect()
        out = {"cast_flags": pitch, "pitch": pitch & 0x3FFF, "rect": box, "width": abs(box["right"] - box["left"]), "height": abs(box["bottom"] - box["top"]), "bit_depth": 8 if pitch & 0x8000 else 1}
        y = x = 0
        if n >= 22:
            at.at = 18
            y, x = at.i16(), at.i16()
        if n >= 24:
            at.u8()
            out["bit_depth"] = at.u8() or out["bit_depth"]
        out |= {"reg_x": x - box["left"], "reg_y": y - box["top"], "palette_id": 0, "palette_lib": 0}
        if pitch & 0x8000 and n >= 26:
            at.at = 24
            lib = at.i16() if n >= 28 else 0
            number = at.i16()
            lib = 0 if lib == -1 else lib
            out |= {"palette_lib": lib, "palette_id": palette_id(number) if number <= 0 and lib == 0 else number}
        return out
    if kind == 8 and n >= 22:
        flags, box = at.u16(), at.rect()
        names = ("shape_type", "pattern", "fore", "back", "line_size", "line_dir")
        return {"cast_flags": flags, "rect": box, "width": box["right"] - box["left"], "height": box["bottom"] - box["top"]} | dict(zip(names, at.numbers("hhHHhh")))
    if kind in (3, 13) and n >= 8:
        return {"rect": at.rect()}
    if kind == 11 and n >= 2:
        return {"script_type": at.u16()}
    if kind in (2, 7, 9) and n >= 12:
        return {"cast_flags": at.u16(), "rect": at.rect()}
    if kind == 6 and n >= 10:
        return {"cast_flags": at.u16(), "sample_rate": at.u32(), "bit_depth": at.u16(), "channels": at.u16()}
    if kind == 14 and n >= 14:
        return {"cast_flags": at.u16(), "duration": at.u16(), "chunk_size": at.u16(), "transition_type": at.u16()}
    if kind == 15 and n >= 4:
        return {"cast_flags": at.u16(), "xtra_id": at.u16()}
    if kind == 4 and n >= 2:
        return {"cast_flags": at.u16()}
    return {}


RECT = "struct<top:int,left:int,bottom:int,right:int>"
MEMBER = (
    "struct<type_id:bigint,name:string,script_text:string,comment:string,flags:bigint,script_id:bigint,created:bigint,modified:bigint,guid:string,"
    f"width:int,height:int,bit_depth:int,pitch:int,palette_id:int,palette_lib:int,reg_x:int,reg_y:int,cast_flags:int,rect:{RECT},shape_type:int,pattern:int,fore:int,back:int,"
    "line_size:int,line_dir:int,script_type:int,sample_rate:bigint,channels:int,duration:int,chunk_size:int,transition_type:int,xtra_id:int,spec:binary>"
)


def member(data: bytes, big: bool = True) -> dict | None:
    """A member's record: type, common info, property items and the fields of its type. None for fewer than 12 bytes."""
    if len(data) < 12:
        return None
    at = Cursor(data, big)
    kind, info, spec = at.numbers("III")
    if kind > 0xFFFF:
        at = Cursor(data, not big)
        kind, info, spec = at.numbers("III")
    out: dict = {"type_id": kind}
    if 0 < info <= len(data) - at.at:
        part = at.take(info)
        if info >= 20:
            inner = Cursor(part, at.big)
            where, _, _, out["flags"], out["script_id"] = inner.numbers("5I")
            if info >= 28:
                out["created"], out["modified"] = inner.u32(), inner.u32()
            try:
                parts = items(part, Cursor(part, at.big, where)) if 0 < where < info else []
            except EOFError:
                parts = []
            for i, item in enumerate(parts):
                if not item:
                    continue
                if i == 0:
                    out["script_text"] = item.decode("utf-8", "replace")
                elif i == 1 and 0 < item[0] < len(item):
                    out["name"] = _text(item[1 : 1 + item[0]])
                elif i == 4 or (i == 20 and not out.get("comment")):
                    out["comment"] = _text(item)
                elif i == 5 and len(item) >= 2:
                    out["palette_id"] = palette_id(struct.unpack_from(">h", item)[0])
                elif i == 6 and len(item) >= 2:
                    out["bit_depth"] = struct.unpack_from(">h", item)[0]
                elif i == 15 and len(item) == 16:
                    out["guid"] = item.hex()
                elif i == 17 and len(item) >= 4:
                    out["created"] = struct.unpack_from(">i", item)[0]
    if 0 < spec <= len(data) - at.at:
        out["spec"] = at.take(spec)
        out |= _spec(kind, out["spec"], at.big)
    return out


CONFIG = f"struct<min_member:int,max_member:int,version:int,palette_id:int,stage:{RECT},stage_color:string,bit_depth:int,frame_rate:int,platform:string,protected:boolean>"


def config(data: bytes) -> dict | None:
    """A movie's settings; fields behind the end of a short record are null. None for fewer than 32 bytes."""
    if len(data) < 32:
        return None
    at = lambda i, code=">h": struct.unpack_from(code, data, i)[0] if i + struct.calcsize(code) <= len(data) else None
    version = at(36) if len(data) > 38 else at(2, ">H")
    number = -1
    if 0x400 <= version < 0x4B1:
        number = at(48)
    elif version >= 0x4B1:
        number = at(56)
    number = -1 if number is None else number
    old = (at(36) if at(36) is not None else 0) < 700
    if old:
        color = f"Palette Index {at(26)}"
    else:
        r, g, b = data[27], data[18], data[19]
        color = f"#{r:02X}{g:02X}{b:02X}" if data[26] else f"Palette Index {r}"
    platform = at(56)
    guard = at(58)
    return {
        "min_member": at(12), "max_member": at(14), "version": version, "palette_id": palette_id(number), "stage": dict(zip(("top", "left", "bottom", "right"), struct.unpack_from(">4h", data, 4))),
        "stage_color": color, "bit_depth": at(28), "frame_rate": at(54), "platform": {-1: "Macintosh", 1024: "Windows"}.get(platform, f"Unknown ({platform})"), "protected": guard is not None and guard % 23 == 0,
    }


def timeline(data: bytes, score: bool = False) -> dict:
    """Frame count and ``(frame, name)`` markers; ``score``: the form whose labels' offset stands at 12."""
    out: dict = {"frame_count": 0, "markers": []}
    try:
        at = Cursor(data, True, 12 if score else 4)
        if not score:
            out["frame_count"] = at.u32()
        where = at.u32()
        if 0 < where < len(data):
            at.at = where
            for _ in range(at.u16()):
                frame, n = at.u16(), at.u8()
                out["markers"].append((frame, at.take(n).decode("utf-8", "replace")))
    except EOFError:
        pass
    return out


PRELOAD = ("Never", "When Needed", "Before Frame 1", "After Frame 1")


def cast_list(data: bytes) -> list[tuple[int, str, str, str]]:
    """``(index, name, path, preload)`` of each linked library; the internal one is left out."""
    import re

    try:
        at = Cursor(data)
        where = at.u32()
        at.u16()
        count, each = at.u16(), at.u16()
        if where >= len(data) or not count or not each:
            return []
        at.at = where
        found = items(data, at)
    except EOFError:
        return []

    def text(i: int) -> str:
        item = found[i] if i < len(found) else b""
        if item and 0 < item[0] < len(item):
            return item[1 : 1 + item[0]].decode("utf-8", "replace")
        return item.replace(b"\0", b"").decode("utf-8", "replace").strip()

    out = []
    for i in range(len(found) // each):
        name, path = text(i * each + 1) or "Unnamed Cast", text(i * each + 2)
        mode = found[i * each + 3] if each > 3 else b""
        preload = struct.unpack_from(">H", mode)[0] if len(mode) >= 2 else 1
        if re.search(r"[\\/]|\.c[sc]t$", name, re.I):
            path = path or name
            name = re.sub(r"\.(cst|cct|dcr|dir)$", "", name.replace("\\", "/").rsplit("/", 1)[-1], flags=re.I)
        if re.search(r"[\\/]", path) and not re.search(r"\.(cst|cct|dcr|dir)$", path, re.I):
            path += ".cst"
        if name.lower() != "internal":
            out.append((i + 1, name, path, PRELOAD[preload] if preload < 4 else f"Unknown ({preload})"))
    return out
