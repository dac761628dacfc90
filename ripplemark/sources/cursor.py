"""A position in bytes, and numbers of either byte order."""

from __future__ import annotations

import struct
from functools import lru_cache


@lru_cache(1024)
def _layout(big: bool, code: str) -> struct.Struct:
    return struct.Struct((">" if big else "<") + code)


class Cursor:
    """Reads past the end raise EOFError."""

    def __init__(self, data: bytes, big: bool = True, at: int = 0):
        self.data, self.big, self.at = data, big, at

    def __len__(self) -> int:
        return len(self.data)

    def take(self, n: int) -> bytes:
        if n < 0 or self.at < 0 or self.at + n > len(self.data):
            raise EOFError(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int | float:
        layout, at = _layout(self.big, code), self.at
        if at < 0 or at + layout.size > len(self.data):
            raise EOFError(f"{layout.size} bytes at {at} of {len(self.data)}")
        self.at = at + layout.size
        return layout.unpack_from(self.data, at)[0]

    def numbers(self, code: str) -> tuple:
        """What a layout of several numbers reads, all of them or none."""
        layout, at = _layout(self.big, code), self.at
        if at < 0 or at + layout.size > len(self.data):
            raise EOFError(f"{layout.size} bytes at {at} of {len(self.data)}")
        self.at = at + layout.size
        return layout.unpack_from(self.data, at)

    def u8(self) -> int:
        return self.number("B")

    def i16(self) -> int:
        return self.number("h")

    def u16(self) -> int:
        return self.number("H")

    def i32(self) -> int:
        return self.number("i")

    def u32(self) -> int:
        return self.number("I")

    def tag(self) -> str:
        return self.take(4).decode("latin-1")

    def peek(self) -> str:
        return self.data[self.at : self.at + 4].decode("latin-1")

    def varint(self) -> int:
        """Groups of seven bits, the highest first; ends with a byte under 128, after six bytes or at the end. Signed 32 bits."""
        value = 0
        for _ in range(6):
            if self.at >= len(self.data):
                break
            byte = self.u8()
            value = (value << 7 | byte & 127) & 0xFFFFFFFF
            if byte < 128:
                break
        return value - (1 << 32) if value >> 31 else value

    def rect(self) -> dict[str, int]:
        return dict(zip(("top", "left", "bottom", "right"), self.numbers("4h")))
