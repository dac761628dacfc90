"""Script bytecode to source text and instruction listings.

A handler is a stack machine. Each instruction pops and pushes expressions, which are text as soon as they are made, with the kind that
decides whether they need parentheses inside others; statements go to the innermost open block, and a block closes at a position in the code.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from math import copysign, inf

from ..sources.cursor import Cursor

LEAST = 132
TOO_SMALL = "-- Script buffer too small/empty"
_FIXED = 92  # header length of the older form

_PLAIN = dict(
    enumerate(
        "ret ret_factory pushint0 mul add sub div mod inv joinstr joinpadstr lt lteq nteq eq gt gteq and or not containsstr contains0str getchunk hilitechunk "
        "ontospr intospr getfield starttell endtell pushlist pushproplist . swap".split(),
        1,
    )
)
_WIDE = dict(
    enumerate(
        "pushint8 pusharglistnoret pusharglist pushcons pushsymb pushvarref . getglobal2 getglobal getprop getparam getlocal . setglobal2 setglobal setprop setparam setlocal "
        "jmp endrepeat jmpifz localcall extcall objcallv4 put putchunk deletechunk get set . getmovieprop setmovieprop getobjprop setobjprop tellcall peek pop thebuiltin objcall "
        ". . . . . pushchunkvarref pushint16 pushint32 getchainedprop pushfloat32 gettoplevelprop newobj".split(),
        1,
    )
)
#: Wide operations with signed operands of two bytes.
_SIGNED = {0x01, 0x2E, 0x13, 0x14, 0x15, 0x16, 0x2F}
_BINARY = {
    "add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "mod", "eq": "=", "nteq": "<>", "lt": "<", "gt": ">", "lteq": "<=", "gteq": ">=",
    "and": "and", "or": "or", "joinstr": "&", "joinpadstr": "&&", "containsstr": "contains",
}
_BARE = frozenset("put alert set go try catch delete hilite".split())
_PUT = {1: "into", 2: "after", 3: "before"}
_CHUNKS = {1: "char", 2: "word", 3: "item", 4: "line"}
_MOVIE = "floatPrecision,mouseDownScript,mouseUpScript,keyDownScript,keyUpScript,timeoutScript,short time,abbr time,long time,short date,abbr date,long date".split(",")
_SPRITE = dict(enumerate("type spriteNum foreColor backColor startFrame endFrame member visible ink blend script scriptNum".split())) | {
    15: "loc", 16: "scoreColor", 21: "rect", 22: "width", 23: "height",
}
_STAGE = dict(
    enumerate(
        "beepOn buttonStyle centerStage checkBoxAccess checkboxType colorDepth colorQD exitLock fixStageSize fullColorPermit imageDirect doubleClick key lastClick lastEvent keyCode lastKey lastRoll "
        "timeoutLapsed multiSound pauseState quickTimePresent selEnd selStart soundEnabled soundLevel stageColor . switchColorDepth timeoutKeyDown timeoutLength timeoutMouse timeoutPlay timer "
        "preLoadRAM videoForWindowsPresent netPresent safePlayer soundKeepDevice soundMixMedia".split(),
        1,
    )
)
_STAGE.pop(28)
_COUNTS = dict(enumerate(["perFrameHook", *(f"number of {x}" for x in "castMembers menus castLibs xtras".split())], 1))
_MEMBER = dict(enumerate("name text textStyle textFont textHeight textAlign textSize picture hilite number size loop duration controller directToStage sound foreColor backColor type".split(), 1))


@dataclass(slots=True)
class Code:
    """One instruction. ``operand`` of a jump is a distance, of others a number or an index of a table."""

    op: str
    operand: int | float
    at: int
    loop: str = ""
    variable: Code | None = None


@dataclass(frozen=True)
class Expr:
    kind: str
    text: str
    value: object = None
    #: Of an argument list: its expressions, whether a value is left of it on the stack, and whether the call's result is dropped.
    items: tuple[Expr, ...] = ()
    beside: bool = False
    dropped: bool = False
    #: Of a comparison and a negation: what is compared or negated.
    parts: tuple[Expr, ...] = ()


@dataclass
class Block:
    owner: Statement | None = None
    end: int = 0
    lines: list[Statement] = field(default_factory=list)
    outer: Block | None = None


class Statement:
    """``head`` and, for blocks, the text before each and after the last one; a case has its branches as ``labels``."""

    def __init__(self, kind: str, head: str, blocks: int = 0, expr: Expr | None = None, indented: bool = True):
        self.kind, self.head, self.expr, self.indented = kind, head, expr, indented
        self.blocks = [Block(self) for _ in range(blocks)]
        self.otherwise = False
        self.final = -1
        self.branches: list[tuple[str, Block]] = []
        self.of: Statement | None = None

    def lines(self, pad: str, out: list[str]) -> None:
        if self.kind == "case":
            out.append(f"{pad}{self.head}")
            for i, (label, block) in enumerate(self.branches):
                if i:
                    out.append("")
                out.append(f"{pad}  {label}:")
                _lines(block, pad + "    ", out)
            out += ["", f"{pad}end case"] if self.branches else ["", f"{pad}end case"]
            return
        out.append(self.head if not self.indented else pad + self.head)
        if self.kind == "if":
            _lines(self.blocks[0], pad + "  ", out)
            if self.otherwise:
                out.append(f"{pad}else")
                _lines(self.blocks[1], pad + "  ", out)
            out.append(f"{pad}end if")
        elif self.kind == "repeat":
            _lines(self.blocks[0], pad + "  ", out)
            out.append(f"{pad}end repeat")
        elif self.kind == "try":
            _lines(self.blocks[0], pad + "  ", out)
            out.append(f"{pad}catch")
            _lines(self.blocks[1], pad + "  ", out)
            out.append(f"{pad}end try")


def _lines(block: Block, pad: str, out: list[str]) -> None:
    for s in block.lines:
        s.lines(pad, out)


def number(value: float) -> str:
    """A number in its shortest decimal form; whole ones without a point, very large and small ones with an exponent."""
    if value != value:
        return "NaN"
    if value in (inf, -inf):
        return "Infinity" if value > 0 else "-Infinity"
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    digits, _, power = repr(abs(value)).partition("e")
    sign = "-" if copysign(1, value) < 0 else ""
    if not power:
        if abs(value) >= 1e-6:
            return sign + digits
        first = len(digits) - len(digits.lstrip("0."))
        power = str(1 - first)
        digits = digits[first:]
        digits = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
    if -7 < int(power) < 0:
        return sign + "0." + "0" * (-int(power) - 1) + digits.replace(".", "")
    return f"{sign}{digits.removesuffix('.0')}e{int(power):+d}"


def _hex(value: int | float) -> str:
    """At least four hexadecimal digits, with a fraction for numbers that have one."""
    if isinstance(value, int) or value != value or value in (inf, -inf):
        return (f"{value:x}" if isinstance(value, int) else number(value)).rjust(4, "0")
    sign, value = ("-" if value < 0 else ""), abs(value)
    whole, rest, digits = int(value), value % 1, ""
    while rest:
        rest *= 16
        digits += f"{int(rest):x}"
        rest %= 1
    return f"{sign}{whole:x}{'.' if digits else ''}{digits}".rjust(4, "0")


def _string(text: str) -> Expr:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\r")):
        text = text.replace(a, b)
    return Expr("string", f'"{text}"', text)


def _int(value: int) -> Expr:
    return Expr("int", str(value), value)


def _float(value: float) -> Expr:
    return Expr("float", number(value), value)


def _error(message: str) -> Expr:
    return Expr("error", f"-- [DECOMPILE ERROR: {message}]", message)


def _wrapped(e: Expr, *kinds: str) -> str:
    return f"({e.text})" if e.kind in kinds else e.text


def _binary(op: str, a: Expr, b: Expr) -> Expr:
    left, right = _wrapped(a, "binary", "the", "of"), _wrapped(b, "binary")
    text = f"{left}.{right}" if op == "." else f"{left}[{right}]" if op == "[]" else f"{left} {op} {right}"
    return Expr("binary", text, op, parts=(a, b))


def _of(name: str, e: Expr) -> str:
    return f"{name} {_wrapped(e, 'binary', 'call', 'method')}"


def _property(name: str, e: Expr) -> Expr:
    return Expr("of", _of(f"the {name} of", e))


def _arguments(args: Expr) -> str:
    return ", ".join(x.text for x in args.items) if args.kind == "args" else args.text


def _call(name: str, args: Expr) -> Expr:
    text = _arguments(args)
    return Expr("call", f"{name} {text}" if name in _BARE else f"{name}({text})", name)


def _member(kind: str, ident: Expr, library: Expr | None) -> Expr:
    return Expr("member", f"{kind} {ident.text}" + (f" of castLib {library.text}" if library is not None and library.text != "0" else ""))


def _args(items: list[Expr], **more: bool) -> Expr:
    return Expr("args", "", items=tuple(items), **more)


@dataclass
class Script:
    """The tables of a script chunk; ``names`` are those of its context."""

    data: bytes
    names: list[str]
    header: int = 0
    kind: int = 0
    parts: dict[str, tuple[int, int, bool]] = field(default_factory=dict)  # offset, length or count, whether it is a count
    shift: int = 0
    literals: list[Expr] = field(default_factory=list)
    handlers: list[tuple[int, int, int, int, int, int, int]] = field(default_factory=list)

    def name(self, ident: int, use: str = "handle") -> str:
        n = len(self.names)
        if not n:
            return f"p_{ident}" if "prop" in use else f"n_{ident}"
        shift = self.shift if use in ("handle", "global") else 0
        return self.names[(ident - shift + n * 50) % n] or f"u_{ident}"


def plausible(name: str) -> bool:
    """Whether a name may be a handler's."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or "") or re.fullmatch(r"[alnpu]_[0-9]+", name) or re.match(r"[tplag][A-Z]", name):
        return False
    return name not in {"me", "constant", "call", "return", "try", "catch", "param", "paramCount", *(f"{x}p" for x in ("string", "object", "void", "integer", "symbol")), "width", "height"}


def _shift(script: Script) -> int:
    """How far the name table is rotated: where the first handler is ``new`` or ``construct``, if that makes more handler names plausible."""
    names, first = script.names, script.handlers[0][0] if script.handlers else 0
    found = [names.index(x) for x in ("new", "construct") if x in names]
    if not names or first in found or script.kind not in (4, 7, 8, 3, 6):
        return 0

    def score(shift: int) -> int:
        told = [names[(h[0] - shift + 50 * len(names)) % len(names)] for h in script.handlers[:6]]
        return sum(3 if plausible(n) else -4 for n in told) if told else -(1 << 30)

    best = 0
    for at in found:
        shift = (first - at + len(names)) % len(names)
        if score(shift) > score(best):
            best = shift
    return best


def _literal(kind: int, at: Cursor) -> Expr:
    if kind == 2:
        return _int(at.i32())
    if kind in (1, 4):
        n = at.u32()
        text = at.data[at.at : at.at + n - 1].decode("utf-8", "replace") if n else ""
        at.at = min(len(at), at.at + max(0, n - 1))
        return _string(text) if kind == 1 else Expr("symbol", f"#{text}", text)
    if kind in (3, 9):
        at.u32()
        return _float(at.number("d"))
    if kind == 5:
        items = []
        for _ in range(at.u32()):
            inner, _ = at.u32(), at.u32()
            items.append(_literal(inner, at))
        return Expr("list", f"[{', '.join(x.text for x in items)}]")
    return _error(f"LT_{kind}")


def read(data: bytes, names: list[str], kind: int = 0, big: bool = True) -> Script:
    """The tables of a script chunk; ``kind`` is the script's type where the header tells none."""
    out = Script(data, names)
    out.header, told = struct.unpack_from(">HH", data, 16)
    out.kind = told or kind
    try:
        if out.header == _FIXED:
            for tag, at in (("PROP", 60), ("HAND", 72), ("LIT ", 78)):
                count, offset = struct.unpack_from(">HI", data, at)
                out.parts[tag] = offset, count, True
            size, offset = struct.unpack_from(">II", data, 84)
            out.parts["LTD "] = offset, size, False
        else:
            at = Cursor(data, True, 52 if out.header == 54 else 50)
            for _ in range(at.u16()):
                tag, offset, size = at.tag(), at.u32(), at.u32()
                out.parts[tag] = offset, size, False
    except (EOFError, struct.error):
        out.parts, out.header, out.kind = {}, 0, kind

    def rows(tag: str, width: int) -> tuple[int, int]:
        offset, n, counted = out.parts.get(tag, (len(data), 0, True))
        return (offset, n if counted else -(-n // width)) if width and offset < len(data) else (offset, 0)

    width = 46 if out.header == _FIXED else out.header
    offset, count = rows("HAND", width)
    at = Cursor(data, big, offset)
    for _ in range(count):
        name, _, size, start, args, args_at, local, local_at = at.numbers("HHIIHIHI") if at.at + 24 <= len(data) else [at.number(c) for c in "HHIIHIHI"]
        out.handlers.append((name, size, start, args, args_at, local, local_at))
        at.at += width - 24
    out.shift = _shift(out)
    offset, count = rows("LIT ", 8)
    if "LTD " in out.parts:
        at = Cursor(data, big, offset)
        told = [(at.u32(), at.u32()) for _ in range(count)]
        for kind_, where in told:
            at.at = out.parts["LTD "][0] + where
            out.literals.append(_literal(kind_, at))
    return out


def properties(script: Script, big: bool = True) -> list[str]:
    offset, n, counted = script.parts.get("PROP", (len(script.data), 0, True))
    if offset >= len(script.data):
        return []
    at = Cursor(script.data, big, offset)
    found = [script.name(at.u16()) for _ in range(n if counted else -(-n // 2))]
    return [x for x in found if x not in ("pNoiseStripped", "constant")]


def symbols(script: Script, count: int, offset: int, big: bool = True) -> tuple[list[str], bool]:
    """Names of arguments or locals, without ``me``, and whether it was there."""
    if not 0 <= offset < len(script.data):
        return [], False
    at = Cursor(script.data, big, offset)
    whole = offset + 2 * count <= len(script.data)
    found = [script.name(i) for i in (at.numbers(f"{count}H") if whole else (at.u16() for _ in range(count)))]
    return [x for x in found if x not in ("me", "constant")], "me" in found


def instructions(data: bytes, base: int = 0) -> list[Code]:
    """The instructions of a handler: no operand below 0x40, then one, two and four bytes; a cut one is an error."""
    out, at = [], Cursor(data)
    while at.at < len(data):
        where, byte = at.at, data[at.at]
        at.at += 1
        low = byte % 0x40
        if byte < 0x40:
            name, value = _PLAIN.get(byte, "."), 0
        else:
            name = _WIDE.get(low, ".")
            if byte >= 0xC0:
                value = at.number("f" if low == 0x31 else "i" if low == 0x2F else "I")
            elif byte >= 0x80:
                value = at.number("h" if low in _SIGNED else "H")
            else:
                value = at.number("b" if low == 0x01 else "B")
        out.append(Code(f"unk_0x{byte:x}" if name == "." else name, value, base + where))
    return out


def _is(code: Code, value: int) -> bool:
    return (code.op in ("pushint8",) and code.operand == value) or (value == 0 and code.op == "pushint0")


_GET = {"setglobal": ("getglobal", "getglobal2"), "setglobal2": ("getglobal", "getglobal2"), "setprop": ("getprop",), "setparam": ("getparam",), "setlocal": ("getlocal",)}


def _counted(codes: list[Code], jump: int, after: int, index: dict[int, int]) -> tuple[str, Code, list[int]] | None:
    """A loop that counts: its tag, the instruction that sets its variable, and the instructions that its head stands for."""
    if jump < 1 or codes[jump - 1].op not in ("lteq", "gteq") or after < 5:
        return None
    down = codes[jump - 1].op == "gteq"
    head = index.get(codes[after - 1].at - codes[after - 1].operand)
    if head is None or head < 1:
        return None
    put, got = codes[head - 1], codes[head]
    gets = _GET.get(put.op, ())
    step, again, add, back = codes[after - 5 : after - 1]
    same = got.op in gets and again.op in gets and got.operand == again.operand == back.operand == put.operand
    if not same or not _is(step, -1 if down else 1) or add.op != "add" or back.op != put.op:
        return None
    return ("down" if down else "to"), put, [head - 1, head, jump - 1, *range(after - 5, after)]


def _listed(codes: list[Code], jump: int, after: int, script: Script) -> tuple[str, Code, list[int]] | None:
    """A loop over a list: a counter and the list lie on the stack."""
    if jump < 7 or jump + 5 >= len(codes) or not 3 <= after < len(codes):
        return None

    def shape(part: list[Code], *wanted: tuple[str, int | str | None]) -> bool:
        for c, (op, value) in zip(part, wanted):
            if op == "int":
                if not _is(c, value):
                    return False
            elif c.op != op or (isinstance(value, str) and script.name(c.operand) != value) or (isinstance(value, int) and c.operand != value):
                return False
        return True

    before = shape(codes[jump - 7 : jump], ("peek", 0), ("pusharglist", 1), ("extcall", "count"), ("int", 1), ("peek", 0), ("peek", 2), ("lteq", None))
    behind = shape(codes[jump + 1 : jump + 5], ("peek", 2), ("peek", 1), ("pusharglist", 2), ("extcall", "getAt")) and codes[jump + 5].op in _GET
    end = shape(codes[after - 3 : after + 1], ("int", 1), ("add", None), ("endrepeat", None), ("pop", 3))
    return ("in", codes[jump + 5], [*range(jump - 7, jump), *range(jump + 1, jump + 6), *range(after - 3, after + 1)]) if before and behind and end else None


def tag_loops(codes: list[Code], script: Script) -> None:
    index = {c.at: i for i, c in enumerate(codes)}
    for i, c in enumerate(codes):
        if c.op != "jmpifz":
            continue
        after = index.get(c.at + c.operand, 0)
        if after < 1 or codes[after - 1].op != "endrepeat" or codes[after - 1].at - codes[after - 1].operand > c.at:
            continue
        found = _listed(codes, i, after, script) or _counted(codes, i, after, index)
        c.loop = found[0] if found else "while"
        if found:
            c.variable = found[1]
            for k in found[2]:
                codes[k].loop = "skip"


class Handler:
    """One handler's translation."""

    def __init__(self, script: Script, row: tuple[int, ...], big: bool = True):
        ident, size, start, n_args, args_at, n_local, local_at = row
        self.script, self.label = script, script.name(ident)
        self.args, me = symbols(script, n_args, args_at, big)
        own = script.kind & 0xFF in (6, 7, 8) or script.kind >> 4 > 0
        if (own or me) and "me" not in self.args:
            self.args.insert(0, "me")
        self.locals, _ = symbols(script, n_local, local_at, big)
        self.codes = instructions(script.data[start : start + size], start)
        tag_loops(self.codes, script)
        self.stack: list[Expr] = []
        self.body = self.block = Block()
        self.case: Statement | None = None
        self.at = 0

    # The stack and the blocks.

    def pop(self) -> Expr:
        return self.stack.pop() if self.stack else _error("Stack Underflow")

    def push(self, e: Expr) -> None:
        self.stack.append(e)

    def add(self, s: Statement) -> Statement:
        s.of = self.block.owner
        self.block.lines.append(s)
        return s

    def say(self, text: str, kind: str = "plain", expr: Expr | None = None, indented: bool = True) -> None:
        self.add(Statement(kind, text, expr=expr, indented=indented))

    def enter(self, block: Block, end: int | None = None) -> None:
        if end is not None:
            block.end = end
        block.outer, self.block = self.block, block

    def leave(self) -> None:
        self.block = self.block.outer or self.block

    def returned(self) -> bool:
        last = self.block.lines[-1] if self.block.lines else None
        return last is not None and last.kind == "return"

    def express(self, e: Expr) -> None:
        """An expression as a statement; only calls are indented."""
        self.say(e.text, "return" if e.kind == "call" and e.value == "return" else "plain", e, e.kind in ("call", "method"))

    # Names.

    def argument(self, i: int) -> str:
        return self.args[i] if 0 <= i < len(self.args) and self.args[i] else f"a_{i}"

    def local(self, i: int) -> str:
        return self.locals[i] if 0 <= i < len(self.locals) and self.locals[i] else f"l_{i}"

    def variable(self, code: Code | None) -> str:
        if code is None:
            return "i"
        if code.op.startswith("setglobal"):
            return self.script.name(code.operand, "global")
        return {"setprop": self.script.name, "setparam": self.argument, "setlocal": self.local}.get(code.op, lambda _: "i")(code.operand)

    def reference(self, kind: int) -> Expr:
        """A variable or field by its kind and the number on the stack."""
        library = self.pop() if kind == 6 and self.script.kind >= 5 else None
        ident = self.pop()
        if ident.kind == "error":
            return _error(f"VarRef {kind}: {ident.value}")
        names: dict[int, tuple[tuple[str, ...], str, Callable[[int], str]]] = {
            1: (("var", "prop"), "global", lambda i: self.script.name(i, "global")), 2: (("var", "prop"), "global", lambda i: self.script.name(i, "global")),
            3: (("var", "prop"), "property", self.script.name), 4: (("param",), "arg", self.argument), 5: (("local",), "local", self.local),
        }
        if kind == 6:
            return _member("field", ident, library)
        if kind not in names:
            return _error(f"Unhandled var type {kind}")
        own, what, find = names[kind]
        if ident.kind in own:
            return ident
        if not isinstance(ident.value, int) or ident.kind != "int":
            return _error(f"VarRef {kind}: Invalid {what} id")
        return Expr({4: "param", 5: "local"}.get(kind, "var"), find(ident.value))

    def chunk(self, base: Expr) -> Expr:
        """The part of a text that eight bounds tell, the last line's popped first."""
        bounds = [(self.pop(), self.pop()) for _ in range(4)]  # (last, first) of lines, items, words, chars
        out = base
        for kind, (last, first) in zip((4, 3, 2, 1), bounds):
            if first.kind == "int" and first.value == 0:
                continue
            if first.kind == "int" and first.value == -30000 and last.kind == "int" and last.value == 0:
                out = Expr("last", _of(f"the last {_CHUNKS[kind]} in", out))
            else:
                upto = "" if last.kind in ("int", "float") and last.value == 0 else f" to {last.text}"
                out = Expr("chunk", f"{_CHUNKS[kind]} {first.text}{upto} of {out.text}")
        return out

    def legacy(self, group: int, ident: Expr) -> Expr:
        """A property of the numbered tables."""
        i = ident.value if ident.kind in ("int", "float") else None
        if i is None:
            return Expr("var", f"v4prop_{group}_{ident.text}")
        old = self.script.header == _FIXED
        if group == 0:
            return Expr("the", f"the {_MOVIE[i]}") if 0 <= i < len(_MOVIE) else Expr("the", f"the movieProp_{i}") if i <= 11 else Expr("last", _of(f"the last {_CHUNKS.get(i - 11, 'chunk')} in", self.pop()))
        if group == 1:
            return Expr("count", _of(f"the number of {_CHUNKS.get(i, 'chunk')}s in", self.pop()))
        if group == 6:
            return _property(_SPRITE.get(i, f"spriteProp_{i}"), _member("sprite", self.pop(), None))
        if group == 7:
            return Expr("the", f"the {_STAGE.get(i, f'animationProp_{i}')}")
        if group == 8:
            name = _COUNTS.get(i, f"animation2Prop_{i}")
            if i == 2 and not old and self.stack:
                top = self.stack[-1]
                if top.kind == "int" and top.value == 0:
                    self.pop()
                elif top.kind != "error":
                    return _property(name, _member("castLib", self.pop(), None))
            return Expr("the", f"the {name}")
        if 9 <= group <= 21:
            name = _MEMBER.get(i, f"memberProp_{i}")
            library = None if old else self.pop()
            kind = "field" if group in (11, 12) else "script" if group in (20, 21) else "cast" if old else "member"
            entity = _member(kind, self.pop(), library)
            return _property(name, self.chunk(entity) if group in (10, 12, 21) else entity)
        return Expr("var", f"v4prop_{group}_{i}")

    # Instructions.

    def run(self) -> Handler:
        for self.at, code in enumerate(self.codes):
            while self.block.end > 0 and code.at >= self.block.end and self.block.outer:
                self.leave()
            self.otherwise(code)
            if self.case and 0 < self.case.final <= code.at:
                self.case = None
            if code.loop != "skip":
                self.step(code)
        return self

    def otherwise(self, code: Code) -> None:
        """Opens the last branch of a case where no further comparison follows before its end."""
        case = self.case
        if case is None or case.otherwise or not self.block.lines or self.block.lines[-1] is not case or not code.at < case.final or case.final <= 0:
            return
        for c in self.codes[self.at :]:
            if c.at >= case.final or c.op == "jmp":
                break
            if c.op == "jmpifz":
                return
        if code.op != "pop":
            case.otherwise = True
            self.branch("otherwise", case.final)

    def branch(self, label: str, end: int) -> None:
        holder = Statement("branch", "", 1)
        holder.of = self.case
        self.case.branches.append((label, holder.blocks[0]))
        self.enter(holder.blocks[0], end)

    def step(self, code: Code) -> None:
        op, n = code.op, code.operand
        name = lambda use="handle": self.script.name(n, use)
        if op in _BINARY:
            right, left = self.pop(), self.pop()
            self.push(_binary(_BINARY[op], left, right))
        elif op in ("pushint0", "pushint8", "pushint16", "pushint32"):
            self.push(_int(n))
        elif op == "pushfloat32":
            self.push(_float(n))
        elif op == "pushcons":
            self.push(self.script.literals[n] if n < len(self.script.literals) else _int(n))
        elif op == "pushsymb":
            self.push(Expr("symbol", f"#{name()}", name()))
        elif op == "pushvarref":
            self.push(Expr("var", name()))
        elif op == "pushchunkvarref":
            self.push(self.reference(n))
        elif op in ("getglobal", "getglobal2"):
            self.push(Expr("var", name("global")))
        elif op == "getprop":
            self.push(Expr("prop", name()))
        elif op == "getparam":
            self.push(Expr("param", self.argument(n)))
        elif op == "getlocal":
            self.push(Expr("local", self.local(n)))
        elif op == "getmovieprop":
            self.push(Expr("the", f"the {name('movie_prop')}"))
        elif op == "gettoplevelprop":
            self.push(Expr("var", name("global_prop")))
        elif op in _GET:
            if op != "setprop" or name() != "pNoiseStripped":
                self.say(f"{self.variable(code)} = {self.pop().text}")
        elif op == "setmovieprop":
            self.say(f"the {name('movie_prop')} = {self.pop().text}")
        elif op == "inv":
            self.push(Expr("unary", f"-{self.pop().text}"))
        elif op == "not":
            e = self.pop()
            self.push(Expr("not", f"not {e.text}", parts=(e,)))
        elif op in ("getobjprop", "getchainedprop"):
            self.push(_property(name(), self.pop()))
        elif op == "setobjprop":
            value, target = self.pop(), self.pop()
            self.say(f"{_property(name(), target).text} = {value.text}")
        elif op in ("get", "set"):
            ref = self.legacy(n, self.pop())
            self.push(ref) if op == "get" else self.say(f"{ref.text} = {self.pop().text}")
        elif op == "getfield":
            library = self.pop() if self.script.kind >= 5 else None
            self.push(_member("field", self.pop(), library))
        elif op in ("pusharglist", "pusharglistnoret"):
            cut = max(0, len(self.stack) - n)
            items, beside = self.stack[cut:], len(self.stack) > n
            del self.stack[cut:]
            self.push(_args(items, beside=beside, dropped=op.endswith("noret")))
        elif op in ("pushlist", "pushproplist"):
            self.literal(op, self.pop())
        elif op in ("getchunk", "putchunk", "put", "deletechunk", "hilitechunk"):
            self.text(op, n)
        elif op in ("localcall", "extcall", "tellcall", "thebuiltin", "newobj"):
            self.call(op, n)
        elif op in ("objcall", "objcallv4"):
            self.method(op, name())
        elif op in ("ret", "ret_factory"):
            self.give(op)
        elif op == "jmpifz":
            self.condition(code)
        elif op == "jmp":
            self.jump(code)
        elif op == "peek":
            self.peek(code)
        elif op == "pop":
            if (e := self.pop()).kind in ("call", "method"):
                self.express(e)

    def literal(self, op: str, args: Expr) -> None:
        items = args.items if args.kind == "args" else (args,)
        if op == "pushlist":
            self.push(Expr("list", f"[{', '.join(x.text for x in items)}]"))
        else:
            pairs = [f"{items[i].text}: {items[i + 1].text if i + 1 < len(items) else ''}" for i in range(0, len(items), 2)]
            self.push(Expr("list", f"[{', '.join(pairs)}]" if pairs else "[:]"))

    def text(self, op: str, n: int) -> None:
        """Reads and changes of parts of texts."""
        if op == "getchunk":
            self.push(self.chunk(self.pop()))
            return
        if op in ("deletechunk", "hilitechunk"):
            target = self.chunk(self.reference(n if op == "deletechunk" else 6))
            self.say(f"{op.removesuffix('chunk')} {target.text}")
            return
        target = self.reference(n & 15)
        if target.kind == "error":
            self.say(target.text, indented=False)
            return
        if op == "putchunk":
            target = self.chunk(target)
        how, value = _PUT.get(n >> 4 & 15), self.pop()
        self.say(f"put {value.text} {how} {target.text}" if how else f"{target.text} = {value.text}")

    def call(self, op: str, n: int) -> None:
        args = self.pop()
        if op == "newobj":
            items = args.items if args.kind == "args" else (args,)
            self.push(_call("new", _args([Expr("var", self.script.name(n)), *items])))
            return
        if op == "localcall":
            name = self.script.name(self.script.handlers[n][0]) if 0 <= n < len(self.script.handlers) else f"handler_{n}"
        else:
            name = self.script.name(n)
        e = _call(name, args)
        if op == "thebuiltin":
            self.push(e)
        elif name == "return" and self.returned():
            pass
        elif name == "try" and args.kind == "args" and args.dropped and not args.items:
            self.enter(self.add(Statement("try", "try", 2)).blocks[0])
        elif args.dropped:
            self.express(e)
        else:
            self.push(e)

    def method(self, op: str, name: str) -> None:
        """A method call; reads and writes of elements and properties have forms of their own."""
        args = self.pop()
        rest = list(args.items) if args.kind == "args" else [args]
        if op == "objcallv4":
            target = Expr("var", name)
        elif rest:
            target = rest.pop(0)
        elif args.kind == "args" and args.beside and self.stack:
            target = self.pop()
        elif op == "objcall":
            return
        symbol = bool(rest) and rest[0].kind == "symbol"
        dotted = lambda: _binary(".", target, Expr("var", rest[0].value))
        ranged = lambda a, b: _binary("[]", dotted(), Expr("range", f"{a.text}..{b.text}") if b else a)
        if name == "count" and len(rest) == 1 and symbol:
            e = _binary(".", target, Expr("var", f"{rest[0].value}.count"))
        elif name in ("getProp", "getPropRef") and len(rest) == 1 and symbol:
            e = dotted()
        elif name == "getAt" and len(rest) == 1:
            e = _binary("[]", target, rest[0])
        elif name == "setAt" and len(rest) == 2:
            self.say(f"{_binary('[]', target, rest[0]).text} = {rest[1].text}")
            return
        elif name in ("getProp", "getPropRef") and len(rest) in (2, 3) and symbol:
            e = ranged(rest[1], rest[2] if len(rest) == 3 else None)
        elif name == "setProp" and len(rest) in (3, 4) and symbol:
            self.say(f"{ranged(rest[1], rest[2] if len(rest) == 4 else None).text} = {rest[-1].text}")
            return
        else:
            e = Expr("method", f"{_wrapped(target, 'binary', 'the', 'of')}.{name}({', '.join(x.text for x in rest)})")
        self.express(e) if args.dropped else self.push(e)

    def give(self, op: str) -> None:
        if op == "ret_factory":
            self.say("exit")
            return
        value = self.pop()
        if value.kind == "args" and len(value.items) == 1:
            value = value.items[0]
        if not self.returned():
            self.say("return " + ("" if value.kind == "error" else value.text), "return")

    def condition(self, code: Code) -> None:
        end = code.at + code.operand
        if code.loop in ("in", "to", "down"):
            last = self.pop()
            head = f"in {last.text}" if code.loop == "in" else f"= {self.pop().text} {'down to' if code.loop == 'down' else 'to'} {last.text}"
            self.enter(self.add(Statement("repeat", f"repeat with {self.variable(code.variable)} {head}", 1)).blocks[0], end)
            return
        test = self.pop()
        inner = test.parts[0] if test.kind == "not" else test
        owner = self.block.owner
        if inner.kind == "call" and inner.value == "catch" and owner and owner.kind == "try":
            self.leave()
            self.enter(owner.blocks[1], end)
        elif self.case and test.kind == "binary" and test.value == "=" and test.parts[0].text == self.case.expr.text:
            self.branch(test.parts[1].text, end)
        elif code.loop == "while":
            self.enter(self.add(Statement("repeat", f"repeat while {test.text}", 1)).blocks[0], end)
        else:
            self.enter(self.add(Statement("if", f"if {test.text} then", 2)).blocks[0], end)

    def jump(self, code: Code) -> None:
        target = code.at + code.operand
        block = self.block
        while block:
            if block.owner and block.owner.kind == "repeat" and target >= block.end:
                self.say("exit repeat")
                return
            block = block.outer
        owner = self.block.owner
        if owner and owner.kind == "if":
            after = self.codes[self.at + 1].at if self.at + 1 < len(self.codes) else None
            if after == self.block.end:
                owner.otherwise = True
                self.leave()
                self.enter(owner.blocks[1], target)
        elif owner and owner.kind == "branch":
            owner.of.final = max(owner.of.final, target)

    def peek(self, code: Code) -> None:
        depth = len(self.stack) - 1 - code.operand
        value = self.stack[depth] if depth >= 0 else self.case.expr if self.case and code.operand == 0 else _error("Stack Underflow")
        self.push(value)
        ahead = self.codes[self.at + 1 : self.at + 4]
        if code.operand == 0 and not self.case and len(ahead) == 3 and ahead[0].op.startswith("push") and ahead[1].op == "eq" and ahead[2].op == "jmpifz":
            self.case = self.add(Statement("case", f"case {value.text} of", expr=value))

    # Text.

    def source(self) -> str:
        out = [f"on {self.label}" + (f" {', '.join(self.args)}" if self.args else "")]
        _lines(self.body, "  ", out)
        return "\n".join([*out, "end"])

    def listing(self) -> str:
        rows = [f"[{c.at:>6}]  {c.op:<16} 0x{_hex(c.operand)} ({number(c.operand)})\n" for c in self.codes]
        return f"\n; --- Handler: {self.label} ---\n" + "".join(rows)


def decompile(data: bytes | None, names: list[str], kind: int = 0, big: bool = True, listed: bool = True) -> tuple[str, str]:
    """``(source, listing)`` of a script chunk. Of one that can't be read the source says why and the listing is empty, as it is unless ``listed``."""
    if not data or len(data) < LEAST:
        return TOO_SMALL, ""
    try:
        script = read(data, names or [], kind, big)
        told = properties(script, big)
        done = [Handler(script, row, big).run() for row in script.handlers if row[2] < len(data)]
        head = f"property {', '.join(told)}\n\n" if told else ""
        return head + "\n\n".join(h.source() for h in done), "\n".join(h.listing() for h in done) if listed else ""
    except (EOFError, struct.error, ValueError, IndexError, RecursionError, OverflowError) as e:
        return f"-- Error: {e}", ""


def beautify(source: str) -> str:
    """Lines indented by the words that open and close blocks; blank lines stay empty."""
    depth, out = 0, []
    for line in re.split(r"\r?\n", source):
        raw = line.strip()
        low = raw.lower()
        if low.startswith(("end", "next", "loop")):
            depth = max(0, depth - 1)
        out.append("  " * depth + raw if raw else "")
        if low.startswith(("on ", "if ", "repeat ", "case ")):
            depth += 1
    return "\n".join(out)
