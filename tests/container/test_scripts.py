import struct

from ripplemark.functions import scripts
from ripplemark.sources import writer

NAMES = "main me a b i list new foo bar count getAt setAt getProp setProp return try catch width text pNoiseStripped beep put go items helper constant".split()
N = {n: i for i, n in enumerate(NAMES)}
a = writer.assemble


def source(*codes, args=("a",), local=("b", "i", "list"), literals=(), kind=0, properties=(), more=()):
    made = writer.script(NAMES, [("main", list(args), list(local), a(*codes)), *more], list(literals), list(properties), kind)
    return scripts.decompile(made, NAMES)[0]


def body(*codes, **more):
    lines = source(*codes, **more).split("\n")
    assert lines[0].startswith("on main") and lines[-1] == "end"
    return [x[2:] for x in lines[1:-1]]


def given(*codes, **more):
    """The expression that the codes leave."""
    (line,) = body(*codes, ("setlocal", 0), **more)
    assert line.startswith("b = ")
    return line[4:]


ONE, TWO, X = ("pushint8", 1), ("pushint8", 2), ("getparam", 0)
ZEROS = [("pushint0",)] * 8


def test_literals_and_references():
    assert given(("pushint0",)) == "0" and given(("pushint8", -5, 1)) == "-5" and given(("pushint16", -300, 2)) == "-300" and given(("pushint32", -70000, 4)) == "-70000"
    assert given(("pushfloat32", 1.5)) == "1.5" and given(("pushfloat32", 2.0)) == "2" and given(("pushfloat32", 1e-7)) == "1.0000000116860974e-7"
    assert given(("pushcons", 0), literals=['say "x"\\\r\n']) == '"say \\"x\\"\\\\\\r\\r"' and given(("pushcons", 0), literals=[""]) == '""'
    assert given(("pushcons", 1), literals=["x", 70000]) == "70000" and given(("pushcons", 0), literals=[0.25]) == "0.25" and given(("pushcons", 7)) == "7"
    assert given(("pushsymb", N["foo"])) == "#foo" and given(("pushvarref", N["foo"])) == "foo"
    for op in ("getglobal", "getglobal2", "getprop", "gettoplevelprop"):
        assert given((op, N["foo"])) == "foo"
    assert given(("getmovieprop", N["width"])) == "the width" and given(("getparam", 0)) == "a" and given(("getparam", 9)) == "a_9" and given(("getlocal", 1)) == "i" and given(("getlocal", 9)) == "l_9"
    for kind, want in ((1, "main"), (2, "main"), (3, "main"), (4, "a"), (5, "b")):
        assert given(("pushint0",), ("pushchunkvarref", kind)) == want
    assert given(("pushcons", 0), ("pushchunkvarref", 6), literals=["f"]) == 'field "f"'
    assert given(ONE, TWO, ("pushchunkvarref", 6), kind=5) == "field 1 of castLib 2"


def test_operators():
    for op, sign in scripts._BINARY.items():
        assert given(ONE, TWO, (op,)) == f"1 {sign} 2"
    assert given(ONE, TWO, ("add",), ONE, TWO, ("sub",), ("mul",)) == "(1 + 2) * (1 - 2)"
    assert given(("getmovieprop", N["width"]), ONE, ("add",)) == "(the width) + 1" and given(ONE, ("getmovieprop", N["width"]), ("add",)) == "1 + the width"
    assert given(X, ("inv",)) == "-a" and given(X, ONE, ("eq",), ("not",)) == "not a = 1"


def test_chunks_and_fields():
    assert given(*ZEROS, X, ("getchunk",)) == "a"
    assert given(ONE, TWO, *ZEROS[:4], ("pushint8", 3), ("pushint0",), X, ("getchunk",)) == "char 1 to 2 of line 3 of a"
    assert given(*ZEROS[:2], ("pushint16", -30000, 2), ("pushint0",), *ZEROS[:4], X, ("getchunk",)) == "the last word in a"
    assert given(*ZEROS[:4], ONE, TWO, *ZEROS[:2], X, ("getchunk",)) == "item 1 to 2 of a"
    assert given(ONE, ("getfield",)) == "field 1" and given(ONE, TWO, ("getfield",), kind=5) == "field 1 of castLib 2"
    assert body(TWO, ("pushint0",), ("put", 0x15)) == ["put 2 into b"] and body(TWO, ("pushint0",), ("put", 0x25)) == ["put 2 after b"] and body(TWO, ("pushint0",), ("put", 0x35)) == ["put 2 before b"]
    assert body(TWO, ("pushint0",), ("put", 0x05)) == ["b = 2"]
    assert body(TWO, ONE, ("pushint0",), *ZEROS[:6], ("pushint0",), ("putchunk", 0x15)) == ["put 2 into char 1 of b"]
    assert body(*ZEROS[:6], ONE, ("pushint0",), ("pushint0",), ("deletechunk", 5)) == ["delete line 1 of b"] and body(ONE, TWO, *ZEROS[:6], ONE, ("hilitechunk",)) == ["hilite char 1 to 2 of field 1"]


def test_assignments_and_properties():
    assert body(ONE, ("setglobal", N["foo"])) == body(ONE, ("setglobal2", N["foo"])) == body(ONE, ("setprop", N["foo"])) == ["foo = 1"]
    assert body(ONE, ("setprop", N["pNoiseStripped"])) == [] and body(ONE, ("setparam", 0)) == ["a = 1"] and body(ONE, ("setmovieprop", N["width"])) == ["the width = 1"]
    assert given(X, ("getobjprop", N["width"])) == given(X, ("getchainedprop", N["width"])) == "the width of a"
    assert given(X, ONE, ("add",), ("getobjprop", N["width"])) == "the width of (a + 1)"
    assert body(X, ONE, ("setobjprop", N["width"])) == ["the width of a = 1"]


def test_numbered_properties():
    assert given(("pushint8", 6), ("get", 0)) == "the short time" and given(X, ("pushint8", 12), ("get", 0)) == "the last char in a"
    assert given(X, ("pushint8", 3), ("get", 1)) == "the number of items in a" and given(ONE, ("pushint8", 0x15), ("get", 6)) == "the rect of sprite 1"
    assert given(ONE, ("get", 7)) == "the beepOn" and given(("pushint8", 0x28), ("get", 7)) == "the soundMixMedia" and given(("pushint8", 0x1C), ("get", 7)) == "the animationProp_28"
    assert given(TWO, ("get", 8)) == "the number of castMembers" and given(ONE, ONE, ("get", 9)) == "the name of cast 1" and given(ONE, TWO, ("get", 11)) == "the text of field 1"
    assert given(*ZEROS[:6], ONE, ("pushint0",), ONE, TWO, ("get", 12)) == "the text of line 1 of field 1" and given(ONE, ("pushint8", 10), ("get", 0x14)) == "the number of script 1"
    assert body(X, ONE, ONE, ("set", 9)) == ["the name of cast 1 = a"] and given(ONE, ("get", 99)) == "v4prop_99_1" and given(("pushint8", 99), ("get", 9), literals=[1]).startswith("the memberProp_99 of cast")


def test_calls_and_lists():
    assert body(ONE, TWO, ("pusharglistnoret", 2), ("extcall", N["foo"])) == ["foo(1, 2)"] and given(("pusharglist", 0), ("extcall", N["foo"])) == "foo()"
    assert body(ONE, ("pusharglistnoret", 1), ("extcall", N["put"])) == ["put 1"] and given(ONE, ("pusharglist", 1), ("thebuiltin", N["foo"])) == "foo(1)"
    assert body(("pusharglistnoret", 0), ("localcall", 0)) == ["main()"] and body(("pusharglistnoret", 0), ("localcall", 5)) == ["handler_5()"] and body(ONE, ("pusharglistnoret", 1), ("tellcall", N["foo"])) == ["foo(1)"]
    assert given(ONE, ("pusharglist", 1), ("newobj", N["foo"])) == "new(foo, 1)"
    assert given(ONE, TWO, ("pusharglist", 2), ("pushlist",)) == "[1, 2]" and given(("pusharglist", 0), ("pushproplist",)) == "[:]"
    assert given(("pushsymb", N["a"]), ONE, ("pushsymb", N["b"]), TWO, ("pusharglist", 4), ("pushproplist",)) == "[#a: 1, #b: 2]"
    assert body(("pusharglist", 0), ("extcall", N["foo"]), ("pop", 1)) == ["foo()"] and body(ONE, ("pop", 1)) == []


def test_methods():
    call = lambda name, *args, ret="pusharglist": (*args, (ret, len(args)), ("objcall", N[name]))
    sym = ("pushsymb", N["width"])
    assert given(*call("foo", X, ONE)) == "a.foo(1)" and body(*call("foo", X, ret="pusharglistnoret")) == ["a.foo()"]
    assert given(*call("getAt", X, ONE)) == "a[1]" and body(*call("setAt", X, ONE, TWO)) == ["a[1] = 2"] and given(*call("count", X, sym)) == "a.width.count"
    assert given(*call("getProp", X, sym)) == "a.width" and given(*call("getProp", X, sym, ONE)) == "(a.width)[1]" and given(*call("getProp", X, sym, ONE, TWO)) == "(a.width)[1..2]"
    assert body(*call("setProp", X, sym, ONE, TWO)) == ["(a.width)[1] = 2"] and body(*call("setProp", X, sym, ONE, TWO, X)) == ["(a.width)[1..2] = a"]
    assert given(("getmovieprop", N["width"]), ("pusharglist", 1), ("objcall", N["foo"])) == "(the width).foo()" and given(ONE, ("pusharglist", 1), ("objcallv4", N["foo"])) == "foo.foo(1)"
    assert body(("pusharglist", 0), ("objcall", N["foo"])) == []


def jump(*codes):
    return len(a(*codes))


def test_conditions():
    then, other = [ONE, ("setlocal", 0)], [TWO, ("setlocal", 0)]
    assert body(X, ("jmpifz", 2 + jump(*then)), *then, TWO, ("setlocal", 1)) == ["if a then", "  b = 1", "end if", "i = 2"]
    assert body(X, ("jmpifz", 4 + jump(*then)), *then, ("jmp", 2 + jump(*other)), *other, ONE, ("setlocal", 1)) == ["if a then", "  b = 1", "else", "  b = 2", "end if", "i = 1"]
    assert body(("ret",)) == ["return "] and body(ONE, ("ret",)) == ["return 1"] and body(("ret_factory",)) == ["exit"]
    assert body(ONE, ("pusharglistnoret", 1), ("extcall", N["return"]), ("ret",)) == ["return(1)"]


def test_loops():
    inner = [ONE, ("setlocal", 0)]
    head = [X, ONE, ("lt",)]
    size = jump(*head) + 2 + jump(*inner)
    assert body(*head, ("jmpifz", 4 + jump(*inner)), *inner, ("endrepeat", size), ("ret_factory",)) == ["repeat while a < 1", "  b = 1", "end repeat", "exit"]
    leave = [("jmp", 4)]
    assert body(*head, ("jmpifz", 4 + jump(*leave)), *leave, ("endrepeat", jump(*head) + 4), ONE, ("setlocal", 0))[:3] == ["repeat while a < 1", "  exit repeat", "end repeat"]
    for op, step, word in (("lteq", ("pushint8", 1), "to"), ("gteq", ("pushint8", -1, 1), "down to")):
        start = [ONE, ("setlocal", 1)]
        test = [("getlocal", 1), ("pushint8", 9), (op,)]
        more = [step, ("getlocal", 1), ("add",), ("setlocal", 1)]
        back = jump(*test) + 2 + jump(*inner, *more)
        assert body(*start, *test, ("jmpifz", 4 + jump(*inner, *more)), *inner, *more, ("endrepeat", back), ("ret_factory",)) == [f"repeat with i = 1 {word} 9", "  b = 1", "end repeat", "exit"]
    before = [("peek", 0), ("pusharglist", 1), ("extcall", N["count"]), ONE, ("peek", 0), ("peek", 2), ("lteq",)]
    behind = [("peek", 2), ("peek", 1), ("pusharglist", 2), ("extcall", N["getAt"]), ("setlocal", 1)]
    rest = [*behind, *inner, ONE, ("add",)]
    back = jump(("peek", 0), ("peek", 2), ("lteq",)) + 2 + jump(*rest)
    assert body(X, *before, ("jmpifz", 4 + jump(*rest)), *rest, ("endrepeat", back), ("pop", 3)) == ["repeat with i in a", "  b = 1", "end repeat"]


def test_cases_and_tries():
    one, two, rest = [ONE, ("setlocal", 0)], [TWO, ("setlocal", 0)], [X, ("setlocal", 0)]
    tail = jump(*rest)
    second = [("peek", 0), TWO, ("eq",), ("jmpifz", 4 + jump(*two)), *two, ("jmp", 2 + tail)]
    first = [("peek", 0), ONE, ("eq",), ("jmpifz", 4 + jump(*one)), *one, ("jmp", 2 + jump(*second) + tail)]
    assert body(X, *first, *second, *rest, ("pop", 1)) == ["case a of", "  1:", "    b = 1", "", "  2:", "    b = 2", "", "  otherwise:", "    b = a", "", "end case"]
    opening = [("pusharglistnoret", 0), ("extcall", N["try"])]
    caught = [("pusharglist", 0), ("extcall", N["catch"])]
    assert body(*opening, *one, *caught, ("jmpifz", 2 + jump(*two)), *two, X, ("setlocal", 1)) == ["try", "  b = 1", "catch", "  b = 2", "end try", "i = a"]
    assert body(*opening, *one, *caught, ("jmpifz", 2 + jump(*two)), *two)[:5] == ["try", "  b = 1", "catch", "  b = 2", "end try"]


def test_what_is_not_translated_and_unknown():
    for op in ("contains0str", "ontospr", "intospr", "starttell", "endtell", "swap", "endrepeat"):
        assert body((op, 0) if op == "endrepeat" else (op,)) == []
    codes = scripts.instructions(bytes([0x20, 0x47, 5]), 7)
    assert [(c.op, c.at) for c in codes] == [("unk_0x20", 7), ("unk_0x47", 8)]
    assert scripts.decompile(None, []) == scripts.decompile(b"x" * 131, []) == ("-- Script buffer too small/empty", "")
    assert body(("setlocal", 0)) == ["b = -- [DECOMPILE ERROR: Stack Underflow]"]


def test_headers_names_and_listings():
    made = writer.script(NAMES, [("main", ["me", "a"], [], a(ONE, ("ret",))), ("helper", [], [], a(("pushint8", -1, 1), ("ret",)))], [], ["foo", "bar", "constant"])
    text, listing = scripts.decompile(made, NAMES)
    assert text == "property foo, bar\n\non main me, a\n  return 1\nend\n\non helper\n  return -1\nend"
    assert listing.split("\n")[1:4] == ["; --- Handler: main ---", "[    98]  pushint8         0x0001 (1)", "[   100]  ret              0x0000 (0)"] and "0x00-1 (-1)" in listing
    assert scripts.decompile(made, [])[0].startswith("property n_7") and source(ONE, ("ret",), kind=7).startswith("on main me, a")
    # A table that is rotated: the first handler's number is not that of a plausible name, but "new" makes it one.
    turned = writer.script(NAMES, [("me", [], [], a(("ret",)))], kind=7)
    assert scripts.decompile(turned, NAMES)[0].startswith("on new me")
    assert scripts.beautify("on x\nif a then\nb\nend if\n\nend") == "on x\n  if a then\n    b\n  end if\n\nend"
    tags = b"".join(t + struct.pack(">II", o, n) for t, o, n in ((b"HAND", 100, 46), (b"PROP", 90, 2)))
    new = bytearray(140)
    struct.pack_into(">HH", new, 16, 46, 0)
    struct.pack_into(">H", new, 50, 2)
    new[52 : 52 + len(tags)] = tags
    struct.pack_into(">H", new, 90, N["foo"])
    struct.pack_into(">HHIIHIHI", new, 100, N["main"], 0, 1, 99, 0, 0, 0, 0)
    new[99] = 1
    assert scripts.decompile(bytes(new) + bytes(20), NAMES)[0] == "property foo\n\non main\n  return \nend"
