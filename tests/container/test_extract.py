import hashlib
import json
import struct
import zlib

import numpy as np
import pytest

from ripplemark.functions import payloads
from ripplemark.plans import extract
from ripplemark.sources import container, records, writer
from ripplemark.storage import materialize


def bitmap_spec(w, h, pitch, depth, palette=0):
    return struct.pack(">H4h4hhhBBhh", 0x8000 | pitch, 0, 0, h, w, 0, 0, h, w, 1, 2, 0, depth, 0, palette)


CLUT = bytes(x for i in range(256) for x in (i, 255 - i, 7))
PIXELS = np.repeat(np.arange(12, dtype=np.uint8), 4).reshape(6, 8)  # runs: what is packed is far from any length that fits unpacked


def movie(big=True):
    keys = [(4, 1, "CASt"), (5, 1, "STXT"), (6, 2, "CASt"), (7, 2, "BITD"), (8, 3, "CASt"), (9, 3, "CLUT"), (10, 4, "CASt"), (99, 5, "STXT"), (11, 6, "CASt"), (12, 6, "snd ")]
    e = ">" if big else "<"
    shape = struct.pack(e + "H4hhhHHhh", 0, 0, 0, 10, 20, 1, 1, 0, 0, 1, 0)
    spec = bitmap_spec(8, 6, 8, 8, 3)
    if not big:
        spec = struct.pack("<H4h4hhhBBhh", 0x8000 | 8, 0, 0, 6, 8, 0, 0, 6, 8, 1, 2, 0, 8, 0, 3)
    return writer.container(
        [
            ("KEY*", writer.key_table(keys, big)),
            ("CASt", writer.member(3, "story.txt", big=big)),
            ("STXT", writer.stxt("a\r\nb\r")),
            ("CASt", writer.member(1, "pic?", spec, big=big)),
            ("BITD", payloads.pack_bits(PIXELS.tobytes())),
            ("CASt", writer.member(4, "pal", big=big)),
            ("CLUT", CLUT),
            ("CASt", writer.member(8, "box", shape, big=big)),
            ("CASt", writer.member(6, "beep", big=big)),
            ("snd ", b"RIFF" + b"\0" * 60),
            ("STXT", writer.stxt("left over")),
        ],
        big,
    )


@pytest.fixture(scope="module")
def made(spark):
    files = spark.createDataFrame([("big", bytearray(movie())), ("little", bytearray(movie(False))), ("junk", bytearray(b"GIF89a" * 9)), ("cut", bytearray(movie()[:150])), ("empty", bytearray()), ("null", None)], "path string, content binary")
    chunks = materialize(container.chunks_of(files), "chunks")
    found = materialize(extract.members(chunks), "members")
    return chunks, found, materialize(extract.artifacts(chunks, found), "artifacts")


@pytest.mark.parametrize("path", ["big", "little"])
def test_members_and_artifacts(made, path):
    rows = {r["id"]: r for r in made[2].where(f"path = '{path}'").collect()}
    assert {k: (r["type"], r["outcome"], r["drop_reason"]) for k, r in rows.items()} == {
        1: ("Text", "extracted", None), 2: ("Bitmap", "extracted", None), 3: ("Palette", "extracted", None), 4: ("Shape", "extracted", None),
        5: ("Text", "unresolved_reference", None), 6: ("Sound", "extracted", None), 13: ("Text", "extracted", None),
    }
    assert rows[1]["data"] == b"a\nb" and rows[1]["file"] == "story__1.txt"
    assert rows[13]["is_orphan"] and rows[13]["format"] == "rtf" and b"left over" in rows[13]["data"]
    assert (rows[2]["file"], rows[2]["width"], rows[2]["height"], rows[2]["palette"]) == ("pic___2.png", 8, 6, "direct")
    raw = rows[2]["data"]
    lines = zlib.decompress(raw[raw.index(b"IDAT") + 4 :])
    pixels = np.frombuffer(lines, np.uint8).reshape(6, 33)[:, 1:].reshape(6, 8, 4)
    assert (pixels[:, :, 0] == PIXELS).all() and (pixels[:, :, 1] == 255 - PIXELS).all() and (pixels[:, :, 3] == 255).all()
    assert rows[3]["data"].startswith(b"JASC-PAL\r\n0100\r\n256\r\n0 255 7\r\n") and rows[4]["data"].startswith(b"<svg") and rows[6]["format"] == "wav"


def test_statistics_balance(made):
    n = {(r["bucket"], r["kind"]): r["n"] for r in extract.statistics(made[2]).collect()}
    assert n["selected", None] == n["extracted", None] + n["skipped", None] + n.get(("failed", None), 0) == 14
    assert n["missing_source", None] == 2


def test_manifest_and_diagnostics(made):
    got = {r["path"]: json.loads(r["manifest"])["members"] for r in extract.manifest(made[2]).collect()}
    assert [m["id"] for m in got["big"]] == [1, 2, 3, 4, 5, 6, 13] and got["big"][1]["image"] == "pic___2.png" and "isOrphan" not in got["big"][0]
    assert {r["path"] for r in extract.diagnostics(made[0]).collect()} == {"junk", "cut", "empty", "null"}


def test_a_second_run_decodes_only_what_changed(made):
    chunks, found, first = made
    again = {(r["path"], r["id"]): r["outcome"] for r in extract.artifacts(chunks, found, previous=first.where("path = 'big' and checksum is not null")).collect()}
    assert again["big", 2] == "unchanged" and again["little", 2] == "extracted" and again["big", 5] == "unresolved_reference"


def test_options(made):
    chunks, found, _ = made
    rows = extract.artifacts(chunks, found, enabled=["Bitmap"]).where("drop_reason is null").collect()
    assert {r["type"] for r in rows} == {"Bitmap"}


def test_compressed_container(spark):
    keys = writer.key_table([(4, 1, "CASt"), (5, 1, "STXT")])
    data = writer.packed([(3, "KEY*", keys, True), (4, "CASt", writer.member(3, "x"), True), (5, "STXT", writer.stxt("abc" * 100), False)], {9: 5})
    chunks = materialize(container.chunks_of(spark.createDataFrame([("p", bytearray(data))], "path string, content binary")), "chunks")
    made = extract.artifacts(chunks, extract.members(chunks)).collect()
    assert [(r["id"], r["outcome"], b"abcabc" in r["data"]) for r in made] == [(1, "extracted", True)]


def test_scripts(spark):
    context = lambda sections, names: struct.pack(">IIIIHH", 0, 0, len(sections), 0, 36, 12).ljust(32, b"\0") + struct.pack(">i", names) + b"".join(struct.pack(">iii", 0, s, 0) for s in sections)
    names = struct.pack(">iiIIHH", 0, 0, 0, 0, 20, 2) + b"\x03foo\x02hi"
    keys = writer.key_table([(4, 1, "CASt"), (7, 50, "LctX")])
    data = writer.container([("KEY*", keys), ("CASt", writer.member(11, "code", struct.pack(">H", 3), script_id=1)), ("Lnam", names), ("Lscr", b"\0" * 140), ("LctX", context([6], 5)), ("Lscr", b"\1" * 140)])
    chunks = materialize(container.chunks_of(spark.createDataFrame([("p", bytearray(data))], "path string, content binary")), "chunks")
    found = materialize(extract.members(chunks), "members")
    refs = extract.script_refs(chunks, extract.key_entries(chunks))
    assert [tuple(r) for r in refs.select("slot", "section", "names", "owner").collect()] == [(1, 6, 5, 50)]
    assert [r["names"] for r in extract.name_tables(chunks).collect()] == [["foo", "hi"]]
    assert sorted((r["id"], r["names_id"]) for r in extract.script_names(chunks, refs).collect()) == [(6, 5), (8, 5)]
    assert [(r["id"], r["section"]) for r in extract.script_sections(chunks, found).collect()] == [(1, 6)]
    assert [(r["id"], r["section"]) for r in extract.dangling_scripts(chunks, found).collect()] == [(1, 8)]


def test_records():
    for big in (True, False):
        assert records.key_table(writer.key_table([(1, 2, "CASt")], big), not big) == [(0, 1, 2, "CASt")]
    assert records.key_table(b"") == records.key_table(b"\xff" * 40) == []
    assert records.member_order(struct.pack(">4H", 7, 0, 9, 0)) == [(1, 7), (3, 9)]
    data = bytearray(64)
    struct.pack_into(">hH4h", data, 0, 64, 0x4C7, 0, 0, 480, 640)
    struct.pack_into(">hh", data, 12, 1, 30)
    struct.pack_into(">h", data, 36, 0x4C7)
    struct.pack_into(">hhh", data, 54, 15, -1, 46)
    c = records.config(bytes(data))
    assert (c["min_member"], c["max_member"], c["palette_id"], c["frame_rate"], c["platform"], c["protected"], c["stage"]["right"]) == (1, 30, -2, 15, "Macintosh", True, 640)
    score = struct.pack(">III", 0, 9, 12) + struct.pack(">H", 2) + struct.pack(">HB", 3, 2) + b"go" + struct.pack(">HB", 5, 9)
    assert records.timeline(score) == {"frame_count": 9, "markers": [(3, "go")]}
    parts = writer.property_table([b"", b"\x03lib", b"\x08a\\b\\lib2", struct.pack(">H", 2), b"", b"\x08Internal", b"", b"\0\0"])
    assert records.cast_list(struct.pack(">IHHH", 10, 0, 2, 4) + parts) == [(1, "lib", "a\\b\\lib2.cst", "Before Frame 1")]


def test_payload_codecs():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"a" * 500, rng.integers(0, 3, 3000, np.uint8).tobytes(), rng.bytes(700)):
        assert payloads.unpack_bits(payloads.pack_bits(data)) == data
    row = lambda d: bytes((0, len(d))) + d
    assert payloads.unpack_rows(row(payloads.pack_bits(b"abcd")) + row(payloads.pack_bits(b"eeee")), 4, 2) == b"abcdeeee"
    for depth, w in ((1, 16), (2, 8), (4, 6), (8, 6), (16, 5), (32, 4)):
        size = payloads.row_sizes(w, depth)[0]
        for data in (rng.bytes(size * 5), b"\0" * (size * 5)):
            for stored in (data, zlib.compress(data), zlib.compress(payloads.pack_bits(data))):
                assert payloads.bitmap(stored, w, 5, depth)[0] == "png"
    assert payloads.bitmap(b"", 4, 4, 8)[0] == payloads.bitmap(b"abc", 90, 90, 16)[0] == "empty_asset"
    assert payloads.bitmap(rng.bytes(101), 300, 300, 16)[0] == "unsupported_content"
    ramp = np.add.outer(np.arange(40) * 3, np.arange(64) * 2).astype(np.uint8)
    assert payloads.bitmap(ramp.tobytes(), 0, 0, 8)[2:] == (64, 40)
    assert payloads.palette(b"\1\2\3" * 256)[5].tolist() == [1, 2, 3] and payloads.palette(b"x") is None
    assert payloads.sound(struct.pack(">HHIHHIIHHIIBB", 2, 0, 0, 0, 0, 0, 1, 22050, 0, 0, 0, 0, 60)[:4].ljust(40, b"\0"))[0] == "snd"
    head = struct.pack(">HHH", 2, 0, 1) + b"\0" * 8 + struct.pack(">IIHHIIBB", 0, 9, 22050, 0, 0, 0, 0, 60)
    assert payloads.sound(head + b"\x80" * 50) == ("wav", payloads.wav(b"\x80" * 50, 22050))
    assert payloads.font(b"xx" + b"OTTO" + b"\0" * 20)[0] == "otf" and payloads.flash(b"..FWS" + b"\0" * 9)[1][:3] == b"FWS" and payloads.video(b"....moov....")[0] == "mov" and payloads.xtra(b"MZ")[0] == "x32"
    loop = b"\0" * 12 + struct.pack(">IHI", 0, 0, 3) + struct.pack(">H", 13) + b"\1" + struct.pack(">HBB4h", 7, 0, 0, 0, 0, 1, 1) + struct.pack(">H", 0) + struct.pack(">H", 13) + b"\2" + struct.pack(">HBB4h", 8, 0, 0, 0, 0, 1, 1)
    frames = json.loads(payloads.film_loop(loop))["frames"]
    assert [sorted(f["channels"]) for f in frames] == [["1"], ["1"], ["1", "2"]]


def test_script_artifacts(spark):
    context = lambda sections: struct.pack(">IIIIHH", 0, 0, len(sections), 0, 36, 12).ljust(32, b"\0") + struct.pack(">i", -1) + b"".join(struct.pack(">iii", 0, s, 0) for s in sections)
    code = lambda n: bytes([n]) * 140
    script = lambda name, number: ("CASt", writer.member(11, name, struct.pack(">H", 3), script_id=number))

    def read(chunks, keys):
        data = writer.container([("KEY*", writer.key_table(keys)), *chunks])
        chunks = materialize(container.chunks_of(spark.createDataFrame([("p", bytearray(data))], "path string, content binary")), "chunks")
        told = {hashlib.sha256(code(n)).hexdigest(): n for n in range(1, 5)}
        return {r["id"]: (r["type"], r["outcome"], r["format"], told.get(r["checksum"])) for r in extract.artifacts(chunks, materialize(extract.members(chunks), "members")).collect()}

    # Chunks are numbered from 4 (the key table is 3): three records, three scripts under one owned context, the context.
    owned = [script("a", 3), script("b", 1), script("c", 2), ("Lscr", code(1)), ("Lscr", code(2)), ("Lscr", code(3)), ("LctX", context([7, 8, 9]))]
    got = read(owned, [(4, 1, "CASt"), (5, 2, "CASt"), (6, 3, "CASt"), (10, 50, "LctX")])
    done = lambda n: ("Script", "extracted", "ls", n)
    assert got == {1: done(3), 2: done(1), 3: done(2), 50: ("Null", None, None, None)}
    # A slot without a member is one itself; members whose script number names no slot take the scripts in no context in their order.
    loose = [script("a", 2), script("b", 77), script("c", 78), ("Lscr", code(1)), ("Lscr", code(2)), ("Lscr", code(3)), ("Lscr", code(4)), ("LctX", context([7, 9]))]
    got = read(loose, [(4, 10, "CASt"), (5, 11, "CASt"), (6, 12, "CASt"), (11, 50, "LctX")])
    assert {k: v for k, v in got.items() if k not in (2, 50)} == {1: done(1), 10: done(3), 11: done(2), 12: done(4)}
    # Two contexts have the slot; the one whose owner's record is nearer counts.
    twice = [script("a", 1), ("CASt", writer.member(3, "x")), ("Lscr", code(1)), ("Lscr", code(2)), ("LctX", context([6])), ("LctX", context([7]))]
    assert read(twice, [(4, 10, "CASt"), (5, 20, "CASt"), (8, 30, "LctX"), (9, 20, "LctX")])[10] == done(1)


def _pixels(art, w, h):
    return np.frombuffer(zlib.decompress(art[art.index(b"IDAT") + 4 :]), np.uint8).reshape(h, 1 + w * 4)[:, 1:].reshape(h, w, 4)


def test_large_bitmaps():
    w, h = 2600, 2200  # 22.9 MB of 32 bits
    line = np.repeat(np.arange(4, dtype=np.uint8) * 60, w)
    data = b"".join(bytes(np.roll(line, y)) for y in range(h))
    for stored in (payloads.pack_bits(data), zlib.compress(data, 1), zlib.compress(payloads.pack_bits(data), 1)):
        form, art, *size = payloads.bitmap(stored, w, h, 32)
        assert (form, size) == ("png", [w, h])
        got = _pixels(art, w, h)
        for y in (0, 1, h - 1):
            assert (got[y, :, :3] == np.roll(line, y).reshape(4, w)[1:].T).all()
    wide = np.arange(5000 * 3, dtype=np.uint32).astype(np.uint8).reshape(3, 5000)
    for stored, w, h in ((wide, 5000, 3), (wide.T[:, :2].copy(), 2, 5000)):
        form, art, *size = payloads.bitmap(stored.tobytes(), w, h, 8)
        assert (form, size) == ("png", [w, h]) and (_pixels(art, w, h)[:, :, 0] == stored).all()
    short = wide.tobytes()[:-700]  # fits no length: padded to the declared geometry
    form, art, *size = payloads.bitmap(short, 5000, 3, 8, 5000)
    assert (form, size) == ("png", [5000, 3]) and (_pixels(art, 5000, 3)[2, :4300, 0] == wide[2, :4300]).all()


def test_parts_of_a_bitmap_are_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    for depth, w in ((1, 16), (2, 9), (4, 7), (8, 5), (16, 5), (32, 4)):
        for row in payloads.row_sizes(w, depth, 40):
            data = rng.bytes(row * 11)
            whole = payloads.png(payloads.render(data, w, 11, depth, row, None, alpha := rng.bytes(w * 11)))
            monkeypatch.setattr(payloads, "BAND", 3 * w)
            stored = payloads.bitmap(data, w, 11, depth, row, None, alpha)[1]
            assert stored is not None and (_pixels(stored, w, 11) == _pixels(whole, w, 11)).all()
            if depth <= 8:
                for d in (data, data[: row * 4 - 1]):
                    assert payloads._told_roughness(d, w, 11, depth, row) == payloads.roughness(payloads._indices(d, w, 11, depth, row))
