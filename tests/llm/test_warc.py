import base64
import gzip
import hashlib
import io

from common import rows

from ripplemark.llm import warc


def members(*records):
    return [warc.encode_record(*r) for r in records]


def test_round_trip_at_any_read_size():
    data = [("a", "http://x/é", b"payload \x1f\x8b\x08 inside"), ("b", None, b""), ("c", "u\r\nInjected: 1", None), ("d", "u", bytes(range(256)) * 5000)]
    blob = b"".join(members(*data))
    for size in (1, 7, 4096, 1 << 20) if len(blob) < 20_000 else (501, 4096, 1 << 20):
        got = list(warc.read_records(io.BytesIO(blob), size))
        assert [r["status"] for r in got] == ["ok"] * 4
        assert [r["payload"] for r in got] == [b"payload \x1f\x8b\x08 inside", b"", None, bytes(range(256)) * 5000]
        assert [r["offset"] for r in got][0] == 0 and got[2]["url"] == "u%0D%0AInjected: 1"


def test_damage_is_reported_and_skipped():
    a, b, c = members(("a", "u", b"one"), ("b", "u", b"two" * 100), ("c", "u", b"three"))
    said = lambda blob: [(r["status"], r.get("payload")) for r in warc.read_records(io.BytesIO(blob), 64)]
    broken = bytearray(b)
    broken[-6] ^= 255  # the member's own checksum
    assert [x for x in said(a + bytes(broken) + c)][0] == ("ok", b"one")
    assert said(a + bytes(broken) + c)[-1] == ("ok", b"three")
    assert "bad member" in [s for s, _ in said(a + bytes(broken) + c)]
    assert said(a + c[:-9]) == [("ok", b"one"), ("truncated", None)]
    assert said(b"junk" + a) == [("bad member", None), ("ok", b"one")]
    assert said(b"") == []


def test_a_large_record_takes_time_in_proportion_and_its_payload_alone():
    import os
    import time
    import tracemalloc

    took = []
    for mb in (8, 64):
        blob = b"".join(members(("a", "u", os.urandom(mb << 20)), ("b", "u", b"x")))
        began = time.perf_counter()
        assert [r["status"] for r in warc.read_records(io.BytesIO(blob))] == ["ok", "ok"]
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0] + 1
    wide = b"".join(members(("a", "u", bytes(256 << 20))))  # 256 MB from a few hundred KB
    tracemalloc.start()
    assert sum(len(r["payload"]) for r in warc.read_records(io.BytesIO(wide))) == 256 << 20
    assert tracemalloc.get_traced_memory()[1] < 700 << 20
    tracemalloc.stop()


def test_what_follows_a_damaged_large_member():
    import os

    a, b = members(("a", "u", os.urandom(3 << 20)), ("b", "u", b"two"))
    broken = bytearray(a)
    broken[-6] ^= 255
    got = [r for r in warc.read_records(io.BytesIO(bytes(broken) + b)) if r["status"] != "bad member"]
    assert [(r["status"], r["offset"], r["payload"]) for r in got] == [("ok", len(a), b"two")]


def again(member, old, new):
    return gzip.compress(gzip.decompress(member).replace(old, new))


def test_framing_and_digests():
    (a,) = members(("a", "u", b"one"))
    said = lambda m: next(warc.read_records(io.BytesIO(m)))["status"]
    assert said(again(a, b"one", b"two")) == "bad digest"
    assert said(again(a, b"Content-Length: ", b"Content-Length: 9")) == "truncated"
    assert said(again(a, b"\r\n\r\none\r\n\r\n", b"\r\n\r\none\r\n\r\nmore")) == "bad framing"
    assert said(again(a, b"WARC/1.0", b"HTTP/1.0")) == said(again(a, b"Content-Length", b"Content-Size")) == "bad header"


def test_odd_rows(spark, tmp_path):
    data = [("1", "http://a", bytearray(b"x")), ("1", "http://a", bytearray(b"x")), (None, None, None), ("2", "", bytearray(b"")), ("3", "u", bytearray(b"long " * 500_000))]
    df = spark.createDataFrame(data, "record_id string, url string, payload binary").selectExpr("*", "1 as status", "2 as file")
    assert warc.write_warc(df, str(tmp_path / "w"), file_bytes=1000) == 5
    got = warc.read_warc(spark, str(tmp_path / "w"))
    assert rows(got.selectExpr("record_id", "url", "status", "length(payload)")) == sorted([("1", "http://a", "ok", 1)] * 2 + [("null", None, "ok", None), ("2", "", "ok", 0), ("3", "u", "ok", 2_500_000)], key=repr)
    assert warc.write_warc(df.limit(0), str(tmp_path / "e")) == 0
    (tmp_path / "e").mkdir(exist_ok=True)
    assert rows(warc.read_warc(spark, str(tmp_path / "e"))) == []


def test_digests_of_other_algorithms_and_spellings():
    (a,) = members(("a", "u", b"one"))
    said = lambda m: next(warc.read_records(io.BytesIO(m)))["status"]
    own = warc.digest(b"one").encode()
    for kind in ("sha1", "sha256", "md5"):
        for data, status in ((b"one", "ok"), (b"two", "bad digest")):
            raw = hashlib.new(kind, data).digest()
            b32 = base64.b32encode(raw).decode()
            for told in (f"{kind}:{b32}", f"{kind.upper()}:{b32}", f"{kind}:{b32.lower()}", f"{kind}:{b32.rstrip('=')}", f"{kind}:{raw.hex()}", f"{kind}:{raw.hex().upper()}"):
                assert said(again(a, own, told.encode())) == status
    assert said(again(a, own, b"blake3:abc")) == said(again(a, own, b"abc")) == "unverified"
    assert said(again(again(a, own, b"blake3:abc"), b"HTTP/1.1 200", b"HTTP/1.1 201")) == "bad digest"
    other = again(a, own, warc.digest(b"two").encode())
    assert said(other) == "bad digest" and said(again(other, b"WARC-Type: response", b"WARC-Type: revisit")) == "ok"
