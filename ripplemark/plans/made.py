"""Whole-job queries over containers made of the driver's tables: one for each kind of payload and record."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..batches import gathered, pieces
from ..functions import payloads
from ..sources import container, writer
from ..storage import materialize, read, spread
from . import extract
from .kernel import _normal_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _files(build: Callable[[dict], bytes], key: str) -> Callable[[pa.RecordBatch], Iterator[tuple[str, bytes]]]:
    """A function that makes paths and containers of a batch of rows; ``key`` names them."""

    def made(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        for part in pieces(tuple(batch.columns)):
            yield from ((f"x-{r[key]}", build(r)) for r in pa.record_batch(list(part), names=batch.schema.names).to_pylist())

    return made


def containers_of(rows: DataFrame, build: Callable[[dict], bytes], key: str) -> DataFrame:
    """``(path, content)``: the container that ``build`` makes of each row, in as many tasks as the rows need; ``key`` names it."""
    made = _files(build, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for files in gathered(made(batch), lambda f: len(f[1])):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*files), (pa.string(), pa.binary()))], names=["path", "content"])

    return spread(rows).mapInArrow(run, "path string, content binary")


def _chunks(rows: DataFrame, build: Callable[[dict], bytes], key: str, *wanted: str) -> DataFrame:
    """The chunks of ``containers_of(rows, build, key)``, which are made and taken apart in one go and written."""
    return materialize(container.chunks_from(spread(rows), _files(build, key), *wanted), "chunks")


def members_of(*members: tuple[bytes, str | None, bytes | None], extra: list[tuple[str, bytes]] = (), big: bool = True) -> bytes:
    """A container of members ``(record, tag, content)`` with the ids 1, 2, ...; a content of None is missing from the file."""
    keys, chunks, at = [], [], 4
    for ident, (record, tag, data) in enumerate(members, 1):
        keys.append((at, ident, "CASt"))
        chunks.append(("CASt", record))
        at += 1
        if tag:
            keys.append((at if data is not None else 9000 + ident, ident, tag))
            if data is not None:
                chunks.append((tag, data))
                at += 1
    return writer.container([("KEY*", _key_table(tuple(keys), big)), *chunks, *extra], big)


@lru_cache(256)
def _key_table(keys: tuple[tuple[int, int, str], ...], big: bool) -> bytes:
    return writer.key_table(list(keys), big)


_member = lru_cache(256)(writer.member)


def _number(name: str) -> Column:
    return F.regexp_extract("path", r"x-(-?\d+)", 1).cast("bigint").alias(name)


def _made(rows: DataFrame, build: Callable[[dict], bytes], key: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(rows, build, key)
    known = extract.structure(chunks)
    return chunks, extract.artifacts(chunks, materialize(extract.members(chunks, known), "members"), known=known)


def _text(data: str = "data") -> Column:
    return F.decode(F.col(data), "UTF-8").alias("text")


_NAMES = ["label", "me", "total", "price", "size", "beep"]


def _script_file(r: dict) -> bytes:
    """A script that multiplies, joins and compares; its chunk has no key entry: the context's slot tells whose it is."""
    code = writer.assemble(
        ("pushint32", r["p_partkey"], 4), ("pushint16", r["p_size"], 2), ("mul",), ("pushcons", 0), ("joinpadstr",), ("setlocal", 0), ("getlocal", 0), ("getparam", 1), ("gt",), ("jmpifz", 6),
        ("pusharglistnoret", 0), ("extcall", 5), ("ret",),
    )
    made = writer.script(_NAMES, [("label", ["me", "size"], ["total"], code)], [r["p_name"]], ["price"])
    script = writer.member(11, "", struct.pack(">H", 1), script_id=1)
    return members_of((script, None, None), extra=[("LctX", writer.script_context([6], 7)), ("Lscr", made), ("Lnam", writer.name_table(_NAMES))])


@_query(r"""
SELECT p_partkey, 'Script' AS type, 'extracted' AS outcome, 'ls' AS format, 'BehaviorScript__1.ls' AS file,
       'property price' || chr(10) || chr(10) || 'on label me, size' || chr(10) || '  total = (' || p_partkey || ' * ' || p_size || ') && "' || replace(replace(p_name, '\', '\\'), '"', '\"') || '"' || chr(10)
       || '  if total > size then' || chr(10) || '    beep()' || chr(10) || '  end if' || chr(10) || '  return ' || chr(10) || 'end' AS text
FROM part
""")
def script_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bytecode: found through the script context, named by its name table, and rendered."""
    _, made = _made(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), _script_file, "p_partkey")
    return made.select(_number("p_partkey"), "type", "outcome", "format", "file", _text())


@_query("""
SELECT p_partkey, chr(10) || '; --- Handler: label ---' || chr(10)
       || '[   112]  pushint32        0x' || lpad(printf('%x', p_partkey), 4, '0') || ' (' || p_partkey || ')' || chr(10) || '[   117]  pushint16        0x' || lpad(printf('%x', p_size), 4, '0') || ' (' || p_size || ')' || chr(10)
       || '[   120]  mul              0x0000 (0)' || chr(10) AS listing FROM part
""")
def script_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first instructions of each part's script."""

    def build(r: dict) -> bytes:
        made = writer.script(_NAMES, [("label", [], [], writer.assemble(("pushint32", r["p_partkey"], 4), ("pushint16", r["p_size"], 2), ("mul",)))], [], ["price"] * 10)
        return members_of((writer.member(11, "s"), "Lscr", made), extra=[("Lnam", writer.name_table(_NAMES))])

    chunks = _chunks(read(spark, sf_dir, "part").select("p_partkey", "p_size"), build, "p_partkey")
    known = extract.structure(chunks)
    listed = extract.listings(chunks, materialize(extract.members(chunks, known), "members"), known)
    return listed.select(_number("p_partkey"), "listing")


_REDS = bytes(range(256)) * 2
_GREENS = bytes(v for i in range(256) for v in (0, i * 3 % 256, 0))


def _colors(r: dict) -> bytes:
    out, first = bytearray(_GREENS), r["vec_id"] % 256
    out[::3] = _REDS[first : first + 256]
    out[2::3] = bytes((r["label"] * 20 % 256,)) * 256
    return bytes(out)


def _image_file(r: dict) -> bytes:
    """A palette, a bitmap of four runs of 16 pixels that uses it, raw, packed or deflated, and one that borrows its palette."""
    pixels = bytes((r["vec_id"] * 7 + i // 16 * 5) % 256 for i in range(64))
    data = (pixels, payloads.pack_bits(pixels), zlib.compress(pixels))[r["vec_id"] % 3]
    other = (_member(1, "copy", writer.bitmap_spec(8, 8, 8, 2)), "BITD", pixels)
    return members_of((_member(4, "colors"), "CLUT", _colors(r)), (_member(1, "picture", writer.bitmap_spec(8, 8, 8, 1)), "BITD", data), other)


@F.arrow_udf(T.StringType())
def _pixels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The pixels of images whose rows are unfiltered, as hexadecimal digits."""
    for (batch,) in (part for whole in batches for part in pieces((whole,))):
        out = []
        for blob in batch.to_pylist():
            width, height = struct.unpack_from(">II", blob, 16)
            size = struct.unpack_from(">I", blob, 33)[0]
            raw = zlib.decompress(blob[41 : 41 + size])
            out.append("".join(raw[y * (4 * width + 1) + 1 : (y + 1) * (4 * width + 1)].hex() for y in range(height)))
        yield pa.array(out, pa.string())


_PIXEL = "((vec_id * 7 + (i // 16) * 5) % 256)"


@_query(f"""
SELECT vec_id, 'Palette' AS type, 'pal' AS format, 'colors__1.pal' AS file, NULL::INTEGER AS width, NULL::VARCHAR AS palette,
       'JASC-PAL' || chr(13) || chr(10) || '0100' || chr(13) || chr(10) || '256' || chr(13) || chr(10)
       || (SELECT string_agg(((vec_id + i) % 256) || ' ' || (i * 3 % 256) || ' ' || (label * 20 % 256) || chr(13) || chr(10), '' ORDER BY i) FROM range(256) t(i)) AS body FROM embeddings
UNION ALL
SELECT vec_id, 'Bitmap', 'png', file, 8, how,
       (SELECT string_agg(printf('%02x%02x%02xff', (vec_id + {_PIXEL}) % 256, {_PIXEL} * 3 % 256, label * 20 % 256), '' ORDER BY i) FROM range(64) t(i)) FROM embeddings, (VALUES ('picture__2.png', 'direct'), ('copy__3.png', 'borrowed')) f(file, how)
""")
def image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as palettes and as bitmaps in three encodings, and back to colour tables and pixels."""
    _, made = _made(read(spark, sf_dir, "embeddings").select("vec_id", "label"), _image_file, "vec_id")
    image = F.col("type") == "Bitmap"
    body = F.when(image, _pixels(F.when(image, F.col("data")).otherwise(F.lit(_BLANK)))).otherwise(F.decode("data", "UTF-8"))
    return made.select(_number("vec_id"), "type", "format", "file", F.when(image, F.col("width")).alias("width"), F.when(image, F.col("palette")).alias("palette"), body.alias("body"))


_BLANK = payloads.png_of(1, 1, [])


def _sound_file(r: dict) -> bytes:
    return members_of((writer.member(6, "tone"), "snd ", writer.sound(bytes((r["s_suppkey"] + i) % 256 % 200 for i in range(16)), 8000 + r["s_suppkey"] % 1000)))


@_query("""
SELECT s_suppkey, 'wav' AS format, 'tone__1.wav' AS file,
       '524946463400000057415645666d74201000000001000100' || x || '0000' || x || '0000' || '0100080064617461' || '10000000'
       || (SELECT string_agg(printf('%02x', (s_suppkey + i) % 256 % 200), '' ORDER BY i) FROM range(16) t(i)) AS body
FROM (SELECT s_suppkey, printf('%02x%02x', (8000 + s_suppkey % 1000) % 256, (8000 + s_suppkey % 1000) // 256) AS x FROM supplier)
""")
def sound_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sound resources, and back as WAV files."""
    _, made = _made(read(spark, sf_dir, "supplier").select("s_suppkey"), _sound_file, "s_suppkey")
    return made.select(_number("s_suppkey"), "format", "file", F.lower(F.hex("data")).alias("body"))


def _shape_file(r: dict) -> bytes:
    frames = [{1: (r["p_partkey"] % 1000, 0, 5, 1, 2, r["p_size"], 4)}, {}, {}]
    spec = writer.shape_spec(r["p_size"] % 4 + 1, r["p_size"] + 10, r["p_size"] + 20, 2, r["p_size"] % 2)
    return members_of((writer.member(8, "shape", spec), None, None), (writer.member(2, "film", writer.film_loop(frames)), None, None))


_STATE = """'{"channels": {"1": {"member": ' || (p_partkey % 1000) || ', "ink": 0, "blend": 5, "top": 1, "left": 2, "bottom": ' || p_size || ', "right": 4}}}'"""
_PAINT = """'fill="' || CASE WHEN p_size % 2 = 1 THEN '#ffffff' ELSE 'none' END || '" stroke="#ffffff" stroke-width="2"/>'"""


@_query(f"""
SELECT p_partkey, 1::INTEGER AS id, 'Shape' AS type, 'svg' AS format, 'shape__1.svg' AS file,
       '<svg xmlns="http://www.w3.org/2000/svg" width="' || (p_size + 10) || '" height="' || (p_size + 20) || '">' || CASE p_size % 4
       WHEN 2 THEN '<ellipse cx="' || printf('%g', (p_size + 10) / 2.0) || '" cy="' || printf('%g', (p_size + 20) / 2.0) || '" rx="' || printf('%g', (p_size + 8) / 2.0) || '" ry="' || printf('%g', (p_size + 18) / 2.0) || '" ' || {_PAINT}
       WHEN 3 THEN '<line x1="0" y1="0" x2="' || (p_size + 10) || '" y2="' || (p_size + 20) || '" stroke="#ffffff" stroke-width="2"/>'
       ELSE '<rect x="1" y="1" width="' || (p_size + 8) || '" height="' || (p_size + 18) || '" rx="' || CASE p_size % 4 WHEN 1 THEN 5 ELSE 0 END || '" ' || {_PAINT} END || '</svg>' AS text
FROM part
UNION ALL
SELECT p_partkey, 2, 'FilmLoop', 'json', 'film__2.json', '{{"frame_count": 3, "frames": [' || {_STATE} || ', ' || {_STATE} || ', ' || {_STATE} || ']}}' FROM part
""")
def shape_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as shapes and as film loops whose last frames repeat the first, and back as drawings and frames."""
    _, made = _made(read(spark, sf_dir, "part").select("p_partkey", "p_size"), _shape_file, "p_partkey")
    return made.select(_number("p_partkey"), "id", "type", "format", "file", _text())


def _packed_file(r: dict) -> bytes:
    """The compressed form: the page in the inline stream or behind it, under a mapped number."""
    keys = writer.key_table([(11, 1, "CASt"), (12, 1, "STXT")])
    text = (12, "STXT", writer.stxt(r["html"] or ""), r["page_id"] % 2 == 0)
    return writer.packed([(10, "KEY*", keys, True), (11, "CASt", writer.member(3, "page.html"), True), text], {12: 12})


@_query(f"SELECT page_id, 'rifx-big' AS form, 'Text' AS type, 'extracted' AS outcome, 'page__1.html' AS file, {_normal_sql('html')} AS text FROM pages")
def packed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the compressed form with its inline stream, and back."""
    chunks, made = _made(read(spark, sf_dir, "pages").select("page_id", "html"), _packed_file, "page_id")
    forms = chunks.groupBy("path").agg(F.max("form").alias("form"))
    return made.join(forms, "path").select(_number("page_id"), "form", "type", "outcome", "file", _text())


@F.arrow_udf(T.StructType([T.StructField("packed", T.StringType()), T.StructField("inflated", T.StringType())]))
def _coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for (batch,) in (part for whole in batches for part in pieces((whole,))):
        out = []
        for data in batch.to_pylist():
            raw = (data or "").encode()
            out.append({"packed": payloads.unpack_bits(payloads.pack_bits(raw)).decode(), "inflated": (payloads.lenient_inflate(b"\x00\x01" + zlib.compress(raw)) or b"").decode()})
        yield pa.array(out, pa.struct([("packed", pa.string()), ("inflated", pa.string())]))


@_query("SELECT page_id, coalesce(html, '') AS packed, coalesce(html, '') AS inflated FROM pages")
def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through run lengths, and through a zlib stream behind two foreign bytes."""
    return read(spark, sf_dir, "pages").select("page_id", _coded("html").alias("c")).select("page_id", "c.packed", "c.inflated")


def _movie_file(r: dict) -> bytes:
    day, status = r["day"], r["o_orderstatus"]
    extra = [("DRCF", writer.config(1, r["o_orderkey"] % 500 + 1, 1200, 8 << r["o_orderkey"] % 3, day)), ("VWSC", writer.timeline(day, [(1, status), (day, r["o_orderpriority"])]))]
    return members_of((_member(3, "note"), "STXT", writer.stxt(status)), extra=extra)


@_query("""
SELECT o_orderkey, 1::INTEGER AS min_member, (o_orderkey % 500 + 1)::INTEGER AS max_member, 1200::INTEGER AS version, (8 * power(2, o_orderkey % 3))::INTEGER AS bit_depth, d::INTEGER AS frame_rate, 'Windows' AS platform,
       d::BIGINT AS frame_count, '1:' || o_orderstatus || ',' || d || ':' || o_orderpriority AS markers
FROM (SELECT *, dayofyear(o_orderdate) AS d FROM orders)
""")
def movie_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as movie settings and timelines, and back as tables."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.dayofyear("o_orderdate").alias("day"))
    chunks = _chunks(orders, _movie_file, "o_orderkey", "DRCF", *extract.TIMELINES)
    marks = F.array_join(F.transform("markers", lambda m: F.concat_ws(":", m["frame"].cast("string"), m["name"])), ",")
    lines = extract.timelines(chunks).select("path", F.col("frame_count").cast("bigint").alias("frame_count"), marks.alias("markers"))
    return extract.movies(chunks).join(lines, "path").select(_number("o_orderkey"), "min_member", "max_member", "version", "bit_depth", "frame_rate", "platform", "frame_count", "markers")


def _outcome_file(r: dict) -> bytes:
    """By the part's number: a text, a text that is missing, one without bytes, a bitmap of no size that fits, or a member that owns nothing."""
    text = writer.member(3, "t")
    kind = r["p_partkey"] % 5
    bitmap = writer.member(1, "b", writer.bitmap_spec(50, 40, 8))
    one = {0: (text, "STXT", writer.stxt("words")), 1: (text, "STXT", None), 2: (text, "STXT", b""), 3: (bitmap, "BITD", b"\x80\x80"), 4: (writer.member(5, "p"), None, None)}[kind]
    return members_of(one)


@_query("""
WITH o AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'extracted' WHEN 1 THEN 'unresolved_reference' WHEN 2 THEN 'placeholder_source' WHEN 3 THEN 'empty_asset' END AS outcome, CASE p_partkey % 5 WHEN 3 THEN 'Bitmap' ELSE 'Text' END AS kind FROM part),
b AS (SELECT outcome AS bucket, kind FROM o WHERE outcome IS NOT NULL UNION ALL SELECT 'selected', kind FROM o WHERE outcome IS NOT NULL
      UNION ALL SELECT 'skipped', kind FROM o WHERE outcome IN ('unresolved_reference', 'placeholder_source', 'empty_asset')
      UNION ALL SELECT 'missing_source', kind FROM o WHERE outcome IN ('unresolved_reference', 'placeholder_source') UNION ALL SELECT 'no_output', kind FROM o WHERE outcome = 'empty_asset')
SELECT bucket, kind, count(*) AS n FROM b GROUP BY bucket, kind UNION ALL SELECT bucket, NULL, count(*) FROM b GROUP BY bucket
""")
def outcome_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of members whose content is there, missing, without bytes or unreadable."""
    _, made = _made(read(spark, sf_dir, "part").select("p_partkey"), _outcome_file, "p_partkey")
    return extract.statistics(made)
