import json

import pytest
from pyspark.sql import functions as F
from compare import compare

from ripplemark.functions import payloads
from ripplemark.plans import containers, extract, made, runs
from ripplemark.sources import container, writer
from ripplemark.storage import materialize


@pytest.mark.parametrize("name", list(made.QUERIES))
def test_query_against_its_sql(spark, name):
    said = compare(spark, "/root/testdata/sf0.001", name, made.QUERIES[name], made.ORACLE_SQL[name])
    assert said.startswith("equal"), said


def test_a_run_is_written_and_read_by_the_next(spark, tmp_path):
    build = lambda word: made.members_of((writer.member(3, "a.txt"), "STXT", writer.stxt(word)), (writer.member(3, "b.txt"), "STXT", writer.stxt("same")), extra=[("DRCF", writer.config(1, 9, 1200, 8, 12)), ("VWSC", writer.timeline(3, [(1, "go")]))])

    def run(word, previous=None):
        files = spark.createDataFrame([("/x/a/m.dcr", bytearray(build(word))), ("/x/b/m.dcr", bytearray(build("other")))], "path string, content binary")
        chunks = materialize(container.chunks_of(files), "chunks")
        known = extract.structure(chunks)
        found = materialize(extract.members(chunks, known), "members")
        return chunks, materialize(extract.artifacts(chunks, found, previous=previous, known=known), "made")

    chunks, first = run("one")
    files = first.select("path", "file", "data").unionByName(runs.sidecars(chunks, first))
    assert containers.write_artifacts(files, str(tmp_path)) == 12
    folders = sorted(p.name for p in tmp_path.iterdir())
    assert len(folders) == 2 and all(f.startswith("m__") for f in folders)  # two files of one stem
    one = tmp_path / folders[0]
    assert sorted(p.name for p in one.iterdir()) == ["a__1.txt", "b__2.txt", "members.cache.json", "members.json", "movie.json", "timeline.json"]
    assert json.loads((one / "timeline.json").read_text()) == {"frameCount": 3, "markers": [{"frame": 1, "name": "go"}]} and json.loads((one / "movie.json").read_text())["frame_rate"] == 12
    previous = runs.previous_run(spark, str(tmp_path), first)
    assert {(r["path"], r["id"]): r["textFile"] for r in previous.collect()} == {(p, i): f for p in ("/x/a/m.dcr", "/x/b/m.dcr") for i, f in ((1, "a__1.txt"), (2, "b__2.txt"))}
    _, second = run("two", previous)
    assert {(r["path"], r["id"]): r["outcome"] for r in second.collect()} == {("/x/a/m.dcr", 1): "extracted", ("/x/a/m.dcr", 2): "unchanged", ("/x/b/m.dcr", 1): "unchanged", ("/x/b/m.dcr", 2): "unchanged"}


def test_older_manifests_are_migrated(spark):
    entry = "struct<m:" + runs._ENTRY + ">"
    df = spark.createDataFrame([(json.dumps(x),) for x in ({"id": 1, "type": "Text", "image": "/old/a.rtf"}, {"id": 2, "type": "Bitmap", "image": "C:\\x\\b.png"}, {"id": 3, "type": "Sound", "image": "i.png", "soundFile": "s/c.wav"}, {"id": 4, "image": "z/d"})], "j string")
    got = {r["m"]["id"]: {k: v for k, v in r["m"].asDict().items() if v is not None and k not in ("id", "type")} for r in runs.migrated(df.selectExpr(f"from_json(concat('{{\"m\":', j, '}}'), '{entry}').m as m")).collect()}
    assert got == {1: {"textFile": "a.rtf"}, 2: {"image": "b.png"}, 3: {"soundFile": "c.wav"}, 4: {"image": "d"}}


def test_members_across_libraries_and_the_default_palette(spark):
    libs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "lib int, path string")
    there = spark.createDataFrame([("a", 5), ("b", 5), ("b", 6), ("c", 6), ("c", 7)], "path string, id int")
    wanted = spark.createDataFrame([(5, 2), (5, 0), (6, 3), (6, 1), (7, None), (8, 1)], "id int, lib int")
    got = {(r["id"], r["lib"]): (r["found"], r["how"]) for r in runs.members_across(wanted, there, libs).collect()}
    assert got == {(5, 2): ("b", "library"), (5, 0): ("a", "any"), (6, 3): ("c", "library"), (6, 1): ("b", "any"), (7, None): ("c", "any"), (8, 1): (None, "none")}
    pals = spark.createDataFrame([("b", bytearray(b"1"), ["m.dcr"]), ("a", bytearray(b"2"), ["x.cct"]), ("System_1", bytearray(b"3"), ["m.dcr"])], "name string, colors binary, sources array<string>")
    said = lambda p, e: runs.default_palette(p, e).first()["name"]
    assert (said(pals, "m.dcr"), said(pals, "none"), said(pals.where("name like 'System%'"), "m.dcr")) == ("b", "a", "System_Mac")
    assert json.loads(bytes(runs.palettes_json(pals).first()["data"]))["b"] == {"colors": "31", "references": ["m.dcr"]}


def test_chunks_by_mapped_numbers(spark):
    data = [("p", 1, 5, 0, True), ("p", 2, 1, 1, False), ("p", 3, 3, 2, True)]
    chunks = spark.createDataFrame(data, "path string, id int, logical_id int, ord int, readable boolean")
    wanted = spark.createDataFrame([("p", i) for i in (1, 3, 5, 9)], "path string, id int")
    said = lambda **k: {r["id"]: (r["chunk"], r["how"]) for r in extract.chunk_of(wanted, chunks, **k).collect()}
    assert said() == {1: (1, "mapped"), 3: (2, "direct"), 5: (0, "mapped"), 9: (None, "none")}
    assert said(prefer_mapped=False)[1] == (0, "direct") and said(readable_only=True)[1] == (0, "direct")


def test_nothing_is_cut():
    big = bytes(range(256)) * 120_000  # 31 MB
    assert payloads.unpack_bits(payloads.pack_bits(bytes(len(big)))) == bytes(len(big)) and payloads.lenient_inflate(__import__("zlib").compress(big, 1)) == big
    raw = __import__("zlib").compress(b"payload " * 50)
    assert container.unpacked(b"abc" + raw) == b"payload " * 50 and container.unpacked(b"plain") == b"plain"
    loop = json.loads(payloads.film_loop(writer.film_loop([{1: (7, 0, 0, 0, 0, 1, 1)}, {}, {}, {}, {}])))
    assert loop["frame_count"] == 5 and [sorted(f["channels"]) for f in loop["frames"]] == [["1"]] * 5


def test_chunks_that_the_file_cuts_off_are_told():
    whole = writer.container([("STXT", writer.stxt("words " * 50))])
    rows = list(container.rows_of("p", whole[:-40]))
    (problem,) = [r[-1] for r in rows if r[-1]]
    assert problem.startswith("chunk 3 (STXT) is cut off: ") and [r for r in rows if r[5] == "STXT"][0][12].endswith(bytes(40))
    assert not [r[-1] for r in container.rows_of("p", whole) if r[-1]]


def test_a_bitmap_wider_than_any_guess_keeps_its_size():
    form, art, *size = payloads.bitmap(bytes(45000), 4500, 10, 8)
    assert (form, size) == ("png", [4500, 10])


def test_tables_of_all_members_are_not_sent_to_the_driver(spark):
    files = made.containers_of(spark.range(50).selectExpr("id as p_partkey"), made._outcome_file, "p_partkey")
    chunks = materialize(container.chunks_of(files), "chunks")
    known = extract.structure(chunks)
    found = extract.members(chunks, known)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (found, extract.artifacts(chunks, materialize(found, "members"), known=known))]
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_containers_are_built_by_many_tasks(spark):
    rows = spark.range(0, 1000, 1, 1).selectExpr("id as p_partkey")
    parts = made.containers_of(rows, made._outcome_file, "p_partkey").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == 2 * spark.sparkContext.defaultParallelism and sum(r["count"] for r in parts) == 1000


def test_movie_tables_take_only_their_chunks_out_of_files(spark):
    data = made._movie_file({"day": 9, "o_orderstatus": "F", "o_orderkey": 5, "o_orderpriority": "high"})
    whole = list(container.rows_of("p", data))
    assert list(container.rows_of("p", data, ("DRCF", "VWSC"))) == [r for r in whole if r[5] in ("DRCF", "VWSC")] and len(whole) == 8
    cut = data[:-20]
    assert [r[-1] for r in container.rows_of("p", cut, ("DRCF",)) if r[-1]] == [r[-1] for r in container.rows_of("p", cut) if r[-1]] != []
    files = spark.createDataFrame([("p", bytearray(data)), ("q", bytearray(data))], "path string, content binary")
    chunks, some = container.chunks_of(files), container.chunks_of(files, "DRCF", *extract.TIMELINES)
    assert some.count() == 4
    for table in (extract.movies, extract.timelines):
        assert sorted(map(str, table(some).collect())) == sorted(map(str, table(chunks).collect()))


def test_workers_pass_on_what_they_have_in_pieces():
    import pyarrow as pa

    from ripplemark import batches

    columns = pa.array([b"x" * 100_000] * 500), pa.array(range(500))
    parts = list(batches.pieces(columns))
    assert max(p[0].nbytes for p in parts) <= batches.BYTES + 100_000 and [i for p in parts for i in p[1].to_pylist()] == list(range(500))
    assert [len(p) for p in batches.gathered(range(2500), lambda r: 0)] == [1024, 1024, 452] and [len(p) for p in batches.gathered(range(5), lambda r: 3 << 20)] == [2, 2, 1]
    big = [("p", made.members_of((writer.member(3, "a"), "STXT", bytes(1_000_000)))) for _ in range(20)]
    rows = (row for p, d in big for row in container.rows_of(p, d))
    assert max(sum(len(r[12] or b"") for r in piece) for piece in batches.gathered(rows, lambda r: len(r[12] or b""))) < 6_000_000


def test_chunks_of_their_own_number_meet_without_a_shuffle(spark):
    """Two chunks share the number 12: the last counts; the first of a tag with a payload leads."""
    two = [(10, "KEY*", writer.key_table([(11, 1, "CASt"), (12, 1, "STXT")]), True), (11, "CASt", writer.member(3, "a.txt"), True), (12, "STXT", writer.stxt("first"), False), (12, "STXT", writer.stxt("last"), False)]
    flags = {(r[4], r[5]): (r[13], r[14]) for r in container.rows_of("p", writer.packed(two)) if r[5]}
    assert [flags[k] for k in sorted(flags)] == [(True, True), (True, True), (True, True), (False, True), (False, False)]
    files = spark.createDataFrame([("p", bytearray(writer.packed(two))), ("q", bytearray(made._outcome_file({"p_partkey": 5})))], "path string, content binary")
    chunks = materialize(container.chunks_of(files), "chunks")
    assert {(r["path"], r["id"], r["ord"]) for r in extract.latest(chunks).where("tag = 'STXT'").collect()} == {("p", 12, 4), ("q", 5, 5)}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(extract.key_entries(chunks)) and "Window" not in plan(extract.movies(chunks)) and "Union" in plan(extract.latest(chunks))


def test_the_same_record_is_read_once_a_piece():
    import pyarrow as pa

    from pyspark.sql import types as T

    read, kind = [], T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("resource", T.LongType())]))

    def order(data, big):
        read.append((data, big))
        if data == b"bad":
            raise ValueError
        return [{"slot": 1, "resource": len(data)}]

    run = extract._reader(order, kind)
    data, big = pa.array([b"a", b"bb", None, b"a", b"bad", b"a"]), pa.array([True, True, True, False, True, None])
    (out,) = run(iter([(data, big)]))
    assert [x and x[0]["resource"] for x in out.to_pylist()] == [1, 2, None, 1, None, 1] and read == [(b"a", True), (b"bb", True), (b"a", False), (b"bad", True)]


def test_structs_are_taken_apart_as_they_are():
    import pyarrow as pa

    rows = [{"a": 1, "box": {"top": 1, "left": None}}, {"a": None, "box": None}, None, {"a": 4, "box": {"top": 7, "left": 8}}]
    column = pa.array(rows, pa.struct([("a", pa.int32()), ("box", pa.struct([("top", pa.int32()), ("left", pa.int32())]))]))
    assert extract._plain(column) == rows and extract._plain(column.slice(2)) == rows[2:]


def test_records_are_not_read_to_look_for_shared_numbers(spark):
    files = made.containers_of(spark.range(5).selectExpr("id as p_partkey"), made._outcome_file, "p_partkey")
    chunks = materialize(container.chunks_of(files), "chunks")
    lines = extract.members(chunks)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    for i, x in enumerate(lines):
        below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert "Window [" not in x or not [y for y in lines[i:below] if "ArrowEvalPython" in y and "payload" in y]


def test_containers_are_taken_apart_where_they_are_made(spark, monkeypatch):
    class Seen(Exception):
        pass

    def seen(df, label):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"), label)

    for module in (made, containers):
        monkeypatch.setattr(module, "materialize", seen)
    for name, query in (made.QUERIES | containers.QUERIES).items():
        if name != "payload_round_trip":
            with pytest.raises(Seen) as said:
                query(spark, "/root/testdata/sf0.001")
            assert said.value.args == (1, "chunks"), name
    rows = spark.range(60).selectExpr("id as p_partkey")
    one, two = container.chunks_from(rows, made._files(made._outcome_file, "p_partkey")), container.chunks_of(made.containers_of(rows, made._outcome_file, "p_partkey"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.select("path").distinct().count() == 60


def test_palette_members_are_looked_up_once(spark):
    files = made.containers_of(spark.range(5).selectExpr("id as vec_id", "1 as label"), made._image_file, "vec_id")
    chunks = materialize(container.chunks_of(files), "chunks")
    found = materialize(extract.members(chunks), "members")
    got = extract.resolved_palettes(chunks, found)
    assert "CLUT" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["id"], r["palette_ref"], r["resolution"]) for r in got.collect()} == {(2, 1, "direct"), (3, 1, "borrowed")} and got.count() == 10


def test_colour_tables_are_written_line_by_line():
    for n in (-3, 0, 300):
        want = [((n + i) % 256, i * 3 % 256, 40) for i in range(256)]
        data = made._colors({"vec_id": n, "label": 2})
        assert data == bytes(v for c in want for v in c)
        assert payloads.jasc(payloads.palette(data)).decode().split("\r\n") == ["JASC-PAL", "0100", "256", *("%d %d %d" % c for c in want), ""]
    assert payloads.jasc(payloads.MAC[:2]) == b"JASC-PAL\r\n0100\r\n256\r\n255 255 255\r\n255 255 204\r\n" + b"0 0 0\r\n" * 254


def test_records_and_payloads_are_given_to_one_worker(spark):
    """What becomes of members is a condition on the decoder's result; exploding a key table infers one on the reader's."""
    chunks = materialize(container.chunks_of(made.containers_of(spark.range(50).selectExpr("id as p_partkey"), made._outcome_file, "p_partkey")), "chunks")
    known = extract.structure(chunks)
    artifacts = extract.artifacts(chunks, materialize(extract.members(chunks, known), "members"), known=known)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert [plan(x).split("Initial Plan")[0].count("ArrowEvalPython") for x in (extract.key_entries(chunks), extract.statistics(artifacts))] == [1, 1]
    assert {(r["bucket"], r["kind"]): r["n"] for r in extract.statistics(artifacts).collect()}[("selected", None)] == 40
