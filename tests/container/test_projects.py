from compare import compare
from ripplemark.plans import containers
from ripplemark.sources import container, writer
from ripplemark.storage import materialize
from ripplemark.streaming import drop_folder


def test_round_trip_of_whole_pages(spark):
    name = "container_round_trip"
    assert compare(spark, "/root/testdata/sf0.001", name, containers.QUERIES[name], containers.ORACLE_SQL[name]).startswith("equal")


def test_projects_follow_links_and_end_in_cycles(spark):
    def movie(*names):
        parts = [b""] * 4 * len(names)
        for i, n in enumerate(names):
            parts[i * 4 + 1] = bytes([len(n)]) + n.encode()
        head = (10).to_bytes(4, "big") + b"\0\0" + len(names).to_bytes(2, "big") + b"\0\4"
        return writer.container([("MCsL", head + writer.property_table(parts))])

    files = spark.createDataFrame([("/p/main.dcr", bytearray(movie("ui", "C:\\x\\sound.cst"))), ("/p/ui.cst", bytearray(movie("main"))), ("/p/ui.cct", bytearray(movie("sound"))), ("/p/sound.cct", bytearray(movie("main"))), ("/p/other.cct", bytearray(movie("ui")))], "path string, content binary")
    chunks = materialize(container.chunks_of(files), "chunks")
    found = containers.project_files(chunks, files, files.where("path like '%main.dcr'"))
    assert {r["path"]: r["depth"] for r in found.collect()} == {"/p/main.dcr": 0, "/p/ui.cct": 1, "/p/sound.cct": 1}


def test_global_palettes(spark):
    df = spark.createDataFrame([("b", "x", bytearray(b"2")), ("a", "x", bytearray(b"1")), ("a", "y", bytearray(b"3"))], "path string, name string, colors binary")
    assert sorted((r["name"], bytes(r["colors"]), r["sources"]) for r in containers.global_palettes(df).collect()) == [("x", b"1", ["a", "b"]), ("y", b"3", ["a"])]


def test_artifacts_are_written(spark, tmp_path):
    df = spark.createDataFrame([("/in/m.dcr", "a__1.txt", bytearray(b"one")), ("/in/m.dcr", None, None)], "path string, file string, data binary")
    assert containers.write_artifacts(df, str(tmp_path)) == 1
    assert (tmp_path / "m" / "a__1.txt").read_bytes() == b"one"


def test_a_drop_folder_is_read_once(spark, tmp_path):
    folder, table, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.cct").write_bytes(writer.container([("STXT", writer.stxt("x"))]))
        drop_folder.ingest(spark, folder, table, mark).awaitTermination(120)
        assert spark.read.parquet(table).where("tag = 'STXT'").count() == k + 1
