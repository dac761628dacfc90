"""Whole-job queries over containers made of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import pieces
from ..sources import container, writer
from ..storage import materialize, read
from . import extract
from .kernel import _normal_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def page_containers(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """``(path, content)``: a container for each page, with its address and its source as text members; odd pages are little-endian."""
    for part in pieces(tuple(batch.columns)):
        for r in pa.record_batch(list(part), names=batch.schema.names).to_pylist():
            big = (r["page_id"] or 0) % 2 == 0
            address, source = _records(big)
            chunks = [("KEY*", _keys(big)), ("CASt", address), ("STXT", writer.stxt(r["url"] or "")), ("CASt", source), ("STXT", writer.stxt(r["html"] or ""))]
            yield f"page-{r['page_id']}", writer.container(chunks, big)


@cache
def _keys(big: bool) -> bytes:
    return writer.key_table([(4, 1, "CASt"), (5, 1, "STXT"), (6, 2, "CASt"), (7, 2, "STXT")], big)


@cache
def _records(big: bool) -> tuple[bytes, bytes]:
    return writer.member(3, "address.txt", big=big), writer.member(3, "source.html", big=big)


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    chunks = materialize(container.chunks_from(pages, page_containers), "chunks")
    known = extract.structure(chunks)
    return extract.artifacts(chunks, materialize(extract.members(chunks, known), "members"), known=known)


def container_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into a container, and its members read back: discovered, typed, joined with their chunks and decoded."""
    made = _made(spark, sf_dir)
    return made.select(F.regexp_extract("path", r"page-(-?\d+)", 1).cast("bigint").alias("page_id"), "id", "type", "name", "outcome", "format", "file", F.decode("data", "UTF-8").alias("text"))


def container_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.statistics(_made(spark, sf_dir))


QUERIES["container_round_trip"] = container_round_trip
ORACLE_SQL["container_round_trip"] = f"""
SELECT page_id, 1::INTEGER AS id, 'Text' AS type, 'address.txt' AS name, 'extracted' AS outcome, 'txt' AS format, 'address__1.txt' AS file, {_normal_sql('url')} AS text FROM pages
UNION ALL SELECT page_id, 2, 'Text', 'source.html', 'extracted', 'html', 'source__2.html', {_normal_sql('html')} FROM pages
"""
QUERIES["container_statistics"] = container_statistics
ORACLE_SQL["container_statistics"] = """
SELECT b AS bucket, k AS kind, count(*) * 2 AS n FROM pages, (VALUES ('extracted'), ('selected')) x(b), (VALUES ('Text'), (NULL)) y(k) GROUP BY 1, 2
"""


def linked_libraries(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, linked)``: files that a container's cast list or its printable strings name, told by their stem.

    ``files(path)`` are the candidates; of several with a stem the extension cct goes before cst, dcr and dir.
    """
    from ..functions import text as rules

    lists = chunks.where("tag = 'MCsL' and payload is not null")
    strings = lists.select("path", F.explode(rules.printable_runs(F.decode("payload", "ISO-8859-1"))).alias("name"))
    named = strings.where(~F.col("name").isin("Internal", "Primary") & ~F.lower("name").startswith("empty"))
    libs = extract.cast_libraries(chunks).select("path", F.explode(F.array("name", "file")).alias("name"))
    stems = named.unionByName(libs).select("path", F.lower(rules.basename(F.col("name"))).alias("stem")).where("stem <> ''").distinct()
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(e) for e in ("cct", "cst", "dcr", "dir")]), ext)
    there = files.select(F.col("path").alias("linked"), F.lower(rules.basename(F.col("path"))).alias("stem"), rank.alias("rank")).where("rank > 0")
    there = there.groupBy("stem").agg(F.min_by("linked", F.struct("rank", "linked")).alias("linked"))
    return stems.join(there, "stem").where("path <> linked").select("path", "linked").distinct()


def project_files(chunks: DataFrame, files: DataFrame, entry: DataFrame) -> DataFrame:
    """``(path, depth)``: all files that the entries ``entry(path)`` link to, directly or through others; cycles end."""
    from ..operators.closure import reachable

    edges = linked_libraries(chunks, files).select(F.col("path").alias("src"), F.col("linked").alias("dst"))
    return reachable(edges, entry.select(F.col("path").alias("node"))).withColumnRenamed("node", "path")


def global_palettes(found_palettes: DataFrame) -> DataFrame:
    """``(name, colors, sources)`` of ``(path, name, colors)``: the first file's colours of each name, and all files that have it, in order."""
    one = F.array_sort(F.collect_list(F.struct("path", "colors")))
    named = found_palettes.groupBy("name").agg(one.alias("all"))
    return named.select("name", F.col("all")[0]["colors"].alias("colors"), F.array_distinct(F.transform("all", lambda x: x["path"])).alias("sources"))


def artifact_folders(paths: DataFrame) -> DataFrame:
    """``(path, folder)``: a file's stem, and where several files share it (letter case ignored), with the beginning of its path's hash."""
    from pyspark.sql import Window

    name = F.element_at(F.split(F.rtrim(F.translate("path", "\\", "/"), F.lit("/")), "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    each = paths.select("path").where("path is not null").distinct().withColumn("stem", stem)
    # A window, not a join: the files of one stem are counted where they meet.
    many = F.count("*").over(Window.partitionBy(F.lower("stem"))) > 1
    return each.select("path", F.when(many, F.concat("stem", F.lit("__"), F.substring(F.sha2("path", 256), 1, 12))).otherwise(F.col("stem")).alias("folder"))


def write_artifacts(made: DataFrame, folder: str) -> int:
    """Write each artifact's bytes to ``folder/<the file's folder>/<artifact>`` from the tasks (see ``artifact_folders``); returns how many. A repeated task writes the same again."""
    data = made.where("data is not null").join(artifact_folders(made), "path").select("folder", "file", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, base = (pyarrow.fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if "://" not in folder or folder.startswith("file:") else pyarrow.fs.FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for own, file, blob in zip(*(batch[c].to_pylist() for c in ("folder", "file", "data"))):
                fs.create_dir(f"{base}/{own}", recursive=True)
                with fs.open_output_stream(f"{base}/{own}/{file}") as out:
                    out.write(blob)
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return data.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
