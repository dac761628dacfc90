"""What a run leaves behind and a later run reads: JSON beside the artifacts, snapshots of hashes, and a project's shared palettes and libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payloads
from ..operators.lookup import Step, fallback_chain
from . import extract
from .containers import artifact_folders

MEMBERS, CACHE = "members.json", "members.cache.json"
ARTIFACTS = ("image", "paletteFile", "scriptFile", "textFile", "soundFile", "dataFile")
#: The field that a type's artifact stands in.
PRIMARY = {"Bitmap": "image", "Shape": "image", "Palette": "paletteFile", "Script": "scriptFile", "Text": "textFile", "Field": "textFile", "Sound": "soundFile"}
_ENTRY = "struct<id:int,type:string,checksum:string,cacheChecksum:string," + ",".join(f"{a}:string" for a in ARTIFACTS) + ">"


def _json(path: str, file: str, rows: DataFrame, body: Column) -> DataFrame:
    return rows.select(F.col(path).alias("path"), F.lit(file).alias("file"), F.encode(F.to_json(body), "UTF-8").alias("data"))


def sidecars(chunks: DataFrame, made: DataFrame) -> DataFrame:
    """``(path, file, data)``: the JSON files of each container's run, in the form that ``write_artifacts`` writes.

    ``members.json`` is the manifest, ``members.cache.json`` the hashes that the next run compares, ``movie.json``, ``timeline.json`` and
    ``castlibs.json`` the settings, markers and linked libraries, each where the container has them.
    """
    one = F.array_sort(F.collect_list(F.struct("id", F.col("checksum").alias("cacheChecksum"))))
    cache = made.where("checksum is not null").groupBy("path").agg(one.alias("members"))
    movies, lines = extract.movies(chunks), extract.timelines(chunks)
    libs = extract.cast_libraries(chunks).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("index", "name", "file", "preload"))).alias("libs"))
    parts = [
        extract.manifest(made).select("path", F.lit(MEMBERS).alias("file"), F.encode("manifest", "UTF-8").alias("data")),
        _json("path", CACHE, cache, F.struct(F.lit(1).alias("version"), "members")),
        _json("path", "movie.json", movies, F.struct(*[c for c in movies.columns if c != "path"])),
        _json("path", "timeline.json", lines, F.struct(F.col("frame_count").alias("frameCount"), "markers")),
        _json("path", "castlibs.json", libs, F.col("libs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _entries(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """``(folder, m)``: the members of each JSON file of that name; a file that isn't JSON gives none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", file).option("recursiveFileLookup", "true").load(folder)
    body = F.from_json(F.decode("content", "UTF-8"), f"struct<members:array<{_ENTRY}>>")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.explode(body["members"]).alias("m")).where("m.id is not null")


def base(name: Column) -> Column:
    """The last part of a path; unset stays unset."""
    return F.element_at(F.split(name, r"[/\\]"), -1)


def migrated(entries: DataFrame) -> DataFrame:
    """Manifest entries ``m`` of older runs in today's form: file names without folders, and an artifact that stood in ``image`` in its type's own field."""
    table = F.create_map(*[F.lit(x) for kv in PRIMARY.items() for x in kv])
    primary = F.coalesce(F.try_element_at(table, F.coalesce("m.type", F.lit(""))), F.lit("dataFile"))
    typed = F.col("m.type").isNotNull()
    moved = [
        F.when(typed & (primary != "image"), None).otherwise(base(F.col("m.image"))).alias("image") if a == "image"
        else F.when(typed & (primary == a), F.coalesce(base(F.col(f"m.{a}")), base(F.col("m.image")))).otherwise(base(F.col(f"m.{a}"))).alias(a)
        for a in ARTIFACTS
    ]
    rest = [c for c in entries.columns if c != "m"]
    return entries.select(*rest, F.struct(F.col("m.id").alias("id"), F.col("m.type").alias("type"), F.col("m.checksum").alias("checksum"), F.col("m.cacheChecksum").alias("cacheChecksum"), *moved).alias("m"))


def previous_run(spark: SparkSession, folder: str, paths: DataFrame) -> DataFrame:
    """``(path, id, checksum, <artifact fields>)`` of an earlier run into ``folder``, for ``artifacts(previous=...)``.

    Hashes are those of the cache files, else the manifests'; of files that repeat a member the greatest hash counts.
    """
    told = migrated(_entries(spark, folder, MEMBERS)).groupBy("folder", "m.id").agg(F.max("m").alias("m"))
    cache = _entries(spark, folder, CACHE).groupBy("folder", "m.id").agg(F.max("m.cacheChecksum").alias("cached"))
    both = told.join(cache, ["folder", "id"], "full_outer")
    known = both.select("folder", "id", F.coalesce("cached", "m.checksum").alias("checksum"), *[F.col(f"m.{a}").alias(a) for a in ARTIFACTS])
    return known.join(artifact_folders(paths), "folder").drop("folder")


def members_across(wanted: DataFrame, members: DataFrame, libraries: DataFrame) -> DataFrame:
    """``wanted(id, lib, ...)`` with ``found`` (a library's path) and ``how``: the library of that number if it has the member, else the first in order that has it.

    ``libraries(lib, path)`` are a project's files in their order from 1; ``members(path, id)`` what they hold. 0 or null names no library.
    """
    there = members.select("path", F.col("id").alias("number")).distinct().join(libraries, "path")
    told = there.select(F.struct(F.col("lib").cast("int").alias("l"), F.col("number").cast("bigint").alias("n")).alias("k"), F.struct("lib", "path").alias("v"))
    first = there.groupBy("number").agg(F.min(F.struct("lib", "path")).alias("v"))
    steps = [
        Step("library", told, "k", "v", F.when(F.col("lib") > 0, F.struct(F.col("lib").cast("int").alias("l"), F.col("id").cast("bigint").alias("n")))),
        Step("any", first, "number", "v", F.col("id")),
    ]
    out = fallback_chain(wanted, steps, "found", "how")
    return out.withColumn("found", F.col("found.path"))


def palettes_json(palettes: DataFrame) -> DataFrame:
    """``(file, data)``: a project's ``global_palettes`` as one JSON object by name; a project has few."""
    one = F.struct("name", F.struct(F.hex("colors").alias("colors"), F.col("sources").alias("references")))
    return palettes.agg(F.encode(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(one)))), "UTF-8").alias("data")).select(F.lit("palettes.json").alias("file"), "data")


def default_palette(palettes: DataFrame, entry: str) -> DataFrame:
    """``(name, colors)``: the palette of ``global_palettes`` that bitmaps without one use: the first by name of the entry file, else the first; the classic
    system palette where a project has only built-in ones."""
    own = F.coalesce(F.array_contains("sources", F.lit(entry)), F.lit(False))
    first = palettes.where(~F.col("name").startswith("System_")).agg(F.min_by(F.struct("name", "colors"), F.struct(~own, "name")).alias("p"))
    return first.select(F.coalesce("p.name", F.lit("System_Mac")).alias("name"), F.coalesce("p.colors", F.lit(payloads.MAC.tobytes())).alias("colors"))
