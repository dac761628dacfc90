"""Tables in the cluster's shared folder, and column names that clash with no other."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = "spark.ripplemark.scratch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``.

    Only a local session that leaves it unset (tests) gets a folder of its own;
    a cluster session without it is an error, since a machine-local folder would lose data.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_DIR, None)
    if path:
        return path
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="ripplemark-")
    spark.conf.set(_OWN_DIR, path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/ripplemark-{label}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and no executor loss can undo it."""
    spark = df.sparkSession
    path = scratch_path(spark, label) + "/data"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_sort(df: DataFrame) -> DataFrame:
    """``df``, and what is derived from it without a join, meets other tables by sorting and is never broadcast.

    The optimizer takes a table for as large as its files. Those of paths and numbers that repeat are a small part of
    what their rows take, so tables of all files' members would be sent to the driver.
    """
    return df.hint("merge")


def spread(rows: DataFrame, each: int = 50_000) -> DataFrame:
    """``rows`` in parts of about ``each`` rows, and in two parts for each core at least: a table of one row group is else read by one task."""
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(parts)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, when nothing reads it any longer."""
    spark = df.sparkSession
    own = shared_dir(spark).rstrip("/").removeprefix("file:").lstrip("/")
    for folder in {f.rsplit("/data/", 1)[0] for f in df.inputFiles() if "/ripplemark-" in f and "/data/" in f}:
        if folder.removeprefix("file:").lstrip("/").startswith(own):
            jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has (letter case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"__{name}"
        while candidate.lower() in taken:
            candidate += "_"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
