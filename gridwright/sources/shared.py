"""Places of files: paths and URIs as open file systems, the session's shared folder, and tables kept there."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library from the folder the driver has it in."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def located(place: str | os.PathLike):
    """The file system of a path or URI, and the path in it. A local path is taken as it is, whatever its letters are;
    so is what follows file:, which Spark doesn't escape in paths that it is given.
    """
    from pyarrow import fs

    place = os.fspath(place)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", place) and not place.startswith("file:"):
        return fs.FileSystem.from_uri(place)
    return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/*", "/", place))


def read_text(place: str | os.PathLike) -> str:
    """A small file's text; FileNotFoundError if it isn't there."""
    where, path = located(place)
    with where.open_input_stream(path, compression=None) as f:
        return f.read().decode()


def write_text(place: str | os.PathLike, text: str) -> None:
    where, path = located(place)
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(path, compression=None) as f:
        f.write(text.encode())


def exists(place: str) -> bool:
    where, path = located(place)
    return where.get_file_info(path).type.name != "NotFound"


def literal(place: str) -> str:
    """A path for Spark's readers that stands for itself, whatever its letters are."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", place)


def qualified(spark: SparkSession, place: str) -> str:
    """A path with its scheme and absolute, as plain() shows those of files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return re.sub(r"^(\w+):/+", r"\1:/", path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())


def plain(encoded: Column | str) -> Column | str:
    """A file's path as its letters are, from what Spark shows, which is percent-encoded."""
    if isinstance(encoded, str):
        return re.sub(r"^(\w+):/+", r"\1:/", unquote(encoded))
    return F.regexp_replace(F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), r"^(\w+):/+", "$1:/")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the checkpoint directory that the
    session was given.

    Where neither is set, a local master gets a temporary folder of its own; on a cluster that is a ValueError. The
    session's settings stay as they are.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"gridwright-tables-{os.getpid()}")
    return found.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder: what uses them twice doesn't compute them twice, on any session."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
