"""Working folders that driver and executors share, and files in stores that pyarrow can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, Spark on one machine gets one of its own and a cluster is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="turnframe-")
    return f"{top.rstrip('/')}/turnframe/{uuid.uuid4().hex}/{name}"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """(the file system of a path or URI, the path in it)."""
    path = re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), str(Path(path).absolute())


def files(path: str) -> list[fs.FileInfo]:
    """The files below a folder, without those that are hidden or being written."""
    system, top = store(path)
    found = system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    return [f for f in found if f.is_file and not any(part[:1] in "._" for part in f.path[len(top) :].split("/") if part)]


def once(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
