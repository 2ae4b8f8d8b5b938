"""Readies a session: the package is importable in Python workers, and their batches are small enough for long texts."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

ROWS = 2000
#: What operators keep in a Python worker from one task to the next: how each lets go of it.
KEPT: dict[str, Callable[[], None]] = {}
TOP = Path(__file__).resolve().parents[2]


def hand_back() -> None:
    """At the end of a task: memory that is free goes back to the system, as the worker lives on beside those of other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def take_over(name: str, release: Callable[[], None] | None = None) -> None:
    """At the start of a task of the operator of that name: what others keep in this worker is let go; release does so for this one's."""
    for other in [k for k in KEPT if k != name]:
        KEPT.pop(other)()
    if release:
        KEPT[name] = release


def ship(spark: SparkSession) -> None:
    """Like --py-files: once for each context, and only where PYTHONPATH lacks the repository.

    Batches of rows between Spark and Python hold ROWS of them, unless the session has a size of its own: at Spark's
    default of 10,000, a batch of documents and its copies would take most of a worker's memory.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    context = spark.sparkContext
    if str(TOP) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_turnframe_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="turnframe-code-")
    shutil.copytree(TOP / "turnframe", f"{folder}/src/turnframe", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/turnframe", "zip", f"{folder}/src"))
    context._turnframe_shipped = True
