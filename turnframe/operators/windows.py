"""Chunk schedules, commit regions and plain time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_schedule(recordings: DataFrame, chunk: int, hop: int) -> DataFrame:
    """(uri, chunk_index, chunk_start, commit_start, commit_end) for recordings (uri, total).

    Windows of length chunk begin every hop; each commits its middle, the first from 0 and the last up to the end, so that
    the commit regions tile [0, total). A window whose commit region would begin at or after the end is not made.
    """
    margin = F.expr(f"({chunk} - {hop}) div 2")
    last = F.when(F.col("total") <= hop + margin, F.lit(0)).otherwise(F.ceil((F.col("total") - margin) / hop) - 1).cast("long")
    each = recordings.where("total > 0").withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("chunk_index") * hop
    return each.select(
        "uri",
        "chunk_index",
        start.alias("chunk_start"),
        F.when(F.col("chunk_index") == 0, F.lit(0).cast("long")).otherwise(start + margin).alias("commit_start"),
        F.least(start + margin + hop, F.col("total")).alias("commit_end"),
    ).where("commit_start < commit_end")


def commit_clip(rows: DataFrame, tolerance: int | float = 0) -> DataFrame:
    """rows (s, e, commit_start, commit_end, …) that reach into their commit region, cut to it."""
    inside = (F.col("e") > F.col("commit_start") + tolerance) & (F.col("s") < F.col("commit_end") - tolerance)
    return rows.where(inside).withColumns({"s": F.greatest("s", "commit_start"), "e": F.least("e", "commit_end")})


def hop_windows(events: DataFrame, ts: str, length: int, hop: int, *keys: str) -> DataFrame:
    """(keys, w, n): count of events in every window [w, w + length) that begins at a multiple of hop; ts and the rest in one integer unit."""
    last = F.floor(F.col(ts) / hop).cast("long")
    first = F.floor((F.col(ts) - length) / hop).cast("long") + 1
    each = events.select(*keys, F.explode(F.sequence(first, last)).alias("k"))
    return each.groupBy(*keys, (F.col("k") * hop).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def tumbling(events: DataFrame, ts: str, length: int, *keys: str) -> DataFrame:
    """(keys, w, n): the hopping window whose hop is its length."""
    return events.groupBy(*keys, (F.floor(F.col(ts) / length).cast("long") * length).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def text_windows(total: int, length: int, overlap: int) -> list[tuple[int, int]]:
    """Spans in which a long recording is transcribed: each reaches `overlap` back into the one before."""
    step, at, spans = length - overlap, 0, []
    if step <= 0:
        raise ValueError("the overlap must be shorter than the window")
    while at < total:
        spans.append((max(0, at - overlap), min(at + step, total)))
        at += step
    return spans
