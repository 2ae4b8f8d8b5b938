"""Turns: intervals [s, e) of a speaker in a recording, in any ordered unit of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnframe.operators.scans import BUCKET, is_small, scanned


def gap_merge(turns: DataFrame, gap: int | float, keys: tuple[str, ...] = ("uri", "spk"), width: int = BUCKET) -> DataFrame:
    """(keys, s, e, n): turns of a key joined while the next starts at most `gap` after the latest end so far."""
    return _merged(turns, gap, keys, width, n=F.lit(1).cast("long"))


def _merged(turns: DataFrame, gap: int | float, keys: tuple[str, ...], width: int, **sums: Column) -> DataFrame:
    """(keys, s, e, sums) of joined turns.

    A turn opens a new one if it starts more than gap after every end before it. What lies between two openings is one:
    its end is the latest end before the second, and its sums are the differences of running sums.
    """
    if is_small(turns):
        order = Window.partitionBy(*keys).orderBy("s", "e")
        before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = turns.withColumn("opens", F.when(before.isNull() | (F.col("s") - before > gap), 1).otherwise(0))
        grouped = opens.withColumn("g", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return grouped.groupBy(*keys, "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), *[F.sum(x).alias(c) for c, x in sums.items()]).drop("g")
    of = {f"_{c}": x for c, x in sums.items()}
    rows = turns.select(*keys, "s", "e", *[x.alias(c) for c, x in of.items()])
    seen = scanned(rows, keys, "s", ["s", "e"], width, latest=("max_before", "e"), **{f"upto{c}": ("sum_before", c) for c in of})
    opens = seen.where(F.col("latest").isNull() | (F.col("s") - F.col("latest") > gap)).select(*keys, "s", "latest", *[f"upto{c}" for c in of], F.lit(0).alias("last"))
    ends = rows.groupBy(*keys).agg(F.max("s").alias("s"), F.max("e").alias("latest"), *[F.sum(c).alias(f"upto{c}") for c in of], F.lit(1).alias("last"))
    pairs = scanned(opens.union(ends), keys, "s", ["s", "last"], width, e=("lead", "latest"), **{f"next{c}": ("lead", f"upto{c}") for c in of})
    return pairs.where("last = 0").select(*keys, "s", "e", *[(F.col(f"next_{c}") - F.coalesce(f"upto_{c}", F.lit(0))).alias(c) for c in sums])


def min_duration(turns: DataFrame, least: int | float) -> DataFrame:
    return turns.where(F.col("e") - F.col("s") >= least)


def durations(turns: DataFrame, keys: tuple[str, ...] = ("uri", "spk")) -> DataFrame:
    """(keys, turns, duration)."""
    return turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("turns"), F.sum(F.col("e") - F.col("s")).alias("duration"))


def shares(turns: DataFrame) -> DataFrame:
    """(uri, spk, duration, speakers, share): a speaker's part of all speech of the recording. A recording without speech has share 0."""
    own = durations(turns)
    whole = Window.partitionBy("uri")
    total = F.sum("duration").over(whole)
    return own.select("uri", "spk", "duration", F.count(F.lit(1)).over(whole).alias("speakers"), F.when(total > 0, F.col("duration") / total).otherwise(0.0).alias("share"))


def gap_merge_pieces(pieces: DataFrame, gap: int | float, least_audio: int | float, width: int = BUCKET) -> DataFrame:
    """(uri, spk, s, e, audio): like gap_merge, but what must reach least_audio is the sum of the pieces' own lengths."""
    found = _merged(pieces, gap, ("uri", "spk"), width, audio=F.col("e") - F.col("s"))
    return found.where(F.col("audio") >= least_audio)


def early_closed(turns: DataFrame, commits: DataFrame, gap: int | float, width: int = BUCKET) -> DataFrame:
    """(uri, spk, s, e, closed_at): merged turns with the first commit_end of the recording that lies more than `gap` behind their end.

    A turn is final once that much has been committed; closed_at is null where only the end of the recording closes it.
    commits: (uri, commit_end). An as-of lookup: union and a running minimum from the end, no range join.
    """
    merged = gap_merge(turns, gap, width=width).select("uri", "spk", "s", "e", (F.col("e") + gap).alias("t"), F.lit(None).cast("long").alias("c"))
    marks = commits.select("uri", F.lit(None).cast("long").alias("spk"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.col("commit_end").alias("t"), F.col("commit_end").alias("c"))
    rows = merged.union(marks).withColumn("is_turn", F.col("c").isNull())  # a commit of the same time is not behind a turn
    return scanned(rows, ("uri",), "t", ["t", "is_turn"], width, closed_at=("min_ahead", "c")).where("is_turn").select("uri", "spk", "s", "e", "closed_at")


def rttm_lines(turns: DataFrame, per_second: int = 1_000_000) -> DataFrame:
    """(uri, s, line): turns as text records with three decimals, halves rounded up."""
    milli = lambda c: F.floor(c * 1000 / per_second + 0.5) / 1000.0
    return turns.select("uri", "s", F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> speaker%d <NA> <NA>", F.col("uri").cast("string"), milli(F.col("s")), milli(F.col("e") - F.col("s")), F.col("spk").cast("long")).alias("line"))
