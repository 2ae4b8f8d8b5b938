"""Frames to regions: runs of active frames, pure and overlapped speech, and capped selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT = ["uri", "chunk", "slot"]


def with_overlap(frames: DataFrame) -> DataFrame:
    """frames (uri, chunk, frame, slot, act) with n_active, the active slots of the frame, overlap (two or more) and pure (active alone)."""
    n = F.sum("act").over(Window.partitionBy("uri", "chunk", "frame"))
    return frames.withColumn("n_active", n).withColumns({"overlap": F.col("n_active") >= 2, "pure": (F.col("act") == 1) & (F.col("n_active") < 2)})


def overlap_frames(frames: DataFrame) -> DataFrame:
    """(uri, chunk, frame, n_active) of the frames in which at least two slots are active."""
    return frames.groupBy("uri", "chunk", "frame").agg(F.sum("act").alias("n_active")).where("n_active >= 2")


def connected_regions(frames: DataFrame, active: str = "act = 1") -> DataFrame:
    """(uri, chunk, slot, f0, f1): runs [f0, f1) of consecutive frames that satisfy `active`."""
    order = Window.partitionBy(*SLOT).orderBy("frame")
    runs = frames.where(active).select(*SLOT, "frame", (F.col("frame") - F.row_number().over(order)).alias("g"))
    return runs.groupBy(*SLOT, "g").agg(F.min("frame").alias("f0"), (F.max("frame") + 1).alias("f1")).drop("g")


def select_capped(regions: DataFrame, cap: int, *priority) -> DataFrame:
    """regions in order of priority until their lengths reach cap; the one that crosses it keeps its head."""
    order = Window.partitionBy(*SLOT).orderBy(*priority)
    before = F.coalesce(F.sum(F.col("f1") - F.col("f0")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = regions.withColumn("before", before).where(F.col("before") < cap)
    return kept.withColumn("f1", F.col("f0") + F.least(F.col("f1") - F.col("f0"), cap - F.col("before"))).drop("before")


def capped_latest(regions: DataFrame, cap: int) -> DataFrame:
    """The latest regions first."""
    return select_capped(regions, cap, F.col("f0").desc())


def capped_commit(regions: DataFrame, cap: int, commit_start: int, commit_end: int) -> DataFrame:
    """What lies inside the commit region first, then what lies before it, then what lies after, each in time order; with its class 0, 1 or 2."""
    cs, ce = F.lit(commit_start), F.lit(commit_end)
    part = lambda k, a, b: F.struct(F.lit(k).alias("class"), a.cast("long").alias("f0"), b.cast("long").alias("f1"))
    f0, f1 = F.col("f0"), F.col("f1")
    cut = regions.withColumn("p", F.explode(F.array(part(0, F.greatest(f0, cs), F.least(f1, ce)), part(1, f0, F.least(f1, cs)), part(2, F.greatest(f0, ce), f1))))
    cut = cut.select(*SLOT, "p.class", "p.f0", "p.f1").where("f1 > f0")
    return select_capped(cut, cap, "class", "f0")


def slot_activity(frames: DataFrame, least_active: int) -> DataFrame:
    """(uri, chunk, slot, active, pure, first, last, mean): activity of the slots with at least least_active active frames."""
    marked = with_overlap(frames)
    found = marked.groupBy(*SLOT).agg(
        F.sum("act").alias("active"),
        F.count_if("pure").alias("pure"),
        F.min(F.when(F.col("act") == 1, F.col("frame"))).alias("first"),
        (F.max(F.when(F.col("act") == 1, F.col("frame"))) + 1).alias("last"),
        F.avg("act").alias("mean"),
    )
    return found.where(F.col("active") >= least_active)


def embedding_gate(activity: DataFrame, least_pure: int) -> DataFrame:
    """activity with selection_mode: the pure frames if there are enough, else all active ones (which may not move a centroid); slots with too few of both are dropped."""
    pure = F.col("pure") >= least_pure
    mode = F.when(pure, "pure").when(F.col("active") >= least_pure, "overlap_fallback")
    return activity.withColumns({"selection_mode": mode, "allow_update": pure}).where("selection_mode is not null")


def slots_to_speakers(frames: DataFrame, assignment: DataFrame) -> DataFrame:
    """(uri, chunk, frame, speakers): the distinct global speakers of the active slots, sorted; slots without one drop out. assignment: (uri, chunk, slot, gid)."""
    joined = frames.where("act = 1").join(assignment, SLOT)
    return joined.groupBy("uri", "chunk", "frame").agg(F.array_sort(F.collect_set("gid")).alias("speakers"))


def top_overlapped(frames: DataFrame, most: int = 2) -> DataFrame:
    """(uri, chunk, slot, n, rank): the slots with most overlap frames of each chunk; ties go to the lower slot."""
    found = with_overlap(frames).where("act = 1 and overlap").groupBy(*SLOT).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("uri", "chunk").orderBy(F.col("n").desc(), "slot")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def window_summary(frames: DataFrame) -> DataFrame:
    """(uri, chunk, frames, slots, least, most, mean, active): what a window's scores look like, for a debug log; numbers with six decimals."""
    found = frames.groupBy("uri", "chunk").agg(F.count_distinct("frame").alias("frames"), F.count_distinct("slot").alias("slots"), F.min("act").alias("least"), F.max("act").alias("most"), F.avg("act").alias("mean"), F.count_if(F.col("act") > 0).alias("active"))
    return found.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("least", "most", "mean")})
