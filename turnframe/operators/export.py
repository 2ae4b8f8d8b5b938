"""How the audio of a commit region is given to its speakers when voices overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_decision(overlap_frames: Column, separated: Column, candidates: Column, passed: Column, least_similarity: Column, threshold: float) -> Column:
    """What a chunk with these facts exports: `mix`, `separate` (each speaker its own track), or `winner` (one track passed the energy gate).

    No overlap, a part too short to separate, fewer than two candidates, no track that passes, or two whose best matching
    falls below the threshold: the mixture. With one passing track its speaker gets the overlap frames of the mixture, and
    the other speaker's overlap frames are dropped.
    """
    plain = (overlap_frames == 0) | ~separated | (candidates < 2) | (passed == 0)
    return F.when(plain, "mix").when(passed == 1, "winner").when(F.coalesce(least_similarity >= threshold, F.lit(False)), "separate").otherwise("mix")


def exported_frames(frames: DataFrame, decisions: DataFrame) -> DataFrame:
    """(uri, chunk, frame, spk, source): frames (uri, chunk, frame, spk, overlap) with the audio they take; decisions (uri, chunk, decision, winner).

    Frames without overlap come from the mixture. Overlap frames come from the speaker's track if separated, from the
    mixture for a winner, and are dropped for the loser.
    """
    joined = frames.join(decisions, ["uri", "chunk"], "left").withColumn("decision", F.coalesce("decision", F.lit("mix")))
    lost = F.col("overlap") & (F.col("decision") == "winner") & ~F.col("spk").eqNullSafe(F.col("winner"))
    source = F.when(F.col("overlap") & (F.col("decision") == "separate"), "track").otherwise("mix")
    return joined.where(~lost).select("uri", "chunk", "frame", "spk", source.alias("source"))
