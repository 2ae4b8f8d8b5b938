"""Replay from stored observations: cluster, map to turns, and the threshold sweep."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnframe.config import EngineConfig
from turnframe.operators.online import DECISIONS, cluster_recording
from turnframe.sources.folders import once


def sweep(observations: DataFrame, spark: SparkSession, match=(0.45, 0.5, 0.55, 0.6, 0.65), new=(0.3, 0.35, 0.4, 0.45, 0.5), cfg: EngineConfig | None = None) -> DataFrame:
    """(match_threshold, new_threshold, observations, clusters, errors): every combination over all recordings, in one grouped job.

    errors counts the observations whose cluster's most frequent label is another; a recording is shipped once and replayed under every setting.
    """
    cfg = cfg or EngineConfig()
    settings = [(float(m), float(n)) for m in match for n in new]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([cluster_recording(pdf, replace(cfg, match_threshold=m, new_threshold=n)).assign(match_threshold=m, new_threshold=n) for m, n in settings])

    found = observations.select("uri", "chunk", "local", "vec", "duration", "allow_update").groupBy("uri").applyInPandas(run, f"{DECISIONS}, match_threshold double, new_threshold double")
    labelled = found.join(observations.select("uri", "chunk", "local", "label"), ["uri", "chunk", "local"])
    keys = ["match_threshold", "new_threshold"]
    counts = labelled.groupBy(*keys, "uri", "global_id", "label").agg(F.count(F.lit(1)).alias("n"))
    by_cluster = counts.groupBy(*keys, "uri", "global_id").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    return by_cluster.groupBy(*keys).agg(F.sum("n").alias("observations"), F.count(F.lit(1)).alias("clusters"), F.sum(F.col("n") - F.col("top")).alias("errors"))


def best_setting(swept: DataFrame) -> DataFrame:
    """The setting with fewest errors, then with fewest clusters."""
    return swept.orderBy("errors", "clusters", "match_threshold", "new_threshold").limit(1)


def numbered(rows: DataFrame, name: str = "_at") -> DataFrame:
    """rows with their places in order, from 0, written once so that they keep them.

    A row's place is its place in its partition and the rows of all partitions before; those counts are one row a partition.
    """
    kept = once(rows.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return kept.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_id")


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a and b side by side, in the order that each has; ValueError if one has more rows. No column name may be in both."""
    left, right = numbered(a), numbered(b)
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows on one side and {m} on the other")
    return left.join(right, "_at").drop("_at")
