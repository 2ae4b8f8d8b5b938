"""Cluster centroids, nearest targets, merge maps and their closure."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnframe.functions.vectors import cosine, dot, l2_normalize


def centroids(observations: DataFrame, keys: tuple[str, ...] = ("uri", "cluster")) -> DataFrame:
    """(keys, n, duration, centroid): the mean of each dimension, at unit length. A sum for each dimension, so no group is gathered."""
    each = observations.where("vec is not null").select(*keys, "duration", F.posexplode("vec").alias("dim", "x"))
    dims = each.groupBy(*keys, "dim").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"))
    packed = dims.groupBy(*keys).agg(F.max("n").alias("n"), F.max("duration").alias("duration"), F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d"))
    return packed.select(*keys, "n", "duration", l2_normalize(F.transform("d", lambda d: d["x"])).alias("centroid"))


def merged_centroids(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Centroids (keys, n, duration, centroid) joined within keys, weighted by their counts."""
    each = parts.select(*keys, "n", "duration", F.posexplode("centroid").alias("dim", "x"))
    dims = each.groupBy(*keys, "dim").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"), F.sum("duration").alias("duration"))
    packed = dims.groupBy(*keys).agg(F.max("n").alias("n"), F.max("duration").alias("duration"), F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d"))
    return packed.select(*keys, "n", "duration", l2_normalize(F.transform("d", lambda d: d["x"])).alias("centroid"))


def packed(vectors: DataFrame, keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    """(keys, targets): the clusters (cluster, centroid) of a recording as one sorted array. A row for each recording, as long as it has clusters."""
    return vectors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("targets"))


def _best(vec: Column, targets: Column) -> Column:
    """The (similarity, minus) of the most similar target, minus being its cluster's negative, so that ties go to the lower one."""
    return F.array_max(F.transform(targets, lambda t: F.struct(dot(vec, t["centroid"]).alias("similarity"), (-t["cluster"]).alias("minus"))))


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """(uri, a, b, cosine) for every pair a < b of the clusters (uri, cluster, centroid) of one recording; made from the recording's array, without a join."""
    each = packed(vectors).select("uri", "targets", F.posexplode("targets").alias("i", "x"))
    others = F.slice("targets", F.col("i") + 2, F.size("targets"))
    pairs = F.transform(others, lambda y: F.struct(y["cluster"].alias("b"), cosine(F.col("x.centroid"), y["centroid"]).alias("cosine")))
    return each.select("uri", F.col("x.cluster").alias("a"), F.explode(pairs).alias("p")).select("uri", "a", "p.b", "p.cosine").where("a < b")


def nearest(observations: DataFrame, targets: DataFrame) -> DataFrame:
    """(uri, chunk, local, best, similarity): the most similar cluster of the recording; ties go to the lower id. A row an observation, none for each pair."""
    rows = observations.where("vec is not null").select("uri", "chunk", "local", "vec").join(packed(targets), "uri")
    found = rows.select("uri", "chunk", "local", _best(F.col("vec"), F.col("targets")).alias("m"))
    return found.select("uri", "chunk", "local", (-F.col("m.minus")).alias("best"), F.col("m.similarity").alias("similarity"))


def post_merge_map(clusters: DataFrame, least_duration: float, least_similarity: float) -> DataFrame:
    """(uri, absorbed, survivor, similarity): clusters (uri, cluster, duration, centroid) shorter than least_duration go to the most similar of the others.

    Short clusters are never targets; one that is less similar than least_similarity to all stays. Without targets nothing merges.
    """
    short = F.coalesce("duration", F.lit(0.0)) < least_duration
    whole = clusters.groupBy("uri").agg(F.collect_list(F.when(short, F.struct("cluster", "centroid"))).alias("small"), F.array_sort(F.collect_list(F.when(~short, F.struct("cluster", "centroid")))).alias("targets"))
    each = whole.where("size(targets) > 0").select("uri", "targets", F.explode("small").alias("x"))
    found = each.select("uri", F.col("x.cluster").alias("absorbed"), _best(F.col("x.centroid"), F.col("targets")).alias("m"))
    return found.where(F.col("m.similarity") >= least_similarity).select("uri", "absorbed", (-F.col("m.minus")).alias("survivor"), F.col("m.similarity").alias("similarity"))


def merge_closure(merges: DataFrame, most: int = 40) -> DataFrame:
    """(uri, absorbed, survivor): chains of merges (uri, absorbed, survivor) followed to their end, by doubling: k rounds reach 2 ** k steps.

    A merge into itself stays as it is. A cycle of several has no end and raises ValueError.
    """
    selves = merges.where("absorbed = survivor").select("uri", "absorbed", "survivor")
    now = _cut(merges.where("absorbed <> survivor").select("uri", "absorbed", "survivor"))
    for _ in range(most):
        step = now.select("uri", F.col("absorbed").alias("survivor"), F.col("survivor").alias("next"))
        moved = _cut(now.join(step, ["uri", "survivor"], "left").select("uri", "absorbed", F.coalesce("next", "survivor").alias("survivor"), F.col("next").isNotNull().alias("moved")))
        now = moved.drop("moved")
        state = moved.agg(F.count_if("moved"), F.count_if(F.col("absorbed") == F.col("survivor"))).first()
        if state[1]:
            break
        if not state[0]:
            return now.union(selves)
    raise ValueError("merges form a cycle")


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder for checkpoints; Spark on one machine gets one if none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnframe-"))
    return df.checkpoint()


def present(vectors: DataFrame, turns: DataFrame) -> DataFrame:
    """vectors (uri, cluster, …) of the speakers that have a turn (uri, spk)."""
    return vectors.join(turns.select("uri", F.col("spk").alias("cluster")), ["uri", "cluster"], "left_semi")


def relabelled(turns: DataFrame, closure: DataFrame) -> DataFrame:
    """turns (uri, spk, …) with every speaker replaced by its survivor; the intervals are not merged again."""
    names = closure.select("uri", F.col("absorbed").alias("spk"), "survivor")
    return turns.join(names, ["uri", "spk"], "left").withColumn("spk", F.coalesce("survivor", "spk")).drop("survivor")


def speaker_status(durations: DataFrame, merges: DataFrame, post: DataFrame, least_duration: float) -> DataFrame:
    """(uri, id, duration, uncertain, merged_into): durations (uri, id, duration) are those of survivors; merges is closed, post is of whole clusters."""
    ids = durations.select("uri", "id").union(merges.select("uri", "absorbed")).distinct()
    first = merges.select("uri", F.col("absorbed").alias("id"), F.col("survivor").alias("one"))
    second = post.select("uri", F.col("absorbed").alias("one"), F.col("survivor").alias("two"))
    led = ids.join(first, ["uri", "id"], "left").withColumn("one", F.coalesce("one", "id")).join(second, ["uri", "one"], "left").withColumn("final", F.coalesce("two", "one"))
    known = led.join(durations, ["uri", "id"], "left")
    merged = F.col("final") != F.col("id")
    length = F.when(~merged, F.coalesce("duration", F.lit(0.0)))
    return known.select("uri", "id", F.round(length, 3).alias("duration"), (~merged & (F.lit(least_duration) > 0) & (F.round(length, 3) < least_duration)).alias("uncertain"), F.when(merged, F.col("final")).alias("merged_into"))


def status_json(status: DataFrame, merges: DataFrame, post: DataFrame, least_duration: float, final: bool) -> DataFrame:
    """(uri, json): one nested record for each recording; a recording's speakers and merges are as many as its clusters."""
    people = status.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("id", "duration", "uncertain", "merged_into"))).alias("speakers"))
    kinds = merges.select("uri", F.lit(0).alias("o"), "absorbed", "survivor", F.lit("merge").alias("kind")).union(post.select("uri", F.lit(1), "absorbed", "survivor", F.lit("post_merge")))
    events = kinds.groupBy("uri").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "absorbed", "survivor", "kind"))), lambda x: F.struct(x["absorbed"].alias("absorbed"), x["survivor"].alias("survivor"), x["kind"].alias("kind"))).alias("merge_events"))
    empty = F.array().cast("array<struct<absorbed:bigint,survivor:bigint,kind:string>>")
    joined = people.join(events, "uri", "left")
    return joined.select("uri", F.to_json(F.struct("uri", F.lit(final).alias("final"), F.lit(least_duration).alias("post_merge_min_speech_duration"), "speakers", F.coalesce("merge_events", empty).alias("merge_events")), {"ignoreNullFields": "false"}).alias("json"))


def merge_events(merges: DataFrame, post: DataFrame) -> DataFrame:
    """(uri, absorbed, survivor, kind)."""
    return merges.select("uri", "absorbed", "survivor", F.lit("merge").alias("kind")).union(post.select("uri", "absorbed", "survivor", F.lit("post_merge").alias("kind")))


def match_two(similarities: DataFrame) -> DataFrame:
    """(keys…, straight, least): two tracks and two candidates, s00 to s11: whether track 0 is candidate 0 (ties too), and the lower similarity of the chosen pairs."""
    straight = F.col("s00") + F.col("s11") >= F.col("s01") + F.col("s10")
    return similarities.withColumns({"straight": straight, "least": F.when(straight, F.least("s00", "s11")).otherwise(F.least("s01", "s10"))})


def overlay(base: DataFrame, newer: DataFrame) -> DataFrame:
    """(uri, cluster, vec): reference vectors, the newer ones first."""
    n = newer.select("uri", "cluster", F.col("vec").alias("new"))
    return base.join(n, ["uri", "cluster"], "full").select("uri", "cluster", F.coalesce("new", "vec").alias("vec"))


def best_merge_pair(pairs: DataFrame, least: float) -> DataFrame:
    """(uri, a, b, cosine): the most similar pair of each recording with at least that similarity; ties go to the first in order of (a, b)."""
    order = Window.partitionBy("uri").orderBy(F.col("cosine").desc(), "a", "b")
    return pairs.where(F.col("cosine") >= least).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
