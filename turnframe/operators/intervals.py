"""Interval joins and sweeps over [s, e) in integer time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnframe.operators.scans import BUCKET, scanned


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, pad: int = 0) -> DataFrame:
    """Pairs of rows of a and b (columns a_*, b_*) with equal keys whose intervals overlap, or come within pad of it.

    Both sides are dealt to buckets of the given width and meet in those; a pair is kept in one bucket only, the first that
    both have. So the join is an equi-join that Spark can shuffle and split, whatever the number of rows of a key.
    """
    rename = lambda df, p: df.withColumnsRenamed({c: f"{p}_{c}" for c in df.columns if c not in keys})
    left = rename(a, "a").withColumn("_a0", F.floor((F.col("a_s") - pad) / width)).withColumn("_bucket", F.explode(F.sequence(F.col("_a0"), F.floor((F.col("a_e") + pad) / width))))
    right = rename(b, "b").withColumn("_b0", F.floor(F.col("b_s") / width)).withColumn("_bucket", F.explode(F.sequence(F.col("_b0"), F.floor(F.col("b_e") / width))))
    met = left.join(right, [*keys, "_bucket"]).where((F.col("a_s") < F.col("b_e") + pad) & (F.col("b_s") < F.col("a_e") + pad) & (F.col("_bucket") == F.greatest("_a0", "_b0")))
    return met.drop("_bucket", "_a0", "_b0")


def overlap_time() -> F.col:
    return F.least("a_e", "b_e") - F.greatest("a_s", "b_s")


def overlap_seconds(ref: DataFrame, sys: DataFrame, width: int) -> DataFrame:
    """(uri, ref, sys, overlap): shared time of every pair of speakers that share any."""
    met = overlap_join(ref, sys, ["uri"], width)
    return met.groupBy("uri", F.col("a_spk").alias("ref"), F.col("b_spk").alias("sys")).agg(F.sum(overlap_time()).alias("overlap"))


def overlap_flags(turns: DataFrame, width: int) -> DataFrame:
    """turns (id, uri, spk, s, e) with overlapped: whether a turn of another speaker strictly overlaps."""
    met = overlap_join(turns, turns, ["uri"], width).where("a_spk <> b_spk").select("uri", F.col("a_id").alias("id")).distinct()
    return turns.join(met.withColumn("hit", F.lit(True)), ["uri", "id"], "left").withColumn("overlapped", F.coalesce("hit", F.lit(False))).drop("hit")


def active_segments(turns: DataFrame, keys: tuple[str, ...] = ("uri",), width: int = BUCKET, points: bool = False) -> DataFrame:
    """(keys, a, b, n): the stretches between consecutive boundaries of the turns and how many turns are open; stretches with none are left out.

    A sweep with running counts; no join. With points, a turn without length is a boundary too, though never open.
    """
    marks = turns.where("e >= s" if points else "e > s").select(*keys, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    steps = marks.groupBy(*keys, F.col("m.t").alias("a")).agg(F.sum("m.d").alias("d"))
    return scanned(steps, keys, "a", ["a"], width, n=("sum", "d"), b=("lead", "a")).where("n > 0").select(*keys, "a", "b", "n")


def speaker_segments(turns: DataFrame, width: int) -> DataFrame:
    """(uri, a, b, speakers): atomic stretches with the sorted set of speakers. Turns without length cut them, too, and speak in none."""
    met = overlap_join(active_segments(turns, points=True).select("uri", F.col("a").alias("s"), F.col("b").alias("e")), turns, ["uri"], width)
    return met.groupBy("uri", F.col("a_s").alias("a"), F.col("a_e").alias("b")).agg(F.array_sort(F.collect_set("b_spk")).alias("speakers"))


def zones(marks: DataFrame, keys: tuple[str, ...] = ("uri",), width: int = BUCKET) -> DataFrame:
    """(keys, s, e): where the running sum of d over marks (keys, t, d) is at least one and no veto is open.

    marks may carry v, changes of a count that forbids. Changes at the same time take effect together.
    """
    v = F.sum("v") if "v" in marks.columns else F.lit(0)
    steps = marks.groupBy(*keys, "t").agg(F.sum("d").alias("d"), v.alias("v"))
    swept = scanned(steps, keys, "t", ["t"], width, open=("sum", "d"), vetoes=("sum", "v"), next=("lead", "t"))
    return swept.where("open >= 1 and vetoes <= 0 and next is not null").select(*keys, F.col("t").alias("s"), F.col("next").alias("e"))


def joined_zones(pieces: DataFrame, keys: tuple[str, ...] = ("uri",), width: int = BUCKET) -> DataFrame:
    """Touching zones joined; zones of a key are disjoint. Where one ends and the next begins the two edges cancel, and what is left are starts and ends in turn."""
    edges = pieces.where("e > s").select(*keys, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    left = edges.groupBy(*keys, F.col("m.t").alias("s")).agg(F.sum("m.d").alias("d")).where("d <> 0")
    return scanned(left, keys, "s", ["s"], width, e=("lead", "s")).where("d > 0").select(*keys, "s", "e")


def _marks(df: DataFrame, s, e, d: int, v: int) -> DataFrame:
    pair = F.array(F.struct(s.alias("t"), F.lit(d).alias("d"), F.lit(v).alias("v")), F.struct(e.alias("t"), F.lit(-d).alias("d"), F.lit(-v).alias("v")))
    return df.select("uri", F.explode(pair).alias("m")).select("uri", "m.t", "m.d", "m.v")


def collared(uem: DataFrame, ref: DataFrame, collar: int) -> DataFrame:
    """uem (uri, s, e) without the time within collar of a boundary of ref."""
    marks = _marks(uem, F.col("s"), F.col("e"), 1, 0)
    for edge in ("s", "e"):
        marks = marks.union(_marks(ref, F.col(edge) - collar, F.col(edge) + collar, 0, 1))
    return joined_zones(zones(marks))


def without_overlap(uem: DataFrame, ref: DataFrame) -> DataFrame:
    """uem without the time in which two or more turns of ref are open."""
    busy = active_segments(ref).where("n >= 2").select("uri", F.col("a").alias("s"), F.col("b").alias("e"))
    return joined_zones(zones(_marks(uem, F.col("s"), F.col("e"), 1, 0).union(_marks(busy, F.col("s"), F.col("e"), 0, 1))))


def extent(turns: DataFrame) -> DataFrame:
    """(uri, s, e): from the first start to the last end; the time that is evaluated where none is given."""
    return turns.groupBy("uri").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def clipped(turns: DataFrame, uem: DataFrame, width: int) -> DataFrame:
    """turns cut to the parts of uem they overlap."""
    met = overlap_join(turns, uem, ["uri"], width)
    return met.select("uri", F.col("a_spk").alias("spk"), F.greatest("a_s", "b_s").alias("s"), F.least("a_e", "b_e").alias("e"))


def contained(turns: DataFrame, uem: DataFrame, width: int, slack: int = 0) -> DataFrame:
    """turns that lie inside one part of uem, but for slack at the ends."""
    met = overlap_join(turns, uem, ["uri"], width, pad=slack + 1).where((F.col("a_s") >= F.col("b_s") - slack) & (F.col("a_e") <= F.col("b_e") + slack))
    return turns.join(met.select("uri", F.col("a_id").alias("id")).distinct(), ["uri", "id"], "left_semi")


def holds_midpoint(points: DataFrame, uem: DataFrame, width: int = BUCKET) -> DataFrame:
    """points (id, uri, s, e) with inside: whether the midpoint lies in a closed part of uem, whose parts are disjoint. An as-of lookup of the last start."""
    mid = (F.col("s") + F.col("e")) / 2
    rows = points.select("uri", "id", mid.alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end"))
    rows = rows.union(uem.select("uri", F.lit(None).cast("long"), F.col("s").cast("double"), F.lit(0), F.col("e")))
    found = scanned(rows, ("uri",), "t", ["t", "kind"], width, last_end=("last", "end")).where("kind = 1")
    return found.select("uri", "id", F.coalesce(F.col("t") <= F.col("last_end"), F.lit(False)).alias("inside"))


def interpolated(points: DataFrame, anchors: DataFrame, width: int = BUCKET) -> DataFrame:
    """points (id, uri, t) with mapped: t on the scale of anchors (uri, t, to), linear between the nearest on either side; outside them shifted as the nearest one is."""
    rows = points.select("uri", "id", "t", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("to"))
    rows = rows.union(anchors.select("uri", F.lit(None).cast("long"), "t", F.col("t"), "to"))
    rows = rows.withColumn("later", F.col("at").isNull())  # an anchor comes before the points of its time
    back = scanned(rows, ("uri",), "t", ["t", "later"], width, t0=("last", "at"), x0=("last", "to"))
    # from a point on, the anchors of its own time count too
    found = scanned(back.withColumn("later", ~F.col("later")), ("uri",), "t", ["t", "later"], width, t1=("next", "at"), x1=("next", "to")).where("id is not null")
    between = F.col("x0") + (F.col("t") - F.col("t0")).cast("double") * (F.col("x1") - F.col("x0")) / (F.col("t1") - F.col("t0"))
    mapped = F.when(F.col("t0") == F.col("t1"), F.col("x0").cast("double")).when(F.col("t0").isNotNull() & F.col("t1").isNotNull(), between).otherwise(F.coalesce(F.col("t") + F.col("x0") - F.col("t0"), F.col("t") + F.col("x1") - F.col("t1"), F.col("t")).cast("double"))
    return found.select("uri", "id", "t", mapped.alias("mapped"))


def index_range(events: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """(uri, id, first, last): the first and the last index of the words (uri, idx, s, e) whose midpoint lies in an event (uri, id, s, e); null where none does."""
    mid = F.expr("(s + e) div 2")
    met = overlap_join(events, words.select("uri", "idx", mid.alias("s"), (mid + 1).alias("e")), ["uri"], width, pad=1).where((F.col("b_s") >= F.col("a_s")) & (F.col("b_s") <= F.col("a_e")))
    found = met.groupBy("uri", F.col("a_id").alias("id")).agg(F.min("b_idx").alias("first"), F.max("b_idx").alias("last"))
    return events.select("uri", "id").join(found, ["uri", "id"], "left")


def extended_zones(excluded: DataFrame, lexemes: DataFrame, segments: DataFrame, most: int, width: int = BUCKET) -> DataFrame:
    """(uri, s, e): the time of excluded events, each stretch widened on either side by up to `most`, but not past the nearest end of a word or edge of a speaker segment.

    A side at which a word is open is not widened. Stretches that come to touch are joined. One sweep with running counts
    and as-of edges; tables are (uri, s, e).
    """
    merged = joined_zones(zones(_marks(excluded.where("e > s"), F.col("s"), F.col("e"), 1, 0)))
    no = F.lit(None).cast("long")
    # kind 0: an edge or a word's mark, which counts before a zone's mark at the same time
    word = lexemes.where("e > s").select("uri", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    rows = word.select("uri", "m.t", F.lit(0).alias("kind"), F.col("m.d").alias("d"), F.when(F.col("m.d") < 0, F.col("m.t")).alias("back"), F.when(F.col("m.d") > 0, F.col("m.t")).alias("ahead"), no.alias("z"))
    edge = segments.where("e > s").select("uri", F.explode(F.array("s", "e")).alias("t"))
    rows = rows.union(edge.select("uri", "t", F.lit(0), F.lit(0), "t", "t", no))
    for kind, side in ((1, "s"), (2, "e")):
        rows = rows.union(merged.select("uri", F.col(side), F.lit(kind), F.lit(0), no, no, F.col("s")))
    # looking ahead, a word that begins at the time of a zone's mark counts: kinds in turned order
    rows = rows.withColumns({"turned": -F.col("kind"), "back_from": F.col("back"), "ahead_from": F.col("ahead")}).drop("back", "ahead")
    seen = scanned(rows, ("uri",), "t", ["t", "kind"], width, open=("sum", "d"), back=("max", "back_from"))
    seen = scanned(seen, ("uri",), "t", ["t", "turned"], width, ahead=("min_ahead", "ahead_from")).where("kind > 0")
    start = F.when(F.col("open") > 0, F.col("t")).otherwise(F.greatest(F.coalesce("back", F.col("t") - most), F.col("t") - most))
    end = F.when(F.col("open") > 0, F.col("t")).otherwise(F.least(F.coalesce("ahead", F.col("t") + most), F.col("t") + most))
    wide = seen.groupBy("uri", "z").agg(F.min(F.when(F.col("kind") == 1, start)).alias("s"), F.max(F.when(F.col("kind") == 2, end)).alias("e"))
    return joined_zones(zones(_marks(wide, F.col("s"), F.col("e"), 1, 0)))


def without_zones(uem: DataFrame, excluded: DataFrame) -> DataFrame:
    """uem without the time of excluded (uri, s, e)."""
    return joined_zones(zones(_marks(uem, F.col("s"), F.col("e"), 1, 0).union(_marks(excluded, F.col("s"), F.col("e"), 0, 1))))
