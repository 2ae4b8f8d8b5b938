"""Diarization scoring: speaker mapping, error components and their roll-ups. Timelines have one open turn for each speaker (merge them first)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnframe.functions.matching import assign
from turnframe.operators.intervals import clipped, contained, extent, holds_midpoint, overlap_join, overlap_seconds
from turnframe.operators.scans import BUCKET, scanned


def _map_recording(pdf: pd.DataFrame) -> pd.DataFrame:
    refs, syss = sorted(pdf["ref"].unique()), sorted(pdf["sys"].unique())
    shared = np.zeros((len(refs), len(syss)))
    for r, s, x in zip(pdf["ref"], pdf["sys"], pdf["overlap"]):
        shared[refs.index(r), syss.index(s)] = x
    pairs = [(i, j) for i, j in assign(-shared) if shared[i, j] > 0]
    return pd.DataFrame({"uri": [pdf["uri"].iloc[0]] * len(pairs), "ref": [refs[i] for i, _ in pairs], "sys": [syss[j] for _, j in pairs], "overlap": [int(shared[i, j]) for i, j in pairs]})


def speaker_mapping(overlaps: DataFrame) -> DataFrame:
    """(uri, ref, sys, overlap): the one-to-one mapping of most shared time; speakers may stay unmapped. overlaps: a row for each pair that shares any.

    A recording's group has a row for each pair of its speakers, not for its turns.
    """
    kinds = dict(overlaps.dtypes)
    return overlaps.groupBy("uri").applyInPandas(_map_recording, f"uri {kinds['uri']}, ref {kinds['ref']}, sys {kinds['sys']}, overlap long")


def active_counts(ref: DataFrame, sys: DataFrame, width: int = BUCKET, keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    """(keys, a, b, n_ref, n_sys): stretches between consecutive boundaries of either timeline, with the open turns of each."""

    def marks(df, r, s):
        pair = F.array(F.struct(F.col("s").alias("t"), F.lit(r).alias("r"), F.lit(s).alias("s")), F.struct(F.col("e").alias("t"), F.lit(-r).alias("r"), F.lit(-s).alias("s")))
        return df.where("e > s").select(*keys, F.explode(pair).alias("m")).select(*keys, "m.t", "m.r", "m.s")

    steps = marks(ref, 1, 0).union(marks(sys, 0, 1)).groupBy(*keys, "t").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    swept = scanned(steps, keys, "t", ["t"], width, n_ref=("sum", "r"), n_sys=("sum", "s"), b=("lead", "t"))
    return swept.where("b is not null and n_ref + n_sys > 0").select(*keys, F.col("t").alias("a"), "b", "n_ref", "n_sys")


def error_components(ref: DataFrame, sys: DataFrame, uem: DataFrame, width: int, mapping_uem: DataFrame | None = None) -> DataFrame:
    """(uri, scored, miss, fa, err) over the time of uem; the mapping is made over mapping_uem (by default uem).

    Speaker error is the time in which both sides have speakers less the time that mapped pairs share; that time is a sum
    over an overlap join, so stretches need no sets of speakers. Recordings that only sys has are not scored.
    """
    r, s = clipped(ref, uem, width), clipped(sys, uem, width)
    if mapping_uem is None:
        shared = overlap_seconds(r, s, width)
        mapped = speaker_mapping(shared)
    else:
        pairs = speaker_mapping(overlap_seconds(clipped(ref, mapping_uem, width), clipped(sys, mapping_uem, width), width)).select("uri", "ref", "sys")
        mapped = overlap_seconds(r, s, width).join(pairs, ["uri", "ref", "sys"])
    d = F.col("b") - F.col("a")
    parts = active_counts(r, s).groupBy("uri").agg(
        F.sum(d * F.col("n_ref")).alias("scored"),
        F.sum(d * F.greatest(F.col("n_ref") - F.col("n_sys"), F.lit(0))).alias("miss"),
        F.sum(d * F.greatest(F.col("n_sys") - F.col("n_ref"), F.lit(0))).alias("fa"),
        F.sum(d * F.least("n_ref", "n_sys")).alias("both"),
    )
    right = mapped.groupBy("uri").agg(F.sum("overlap").alias("right"))
    none = F.lit(0).cast("long")
    known = ref.select("uri").distinct().join(parts, "uri", "left").join(right, "uri", "left")
    return known.select("uri", *[F.coalesce(c, none).alias(c) for c in ("scored", "miss", "fa")], (F.coalesce("both", none) - F.coalesce("right", none)).alias("err"))


def der_components(ref: DataFrame, sys: DataFrame, width: int) -> DataFrame:
    """error_components over the extent of each reference recording."""
    return error_components(ref, sys, extent(ref), width)


def speech_time(ref: DataFrame, sys: DataFrame, uem: DataFrame, width: int) -> DataFrame:
    """(uri, speech, missed, false_alarm): the time of uem in which anyone of ref speaks, of it the time in which no one of sys does, and the time in which only sys has speakers."""
    d, none = F.col("b") - F.col("a"), F.lit(0).cast("long")
    when = lambda cond: F.sum(F.when(cond, d).otherwise(none))
    found = active_counts(clipped(ref, uem, width), clipped(sys, uem, width)).groupBy("uri")
    return found.agg(when(F.col("n_ref") > 0).alias("speech"), when((F.col("n_ref") > 0) & (F.col("n_sys") == 0)).alias("missed"), when((F.col("n_ref") == 0) & (F.col("n_sys") > 0)).alias("false_alarm"))


def running_total(rows: DataFrame, score: Column, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, id, total): the sum of score over the rows (id) of a key up to each, in order."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, "id", F.sum(score).over(upto).alias("total"))


def without_subtype(ref: DataFrame, sys: DataFrame, subtype: str, width: int) -> tuple[DataFrame, DataFrame]:
    """ref (uri, id, s, e, subt) without the events of a subtype, and sys (uri, id, s, e, mapped) without those mapped to one, or unmapped with their midpoint inside one.

    mapped is the id of the ref event, or null. Midpoints meet events in time buckets.
    """
    gone = ref.where(F.col("subt") == subtype)
    left = sys.join(gone.select("uri", F.col("id").alias("mapped")), ["uri", "mapped"], "left_anti")
    mid = (F.col("s") + F.col("e")) / 2
    points = left.where("mapped is null").select("uri", "id", mid.alias("s"), mid.alias("e"))
    met = overlap_join(points, gone.select("uri", "s", "e"), ["uri"], width, pad=1).where("a_s between b_s and b_e")
    return ref.where(~F.col("subt").eqNullSafe(subtype)), left.join(met.select("uri", F.col("a_id").alias("id")).distinct(), ["uri", "id"], "left_anti")


def grouped_sets(rows: DataFrame, sets: list[list[str]], *sums: Column) -> DataFrame:
    """sums over each of several groupings, e.g. by recording, speaker and gender; what a set leaves out is null."""
    by = list(dict.fromkeys(c for some in sets for c in some))
    return rows.groupingSets([[F.col(c) for c in some] for some in sets], *by).agg(*sums)


def rate(part: Column, whole: Column) -> Column:
    """In percent; nothing of nothing is 0, something of nothing infinite."""
    return F.when(whole != 0, part * 100.0 / whole).when(part == 0, 0.0).otherwise(F.lit(float("inf")))


def with_rates(components: DataFrame) -> DataFrame:
    """components with ms, fa_rate, ser and der in percent of the scored time."""
    c = F.col
    return components.select("*", rate(c("miss"), c("scored")).alias("ms"), rate(c("fa"), c("scored")).alias("fa_rate"), rate(c("err"), c("scored")).alias("ser"), rate(c("miss") + c("fa") + c("err"), c("scored")).alias("der"))


def pooled_and_macro(components: DataFrame) -> DataFrame:
    """One row (files, global_der, avg_der): of the summed times, and the mean of the recordings' rates."""
    return with_rates(components).agg(F.count(F.lit(1)).alias("files"), rate(F.sum("miss") + F.sum("fa") + F.sum("err"), F.sum("scored")).alias("global_der"), F.avg("der").alias("avg_der"))


def rolled_up(components: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, scored, miss, fa, err, der) for every subset of by; what is rolled up is null, and label says ALL or which are not."""
    label = F.concat_ws(" ", *[F.when(F.grouping(c) == 0, F.concat(F.lit(f"{c[0]}="), F.col(c).cast("string"))) for c in by])
    sums = components.cube(*by).agg(*[F.sum(x).alias(x) for x in ("scored", "miss", "fa", "err")], F.when(label == "", "ALL").otherwise(label).alias("label"))
    return sums.select(*by, "label", "scored", "miss", "fa", "err", rate(F.col("miss") + F.col("fa") + F.col("err"), F.col("scored")).alias("der"))


def type_confusion(overlaps: DataFrame, types: DataFrame) -> DataFrame:
    """(ref_type, sys_type, pairs, time): shared time of speakers by their types; speakers without one are `unknown`. types: (spk, type)."""
    a, b = types.select(F.col("spk").alias("ref"), F.col("type").alias("ref_type")), types.select(F.col("spk").alias("sys"), F.col("type").alias("sys_type"))
    typed = overlaps.join(a, "ref", "left").join(b, "sys", "left").fillna("unknown", ["ref_type", "sys_type"])
    return typed.groupBy("ref_type", "sys_type").agg(F.count(F.lit(1)).alias("pairs"), F.sum("overlap").alias("time"))


MISS, FALSE_ALARM = "MISS", "FALSE ALARM"


def type_time(ref: DataFrame, sys: DataFrame, types: list[str], width: int = BUCKET) -> DataFrame:
    """(uri, ref_type, sys_type, time): speaker time by types of turns (uri, type, s, e), over stretches in which the open turns stay the same.

    In a stretch a pair of types shares as many speakers as both have there; a type of ref misses as many as it has beyond all
    of sys, and one of sys raises as many false alarms as it has beyond all of ref. Each cell is a sweep of its own two
    timelines, so no stretch carries sets of speakers.
    """
    every = lambda kinds: F.explode(F.array(*map(F.lit, kinds)))
    keys, d = ("uri", "ref_type", "sys_type"), F.col("b") - F.col("a")
    own_ref, own_sys = ref.withColumnRenamed("type", "ref_type"), sys.withColumnRenamed("type", "sys_type")
    left = own_ref.withColumn("sys_type", every([*types, MISS])).union(ref.select("uri", F.lit(FALSE_ALARM).alias("ref_type"), "s", "e", every(types).alias("sys_type")).select("uri", "ref_type", "s", "e", "sys_type"))
    right = own_sys.withColumn("ref_type", every([*types, FALSE_ALARM])).select("uri", "ref_type", "s", "e", "sys_type")
    right = right.union(sys.select("uri", every(types).alias("ref_type"), "s", "e", F.lit(MISS).alias("sys_type")))
    counts = active_counts(left.select(*keys, "s", "e"), right.select(*keys, "s", "e"), width, keys)
    n = F.when(F.col("sys_type") == MISS, F.greatest(F.col("n_ref") - F.col("n_sys"), F.lit(0))).when(F.col("ref_type") == FALSE_ALARM, F.greatest(F.col("n_sys") - F.col("n_ref"), F.lit(0))).otherwise(F.least("n_ref", "n_sys"))
    return counts.groupBy(*keys).agg(F.sum(n * d).alias("time")).where("time > 0")


def type_counts(ref: DataFrame, sys: DataFrame, mapping: DataFrame) -> DataFrame:
    """(uri, ref_type, sys_type, speakers): speakers of ref (uri, spk, type) by their type and that of the speaker they are mapped to (uri, ref, sys), and speakers of sys that none is mapped to."""
    r = ref.select("uri", F.col("spk").alias("ref"), F.col("type").alias("ref_type")).distinct()
    s = sys.select("uri", F.col("spk").alias("sys"), F.col("type").alias("sys_type")).distinct()
    told = r.join(mapping.select("uri", "ref", "sys"), ["uri", "ref"], "left").join(s, ["uri", "sys"], "left").select("uri", "ref_type", F.coalesce("sys_type", F.lit(MISS)).alias("sys_type"))
    alone = s.join(mapping.select("uri", "sys"), ["uri", "sys"], "left_anti").select("uri", F.lit(FALSE_ALARM).alias("ref_type"), "sys_type")
    return told.union(alone).groupBy("uri", "ref_type", "sys_type").agg(F.count(F.lit(1)).alias("speakers"))


def error_table(components: DataFrame, most: float = 999.99) -> DataFrame:
    """(uri, kind, amount, percent): deletions, insertions and substitutions, in percent of the scored time, at most `most`."""
    long = components.selectExpr("uri", "scored", "stack(3, 'del', miss, 'ins', fa, 'sub', err) as (kind, amount)")
    return long.select("uri", "kind", "amount", F.least(F.lit(most), rate(F.col("amount"), F.col("scored"))).alias("percent"))


def offset_histogram(offsets: DataFrame, step: int, tail: int = 3) -> DataFrame:
    """(uri, bin, n): offsets in steps, rounded down, those beyond `tail` steps in the two outer bins."""
    k = F.greatest(F.lit(-tail - 1), F.least(F.lit(tail + 1), F.floor(F.col("offset") / step))).cast("int")
    return offsets.groupBy("uri", k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def reference_match(sys_files: DataFrame, ref_files: DataFrame, suffix: str = "") -> DataFrame:
    """(path, uri, ref_path, reason) for every file of sys_files (path): matched with the reference of the same stem, else with a reason for skipping it."""
    stem = lambda p: F.regexp_replace(F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", ""), f"{suffix}$" if suffix else "^$", "")
    refs = ref_files.select(stem(F.col("path")).alias("uri"), "path").groupBy("uri").agg(F.min("path").alias("ref_path"))
    return sys_files.select("path", stem(F.col("path")).alias("uri")).join(refs, "uri", "left").select("path", "uri", "ref_path", F.when(F.col("ref_path").isNull(), "no reference").alias("reason"))


def single_reference(sys_files: DataFrame, ref_path: str) -> DataFrame:
    """reference_match where one file is the reference: it is that of a single file of sys_files, and of several none has one."""
    many = sys_files.limit(2).count() > 1
    uri = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return sys_files.select("path", uri.alias("uri"), F.lit(None if many else ref_path).cast("string").alias("ref_path"), F.lit("a single reference for several files" if many else None).cast("string").alias("reason"))


def evaluated_words(words: DataFrame, uem: DataFrame) -> DataFrame:
    """words (uri, id, type, s, e) without the lexemes whose midpoint lies in no part of uem; other types stay."""
    inside = holds_midpoint(words.where("type = 'LEXEME'"), uem).where("inside").select("uri", "id")
    return words.where("type <> 'LEXEME'").union(words.where("type = 'LEXEME'").join(inside, ["uri", "id"], "left_semi").select(*words.columns))


def evaluated_metadata(marks: DataFrame, uem: DataFrame, kind: str, width: int) -> DataFrame:
    """marks (uri, id, type, mapped, s, e) without those of the type that are neither mapped nor inside one part of uem."""
    asked = (F.col("type") == kind) & ~F.coalesce("mapped", F.lit(False))
    kept = contained(marks.where(asked), uem, width)
    return marks.where(~asked).unionByName(kept.select(*marks.columns))
