"""Metadata events over words (sentence units, fillers, edits, interruption points): their word ranges, alignment and errors.

An event (uri, id, type, subtype, s, e) holds the words whose midpoint lies in it. Words (uri, idx, s, e and, if there,
scoreable) are counted by their midpoints from 0, so a range is two counts, found by one scan over words and events. Events
of one recording and type are aligned by the path with the highest total score, inside stretches without a gap.

Rows: a null time has no range, and such an event is left out. A null subtype
is an empty one. Events and words may repeat times; tables may be empty. An id names one event of a recording.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnframe.operators.alignment import align, in_islands, islands
from turnframe.operators.intervals import BUCKET, overlap_join
from turnframe.operators.scans import scanned

#: The gap in words over which events pair, how many of a sentence unit's last words count, what equal subtypes
#: and equal last words multiply a score by, and the extent of an event that has none.
GAP, UNIT_WORDS = 0.1, 2
SAME_SUBTYPE, SAME_END = 1.1, 1.001
EPSILON = 1e-8
#: Types that mark their words, that mark their last word, and that are points.
SPANS, ENDS, POINTS = ("FILLER", "EDIT"), ("SU", "IP"), ("IP", "CB")
#: Scores of events without extent are of the order of EPSILON; all are counted in finer units.
FINER = 1e6
ALIGNED = "uri string, type string, ref_id long, sys_id long, ref_subtype string, sys_subtype string, kind string, dbeg long, dend long, ref_first long, ref_last long, sys_first long, sys_last long"


def _mid(df: DataFrame):
    return F.expr("(s + e) div 2")


def word_ranges(events: DataFrame, words: DataFrame, width: int = BUCKET) -> DataFrame:
    """events with first, last (counts of words: the range is empty where last = first - 1), before and until (scoreable words before the range, and up to its end) and last_idx, the idx of the last word up to the event's end."""
    scoreable = F.col("scoreable").cast("long") if "scoreable" in words.columns else F.lit(1).cast("long")
    about = ["id", "type", "subtype", "s", "e"]
    none = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in about]
    # at one time an event's start comes before the words, and its end after them
    marks = F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("e").alias("t"), F.lit(2).alias("kind")))).alias("m")
    at = events.where("s is not null and e is not null").select("uri", *about, marks).select("uri", "m.t", "m.kind", *about, F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("sure"), F.lit(None).cast("long").alias("word"))
    of = words.where("s is not null and e is not null").select("uri", _mid(words).alias("t"), F.lit(1).alias("kind"), *none, F.lit(1).cast("long").alias("one"), F.coalesce(scoreable, F.lit(0)).alias("sure"), F.col("idx").cast("long").alias("word"))
    found = scanned(at.unionByName(of), ("uri",), "t", ["t", "kind", "word"], width, n=("sum", "one"), k=("sum", "sure"), w=("last", "word")).where("kind <> 1")
    end = F.col("kind") == 2
    return found.groupBy("uri", *about).agg(F.max(F.when(~end, F.col("n"))).alias("first"), (F.max(F.when(end, F.col("n"))) - 1).alias("last"), F.max(F.when(~end, F.col("k"))).alias("before"), F.max(F.when(end, F.col("k"))).alias("until"), F.max(F.when(end, F.col("w"))).alias("last_idx"))


def tagged_words(events: DataFrame, words: DataFrame, width: int = BUCKET) -> DataFrame:
    """(uri, idx, type, subtype): fillers and edits mark all their words, sentence units and points the last word up to their end; of several events of a type the latest marks the word."""
    order = F.struct("s", "e", "id").alias("place")
    met = overlap_join(events.where(F.col("type").isin(*SPANS)), words.select("uri", "idx", _mid(words).alias("s"), (_mid(words) + 1).alias("e")), ["uri"], width, pad=1)
    spans = met.where("b_s >= a_s and b_s <= a_e").select("uri", F.col("b_idx").cast("long").alias("idx"), F.col("a_type").alias("type"), F.col("a_subtype").alias("subtype"), F.struct(F.col("a_s").alias("s"), F.col("a_e").alias("e"), F.col("a_id").alias("id")).alias("place"))
    ends = word_ranges(events.where(F.col("type").isin(*ENDS)), words, width).where("last_idx is not null").select("uri", F.col("last_idx").alias("idx"), "type", "subtype", order)
    return spans.union(ends).groupBy("uri", "idx", "type").agg(F.max_by("subtype", "place").alias("subtype"))


def event_score(gap: float = GAP) -> Callable:
    """What a pair of events adds to a path: the words they share, and gap, more for equal subtypes and equal ends, softened by the gap's part in the whole."""

    def score(r, s) -> float:
        point = r.wtype in POINTS
        extent = r.e - r.s
        shared = min(r.e, s.e) - max(r.s, s.s) + (EPSILON if point else 0.0) + gap
        shared *= (SAME_SUBTYPE if r.word == s.word else 1.0) * (SAME_END if r.e == s.e else 1.0)
        return shared * max(extent, EPSILON) / (extent + gap) * FINER

    return score


def aligned_events(ref: DataFrame, sys: DataFrame, gap: float = GAP, unit_words: int = UNIT_WORDS, most_behind: float = float("inf")) -> DataFrame:
    """The ALIGNED rows of events with word ranges (see word_ranges): kind is cor, sub, del or ins; dbeg and dend are the offsets of both ends in scoreable words.

    Of a sentence unit only the last unit_words count. A task holds one stretch of one recording and type at a time; time grows
    with the pairs of its events that are near in time.
    """
    if gap <= 0:
        raise ValueError("gap must be above 0")

    def side(df: DataFrame) -> DataFrame:
        cut = F.when(F.col("type") == "SU", F.greatest("first", F.col("last") - (unit_words - 1))).otherwise(F.col("first"))
        about = F.struct(F.col("uri").cast("string").alias("uri"), *[F.col(c).cast("long").alias(c) for c in ("first", "last", "before", "until")]).alias("about")
        # a recording and type are one key of the stretches
        return df.select(F.to_json(F.struct(F.col("uri").cast("string"), F.col("type"))).alias("uri"), F.col("id").alias("idx"), F.coalesce("subtype", F.lit("")).alias("word"), F.col("type").alias("wtype"), cut.cast("long").alias("s"), (F.col("last") + 1).cast("long").alias("e"), about)

    score, zero = event_score(gap), lambda w: 0.0

    def row(r, s):
        one, a, b = r or s, r and r.more, s and s.more
        kind = "ins" if r is None else "del" if s is None else "cor" if r.word == s.word else "sub"
        off = (b["before"] - a["before"], b["until"] - a["until"]) if r and s else (None, None)
        ends = [x[c] if x else None for x in (a, b) for c in ("first", "last")]
        return (one.more["uri"], one.wtype, r and r.idx, s and s.idx, r and r.word, s and s.word, kind, *off, *ends)

    def run(_, r, s):
        return [row(None if i is None else r[i], None if j is None else s[j]) for i, j in align(r, s, gap, score, zero, most_behind)]

    return in_islands(islands(side(ref), side(sys), gap, "about"), run, ALIGNED, "about")


def event_errors(aligned: DataFrame) -> DataFrame:
    """(uri, type, subtype, refs, cor, sub, dele, ins, rate): counts by the reference's subtype, insertions by the system's; rate is in percent of refs, null where there are none."""
    count = {k: F.count_if(F.col("kind") == k).alias(c) for k, c in (("cor", "cor"), ("sub", "sub"), ("del", "dele"), ("ins", "ins"))}
    found = aligned.groupBy("uri", "type", F.coalesce("ref_subtype", "sys_subtype").alias("subtype")).agg(F.count("ref_id").alias("refs"), *count.values())
    return found.withColumn("rate", F.when(F.col("refs") > 0, (F.col("sub") + F.col("dele") + F.col("ins")) * 100.0 / F.col("refs")))


def event_confusion(aligned: DataFrame) -> DataFrame:
    """(type, ref_subtype, sys_subtype, n) of the pairs."""
    return aligned.where("ref_id is not null and sys_id is not null").groupBy("type", "ref_subtype", "sys_subtype").agg(F.count(F.lit(1)).alias("n"))


def event_offsets(aligned: DataFrame) -> DataFrame:
    """(type, side, words, n): how many pairs begin (BEG) or end (END) so many scoreable words later than the reference."""
    ends = F.explode(F.array(F.struct(F.lit("BEG").alias("side"), F.col("dbeg").alias("words")), F.struct(F.lit("END").alias("side"), F.col("dend").alias("words")))).alias("x")
    return aligned.where("ref_id is not null and sys_id is not null").select("type", ends).groupBy("type", "x.side", "x.words").agg(F.count(F.lit(1)).alias("n"))


def marked_word_errors(aligned: DataFrame, unscored: DataFrame | None = None) -> DataFrame:
    """(uri, type, refs, dele, ins, sub): errors counted at words. Fillers and edits stand at all their words, sentence units and points at their last.

    A point or unit of the system without a partner is an insertion whatever else stands at its word. unscored has (uri, pos),
    the counts of words at which fillers and edits are not scored.
    """
    span = F.col("type").isin(*SPANS)

    def side(name: str):
        first, last, own = F.greatest(F.col(f"{name}_first"), F.lit(0)), F.col(f"{name}_last"), aligned.where(F.col(f"{name}_id").isNotNull())
        at = F.when(span, F.when(last >= first, F.sequence(first, last))).otherwise(F.array(F.greatest(last, F.lit(0))))
        paired = F.col("ref_id").isNotNull() & F.col("sys_id").isNotNull()
        return own.select("uri", "type", F.col(f"{name}_subtype").alias("subtype"), F.lit(name).alias("side"), (span | paired).alias("mapped"), F.explode(at).alias("pos"))

    rows = side("ref").union(side("sys"))
    if unscored is not None:
        out = unscored.select(F.col("uri").cast("string").alias("_uri"), F.col("pos").alias("_pos"))
        rows = rows.join(out, span & (F.col("uri") == F.col("_uri")) & (F.col("pos") == F.col("_pos")), "left_anti")
    of = lambda name, mapped: F.count_if((F.col("side") == name) & (F.col("mapped") == mapped))
    each = rows.groupBy("uri", "type", "pos", "subtype").agg(of("ref", True).alias("r"), of("ref", False).alias("x"), of("sys", True).alias("s"), of("sys", False).alias("i"))
    word = each.groupBy("uri", "type", "pos").agg(F.sum(F.col("r") + F.col("x")).alias("r"), F.sum("s").alias("s"), F.sum("i").alias("i"), F.sum(F.least("r", "s")).alias("c"))
    sums = {"refs": F.col("r"), "dele": F.greatest(F.col("r") - F.col("s"), F.lit(0)), "ins": F.greatest(F.col("s") - F.col("r"), F.lit(0)) + F.col("i"), "sub": F.least("r", "s") - F.col("c")}
    return word.groupBy("uri", "type").agg(*[F.sum(x).alias(c) for c, x in sums.items()])
