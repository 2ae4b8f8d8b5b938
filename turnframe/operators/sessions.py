"""Transcripts, the session catalogue, logs and other record work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnframe.functions.text import HEAD, event_key, tag, untagged
from turnframe.operators.intervals import overlap_join


def sorted_transcript(rows: DataFrame) -> DataFrame:
    """(uri, seq, speaker_id, s, e, text): without empty texts, numbered by (s, e) in each recording."""
    order = Window.partitionBy("uri").orderBy("s", "e", "speaker_id", "text")
    return rows.where("text is not null and trim(text) <> ''").select("uri", F.row_number().over(order).alias("seq"), "speaker_id", "s", "e", "text")


def session_catalog(transcripts: DataFrame, audio: DataFrame, sidecars: DataFrame, overrides: DataFrame) -> DataFrame:
    """(uri, transcript, audio, speakers): transcripts (uri, path) left-joined twice; an override (uri, path) goes before the audio found, of which the first path counts."""
    first = lambda df, name: df.groupBy("uri").agg(F.min("path").alias(name))
    found = transcripts.select("uri", F.col("path").alias("transcript")).join(first(audio, "found"), "uri", "left").join(first(overrides, "given"), "uri", "left").join(first(sidecars, "speakers"), "uri", "left")
    return found.select("uri", "transcript", F.coalesce("given", "found").alias("audio"), "speakers")


def parsed_log(lines: DataFrame, order: list[str]) -> DataFrame:
    """lines with ts, level, tag, message and continuation: a line without a head continues the one before it."""
    part = lambda i: F.nullif(F.regexp_extract("line", HEAD, i), F.lit(""))
    found = lines.withColumns({"ts": F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss"), "level": part(3), "_rest": F.regexp_extract("line", HEAD, 4)})
    return found.withColumns({"continuation": F.col("level").isNull(), "tag": F.when(F.col("level").isNotNull(), tag(F.col("_rest"))), "message": F.when(F.col("level").isNotNull(), untagged(F.col("_rest")))}).drop("_rest")


def log_events(parsed: DataFrame) -> DataFrame:
    """(tag, event, level, n)."""
    return parsed.where("not continuation").groupBy("tag", event_key(F.col("message")).alias("event"), "level").agg(F.count(F.lit(1)).alias("n"))


def log_span(parsed: DataFrame) -> DataFrame:
    """One row (lines, continuations, issues, first, last)."""
    issue = F.col("level").isin("WARNING", "ERROR", "CRITICAL")
    return parsed.agg(F.count(F.lit(1)).alias("lines"), F.count_if("continuation").alias("continuations"), F.count_if(issue).alias("issues"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def log_top(events: DataFrame, most: int = 5) -> DataFrame:
    """(tag, event, n, rank, more): the most frequent events of each tag, and how many further ones it has."""
    sums = events.groupBy("tag", "event").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("tag")
    ranked = sums.withColumns({"rank": F.row_number().over(own.orderBy(F.col("n").desc(), "event")), "kinds": F.count(F.lit(1)).over(own)})
    return ranked.where(F.col("rank") <= most).select("tag", "event", "n", "rank", F.greatest(F.col("kinds") - most, F.lit(0)).alias("more"))


def parameter_grid(rows: DataFrame, **values: list[float]) -> DataFrame:
    """rows, each once for every combination of the given values."""
    for name, some in values.items():
        rows = rows.select("*", F.explode(F.array(*map(F.lit, some))).alias(name))
    return rows


def rms(samples: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, rms): root mean square of x, with a floor of 1e-12 below the root; without samples 0."""
    return samples.groupBy(*keys).agg(F.when(F.count("x") > 0, F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-12)).otherwise(0.0).alias("rms"))


def energy_gate(track: DataFrame, mix: DataFrame, keys: tuple[str, ...], ratio: float) -> DataFrame:
    """(keys, share, passed): a track's RMS against the mixture's; a silent or missing mixture never passes."""
    a, b = rms(track, keys).withColumnRenamed("rms", "own"), rms(mix, keys).withColumnRenamed("rms", "whole")
    share = F.when(F.col("whole") > 0, F.col("own") / F.col("whole"))
    return a.join(b, list(keys), "left").select(*keys, share.alias("share"), F.coalesce(share >= ratio, F.lit(False)).alias("passed"))


def peaks(samples: DataFrame, buckets: int) -> DataFrame:
    """(uri, bucket, low, high): samples (uri, i, n, x) of a recording of n in so many buckets; zero is always inside the bounds."""
    per = F.greatest(F.ceil(F.col("n") / buckets), F.lit(1).cast("long"))
    return samples.groupBy("uri", F.floor(F.col("i") / per).alias("bucket")).agg(F.least(F.min("x"), F.lit(0.0)).alias("low"), F.greatest(F.max("x"), F.lit(0.0)).alias("high"))


def current_row(transcript: DataFrame, times: DataFrame, width: int = 60_000) -> DataFrame:
    """(uri, t, seq): the first row of the sorted transcript that is open at each time asked for. Both meet in buckets of time."""
    asked = times.select("uri", F.col("t").alias("s"), (F.col("t") + 1).alias("e"))
    met = overlap_join(transcript.select("uri", "seq", "s", "e"), asked, ["uri"], width, pad=1).where("a_s <= b_s and b_s <= a_e")
    return met.groupBy("uri", F.col("b_s").alias("t")).agg(F.min("a_seq").alias("seq"))


def in_view(rows: DataFrame, views: DataFrame, speakers: list[int], width: int = 60_000) -> DataFrame:
    """rows of the given speakers that reach into the view (uri, a, b) of their recording. Both meet in buckets of time."""
    met = overlap_join(rows.where(F.col("speaker_id").isin(speakers)), views.select("uri", F.col("a").alias("s"), F.col("b").alias("e")), ["uri"], width)
    return met.select(*["uri" if c == "uri" else F.col(f"a_{c}").alias(c) for c in rows.columns])


def lanes(rows: DataFrame, most: int = 3) -> DataFrame:
    """(uri, speaker_id, lane): speakers in order of their first appearance, dealt over so many lanes."""
    first = rows.groupBy("uri", "speaker_id").agg(F.min(F.struct("s", "e")).alias("first"))
    order = Window.partitionBy("uri").orderBy("first", "speaker_id")
    return first.select("uri", "speaker_id", ((F.dense_rank().over(order) - 1) % most).alias("lane"))


def unchanged_prefix(old: DataFrame, new: DataFrame) -> DataFrame:
    """(uri, unchanged): whether each row (uri, seq, text) of old is in new at its place."""
    joined = old.join(new.select("uri", "seq", F.col("text").alias("now")), ["uri", "seq"], "left")
    return joined.groupBy("uri").agg(F.bool_and(F.coalesce(F.col("text") == F.col("now"), F.lit(False))).alias("unchanged"))


def standard_words(words: DataFrame, glm: DataFrame) -> DataFrame:
    """(uri, id, k, word, s, e): words (uri, id, word, s, e) in lower case, mapped by glm (word, to), split at spaces and hyphens, their time shared out evenly."""
    low = words.withColumn("w", F.lower("word"))
    rules = glm.select(F.lower("word").alias("w"), F.col("to"))
    mapped = low.join(rules, "w", "left").withColumn("parts", F.filter(F.split(F.coalesce("to", "w"), r"[ -]+"), lambda x: x != ""))
    n, each = F.size("parts"), F.expr("(e - s) div greatest(size(parts), 1)")
    cut = mapped.withColumns({"n": n, "each": each}).select("uri", "id", "s", "each", F.posexplode("parts").alias("k", "part"))
    return cut.select("uri", "id", "k", F.col("part").alias("word"), (F.col("s") + F.col("k") * F.col("each")).alias("s"), (F.col("s") + (F.col("k") + 1) * F.col("each")).alias("e"))
