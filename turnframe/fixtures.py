"""Stand-in views over the driver tables: turns, scoring timelines, frames, observations, transcripts and log lines.

Times are integer microseconds, so that gaps and overlaps compare exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnframe.functions.vectors import let

SECOND = 1_000_000
FRAMES, SLOTS = 60, 3
#: Weight of the driver's vectors beside the planted cluster direction.
EPS = 1.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.col:
    """Microseconds since the epoch; the session's time zone is UTC, as the column has none."""
    return F.unix_micros(ts.cast("timestamp_ltz"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, uri, spk, s, e): each event is a turn of one of five speakers in the recording named by its type."""
    length = F.floor(F.col("value") * 100 + 0.5).cast("long") * 10_000
    start = micros(F.col("ts"))
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("uri"), (F.col("user_id") % 5).alias("spk"), start.alias("s"), (start + length).alias("e"))


def system_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second timeline of the same recordings: shifted, partly missing, with other speakers."""
    events = load(spark, sf_dir, "events").where("event_id % 11 <> 0")
    shift = (F.col("event_id") % 3 - 1) * 5 * SECOND
    length = F.floor(F.col("value") * 100 + 0.5).cast("long") * 10_000
    start = micros(F.col("ts")) + shift
    spk = F.when(F.col("event_id") % 13 == 0, (F.col("user_id") + 1) % 4).otherwise((F.col("user_id") * 7) % 4)
    return events.select(F.col("event_id").alias("id"), F.col("event_type").alias("uri"), spk.alias("spk"), start.alias("s"), (start + length).alias("e"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uri, chunk, frame, slot, act): three slots for each frame, 60 frames for each chunk, in time order of the events."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    ordered = load(spark, sf_dir, "events").select("event_type", "user_id", "value", (F.row_number().over(order) - 1).cast("long").alias("rn"))
    slots = ordered.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))))
    act = ((F.col("user_id") + F.col("slot")) % 4 == 0) | (F.col("value") > 100 * (F.col("slot") + 1))
    return slots.select(F.col("event_type").alias("uri"), F.floor(F.col("rn") / FRAMES).cast("long").alias("chunk"), (F.col("rn") % FRAMES).alias("frame"), "slot", act.cast("int").alias("act"))


def observations(spark: SparkSession, sf_dir: str, eps: float = EPS) -> DataFrame:
    """(uri, chunk, local, label, vec, duration, allow_update): vectors with a planted direction for each label, at unit length."""
    base = load(spark, sf_dir, "embeddings")
    planted = F.transform("embedding", lambda x, i: x.cast("double") * eps + F.when(i == F.col("label"), 1.0).otherwise(0.0))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    return base.withColumn("raw", planted).select(
        F.expr("vec_id div 100").alias("uri"),
        F.expr("(vec_id % 100) div 3").alias("chunk"),
        F.expr("(vec_id % 100) % 3").alias("local"),
        F.col("label").cast("long").alias("label"),
        let(norm, lambda n: F.transform("raw", lambda x: x / n)).alias("vec"),
        (0.5 + (F.col("vec_id") % 5) * 0.5).alias("duration"),
        (F.col("vec_id") % 7 != 0).alias("allow_update"),
    )


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uri, speaker_id, s, e, text): a conversation's turns, with times in milliseconds."""
    speaker = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).cast("long")
    start = (F.col("turn") * 10 + F.col("conv_id") % 3) * 1000
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("uri"), speaker.alias("speaker_id"), start.alias("s"), (start + F.least(F.lit(30_000).cast("long"), F.length("text").cast("long") * 50)).alias("e"), "text")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): log lines made of the documents, with tag, level and numbers; every seventh has a second line without a head."""
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    level = F.when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "WARNING").when(F.col("quality").isNull(), "DEBUG").otherwise("INFO")
    at = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 7), "yyyy-MM-dd HH:mm:ss")
    tag = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("["), F.col("source"), F.lit("] ")))
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("stored: "), F.col("n_chars").cast("string"))).otherwise(F.concat(F.lit("read "), F.col("n_chars").cast("string"), F.lit(" chars of text "), F.col("lang"), F.lit(" now please")))
    line = F.concat(at, F.lit(",123 ["), level, F.lit("] "), tag, body)
    more = F.when(F.col("doc_id") % 7 == 0, F.array(line, F.lit("  continued"))).otherwise(F.array(line))
    return docs.select("doc_id", F.posexplode(more).alias("part", "line"))


#: The same views for DuckDB, as common table expressions.
SQL = {
    "turns": "turns AS (SELECT event_id AS id, event_type AS uri, user_id % 5 AS spk, epoch_us(ts) AS s, epoch_us(ts) + cast(floor(value * 100 + 0.5) AS bigint) * 10000 AS e FROM events)",
    "sys": "sys AS (SELECT event_id AS id, event_type AS uri, CASE WHEN event_id % 13 = 0 THEN (user_id + 1) % 4 ELSE (user_id * 7) % 4 END AS spk, epoch_us(ts) + (event_id % 3 - 1) * 5000000 AS s, epoch_us(ts) + (event_id % 3 - 1) * 5000000 + cast(floor(value * 100 + 0.5) AS bigint) * 10000 AS e FROM events WHERE event_id % 11 <> 0)",
    "frames": "frames AS (SELECT uri, rn // 60 AS chunk, rn % 60 AS frame, slot, cast((user_id + slot) % 4 = 0 OR value > 100 * (slot + 1) AS int) AS act FROM (SELECT event_type AS uri, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM events), (SELECT unnest([0, 1, 2]) AS slot))",
    "obs": "obs AS (SELECT vec_id // 100 AS uri, (vec_id % 100) // 3 AS chunk, (vec_id % 100) % 3 AS local, cast(label AS bigint) AS label, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS vec, 0.5 + (vec_id % 5) * 0.5 AS duration, vec_id % 7 <> 0 AS allow_update FROM (SELECT *, list_transform(embedding, lambda x, i: cast(x AS double) + CASE WHEN i - 1 = label THEN 1.0 ELSE 0.0 END) AS raw FROM embeddings))",
    "transcript": "transcript AS (SELECT conv_id AS uri, cast(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS bigint) AS speaker_id, (turn * 10 + conv_id % 3) * 1000 AS s, (turn * 10 + conv_id % 3) * 1000 + least(30000, length(text) * 50) AS e, text FROM conversations)",
    "log_lines": "log_lines AS (SELECT doc_id, unnest([0, 1]) AS part, unnest([line, '  continued']) AS line FROM (SELECT doc_id, strftime(make_timestamp((1704067200 + doc_id * 7) * 1000000), '%Y-%m-%d %H:%M:%S') || ',123 [' || CASE WHEN toxic = 1 THEN 'ERROR' WHEN quality = 0 THEN 'WARNING' WHEN quality IS NULL THEN 'DEBUG' ELSE 'INFO' END || '] ' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '[' || source || '] ' END || CASE WHEN doc_id % 2 = 0 THEN 'stored: ' || n_chars ELSE 'read ' || n_chars || ' chars of text ' || lang || ' now please' END AS line FROM documents LEFT JOIN labels USING (doc_id)))",
}


def with_views(*names: str, body: str) -> str:
    """body with the views it names, and further expressions that it starts with ', name AS (...)'."""
    return f"WITH {', '.join(SQL[n] for n in names)}{body}"
