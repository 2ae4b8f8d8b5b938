"""Further queries: window summaries, present speakers, evaluated words and metadata, records as text, and small expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnframe import fixtures as fx
from turnframe.fixtures import SECOND, with_views
from turnframe.functions import text as tx
from turnframe.functions.vectors import rounded
from turnframe.operators import clusters as cl
from turnframe.operators import intervals as iv
from turnframe.operators import regions as rg
from turnframe.operators import scoring as sc
from turnframe.plans.queries import WIDTH, query
from turnframe.plans.replay import best_setting
from turnframe.sources import records as rc
from turnframe.sources import segments as sg
from turnframe.sources import tail
from turnframe.sources import rttm
from turnframe.sources.folders import shared_folder
from turnframe.streaming import control

HOURS = 3600 * SECOND


@query(with_views("frames", body=" SELECT uri, chunk, count(DISTINCT frame) AS frames, count(DISTINCT slot) AS slots, round(cast(min(act) AS double), 6) AS least, round(cast(max(act) AS double), 6) AS most, round(avg(act), 6) AS mean, count(*) FILTER (act > 0) AS active FROM frames GROUP BY uri, chunk"))
def window_summary(spark, d):
    return rg.window_summary(fx.frames(spark, d))


@query(with_views("obs", body=" SELECT uri, label AS cluster, count(*) AS n FROM obs o WHERE EXISTS (SELECT 1 FROM obs p WHERE p.uri = o.uri AND p.label = o.label AND p.chunk < 5) GROUP BY uri, label"))
def present_speakers(spark, d):
    obs = fx.observations(spark, d)
    vectors = cl.centroids(obs.withColumn("cluster", F.col("label")))
    return cl.present(vectors, obs.where("chunk < 5").select("uri", F.col("label").alias("spk"))).select("uri", "cluster", "n")


UEM = f", z AS (SELECT uri, min(s) AS z, max(e) AS y FROM turns GROUP BY uri), uem AS (SELECT uri, s, s + {4 * HOURS} AS e FROM (SELECT uri, unnest(generate_series(z, y, {6 * HOURS})) AS s FROM z))"


def _uem(spark, d):
    whole = iv.extent(fx.turns(spark, d))
    return whole.select("uri", F.explode(F.sequence("s", "e", F.lit(6 * HOURS))).alias("s")).withColumn("e", F.col("s") + 4 * HOURS)


KINDS = "CASE WHEN id % 3 = 0 THEN 'NON-LEX' ELSE 'LEXEME' END"


@query(with_views("turns", body=UEM + f", w AS (SELECT uri, id, {KINDS} AS type, s, e FROM turns) SELECT uri, id, type FROM w WHERE type <> 'LEXEME' OR EXISTS (SELECT 1 FROM uem u WHERE u.uri = w.uri AND (w.s + w.e) / 2 >= u.s AND (w.s + w.e) / 2 <= u.e)"))
def evaluated_words(spark, d):
    words = fx.turns(spark, d).select("uri", "id", F.expr(KINDS).alias("type"), "s", "e")
    return sc.evaluated_words(words, _uem(spark, d)).select("uri", "id", "type")


MARKS = "CASE WHEN id % 4 = 0 THEN 'SU' ELSE 'EDIT' END"


@query(with_views("turns", body=UEM + f", w AS (SELECT uri, id, {MARKS} AS type, id % 5 = 0 AS mapped, s, e FROM turns) SELECT uri, id, type, mapped FROM w WHERE type <> 'EDIT' OR mapped OR EXISTS (SELECT 1 FROM uem u WHERE u.uri = w.uri AND w.s >= u.s AND w.e <= u.e)"))
def evaluated_metadata(spark, d):
    marks = fx.turns(spark, d).select("uri", "id", F.expr(MARKS).alias("type"), (F.col("id") % 5 == 0).alias("mapped"), "s", "e")
    return sc.evaluated_metadata(marks, _uem(spark, d), "EDIT", WIDTH).select("uri", "id", "type", "mapped")


LADDER = ", ".join(str(float(x)) for x in tx.TICKS)


@query(f"SELECT event_id, cast(coalesce(list_filter([{LADDER}], lambda s: s / (event_id % 997 + 1) * 800 >= 90)[1], 7200.0) AS double) AS step FROM events")
def tick_step(spark, d):
    return fx.load(spark, d, "events").select("event_id", tx.tick_step(F.col("event_id") % 997 + 1, 800).alias("step"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN len(string_split(text, ' ')) ELSE length(text) END AS tokens FROM conversations")
def token_fallback(spark, d):
    counted = F.when(F.col("turn") % 2 == 0, F.size(F.split("text", " ")))
    return fx.load(spark, d, "conversations").select("conv_id", "turn", tx.count_or_length(counted, F.col("text")).alias("tokens"))


@query("SELECT kind, cast((SELECT count(*) FROM pages WHERE ends_with(url, e)) AS bigint) AS n FROM (VALUES ('nine', '9'), ('zeros', '00'), ('none', '.refined.rttm')) AS k(kind, e)")
def artifact_counts(spark, d):
    return rc.artifact_counts(fx.load(spark, d, "pages").select(F.col("url").alias("path")), {"nine": "9", "zeros": "00", "none": ".refined.rttm"})


RATE = "CASE WHEN event_id % 17 = 0 THEN 8000 WHEN event_id % 19 = 0 THEN NULL ELSE 16000 END"


@query(f"SELECT event_id, 'segment sample rate mismatch: ' || event_id || '.wav is ' || coalesce(cast(r AS varchar), 'unknown') || ', expected 16000' AS error FROM (SELECT event_id, {RATE} AS r FROM events) WHERE r IS DISTINCT FROM 16000")
def sample_rate_errors(spark, d):
    segments = fx.load(spark, d, "events").select("event_id", F.concat(F.col("event_id").cast("string"), F.lit(".wav")).alias("path"), F.expr(RATE).alias("sample_rate"))
    return rc.at_rate(segments, 16_000)[1].select("event_id", "error")


@query("SELECT event_type AS stage, CASE arg_max(event_id % 2, (ts, event_id % 2)) WHEN 1 THEN 'done' ELSE 'ready' END AS state FROM events GROUP BY event_type")
def sentinel_states(spark, d):
    marks = fx.load(spark, d, "events").select(F.col("event_type").alias("stage"), F.expr("CASE WHEN event_id % 2 = 1 THEN 'done' ELSE 'ready' END").alias("state"), F.col("ts").alias("at"))
    return control.states(marks)


SPEAKER = "'SPEAKER ' || uri || ' 1 ' || printf('%.3f', (s % 86400000000 // 1000) / 1000.0) || ' ' || printf('%.3f', ((e - s) // 1000) / 1000.0) || ' <NA> <NA> speaker' || spk || ' <NA> <NA>'"


def _records(spark, d):
    """Lines of records, every seventh a comment and every eleventh of another type."""
    milli = lambda c: F.floor(c / 1000).cast("long") / 1000.0
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> speaker%d <NA> <NA>", "uri", milli(F.col("s") % 86_400_000_000), milli(F.col("e") - F.col("s")), F.col("spk").cast("long"))
    shown = F.when(F.col("id") % 7 == 0, F.lit(";; nothing")).when(F.col("id") % 11 == 0, F.regexp_replace(line, "^SPEAKER", "NOSCORE")).otherwise(line)
    return fx.turns(spark, d).select(shown.alias("line"))


NUMBERS = "(s % 86400000000 // 1000) / 1000.0 AS tbeg, ((e - s) // 1000) / 1000.0 AS tdur"


@query(with_views("turns", body=f" SELECT uri, 'speaker' || spk AS spkr, {NUMBERS} FROM turns WHERE id % 7 <> 0 AND id % 11 <> 0"))
def refined_records(spark, d):
    return rttm.parse_refined(_records(spark, d)).select("uri", "spkr", "tbeg", "tdur")


@query(with_views("turns", body=f" SELECT CASE WHEN id % 11 = 0 THEN 'NOSCORE' ELSE 'SPEAKER' END AS type, uri, {NUMBERS} FROM turns WHERE id % 7 <> 0"))
def strict_records(spark, d):
    return rttm.parse_strict(_records(spark, d)).select("type", "uri", "tbeg", "tdur")


@query(with_views("turns", body=UEM + f" SELECT uri, '1' AS chnl, (s % {10**12} + row_number() OVER (PARTITION BY uri ORDER BY s) * {10**12}) // {SECOND} * cast(1 AS double) AS tbeg, (s % {10**12} + row_number() OVER (PARTITION BY uri ORDER BY s) * {10**12}) // {SECOND} + cast(9.5 AS double) AS tend FROM uem"))
def evaluated_parts(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("uri").orderBy("s"))
    at = F.floor((F.col("s") % 10**12 + n * F.lit(10**12)) / SECOND).cast("long")
    lines = _uem(spark, d).select(F.format_string("/data/%s.sph 1 %d.0 %d.5", "uri", at, at + 9).alias("line"))
    return rttm.parse_uem(lines).select("uri", "chnl", "tbeg", "tend")


@query("SELECT lower('Word' || part.p_partkey) AS word, p_name AS \"to\" FROM part WHERE p_partkey % 3 <> 0")
def word_map(spark, d):
    part = fx.load(spark, d, "part")
    lines = part.select(F.when(F.col("p_partkey") % 3 == 0, F.lit("; comment")).otherwise(F.concat(F.lit("Word"), F.col("p_partkey").cast("string"), F.lit("  =>  "), "p_name")).alias("line"))
    return rttm.parse_glm(lines)


@query("SELECT 'k' || event_id AS key, 'a=' || event_type AS value FROM events WHERE event_id % 4 <> 0")
def key_values(spark, d):
    events = fx.load(spark, d, "events")
    return rc.key_values(events.select(F.when(F.col("event_id") % 4 == 0, F.lit("no sign")).otherwise(F.concat(F.lit("k"), F.col("event_id").cast("string"), F.lit("=a="), "event_type")).alias("line")))


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, length(text) - 39) END AS tail, CASE WHEN starts_with(text, substr(text, 1, 5)) AND length(text) > 0 THEN ltrim(substr(text, 6)) ELSE text END AS rest FROM conversations")
def text_ends(spark, d):
    return fx.load(spark, d, "conversations").select("conv_id", "turn", tx.tail(F.col("text"), 40).alias("tail"), tx.without_prefix(F.col("text"), F.left("text", F.lit(5))).alias("rest"))


@query("SELECT event_id, array_to_string(list_transform(generate_series(0, event_id % 5), lambda i: printf('%.4f', (i + 0.5) * 0.25)), ' ') AS centres FROM events")
def frame_centres(spark, d):
    found = tx.frame_centres((F.col("event_id") % 5 + 1).cast("int"), 0.25)
    return fx.load(spark, d, "events").select("event_id", F.array_join(F.transform(found, lambda x: F.format_string("%.4f", x)), " ").alias("centres"))


@query("SELECT vec_id, cast(len(embedding) + 7 AS int) AS n, round(list_sum(list_transform(embedding, lambda x: cast(x AS double))), 5) AS total, round(cast(embedding[3] AS double) + embedding[4] + embedding[8], 5) AS picked FROM embeddings")
def padded_samples(spark, d):
    vec = fx.load(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    slices = F.array(F.struct(F.lit(2).alias("a"), F.lit(4).alias("b")), F.struct(F.lit(7).alias("a"), F.lit(8).alias("b")))
    size = vec.select(F.size("x")).first()[0] + 7 if vec.head(1) else 7
    total = lambda a: rounded(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    wide = vec.select("vec_id", "x", tx.padded(F.col("x"), size).alias("wide"))
    return wide.select("vec_id", F.size("wide").alias("n"), total("wide").alias("total"), total(tx.joined_slices(F.col("x"), slices)).alias("picked"))


@query(with_views("obs", body=" SELECT uri, local AS local_idx, cast(chunk * 5 AS double) AS start, cast(chunk * 5 + 10 AS double) AS \"end\", cast(duration AS double) AS duration, cast(len(vec) AS int) AS dims FROM obs"))
def embedding_dump(spark, d):
    folder = shared_folder(spark, "embeddings")
    rc.write_embeddings(fx.observations(spark, d).withColumns({"s": F.col("chunk") * 5, "e": F.col("chunk") * 5 + 10}), folder)
    return rc.read_embeddings(spark, folder).select(F.col("uri").cast("long").alias("uri"), "local_idx", "start", "end", "duration", F.size("embedding").alias("dims"))


@query("SELECT o_orderpriority AS match_threshold, o_orderstatus AS new_threshold, count(*) AS errors, count(DISTINCT o_custkey) AS clusters FROM orders GROUP BY ALL ORDER BY errors, clusters, match_threshold, new_threshold LIMIT 1")
def least_errors(spark, d):
    settings = fx.load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("match_threshold"), F.col("o_orderstatus").alias("new_threshold"))
    return best_setting(settings.agg(F.count(F.lit(1)).alias("errors"), F.count_distinct("o_custkey").alias("clusters")))


@query("SELECT conv_id, turn, text FROM conversations")
def tailed_lines(spark, d):
    """Lines appended in two steps and followed by a query that is stopped and started again in between."""
    rows = fx.load(spark, d, "conversations")
    source, out, state = (shared_folder(spark, x) for x in ("lines", "tailed", "state"))
    kind = "conv_id bigint, turn bigint, text string"
    for part in (0, 1):
        rows.where(F.col("turn") % 2 == part).select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value")).write.mode("append").text(source)
        lines = tail.tail_lines(spark, source, "part-*", part=4096).select(F.from_json("line", kind).alias("r")).select("r.*")
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kind).parquet(out)


@query('SELECT cast(conv_id AS varchar) AS uri, turn AS speaker_id, cast(turn * 10 AS double) AS start, round(turn * 10 + length(text) / 1000.0, 3) AS "end", cast(44 + 2 * length(text) AS bigint) AS bytes FROM conversations WHERE length(text) > 0')
def segment_files(spark, d):
    """Segments written in two phases; every row of the manifest with the length of its file."""
    n = F.length("text")
    made = fx.load(spark, d, "conversations").where(n > 0).select(F.col("conv_id").cast("string").alias("uri"), F.col("turn").alias("speaker_id"), (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + n / 1000).alias("end"), F.lit(8000).alias("rate"), F.transform(F.sequence(F.lit(1), n), lambda i: (i * 7 % 200 - 100) / 100).alias("pcm"))
    root = shared_folder(spark, "segments")
    sg.write_segments(made, root)
    return sg.with_bytes(sg.read_segments(spark, root)).select("uri", "speaker_id", "start", "end", "bytes")
