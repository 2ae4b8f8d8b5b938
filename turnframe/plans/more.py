"""Further queries: sessions, speech time, labels, sample indices, pairs of words within a gap, discarded subtypes, roll-ups and word alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnframe import fixtures as fx
from turnframe.fixtures import SECOND, with_views
from turnframe.functions import text as tx
from turnframe.operators import alignment as al
from turnframe.operators import clusters as cl
from turnframe.operators import intervals as iv
from turnframe.operators import metadata as md
from turnframe.operators import scoring as sc
from turnframe.operators import sessions as ss
from turnframe.plans.queries import BOTH, COUNTS, GAP, MERGE, STATUS, WIDTH, _recursive, _ref, _status, _sys, query
from turnframe.plans.replay import zipped
from turnframe.streaming.turns import merged_turns

NEAR = 60 * SECOND


@query(with_views("turns", body=MERGE.format(name="turns", gap=GAP) + "SELECT uri, spk, s, e, n FROM turns_m"))
def session_turns(spark, d):
    rows = fx.turns(spark, d).select("uri", "spk", F.timestamp_micros("s").alias("ts"), F.expr("(e - s) div 1000").alias("length_ms"))
    return merged_turns(rows, GAP // 1000).select("uri", "spk", F.unix_micros("s").alias("s"), F.unix_micros("e").alias("e"), "n")


SEGMENTS = COUNTS.split(",\no AS (")[0]


@query(with_views("turns", "sys", body=BOTH + SEGMENTS + " SELECT uri, cast(sum(CASE WHEN nref > 0 THEN d ELSE 0 END) AS bigint) AS speech, cast(sum(CASE WHEN nref > 0 AND nsys = 0 THEN d ELSE 0 END) AS bigint) AS missed, cast(sum(CASE WHEN nref = 0 AND nsys > 0 THEN d ELSE 0 END) AS bigint) AS false_alarm FROM seg GROUP BY uri"))
def speech_time_stats(spark, d):
    ref = _ref(spark, d)
    return sc.speech_time(ref, _sys(spark, d), iv.extent(ref), WIDTH)


@query(_recursive(with_views("obs", body=STATUS + " SELECT uri, id, cast(id AS varchar) || CASE WHEN merged_into IS NULL THEN '' ELSE '→' || cast(merged_into AS varchar) END || CASE WHEN merged_into IS NULL AND coalesce(duration < 15, false) THEN '?' ELSE '' END AS label, id % 12 AS colour FROM st")))
def speaker_labels(spark, d):
    status = cl.speaker_status(*_status(spark, d), 15.0)
    return status.select("uri", "id", tx.speaker_label(F.col("id"), F.col("merged_into"), F.coalesce("uncertain", F.lit(False))).alias("label"), tx.colour(F.col("id")).alias("colour"))


@query(with_views("turns", body=", x AS (SELECT id, least(greatest(cast(round_even((s % 1000000000) / 1e6 * 16000, 0) AS bigint), 0), 12000000) AS a, least(greatest(cast(round_even((s % 1000000000 + e - s) / 1e6 * 16000, 0) AS bigint), 0), 12000000) AS b FROM turns) SELECT id, a, b FROM x WHERE b > a"))
def sample_slices(spark, d):
    start = F.col("s") % 1_000_000_000
    cut = tx.sample_slice(start / 1e6, (start + F.col("e") - F.col("s")) / 1e6, 16_000, F.lit(12_000_000).cast("long"))
    return fx.turns(spark, d).select("id", cut.alias("x")).where("x is not null").select("id", "x.a", "x.b")


@query("SELECT event_id, ([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [1, 0, 1], [0, 1, 1]])[event_id % 7 + 1] AS slots FROM events")
def powerset_decode(spark, d):
    return fx.load(spark, d, "events").select("event_id", tx.powerset_slots((F.col("event_id") % 7).cast("int"), 3, 2).alias("slots"))


@query(with_views("turns", "sys", body=f"SELECT t.uri, t.id AS ref, y.id AS sys FROM turns t JOIN sys y ON t.uri = y.uri AND t.s < y.e + {NEAR} AND y.s < t.e + {NEAR}"))
def near_pairs(spark, d):
    met = iv.overlap_join(fx.turns(spark, d), fx.system_turns(spark, d), ["uri"], WIDTH, pad=NEAR)
    return met.select("uri", F.col("a_id").alias("ref"), F.col("b_id").alias("sys"))


@query(with_views("sys", body="SELECT uri, id, cast(sum(-(1 + id % 2)) OVER (PARTITION BY uri ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS total FROM sys"))
def running_insertions(spark, d):
    return sc.running_total(fx.system_turns(spark, d), -(1 + F.col("id") % 2), ["uri"], ["s", "id"])


@query(with_views("turns", body=", g AS (SELECT uri, spk, CASE WHEN spk IN (0, 3) THEN 'm' WHEN spk = 1 THEN 'f' ELSE 'unknown' END AS gender, e - s AS d FROM turns) SELECT uri, gender, spk, count(*) AS n, cast(sum(d) AS bigint) AS duration FROM g GROUP BY GROUPING SETS ((), (uri), (gender), (uri, gender), (uri, spk))"))
def gender_rollup(spark, d):
    types = spark.createDataFrame([(0, "m"), (1, "f"), (3, "m")], "spk long, gender string")
    turns = fx.turns(spark, d).join(types, "spk", "left").fillna("unknown", ["gender"])
    return sc.grouped_sets(turns.withColumn("d", F.col("e") - F.col("s")), [[], ["uri"], ["gender"], ["uri", "gender"], ["uri", "spk"]], F.count(F.lit(1)).alias("n"), F.sum("d").alias("duration"))


VIEW = "(SELECT uri, min(s) + 40000 AS a, min(s) + 65000 AS b FROM transcript GROUP BY uri)"


@query(with_views("transcript", body=f"SELECT t.uri, speaker_id, s, e FROM transcript t JOIN {VIEW} v ON t.uri = v.uri AND e > a AND s < b WHERE speaker_id IN (0, 1)"))
def viewport(spark, d):
    rows = fx.transcript(spark, d)
    views = rows.groupBy("uri").agg((F.min("s") + 40_000).alias("a"), (F.min("s") + 65_000).alias("b"))
    return ss.in_view(rows, views, [0, 1]).select("uri", "speaker_id", "s", "e")


@query(with_views("transcript", body=", q AS (SELECT uri, cast(row_number() OVER (PARTITION BY uri ORDER BY s, e, speaker_id, text) AS int) AS seq, text FROM transcript WHERE text IS NOT NULL AND trim(text) <> '') SELECT uri, bool_and(NOT (uri % 4 = 0 AND seq = 2)) AS unchanged FROM q GROUP BY uri"))
def unchanged_prefix(spark, d):
    old = ss.sorted_transcript(fx.transcript(spark, d)).select("uri", "seq", "text")
    new = old.withColumn("text", F.when((F.col("uri") % 4 == 0) & (F.col("seq") == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return ss.unchanged_prefix(old, new)


SPOKEN = ", wd AS (SELECT cast(conv_id AS varchar) || '-' || cast(turn AS varchar) AS uri, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations WHERE text IS NOT NULL), ex AS (SELECT uri, unnest(generate_series(1, len(ws))) AS i FROM wd), k AS (SELECT uri, count(*) FILTER (i % 11 <> 3) AS words, count(*) FILTER (i % 11 <> 3 AND i % 7 <> 0 AND i % 5 <> 0) AS cor, count(*) FILTER (i % 11 <> 3 AND i % 7 <> 0 AND i % 5 = 0) AS sub, count(*) FILTER (i % 11 <> 3 AND i % 7 = 0) AS dele, count(*) FILTER (i % 11 = 3 AND i % 7 <> 0) AS ins FROM ex GROUP BY uri)"


@query("WITH dummy AS (SELECT 1)" + SPOKEN + " SELECT *, round(100.0 * (sub + dele + ins) / words, 6) AS wer FROM k")
def word_alignment(spark, d):
    uri = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    words = fx.load(spark, d, "conversations").where("text is not null").select(uri.alias("uri"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("i", "word"))
    words = words.select("uri", (F.col("i") + 1).alias("idx"), "word", (F.col("i") * 900).alias("s"), (F.col("i") * 900 + 700).alias("e"))
    heard = words.where("idx % 7 <> 0").withColumn("word", F.when(F.col("idx") % 5 == 0, F.concat("word", F.lit("x"))).otherwise(F.col("word")))
    return al.word_errors(al.aligned_words(words.where("idx % 11 <> 3"), heard, gap=100)).withColumn("wer", F.round("wer", 6))


# --- asof_time_map, word_index_range, discarded_subtype and stitch_overlap over all their rows --------------------------

ALL_ANCHORS = ", anc AS (SELECT uri, t, t + (t // 7919) % 1000000 AS to_ FROM (SELECT uri, s AS t, min(id) AS id FROM turns GROUP BY uri, s) WHERE id % 17 = 0), pts AS (SELECT uri, id, s AS t FROM turns)"


@query(
    with_views(
        "turns",
        body=ALL_ANCHORS
        + ", b AS (SELECT p.*, a.t AS t0, a.to_ AS x0 FROM pts p ASOF LEFT JOIN anc a ON p.uri = a.uri AND p.t >= a.t), n AS (SELECT b.*, a.t AS t1, a.to_ AS x1 FROM b ASOF LEFT JOIN anc a ON b.uri = a.uri AND b.t <= a.t) SELECT uri, id, t, round(cast(CASE WHEN t0 = t1 THEN x0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN x0 + cast(t - t0 AS double) * (x1 - x0) / (t1 - t0) WHEN t0 IS NOT NULL THEN t + x0 - t0 WHEN t1 IS NOT NULL THEN t + x1 - t1 ELSE t END AS double), 0) AS mapped FROM n",
    )
)
def asof_time_map_all(spark, d):
    turns = fx.turns(spark, d)
    anchors = turns.groupBy("uri", F.col("s").alias("t")).agg(F.min("id").alias("id")).where("id % 17 = 0").select("uri", "t", F.expr("t + (t div 7919) % 1000000").alias("to"))
    return iv.interpolated(turns.select("uri", "id", F.col("s").alias("t")), anchors).withColumn("mapped", F.round("mapped", 0))


ALL_WORDS = ", wd AS (SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY s, id) AS idx, s, e FROM turns), ev AS (SELECT uri, id, s - 300000000 AS s, e + 300000000 AS e FROM turns)"


@query(with_views("turns", body=ALL_WORDS + " SELECT v.uri, v.id, min(w.idx) AS first, max(w.idx) AS last FROM ev v LEFT JOIN wd w ON w.uri = v.uri AND (w.s + w.e) // 2 BETWEEN v.s AND v.e GROUP BY v.uri, v.id"))
def word_index_range_all(spark, d):
    turns = fx.turns(spark, d)
    words = turns.select("uri", F.row_number().over(Window.partitionBy("uri").orderBy("s", "id")).cast("long").alias("idx"), "s", "e")
    events = turns.select("uri", "id", (F.col("s") - 300 * SECOND).alias("s"), (F.col("e") + 300 * SECOND).alias("e"))
    return iv.index_range(events, words, WIDTH)


ALL_SUBTYPES = ", r AS (SELECT uri, id, s, e, CASE WHEN id % 4 = 0 THEN 'other' ELSE 'statement' END AS subt FROM turns), y AS (SELECT uri, id, s, e, CASE WHEN id % 2 = 0 THEN id END AS mapped FROM sys)"


@query(with_views("turns", "sys", body=ALL_SUBTYPES + " SELECT y.uri, y.id FROM y LEFT JOIN r m ON y.mapped = m.id AND y.uri = m.uri WHERE NOT coalesce(m.subt = 'other', false) AND NOT (y.mapped IS NULL AND EXISTS (SELECT 1 FROM r WHERE r.uri = y.uri AND r.subt = 'other' AND (y.s + y.e) / 2 BETWEEN r.s AND r.e))"))
def discarded_subtype_all(spark, d):
    ref = fx.turns(spark, d).select("uri", "id", "s", "e", F.when(F.col("id") % 4 == 0, "other").otherwise("statement").alias("subt"))
    sys = fx.system_turns(spark, d).select("uri", "id", "s", "e", F.expr("CASE WHEN id % 2 = 0 THEN id END").alias("mapped"))
    return sc.without_subtype(ref, sys, "other", WIDTH)[1].select("uri", "id")


@query(
    "WITH c AS (SELECT conv_id, turn, left(text, length(text) // 2 + 15) AS acc, substr(text, greatest(length(text) // 2 - 15, 0) + 1) AS new FROM conversations WHERE text IS NOT NULL), k AS (SELECT *, coalesce(list_max(list_filter(generate_series(0, least(50, length(acc), length(new))), lambda k: suffix(acc, left(new, k)))), 0) AS k FROM c) SELECT conv_id, turn, acc || substr(new, cast(k AS int) + 1) AS text FROM k"
)
def stitch_overlap_all(spark, d):
    half = F.expr("length(text) div 2").cast("int")
    cut = F.left("text", half + 15), F.substring("text", F.greatest(half - 15, F.lit(0)) + 1, F.length("text"))
    rows = fx.load(spark, d, "conversations").where("text is not null").select("conv_id", "turn", cut[0].alias("acc"), cut[1].alias("new"))
    return rows.select("conv_id", "turn", F.concat("acc", tx.stitch(F.col("acc"), F.col("new"))).alias("text"))


@query("SELECT uri, cast(m.x AS double) AS match_threshold, cast(n.x AS double) AS new_threshold FROM (SELECT DISTINCT event_type AS uri FROM events) e, (SELECT unnest([0.45, 0.5, 0.55, 0.6, 0.65]) AS x) m, (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5]) AS x) n")
def recording_grid(spark, d):
    """Every recording under every setting of a sweep."""
    uris = fx.load(spark, d, "events").select(F.col("event_type").alias("uri")).distinct()
    return ss.parameter_grid(uris, match_threshold=[0.45, 0.5, 0.55, 0.6, 0.65], new_threshold=[0.3, 0.35, 0.4, 0.45, 0.5])


@query()
def word_alignment_islands(spark, d):
    """Words with pauses shorter than the gap, so that a whole text is one island, heard late, with some lost, altered and doubled."""
    uri = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    words = fx.load(spark, d, "conversations").where("text is not null").select(uri.alias("uri"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("i", "word"))
    words = words.select("uri", (F.col("i") * 2).alias("idx"), "word", (F.col("i") * 900).alias("s"), (F.col("i") * 900 + 700).alias("e"))
    late = words.where("idx % 14 <> 0").withColumns({"s": F.col("s") + F.col("idx") % 5 * 60, "e": F.col("e") + F.col("idx") % 3 * 90, "word": F.when(F.col("idx") % 10 == 0, F.concat("word", F.lit("x"))).otherwise(F.col("word"))})
    heard = late.union(late.where("idx % 22 = 2").withColumn("idx", F.col("idx") + 1))
    return al.word_errors(al.aligned_words(words, heard, gap=500)).withColumn("wer", F.round("wer", 6))


TYPED = BOTH + ", ty AS (SELECT * FROM (VALUES (0, 'm'), (1, 'f'), (3, 'm')) v(spk, type)), tr AS (SELECT m.uri, m.spk, coalesce(ty.type, 'unknown') AS type, s, e FROM turns_m m LEFT JOIN ty USING (spk)), tz AS (SELECT m.uri, m.spk, coalesce(ty.type, 'unknown') AS type, s, e FROM sys_m m LEFT JOIN ty USING (spk))"
STRETCHES = """, tb AS (SELECT uri, s AS t FROM tr UNION SELECT uri, e FROM tr UNION SELECT uri, s FROM tz UNION SELECT uri, e FROM tz),
tg AS (SELECT uri, t AS a, lead(t) OVER (PARTITION BY uri ORDER BY t) AS b FROM tb),
cr AS (SELECT g.uri, a, b - a AS d, x.type, count(*) AS n FROM tg g JOIN tr x ON x.uri = g.uri AND x.s <= a AND x.e >= b GROUP BY ALL),
cz AS (SELECT g.uri, a, b - a AS d, x.type, count(*) AS n FROM tg g JOIN tz x ON x.uri = g.uri AND x.s <= a AND x.e >= b GROUP BY ALL),
wr AS (SELECT uri, a, sum(n) AS n FROM cr GROUP BY ALL), wz AS (SELECT uri, a, sum(n) AS n FROM cz GROUP BY ALL)
SELECT uri, ref_type, sys_type, cast(sum(x) AS bigint) AS time FROM (
  SELECT cr.uri, cr.type AS ref_type, cz.type AS sys_type, least(cr.n, cz.n) * cr.d AS x FROM cr JOIN cz ON cr.uri = cz.uri AND cr.a = cz.a
  UNION ALL SELECT cr.uri, cr.type, 'MISS', greatest(cr.n - coalesce(wz.n, 0), 0) * cr.d FROM cr LEFT JOIN wz ON cr.uri = wz.uri AND cr.a = wz.a
  UNION ALL SELECT cz.uri, 'FALSE ALARM', cz.type, greatest(cz.n - coalesce(wr.n, 0), 0) * cz.d FROM cz LEFT JOIN wr ON cz.uri = wr.uri AND cz.a = wr.a)
GROUP BY ALL HAVING sum(x) > 0"""


def _typed(spark, turns):
    types = spark.createDataFrame([(0, "m"), (1, "f"), (3, "m")], "spk long, type string")
    return turns.join(types, "spk", "left").fillna("unknown", ["type"])


@query(with_views("turns", "sys", body=TYPED + STRETCHES))
def type_time(spark, d):
    ref, sys = (_typed(spark, x).select("uri", "type", "s", "e") for x in (_ref(spark, d), _sys(spark, d)))
    return sc.type_time(ref, sys, ["m", "f", "unknown"])


@query("SELECT conv_id, turn, text, octet_length(encode(text)) AS bytes FROM conversations WHERE text IS NOT NULL")
def zipped_rows(spark, d):
    """Two tables in one order, without a key, side by side."""
    rows = fx.load(spark, d, "conversations").where("text is not null").orderBy("conv_id", "turn")
    return zipped(rows.select("conv_id", "turn"), rows.select("text", F.octet_length("text").cast("long").alias("bytes")))


EVENTS = """WITH x AS (SELECT conv_id || '-' || turn AS uri, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM conversations WHERE text IS NOT NULL),
w AS (SELECT uri, unnest(ws) AS word, cast(unnest(range(len(ws))) AS bigint) AS i FROM x),
words AS (SELECT uri, i AS idx, i * 900 + 350 AS mid, i % 5 <> 0 AS scoreable FROM w),
ev AS (SELECT uri, i * 4 AS id, 'SU' AS type, CASE WHEN length(word) % 2 = 0 THEN 'statement' ELSE 'question' END AS subtype, i * 900 AS s, i * 900 + 6200 AS e FROM w WHERE i % 7 = 0
UNION ALL SELECT uri, i * 4 + 1, 'FILLER', CASE WHEN length(word) = 1 THEN 'filled' ELSE 'marker' END, i * 900, i * 900 + 700 FROM w WHERE length(word) <= 2
UNION ALL SELECT uri, i * 4 + 2, 'EDIT', CASE WHEN length(word) % 2 = 0 THEN 'repeat' ELSE 'revise' END, i * 900, i * 900 + 1600 FROM w WHERE i % 9 = 4
UNION ALL SELECT uri, i * 4 + 3, 'IP', CASE WHEN length(word) % 2 = 0 THEN 'repeat' ELSE 'revise' END, i * 900 + 1700, i * 900 + 1700 FROM w WHERE i % 9 = 4),
met AS (SELECT ev.*, idx, mid, scoreable FROM ev LEFT JOIN words ON ev.uri = words.uri AND mid <= e)
"""


def _words_and_events(spark, d):
    """Words of the turns of conversations, and events over them told from their places and lengths."""
    uri = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    w = fx.load(spark, d, "conversations").where("text is not null").select(uri.alias("uri"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("i", "word"))
    w = w.select("uri", F.col("i").cast("long").alias("i"), "word")
    words = w.select("uri", F.col("i").alias("idx"), (F.col("i") * 900).alias("s"), (F.col("i") * 900 + 700).alias("e"), (F.col("i") % 5 != 0).alias("scoreable"))
    even, at = F.length("word") % 2 == 0, F.col("i") * 900

    def event(k, kind, subtype, s, e, where):
        return F.when(where, F.struct((F.col("i") * 4 + k).alias("id"), F.lit(kind).alias("type"), subtype.alias("subtype"), s.alias("s"), e.alias("e")))

    change, place = F.when(even, "repeat").otherwise("revise"), F.col("i") % 9 == 4
    found = F.array(
        event(0, "SU", F.when(even, "statement").otherwise("question"), at, at + 6200, F.col("i") % 7 == 0),
        event(1, "FILLER", F.when(F.length("word") == 1, "filled").otherwise("marker"), at, at + 700, F.length("word") <= 2),
        event(2, "EDIT", change, at, at + 1600, place),
        event(3, "IP", change, at + 1700, at + 1700, place),
    )
    return words, w.select("uri", F.explode(F.array_compact(found)).alias("x")).select("uri", "x.*")


@query(EVENTS + "SELECT uri, id, type, count(*) FILTER (mid < s) AS first, count(mid) - 1 AS last, count(*) FILTER (mid < s AND scoreable) AS before, count(*) FILTER (scoreable) AS until FROM met GROUP BY uri, id, type")
def event_word_ranges(spark, d):
    words, events = _words_and_events(spark, d)
    return md.word_ranges(events, words).select("uri", "id", "type", "first", "last", "before", "until")


@query(EVENTS + """, tags AS (SELECT uri, idx, type, subtype, s, e, id FROM met WHERE type IN ('FILLER', 'EDIT') AND mid >= s
UNION ALL SELECT uri, max(idx), type, subtype, s, e, id FROM met WHERE type IN ('SU', 'IP') AND idx IS NOT NULL GROUP BY ALL)
SELECT uri, idx, type, subtype FROM tags QUALIFY row_number() OVER (PARTITION BY uri, idx, type ORDER BY s DESC, e DESC, id DESC) = 1""")
def event_tagged_words(spark, d):
    words, events = _words_and_events(spark, d)
    return md.tagged_words(events, words)


@query()
def event_errors(spark, d):
    """Errors by type and subtype of events that a system hears shifted, with some lost and some of another subtype."""
    words, events = _words_and_events(spark, d)
    n = F.expr("id div 4")
    shift = (n % 5 - 2) * 300
    heard = events.where(n % 11 != 3).withColumns({"s": F.col("s") + shift, "e": F.col("e") + shift, "subtype": F.when(n % 6 == 1, "other").otherwise(F.col("subtype"))})
    aligned = md.aligned_events(md.word_ranges(events, words), md.word_ranges(heard, words))
    return md.event_errors(aligned).groupBy("type", "subtype").agg(*[F.sum(c).alias(c) for c in ("refs", "cor", "sub", "dele", "ins")])
