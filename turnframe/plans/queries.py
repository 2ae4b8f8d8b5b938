"""The queries over the driver's tables, each beside the SQL that DuckDB answers the same with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from turnframe import fixtures as fx
from turnframe.fixtures import SECOND, with_views
from turnframe.functions import text as tx
from turnframe.functions.vectors import cosine, l2_normalize, rounded
from turnframe.operators import clusters as cl
from turnframe.operators import intervals as iv
from turnframe.operators import regions as rg
from turnframe.operators import scoring as sc
from turnframe.operators import sessions as ss
from turnframe.operators import turns as tn
from turnframe.operators import windows as wn

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
GAP, WIDTH = 600 * SECOND, 900 * SECOND
CHUNK, HOP = 7200 * SECOND, 3600 * SECOND
COLLAR = 2 * SECOND


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- turns ----------------------------------------------------------------------------------------------------------

MERGE = """
, {name}_p AS (SELECT *, max(e) OVER (PARTITION BY uri, spk ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {name}),
{name}_g AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY uri, spk ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {name}_p),
{name}_m AS (SELECT uri, spk, min(s) AS s, max(e) AS e, count(*) AS n FROM {name}_g GROUP BY uri, spk, g)
"""


@query(with_views("turns", body=MERGE.format(name="turns", gap=GAP) + "SELECT uri, spk, s, e, n FROM turns_m"))
def turn_merge(spark, d):
    return tn.gap_merge(fx.turns(spark, d), GAP)


@query(with_views("turns", body=MERGE.format(name="turns", gap=GAP) + f"SELECT uri, spk, s, e, n FROM turns_m WHERE e - s >= {200 * SECOND}"))
def turn_min_filter(spark, d):
    return tn.min_duration(tn.gap_merge(fx.turns(spark, d), GAP), 200 * SECOND)


@query(with_views("turns", body=MERGE.format(name="turns", gap=GAP) + "SELECT uri, spk, count(*) AS turns, cast(sum(e - s) AS bigint) AS duration FROM turns_m GROUP BY uri, spk"))
def speaker_durations(spark, d):
    return tn.durations(tn.gap_merge(fx.turns(spark, d), GAP))


@query(with_views("turns", body=", o AS (SELECT uri, spk, cast(sum(e - s) AS bigint) AS duration FROM turns GROUP BY uri, spk) SELECT uri, spk, duration, count(*) OVER (PARTITION BY uri) AS speakers, round(duration / sum(duration) OVER (PARTITION BY uri), 6) AS share FROM o"))
def speaker_share(spark, d):
    return tn.shares(fx.turns(spark, d)).withColumn("share", F.round("share", 6))


@query(with_views("turns", body=MERGE.format(name="turns", gap=GAP) + f", a AS (SELECT uri, spk, g, min(s) AS s, max(e) AS e, cast(sum(e - s) AS bigint) AS audio FROM turns_g GROUP BY uri, spk, g) SELECT uri, spk, s, e, audio FROM a WHERE audio >= {250 * SECOND}"))
def piece_merge(spark, d):
    return tn.gap_merge_pieces(fx.turns(spark, d), GAP, 250 * SECOND)


COMMITS = f", t0 AS (SELECT uri, min(s) AS z, max(e) AS y FROM turns GROUP BY uri), commits AS (SELECT uri, unnest(generate_series(z, y, {HOP})) AS commit_end FROM t0)"


@query(with_views("turns", body=MERGE.format(name="turns", gap=GAP) + COMMITS + f" SELECT uri, spk, s, e, (SELECT min(commit_end) FROM commits c WHERE c.uri = m.uri AND c.commit_end > m.e + {GAP}) AS closed_at FROM turns_m m"))
def early_close(spark, d):
    turns = fx.turns(spark, d)
    commits = iv.extent(turns).select("uri", F.explode(F.sequence("s", "e", F.lit(HOP).cast("long"))).alias("commit_end"))
    return tn.early_closed(turns, commits, GAP)


@query(with_views("turns", body=MERGE.format(name="turns", gap=GAP) + "SELECT uri, s, printf('SPEAKER %s 1 %.3f %.3f <NA> <NA> speaker%d <NA> <NA>', uri, floor(s / 1000 + 0.5) / 1000.0, floor((e - s) / 1000 + 0.5) / 1000.0, spk) AS line FROM turns_m"))
def rttm_text(spark, d):
    return tn.rttm_lines(tn.gap_merge(fx.turns(spark, d), GAP))


@query(with_views("turns", body=MERGE.format(name="turns", gap=GAP) + "SELECT uri, spk, round(s / 1e6, 3) AS tbeg, round((e - s) / 1e6, 3) AS tdur FROM turns_m"))
def rttm_round_trip(spark, d):
    from turnframe.sources.rttm import parse_lenient

    lines = tn.rttm_lines(tn.gap_merge(fx.turns(spark, d), GAP)).select("line")
    return parse_lenient(lines).select("uri", F.regexp_extract("spkr", r"\d+", 0).cast("long").alias("spk"), F.round("tbeg", 3).alias("tbeg"), F.round("tdur", 3).alias("tdur"))


# --- frames and regions ---------------------------------------------------------------------------------------------


@query(with_views("frames", body="SELECT uri, chunk, frame, cast(sum(act) AS bigint) AS n_active FROM frames GROUP BY uri, chunk, frame HAVING sum(act) >= 2"))
def frame_overlap(spark, d):
    return rg.overlap_frames(fx.frames(spark, d))


RUNS = ", w AS (SELECT *, sum(act) OVER (PARTITION BY uri, chunk, frame) AS n FROM frames), r AS (SELECT uri, chunk, slot, frame, frame - row_number() OVER (PARTITION BY uri, chunk, slot ORDER BY frame) AS g FROM w WHERE {cond}), runs AS (SELECT uri, chunk, slot, min(frame) AS f0, max(frame) + 1 AS f1 FROM r GROUP BY uri, chunk, slot, g)"


@query(with_views("frames", body=RUNS.format(cond="act = 1 AND n < 2") + "SELECT * FROM runs"))
def pure_regions(spark, d):
    return rg.connected_regions(rg.with_overlap(fx.frames(spark, d)), "pure")


@query(with_views("frames", body=RUNS.format(cond="act = 1") + "SELECT * FROM runs"))
def active_regions(spark, d):
    return rg.connected_regions(fx.frames(spark, d))


@query(with_views("frames", body=RUNS.format(cond="act = 1") + ", b AS (SELECT *, coalesce(sum(f1 - f0) OVER (PARTITION BY uri, chunk, slot ORDER BY f0 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM runs) SELECT uri, chunk, slot, f0, cast(f0 + least(f1 - f0, 12 - before) AS bigint) AS f1 FROM b WHERE before < 12"))
def capped_selection_latest(spark, d):
    return rg.capped_latest(rg.connected_regions(fx.frames(spark, d)), 12)


@query(
    with_views(
        "frames",
        body=RUNS.format(cond="act = 1")
        + ", c AS (SELECT uri, chunk, slot, 0 AS class, greatest(f0, 15) AS f0, least(f1, 45) AS f1 FROM runs UNION ALL SELECT uri, chunk, slot, 1, f0, least(f1, 15) FROM runs UNION ALL SELECT uri, chunk, slot, 2, greatest(f0, 45), f1 FROM runs), b AS (SELECT *, coalesce(sum(f1 - f0) OVER (PARTITION BY uri, chunk, slot ORDER BY class, f0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE f1 > f0) SELECT uri, chunk, slot, class, f0, cast(f0 + least(f1 - f0, 20 - before) AS bigint) AS f1 FROM b WHERE before < 20",
    )
)
def capped_selection_commit(spark, d):
    return rg.capped_commit(rg.connected_regions(fx.frames(spark, d)), 20, 15, 45)


GATE = ", w AS (SELECT *, sum(act) OVER (PARTITION BY uri, chunk, frame) AS n FROM frames), a AS (SELECT uri, chunk, slot, cast(sum(act) AS bigint) AS active, count(*) FILTER (act = 1 AND n < 2) AS pure, min(frame) FILTER (act = 1) AS first, max(frame) FILTER (act = 1) + 1 AS last, round(avg(act), 6) AS mean FROM w GROUP BY uri, chunk, slot HAVING sum(act) >= 4) "


@query(with_views("frames", body=GATE + "SELECT * FROM a"))
def slot_activity(spark, d):
    return rg.slot_activity(fx.frames(spark, d), 4).withColumn("mean", F.round("mean", 6))


@query(with_views("frames", body=GATE + "SELECT *, CASE WHEN pure >= 8 THEN 'pure' ELSE 'overlap_fallback' END AS selection_mode, pure >= 8 AS allow_update FROM a WHERE pure >= 8 OR active >= 8"))
def embedding_gate(spark, d):
    return rg.embedding_gate(rg.slot_activity(fx.frames(spark, d), 4), 8).withColumn("mean", F.round("mean", 6))


ASSIGNMENT = ", asg AS (SELECT DISTINCT uri, chunk, slot, (chunk + slot) % 4 AS gid FROM frames WHERE (chunk + slot) % 5 <> 0)"


@query(with_views("frames", body=ASSIGNMENT + "SELECT uri, chunk, frame, list_sort(list_distinct(list(gid))) AS speakers FROM frames JOIN asg USING (uri, chunk, slot) WHERE act = 1 GROUP BY uri, chunk, frame"))
def slot_to_global(spark, d):
    frames = fx.frames(spark, d)
    assignment = frames.where("(chunk + slot) % 5 <> 0").select("uri", "chunk", "slot", F.expr("(chunk + slot) % 4").alias("gid")).distinct()
    return rg.slots_to_speakers(frames, assignment)


@query(with_views("frames", body=", o AS (SELECT *, sum(act) OVER (PARTITION BY uri, chunk, frame) AS na FROM frames), c AS (SELECT uri, chunk, slot, count(*) AS n FROM o WHERE act = 1 AND na >= 2 GROUP BY uri, chunk, slot) SELECT uri, chunk, slot, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY uri, chunk ORDER BY n DESC, slot) AS rank FROM c) WHERE rank <= 2"))
def top2_overlap(spark, d):
    return rg.top_overlapped(fx.frames(spark, d))


# --- windows --------------------------------------------------------------------------------------------------------

TOTALS = ", tot AS (SELECT uri, max(e) - min(s) AS total FROM turns GROUP BY uri)"
SCHEDULE = TOTALS + f", ch AS (SELECT uri, total, unnest(generate_series(0, total // {HOP} + 1)) AS i FROM tot), sch AS (SELECT uri, i AS chunk_index, i * {HOP} AS chunk_start, CASE WHEN i = 0 THEN 0 ELSE i * {HOP} + {(CHUNK - HOP) // 2} END AS commit_start, least(i * {HOP} + {(CHUNK - HOP) // 2 + HOP}, total) AS commit_end FROM ch), schedule AS (SELECT * FROM sch WHERE commit_start < commit_end)"


def _schedule(spark, d):
    return wn.chunk_schedule(iv.extent(fx.turns(spark, d)).select("uri", (F.col("e") - F.col("s")).alias("total")), CHUNK, HOP)


@query(with_views("turns", body=SCHEDULE + "SELECT * FROM schedule"))
def chunk_schedule(spark, d):
    return _schedule(spark, d)


@query(with_views("turns", body=SCHEDULE + ", z AS (SELECT uri, min(s) AS z FROM turns GROUP BY uri), rel AS (SELECT id, uri, spk, s - z AS s, e - z AS e FROM turns JOIN z USING (uri)) SELECT r.uri, id, spk, chunk_index, greatest(s, commit_start) AS s, least(e, commit_end) AS e FROM rel r JOIN schedule c ON r.uri = c.uri AND e > commit_start AND s < commit_end"))
def commit_clip(spark, d):
    turns = fx.turns(spark, d)
    first = turns.groupBy("uri").agg(F.min("s").alias("z"))
    rel = turns.join(first, "uri").select("id", "uri", "spk", (F.col("s") - F.col("z")).alias("s"), (F.col("e") - F.col("z")).alias("e"))
    regions = _schedule(spark, d).select("uri", "chunk_index", F.col("commit_start").alias("s"), F.col("commit_end").alias("e"))
    met = iv.overlap_join(rel, regions, ["uri"], HOP).select("uri", F.col("a_id").alias("id"), F.col("a_spk").alias("spk"), F.col("b_chunk_index").alias("chunk_index"), F.col("a_s").alias("s"), F.col("a_e").alias("e"), F.col("b_s").alias("commit_start"), F.col("b_e").alias("commit_end"))
    return wn.commit_clip(met).drop("commit_start", "commit_end")


@query(f"WITH t AS (SELECT event_type AS uri, epoch_us(ts) AS t FROM events), w AS (SELECT uri, unnest(generate_series(t // {HOP} * {HOP} - {CHUNK - HOP}, t // {HOP} * {HOP}, {HOP})) AS w FROM t) SELECT uri, w, count(*) AS n FROM w GROUP BY uri, w")
def hop_window_counts(spark, d):
    events = fx.load(spark, d, "events").select(F.col("event_type").alias("uri"), fx.micros(F.col("ts")).alias("t"))
    return wn.hop_windows(events, "t", CHUNK, HOP, "uri")


@query(f"SELECT event_type AS uri, epoch_us(ts) // {HOP} * {HOP} AS w, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    events = fx.load(spark, d, "events").select(F.col("event_type").alias("uri"), fx.micros(F.col("ts")).alias("t"))
    return wn.tumbling(events, "t", HOP, "uri")


# --- intervals and scoring ------------------------------------------------------------------------------------------

REF = MERGE.format(name="turns", gap=0)
BOTH = REF + MERGE.format(name="sys", gap=0)


def _ref(spark, d):
    return tn.gap_merge(fx.turns(spark, d), 0).select("uri", "spk", "s", "e")


def _sys(spark, d):
    return tn.gap_merge(fx.system_turns(spark, d), 0).select("uri", "spk", "s", "e")


@query(with_views("turns", body="SELECT id, uri, spk, s, e, EXISTS (SELECT 1 FROM turns o WHERE o.uri = t.uri AND o.spk <> t.spk AND o.s < t.e AND t.s < o.e) AS overlapped FROM turns t"))
def overlap_flags(spark, d):
    return iv.overlap_flags(fx.turns(spark, d), WIDTH)


OVERLAPS = BOTH + ", ov AS (SELECT a.uri, a.spk AS ref, b.spk AS sys, cast(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS bigint) AS overlap FROM turns_m a JOIN sys_m b ON a.uri = b.uri AND a.s < b.e AND b.s < a.e GROUP BY ALL)"


@query(with_views("turns", "sys", body=OVERLAPS + "SELECT * FROM ov"))
def overlap_seconds(spark, d):
    return iv.overlap_seconds(_ref(spark, d), _sys(spark, d), WIDTH)


@query(with_views("turns", body=REF + ", t AS (SELECT uri, s AS t FROM turns_m UNION SELECT uri, e FROM turns_m), g AS (SELECT uri, t AS a, lead(t) OVER (PARTITION BY uri ORDER BY t) AS b FROM t) SELECT g.uri, a, b, list_sort(list(DISTINCT spk)) AS speakers FROM g JOIN turns_m m ON m.uri = g.uri AND m.s <= a AND m.e >= b GROUP BY ALL"))
def atomic_segments(spark, d):
    return iv.speaker_segments(_ref(spark, d), WIDTH)


COUNTS = """, uem AS (SELECT uri, min(s) AS s, max(e) AS e FROM turns_m GROUP BY uri),
r AS (SELECT m.uri, m.spk, greatest(m.s, u.s) AS s, least(m.e, u.e) AS e FROM turns_m m JOIN uem u ON m.uri = u.uri AND m.s < u.e AND u.s < m.e),
y AS (SELECT m.uri, m.spk, greatest(m.s, u.s) AS s, least(m.e, u.e) AS e FROM sys_m m JOIN uem u ON m.uri = u.uri AND m.s < u.e AND u.s < m.e),
t AS (SELECT uri, s AS t FROM r UNION SELECT uri, e FROM r UNION SELECT uri, s FROM y UNION SELECT uri, e FROM y),
g AS (SELECT uri, t AS a, lead(t) OVER (PARTITION BY uri ORDER BY t) AS b FROM t),
nr AS (SELECT g.uri, a, count(*) AS n FROM g JOIN r ON r.uri = g.uri AND r.s <= a AND r.e >= b GROUP BY ALL),
ny AS (SELECT g.uri, a, count(*) AS n FROM g JOIN y ON y.uri = g.uri AND y.s <= a AND y.e >= b GROUP BY ALL),
seg AS (SELECT g.uri, a, b, b - a AS d, coalesce(nr.n, 0) AS nref, coalesce(ny.n, 0) AS nsys FROM g LEFT JOIN nr USING (uri, a) LEFT JOIN ny USING (uri, a) WHERE b IS NOT NULL),
o AS (SELECT r.uri, r.spk AS ref, y.spk AS sys, cast(sum(least(r.e, y.e) - greatest(r.s, y.s)) AS bigint) AS overlap FROM r JOIN y ON r.uri = y.uri AND r.s < y.e AND y.s < r.e GROUP BY ALL),
walk AS (
  SELECT DISTINCT uri, -1 AS k, cast([] AS bigint[]) AS used, cast(0 AS bigint) AS total, cast([] AS bigint[]) AS pairs FROM o
  UNION ALL
  SELECT w.uri, w.k + 1, CASE WHEN o.sys IS NULL THEN w.used ELSE list_append(w.used, o.sys) END, w.total + coalesce(o.overlap, 0), CASE WHEN o.sys IS NULL THEN w.pairs ELSE list_append(w.pairs, w.k + 1) END
  FROM walk w JOIN (SELECT uri, ref, sys, overlap FROM o UNION ALL SELECT DISTINCT uri, ref_, NULL, 0 FROM (SELECT uri FROM (SELECT DISTINCT uri FROM o)), (SELECT unnest(generate_series(0, 4)) AS ref_)) o
    ON o.uri = w.uri AND o.ref = w.k + 1 AND (o.sys IS NULL OR NOT list_contains(w.used, o.sys)) WHERE w.k < 4),
best AS (SELECT uri, max(total) AS total FROM walk WHERE k = 4 GROUP BY uri),
mapped AS (SELECT uri, arg_max(pairs, total) AS refs, arg_max(used, total) AS syss FROM walk WHERE k = 4 GROUP BY uri),
parts AS (SELECT uri, cast(sum(d * nref) AS bigint) AS scored, cast(sum(d * greatest(nref - nsys, 0)) AS bigint) AS miss, cast(sum(d * greatest(nsys - nref, 0)) AS bigint) AS fa, cast(sum(d * least(nref, nsys)) AS bigint) AS both_ FROM seg GROUP BY uri),
comp AS (SELECT uri, scored, miss, fa, both_ - total AS err FROM parts JOIN best USING (uri)) """


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _components(spark, d):
    return sc.der_components(_ref(spark, d), _sys(spark, d), WIDTH)


@query(_recursive(with_views("turns", "sys", body=BOTH + COUNTS + "SELECT * FROM comp")))
def der_components(spark, d):
    return _components(spark, d)


@query(_recursive(with_views("turns", "sys", body=BOTH + COUNTS + "SELECT *, round(100.0 * miss / scored, 6) AS ms, round(100.0 * fa / scored, 6) AS fa_rate, round(100.0 * err / scored, 6) AS ser, round(100.0 * (miss + fa + err) / scored, 6) AS der FROM comp")))
def der_rates(spark, d):
    return sc.with_rates(_components(spark, d)).withColumns({c: F.round(c, 6) for c in ("ms", "fa_rate", "ser", "der")})


@query(_recursive(with_views("turns", "sys", body=BOTH + COUNTS + "SELECT count(*) AS files, round(100.0 * sum(miss + fa + err) / sum(scored), 6) AS global_der, round(avg(100.0 * (miss + fa + err) / scored), 6) AS avg_der FROM comp")))
def der_pooled_vs_macro(spark, d):
    return sc.pooled_and_macro(_components(spark, d)).withColumns({c: F.round(c, 6) for c in ("global_der", "avg_der")})


@query(
    _recursive(
        with_views(
            "turns",
            "sys",
            body=BOTH
            + COUNTS
            + ", f AS (SELECT *, cast(1 + length(uri) % 2 AS int) AS channel FROM comp) SELECT uri, channel, coalesce(nullif(concat_ws(' ', 'u=' || uri, 'c=' || channel), ''), 'ALL') AS label, cast(sum(scored) AS bigint) AS scored, cast(sum(miss) AS bigint) AS miss, cast(sum(fa) AS bigint) AS fa, cast(sum(err) AS bigint) AS err, round(100.0 * sum(miss + fa + err) / sum(scored), 6) AS der FROM f GROUP BY CUBE (uri, channel)",
        )
    )
)
def der_grouping_sets(spark, d):
    return sc.rolled_up(_components(spark, d).withColumn("channel", 1 + F.length("uri") % 2), ["uri", "channel"]).withColumn("der", F.round("der", 6))


@query(_recursive(with_views("turns", "sys", body=BOTH + COUNTS + ", p AS (SELECT uri, unnest(refs) AS ref, unnest(syss) AS sys FROM mapped) SELECT p.uri, p.ref, p.sys, o.overlap FROM p JOIN o USING (uri, ref, sys)")))
def speaker_mapping(spark, d):
    ref, sys = _ref(spark, d), _sys(spark, d)
    uem = iv.extent(ref)
    return sc.speaker_mapping(iv.overlap_seconds(iv.clipped(ref, uem, WIDTH), iv.clipped(sys, uem, WIDTH), WIDTH))


@query(_recursive(with_views("turns", "sys", body=BOTH + COUNTS + "SELECT uri, unnest(['del', 'ins', 'sub']) AS kind, unnest([miss, fa, err]) AS amount, round(least(999.99, 100.0 * unnest([miss, fa, err]) / scored), 6) AS percent FROM comp")))
def error_table(spark, d):
    return sc.error_table(_components(spark, d)).withColumn("percent", F.round("percent", 6))


# no-score time by brute force: a piece between neighbouring boundaries counts if its middle does
ZONE = """, cut AS (SELECT uri, t FROM bounds GROUP BY uri, t), pc AS (SELECT uri, t AS s, lead(t) OVER (PARTITION BY uri ORDER BY t) AS e FROM cut),
ok AS (SELECT pc.* FROM pc JOIN uem u ON u.uri = pc.uri AND u.s <= pc.s AND u.e >= pc.e ANTI JOIN veto v ON v.uri = pc.uri AND v.s < pc.e AND pc.s < v.e),
mk AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY uri ORDER BY s) = s THEN 0 ELSE 1 END AS o FROM ok),
gr AS (SELECT *, sum(o) OVER (PARTITION BY uri ORDER BY s) AS g FROM mk)
SELECT uri, min(s) AS s, max(e) AS e FROM gr GROUP BY uri, g"""


@query(with_views("turns", body=REF + f", uem AS (SELECT uri, min(s) AS s, max(e) AS e FROM turns_m GROUP BY uri), veto AS (SELECT uri, s - {COLLAR} AS s, s + {COLLAR} AS e FROM turns_m UNION ALL SELECT uri, e - {COLLAR}, e + {COLLAR} FROM turns_m), bounds AS (SELECT uri, s AS t FROM uem UNION SELECT uri, e FROM uem UNION SELECT uri, s FROM veto UNION SELECT uri, e FROM veto)" + ZONE))
def collar_uem(spark, d):
    ref = _ref(spark, d)
    return iv.collared(iv.extent(ref), ref, COLLAR)


@query(with_views("turns", body=REF + ", uem AS (SELECT uri, min(s) AS s, max(e) AS e FROM turns_m GROUP BY uri), veto AS (SELECT a.uri, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM turns_m a JOIN turns_m b ON a.uri = b.uri AND a.spk < b.spk AND a.s < b.e AND b.s < a.e), bounds AS (SELECT uri, s AS t FROM uem UNION SELECT uri, e FROM uem UNION SELECT uri, s FROM veto UNION SELECT uri, e FROM veto)" + ZONE))
def overlap_exclusion(spark, d):
    ref = _ref(spark, d)
    return iv.without_overlap(iv.extent(ref), ref)


@query()
def der_collared(spark, d):
    ref, sys = _ref(spark, d), _sys(spark, d)
    return sc.error_components(ref, sys, iv.collared(iv.extent(ref), ref, COLLAR), WIDTH, mapping_uem=iv.extent(ref))


@query(with_views("turns", "sys", body=OVERLAPS + ", ty AS (SELECT * FROM (VALUES (0, 'm'), (1, 'f'), (3, 'm')) v(spk, type)) SELECT coalesce(a.type, 'unknown') AS ref_type, coalesce(b.type, 'unknown') AS sys_type, count(*) AS pairs, cast(sum(overlap) AS bigint) AS time FROM ov LEFT JOIN ty a ON ref = a.spk LEFT JOIN ty b ON sys = b.spk GROUP BY ALL"))
def type_confusion(spark, d):
    types = spark.createDataFrame([(0, "m"), (1, "f"), (3, "m")], "spk long, type string")
    return sc.type_confusion(iv.overlap_seconds(_ref(spark, d), _sys(spark, d), WIDTH), types)


@query(with_views("turns", "sys", body="SELECT t.uri, cast(greatest(-4, least(4, floor((y.s + 137000 * (t.id % 90) - 6000000 - t.s) / 2000000.0))) AS int) AS bin, count(*) AS n FROM turns t JOIN sys y USING (id) GROUP BY ALL"))
def offset_histogram(spark, d):
    ref, sys = fx.turns(spark, d), fx.system_turns(spark, d).select("id", F.col("s").alias("y"))
    return sc.offset_histogram(ref.join(sys, "id").select("uri", (F.col("y") + 137_000 * (F.col("id") % 90) - 6_000_000 - F.col("s")).alias("offset")), 2_000_000)


@query(with_views("turns", body=REF + f", u AS (SELECT uri, min(s) + 50 * {HOP} AS s, min(s) + 150 * {HOP} AS e FROM turns GROUP BY uri) SELECT t.id, t.uri, t.spk, t.s, t.e FROM turns t JOIN u ON t.uri = u.uri AND t.s >= u.s AND t.e <= u.e"))
def uem_contained(spark, d):
    turns = fx.turns(spark, d)
    uem = turns.groupBy("uri").agg((F.min("s") + 50 * HOP).alias("s"), (F.min("s") + 150 * HOP).alias("e"))
    return iv.contained(turns, uem, HOP)


@query(with_views("turns", body=f", u AS (SELECT uri, min(s) + 50 * {HOP} AS s, min(s) + 150 * {HOP} AS e FROM turns GROUP BY uri) SELECT t.uri, t.id, (t.s + t.e) / 2 BETWEEN u.s AND u.e AS inside FROM turns t JOIN u USING (uri)"))
def midpoint_in_uem(spark, d):
    turns = fx.turns(spark, d)
    return iv.holds_midpoint(turns, turns.groupBy("uri").agg((F.min("s") + 50 * HOP).alias("s"), (F.min("s") + 150 * HOP).alias("e")))


# --- vectors and clusters -------------------------------------------------------------------------------------------

CENTROIDS = """, dims AS (SELECT uri, label AS cluster, duration, unnest(vec) AS x, unnest(generate_series(1, len(vec))) AS dim FROM obs),
av AS (SELECT uri, cluster, dim, avg(x) AS x, count(*) AS n, sum(duration) AS duration FROM dims GROUP BY ALL),
pk AS (SELECT uri, cluster, max(n) AS n, max(duration) AS duration, list(x ORDER BY dim) AS v FROM av GROUP BY ALL),
cen AS (SELECT uri, cluster, n, duration, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS centroid FROM pk)"""


def _centroids(spark, d):
    return cl.centroids(fx.observations(spark, d).withColumnRenamed("label", "cluster"))


@query(with_views("obs", body=CENTROIDS + "SELECT uri, cluster, n, duration, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM cen"))
def centroids(spark, d):
    return _centroids(spark, d).withColumn("centroid", F.transform("centroid", lambda x: rounded(x, 6)))


@query(with_views("obs", body=CENTROIDS + ", h AS (SELECT uri, cluster % 3 AS part, n, duration, unnest(centroid) AS x, unnest(generate_series(1, len(centroid))) AS dim FROM cen), av2 AS (SELECT uri, part, dim, sum(x * n) / sum(n) AS x, cast(sum(n) AS bigint) AS n, sum(duration) AS duration FROM h GROUP BY ALL), pk2 AS (SELECT uri, part, max(n) AS n, max(duration) AS duration, list(x ORDER BY dim) AS v FROM av2 GROUP BY ALL) SELECT uri, part, n, duration, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS centroid FROM pk2"))
def centroid_merge(spark, d):
    return cl.merged_centroids(_centroids(spark, d).withColumn("part", F.col("cluster") % 3), ("uri", "part")).withColumn("centroid", F.transform("centroid", lambda x: rounded(x, 6)))


@query(with_views("obs", body=CENTROIDS + "SELECT a.uri, a.cluster AS a, b.cluster AS b, round(list_dot_product(a.centroid, b.centroid), 6) AS cosine FROM cen a JOIN cen b ON a.uri = b.uri AND a.cluster < b.cluster"))
def cosine_pairs(spark, d):
    return cl.cosine_pairs(_centroids(spark, d)).withColumn("cosine", rounded("cosine", 6))


@query(with_views("obs", body=CENTROIDS + ", p AS (SELECT a.uri, a.cluster AS a, b.cluster AS b, list_dot_product(a.centroid, b.centroid) AS c FROM cen a JOIN cen b ON a.uri = b.uri AND a.cluster < b.cluster) SELECT uri, a, b, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY c DESC, a, b) AS r FROM p WHERE c >= 0.1) WHERE r = 1"))
def merge_pair(spark, d):
    return cl.best_merge_pair(cl.cosine_pairs(_centroids(spark, d)), 0.1).withColumn("cosine", rounded("cosine", 6))


@query(with_views("obs", body=CENTROIDS + ", p AS (SELECT o.uri, chunk, local, c.cluster AS best, list_dot_product(o.vec, c.centroid) AS s FROM obs o JOIN cen c USING (uri)) SELECT uri, chunk, local, best, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY uri, chunk, local ORDER BY s DESC, best) AS r FROM p) WHERE r = 1"))
def nearest_centroid(spark, d):
    return cl.nearest(fx.observations(spark, d), _centroids(spark, d)).withColumn("similarity", rounded("similarity", 6))


POST = CENTROIDS + ", pm AS (SELECT uri, absorbed, survivor, similarity FROM (SELECT a.uri, a.cluster AS absorbed, b.cluster AS survivor, list_dot_product(a.centroid, b.centroid) AS similarity, row_number() OVER (PARTITION BY a.uri, a.cluster ORDER BY list_dot_product(a.centroid, b.centroid) DESC, b.cluster) AS r FROM cen a JOIN cen b ON a.uri = b.uri WHERE a.duration < 15 AND b.duration >= 15) WHERE r = 1 AND similarity >= 0.05)"


def _post(spark, d):
    return cl.post_merge_map(_centroids(spark, d), 15.0, 0.05)


@query(with_views("obs", body=POST + " SELECT uri, absorbed, survivor, round(similarity, 6) AS similarity FROM pm"))
def post_merge_map(spark, d):
    return _post(spark, d).withColumn("similarity", rounded("similarity", 6))


CHAINS = ", mg AS (SELECT DISTINCT uri, label AS absorbed, label // 2 AS survivor FROM obs WHERE label > 0 AND (label + uri) % 3 <> 0)"
WALK = CHAINS + ", wk AS (SELECT uri, absorbed, survivor, 0 AS depth FROM mg UNION ALL SELECT w.uri, w.absorbed, m.survivor, w.depth + 1 FROM wk w JOIN mg m ON w.uri = m.uri AND w.survivor = m.absorbed WHERE w.depth < 64), cls AS (SELECT uri, absorbed, arg_max(survivor, depth) AS survivor FROM wk GROUP BY ALL)"


def _merges(spark, d):
    return fx.observations(spark, d).where("label > 0 and (label + uri) % 3 <> 0").select("uri", F.col("label").alias("absorbed"), F.expr("label div 2").alias("survivor")).distinct()


@query(_recursive(with_views("obs", body=WALK + " SELECT * FROM cls")))
def merge_closure(spark, d):
    return cl.merge_closure(_merges(spark, d))


@query(_recursive(with_views("obs", body=WALK + " SELECT o.uri, coalesce(survivor, label) AS spk, chunk, local FROM obs o LEFT JOIN cls ON o.uri = cls.uri AND label = absorbed")))
def refined_relabel(spark, d):
    turns = fx.observations(spark, d).select("uri", F.col("label").alias("spk"), "chunk", "local")
    return cl.relabelled(turns, cl.merge_closure(_merges(spark, d)))


STATUS = WALK + POST.replace(CENTROIDS, CENTROIDS, 1) + ", du AS (SELECT o.uri, coalesce(survivor, label) AS id, sum(duration) AS duration FROM obs o LEFT JOIN cls ON o.uri = cls.uri AND label = absorbed GROUP BY ALL), pq AS (SELECT pm.* FROM pm ANTI JOIN cls ON pm.uri = cls.uri AND (pm.absorbed = cls.absorbed OR pm.survivor = cls.absorbed)), ids AS (SELECT uri, id FROM du UNION SELECT uri, absorbed FROM cls), led AS (SELECT i.uri, i.id, coalesce(c.survivor, i.id) AS one FROM ids i LEFT JOIN cls c ON i.uri = c.uri AND i.id = c.absorbed), fin AS (SELECT l.uri, l.id, coalesce(p.survivor, l.one) AS f FROM led l LEFT JOIN pq p ON l.uri = p.uri AND l.one = p.absorbed), st AS (SELECT f.uri, f.id, CASE WHEN f.f = f.id THEN round(coalesce(du.duration, 0), 3) END AS duration, CASE WHEN f.f <> f.id THEN f.f END AS merged_into FROM fin f LEFT JOIN du ON f.uri = du.uri AND f.id = du.id)"


def _status(spark, d):
    closure = cl.merge_closure(_merges(spark, d))
    own = cl.relabelled(fx.observations(spark, d).select("uri", F.col("label").alias("spk"), "duration"), closure)
    durations = own.groupBy("uri", F.col("spk").alias("id")).agg(F.sum("duration").alias("duration"))
    gone = closure.select("uri", F.col("absorbed").alias("x"))
    post = _post(spark, d).select("uri", "absorbed", "survivor")
    post = post.join(gone.withColumnRenamed("x", "absorbed"), ["uri", "absorbed"], "left_anti").join(gone.withColumnRenamed("x", "survivor"), ["uri", "survivor"], "left_anti").select("uri", "absorbed", "survivor")
    return durations, closure, post


@query(_recursive(with_views("obs", body=STATUS + " SELECT *, merged_into IS NULL AND coalesce(duration < 15, false) AS uncertain FROM st")))
def speaker_status(spark, d):
    return cl.speaker_status(*_status(spark, d), 15.0).withColumn("uncertain", F.coalesce("uncertain", F.lit(False)))


@query(_recursive(with_views("obs", body=STATUS + " SELECT uri, absorbed, survivor, 'merge' AS kind FROM cls UNION ALL SELECT uri, absorbed, survivor, 'post_merge' FROM pq")))
def merge_events(spark, d):
    _, closure, post = _status(spark, d)
    return cl.merge_events(closure, post)


@query()
def speaker_status_json(spark, d):
    durations, closure, post = _status(spark, d)
    return cl.status_json(cl.speaker_status(durations, closure, post, 15.0), closure, post, 15.0, True)


SIMS = ", q AS (SELECT a.uri, a.chunk, list_dot_product(a.vec, c.vec) AS s00, list_dot_product(a.vec, e.vec) AS s01, list_dot_product(b.vec, c.vec) AS s10, list_dot_product(b.vec, e.vec) AS s11 FROM obs a JOIN obs b ON a.uri = b.uri AND a.chunk = b.chunk AND a.local = 0 AND b.local = 1 JOIN obs c ON c.uri = a.uri AND c.chunk = a.chunk + 1 AND c.local = 0 JOIN obs e ON e.uri = a.uri AND e.chunk = a.chunk + 1 AND e.local = 1)"


@query(with_views("obs", body=SIMS + " SELECT uri, chunk, round(s00, 6) AS s00, round(s01, 6) AS s01, round(s10, 6) AS s10, round(s11, 6) AS s11, s00 + s11 >= s01 + s10 AS straight, round(CASE WHEN s00 + s11 >= s01 + s10 THEN least(s00, s11) ELSE least(s01, s10) END, 6) AS least FROM q"))
def match_2x2(spark, d):
    obs = fx.observations(spark, d)
    one = lambda name, local, back: obs.where(F.col("local") == local).select("uri", (F.col("chunk") - back).alias("chunk"), F.col("vec").alias(name))
    four = one("t0", 0, 0).join(one("t1", 1, 0), ["uri", "chunk"]).join(one("c0", 0, 1), ["uri", "chunk"]).join(one("c1", 1, 1), ["uri", "chunk"])
    sims = four.select("uri", "chunk", *[cosine(f"t{i}", f"c{j}").alias(f"s{i}{j}") for i in (0, 1) for j in (0, 1)])
    return cl.match_two(sims).withColumns({c: rounded(c, 6) for c in ("s00", "s01", "s10", "s11", "least")})


@query(with_views("obs", body=", b AS (SELECT uri, label, min(chunk * 3 + local) AS k, max(chunk * 3 + local) AS l FROM obs GROUP BY ALL) SELECT b.uri, b.label AS cluster, chunk * 3 + local AS at FROM b JOIN obs o ON o.uri = b.uri AND o.chunk * 3 + o.local = CASE WHEN (b.uri + b.label) % 2 = 0 THEN l ELSE k END"))
def reference_overlay(spark, d):
    obs = fx.observations(spark, d).withColumn("at", F.col("chunk") * 3 + F.col("local"))
    first = obs.groupBy("uri", F.col("label").alias("cluster")).agg(F.min("at").alias("vec"))
    last = obs.groupBy("uri", F.col("label").alias("cluster")).agg(F.max("at").alias("vec")).where("(uri + cluster) % 2 = 0")
    return cl.overlay(first, last).select("uri", "cluster", F.col("vec").alias("at"))


@query()
def online_clusters(spark, d):
    from turnframe.operators.online import online_clusters as run

    return run(fx.observations(spark, d))


@query()
def ahc_clusters(spark, d):
    from turnframe.operators.online import ahc_clusters as run

    return run(fx.observations(spark, d))


@query()
def threshold_sweep(spark, d):
    from turnframe.plans.replay import sweep

    return sweep(fx.observations(spark, d), spark)


# --- transcripts, sessions and logs ---------------------------------------------------------------------------------


@query(with_views("transcript", body="SELECT uri, cast(row_number() OVER (PARTITION BY uri ORDER BY s, e, speaker_id, text) AS int) AS seq, speaker_id, s, e, text FROM transcript WHERE text IS NOT NULL AND trim(text) <> ''"))
def transcript_sorted(spark, d):
    return ss.sorted_transcript(fx.transcript(spark, d))


CATALOG = "WITH u AS (SELECT DISTINCT conv_id AS uri FROM conversations), t AS (SELECT uri, 'out/' || uri || '.jsonl' AS transcript FROM u), a AS (SELECT uri, 'wav/' || uri || '.wav' AS p FROM u WHERE uri % 3 > 0 UNION ALL SELECT uri, 'alt/' || uri || '.wav' FROM u WHERE uri % 6 = 1), o AS (SELECT uri, 'given/' || uri || '.wav' AS p FROM u WHERE uri % 5 = 0), s AS (SELECT uri, 'out/' || uri || '.speakers.json' AS p FROM u WHERE uri % 2 = 0) "


@query(CATALOG + "SELECT t.uri, transcript, coalesce(o.p, (SELECT min(p) FROM a WHERE a.uri = t.uri)) AS audio, s.p AS speakers FROM t LEFT JOIN o USING (uri) LEFT JOIN s USING (uri)")
def session_catalog(spark, d):
    u = fx.load(spark, d, "conversations").select(F.col("conv_id").alias("uri")).distinct()
    path = lambda df, head, end: df.select("uri", F.concat(F.lit(head), F.col("uri").cast("string"), F.lit(end)).alias("path"))
    audio = path(u.where("uri % 3 > 0"), "wav/", ".wav").union(path(u.where("uri % 6 = 1"), "alt/", ".wav"))
    return ss.session_catalog(path(u, "out/", ".jsonl"), audio, path(u.where("uri % 2 = 0"), "out/", ".speakers.json"), path(u.where("uri % 5 = 0"), "given/", ".wav"))


@query("WITH s AS (SELECT DISTINCT 'run/' || source || '.' || lang || '.rttm' AS path, source || '.' || lang AS uri FROM documents), r AS (SELECT DISTINCT 'ref/' || source || '.en.rttm' AS path, source || '.en' AS uri FROM documents) SELECT s.path, s.uri, r.path AS ref_path, CASE WHEN r.path IS NULL THEN 'no reference' END AS reason FROM s LEFT JOIN r USING (uri)")
def ref_match_skips(spark, d):
    docs = fx.load(spark, d, "documents")
    sys = docs.select(F.concat(F.lit("run/"), "source", F.lit("."), "lang", F.lit(".rttm")).alias("path")).distinct()
    ref = docs.select(F.concat(F.lit("ref/"), "source", F.lit(".en.rttm")).alias("path")).distinct()
    return sc.reference_match(sys, ref)


LOG = ", hd AS (SELECT *, regexp_extract(line, '^(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}),(\\d{3}) \\[(\\w+)\\] (.*)$', ['ts', 'ms', 'level', 'rest']) AS m FROM log_lines), lg AS (SELECT doc_id, part, m.level <> '' AS head, m.ts AS ts, m.level AS level, coalesce(nullif(regexp_extract(m.rest, '^\\[([^\\]]+)\\] ?', 1), ''), 'general') AS tag, regexp_replace(m.rest, '^\\[[^\\]]+\\] ?', '') AS message FROM hd WHERE part = 0 OR doc_id % 7 = 0), le AS (SELECT tag, level, left(trim(regexp_replace(CASE WHEN instr(message, ':') BETWEEN 2 AND 41 THEN left(message, instr(message, ':') - 1) ELSE array_to_string(string_split_regex(trim(message), '\\s+')[1:5], ' ') END, '\\d+(\\.\\d+)?', '#', 'g')), 60) AS event FROM lg WHERE head), ev AS (SELECT tag, event, level, count(*) AS n FROM le GROUP BY ALL)"


def _log(spark, d):
    return ss.parsed_log(fx.log_lines(spark, d), ["doc_id", "part"])


@query(with_views("log_lines", body=LOG + " SELECT * FROM ev"))
def log_events(spark, d):
    return ss.log_events(_log(spark, d))


@query(with_views("log_lines", body=LOG + " SELECT count(*) AS lines, count(*) FILTER (NOT head) AS continuations, count(*) FILTER (level IN ('WARNING', 'ERROR', 'CRITICAL')) AS issues, min(ts) FILTER (head) AS first, max(ts) FILTER (head) AS last FROM lg"))
def log_span(spark, d):
    return ss.log_span(_log(spark, d)).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


@query(with_views("log_lines", body=LOG + ", s2 AS (SELECT tag, event, cast(sum(n) AS bigint) AS n FROM ev GROUP BY ALL) SELECT tag, event, n, cast(rank AS int) AS rank, greatest(kinds - 1, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, event) AS rank, count(*) OVER (PARTITION BY tag) AS kinds FROM s2) WHERE rank <= 1"))
def log_top_n(spark, d):
    return ss.log_top(ss.log_events(_log(spark, d)), 1)


@query(with_views("transcript", body=", f AS (SELECT uri, speaker_id, min(s) AS s0, arg_min(e, (s, e)) AS e0 FROM transcript GROUP BY ALL) SELECT uri, speaker_id, cast((row_number() OVER (PARTITION BY uri ORDER BY s0, e0, speaker_id) - 1) % 3 AS int) AS lane FROM f"))
def lane_allocation(spark, d):
    return ss.lanes(fx.transcript(spark, d)).withColumn("lane", F.col("lane").cast("int"))


@query(with_views("transcript", body=", q AS (SELECT uri, cast(row_number() OVER (PARTITION BY uri ORDER BY s, e, speaker_id, text) AS int) AS seq, s, e FROM transcript WHERE text IS NOT NULL AND trim(text) <> ''), t AS (SELECT DISTINCT uri, unnest([5000, 15000, 25500]) AS t FROM transcript) SELECT t.uri, t.t, min(seq) AS seq FROM t JOIN q ON q.uri = t.uri AND s <= t AND t <= e GROUP BY ALL"))
def row_at_time(spark, d):
    rows = fx.transcript(spark, d)
    times = rows.select("uri").distinct().withColumn("t", F.explode(F.array(*[F.lit(x).cast("long") for x in (5000, 15000, 25500)])))
    return ss.current_row(ss.sorted_transcript(rows), times)


@query("WITH x AS (SELECT user_id AS uri, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), y AS (SELECT uri, i // greatest(cast(ceil(n / 8.0) AS bigint), 1) AS bucket, value - 100 AS v FROM x) SELECT uri, bucket, least(min(v), 0.0) AS low, greatest(max(v), 0.0) AS high FROM y GROUP BY ALL")
def peaks(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id")
    samples = fx.load(spark, d, "events").select(F.col("user_id").alias("uri"), (F.row_number().over(own.orderBy("ts", "event_id")) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(own).alias("n"), (F.col("value") - 100).alias("x"))
    return ss.peaks(samples, 8)


@query("WITH a AS (SELECT user_id, sqrt(avg(value * value) + 1e-12) AS own FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, sqrt(avg(value * value) + 1e-12) AS whole FROM events GROUP BY ALL) SELECT user_id, round(own / whole, 6) AS share, own / whole >= 1.0 AS passed FROM a JOIN b USING (user_id)")
def rms_gate(spark, d):
    events = fx.load(spark, d, "events").select("user_id", "event_type", F.col("value").alias("x"))
    return ss.energy_gate(events.where("event_type = 'click'"), events, ("user_id",), 1.0).withColumn("share", F.round("share", 6))


GLM = ", glm AS (SELECT * FROM (VALUES ('the', 'that one'), ('of', '')) v(word, to_)), wd AS (SELECT conv_id AS uri, turn AS id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations WHERE text IS NOT NULL), ex AS (SELECT uri, id * 1000 + i AS id, ws[i] AS word, i * 900 AS s, i * 900 + 700 AS e FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM wd))"


@query("WITH dummy AS (SELECT 1)" + GLM + ", pr AS (SELECT uri, id, s, e, list_filter(string_split_regex(coalesce(to_, lower(ex.word)), '[ -]+'), lambda x: x <> '') AS parts FROM ex LEFT JOIN glm ON lower(ex.word) = glm.word), p2 AS (SELECT uri, id, s, (e - s) // greatest(len(parts), 1) AS each, parts, unnest(generate_series(0, len(parts) - 1)) AS k FROM pr WHERE len(parts) > 0) SELECT uri, id, cast(k AS int) AS k, parts[k + 1] AS word, s + k * each AS s, s + (k + 1) * each AS e FROM p2")
def word_standardise(spark, d):
    words = fx.load(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("uri"), "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("i", "word"))
    i = F.col("i").cast("long") + 1
    glm = spark.createDataFrame([("the", "that one"), ("of", "")], "word string, to string")
    return ss.standard_words(words.select("uri", (F.col("turn") * 1000 + i).alias("id"), "word", (i * 900).alias("s"), (i * 900 + 700).alias("e")), glm)


@query("SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS vec FROM (SELECT vec_id, list_transform(embedding, lambda x, i: cast(x AS double) * i) AS v FROM embeddings)")
def normalized_vectors(spark, d):
    v = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return fx.load(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.transform(l2_normalize("v"), lambda x: rounded(x, 6)).alias("vec"))


@query("WITH k AS (SELECT event_id, epoch_us(ts) % 1000000000 AS us, value FROM events) SELECT event_id, printf('%d:%02d:%02d.%03d', us // 3600000000, us // 60000000 % 60, us // 1000000 % 60, us // 1000 % 1000) AS clock, cast(event_id % 12 AS bigint) AS colour FROM (SELECT event_id, us // 1000 * 1000 AS us FROM k)")
def clock_labels(spark, d):
    us = fx.micros(F.col("ts")) % 1_000_000_000
    return fx.load(spark, d, "events").select("event_id", tx.clock(F.floor(us / 1000) / 1000.0).alias("clock"), tx.colour(F.col("event_id")).alias("colour"))
