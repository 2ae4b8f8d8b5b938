"""Vectors, online and hierarchical clustering, merges and the refined view; streams give what batches give."""

import json
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from turnframe import fixtures as fx
from turnframe.config import EngineConfig, coerced, configured
from turnframe.operators import clusters as cl
from turnframe.operators.online import State, agglomerate, ahc_clusters, cluster_recording, decide_chunk, online_clusters

SF = "/root/testdata/sf0.001"


def obs(*items):
    return [{"local": i, "vec": v, "duration": d, "allow_update": a} for i, (v, d, a) in enumerate(items)]


def test_decisions_in_order():
    cfg, s = EngineConfig(min_new_duration=1.0), State()
    x, y = [1.0, 0.0], [0.0, 1.0]
    first = decide_chunk(s, obs((x, 2.0, True), (y, 2.0, True), (None, 2.0, True)), cfg)
    assert [(r["global_id"], r["decision"], r["similarity"]) for r in first] == [(0, "new", -1.0), (1, "new", -1.0)]
    then = decide_chunk(s, obs(([0.9, 0.1], 0.1, True), ([-1.0, -1.0], 2.0, True), ([0.1, 1.0], 2.0, False)), cfg)
    assert [(r["local"], r["decision"], r["skip_reason"]) for r in then] == [(0, "matched", "short"), (1, "new", None), (2, "matched", "overlap")]
    fall = decide_chunk(s, obs(([0.45, -0.9], 0.2, True)), cfg)
    assert [(r["decision"], r["skip_reason"]) for r in fall] == [("fallback", "fallback")]


def test_a_match_with_an_absorbed_cluster_is_resolved():
    s = State({0: np.array([1.0, 0, 0]), 1: np.array([0, 1.0, 0]), 2: np.array([0.0, 0, 1.0])}, {0: 5, 1: 1, 2: 1}, {}, 3)
    s.merged, s.vectors, s.counts = {1: 0}, {0: s.vectors[0], 2: s.vectors[2]}, {0: 6, 2: 1}
    s.merged[0] = 2
    del s.vectors[0], s.counts[0]
    assert s.survivor(1) == 2


def test_close_clusters_merge_into_the_larger():
    s = State({0: np.array([1.0, 0.0]), 1: np.array([0.0, 1.0])}, {0: 1, 1: 9}, {}, 2)
    cfg = EngineConfig(merge_threshold=0.7, match_threshold=0.1)
    rows = decide_chunk(s, obs(([0.6, 0.8], 2.0, True)), cfg)
    assert s.merged in ({}, {0: 1}) and rows[0]["global_id"] in s.vectors
    s.vectors[0] = np.array([0.05, 1.0]) / np.linalg.norm([0.05, 1.0]) if 0 in s.vectors else None
    if 0 in s.vectors and s.vectors[0] is not None:
        decide_chunk(s, obs(([0.0, 1.0], 2.0, True)), cfg)
        assert s.merged == {0: 1}


def twin(rows, cfg):
    state, out = State(), []
    for chunk in sorted({r["chunk"] for r in rows}):
        part = sorted((r for r in rows if r["chunk"] == chunk), key=lambda r: r["local"])
        out += [(chunk, r["local"], r["global_id"], r["decision"]) for r in decide_chunk(state, part, cfg)]
    return out


def test_batch_is_the_sequential_twin(spark):
    df = fx.observations(spark, SF)
    got = online_clusters(df).collect()
    rows = [r.asDict() for r in df.collect()]
    for uri in {r["uri"] for r in rows}:
        want = twin([r for r in rows if r["uri"] == uri], EngineConfig())
        assert sorted((r.chunk, r.local, r.global_id, r.decision) for r in got if r.uri == uri) == sorted(want)
    assert {r.decision for r in got} >= {"matched", "new"}


def test_stream_is_batch(spark, tmp_path):
    from turnframe.streaming.turns import online_clusters_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = fx.observations(spark, SF).where("uri < 2 and chunk < 8").select("uri", "chunk", "local", "vec", "duration", "allow_update")
    pdf = df.toPandas()
    order = [1, 0, 2, 4, 3, 5, 6, 7]  # chunks out of order are held
    for k, chunk in enumerate(order):
        spark.createDataFrame(pdf[pdf["chunk"] == chunk], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = online_clusters_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert not q.isActive
    key = lambda rows: sorted((r.uri, r.chunk, r.local, r.decision) for r in rows)
    assert key(spark.read.parquet(str(tmp_path / "out")).collect()) == key(online_clusters(df).collect())


def test_merged_turns_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from turnframe.operators.turns import gap_merge
    from turnframe.streaming.turns import merged_turns

    rows = fx.turns(spark, SF)
    ms = rows.select("uri", "spk", F.timestamp_millis(F.floor(F.col("s") / 1000)).alias("ts"), F.floor((F.col("e") - F.col("s")) / 1000).cast("long").alias("length_ms"))
    whole = gap_merge(rows.select("uri", "spk", F.floor(F.col("s") / 1000).alias("s"), (F.floor(F.col("s") / 1000) + F.floor((F.col("e") - F.col("s")) / 1000)).alias("e")), 600_000)
    key = lambda df: sorted((r.uri, r.spk, r.a, r.b) for r in df.collect())
    want = key(whole.selectExpr("uri", "spk", "s as a", "e as b"))
    assert key(merged_turns(ms, 600_000).selectExpr("uri", "spk", "unix_millis(s) as a", "unix_millis(e) as b")) == want
    ms.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([("end", 0, datetime(2030, 1, 1), 0)], "uri string, spk long, ts timestamp, length_ms long")
    stream = spark.readStream.schema(ms.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"), )
    q = merged_turns(stream, 600_000, "40 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    end.select(ms.columns).write.mode("append").parquet(str(tmp_path / "in"))
    q = merged_turns(stream, 600_000, "40 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).where("uri <> 'end'").selectExpr("uri", "spk", "unix_millis(s) as a", "unix_millis(e) as b")
    assert key(got) == want


def test_refined_sink(spark, tmp_path):
    from turnframe.streaming.turns import latest_refined, refined_sink

    sink = refined_sink(str(tmp_path), lambda raw: raw.groupBy("k").count())
    for b in (0, 1, 1):
        sink(spark.createDataFrame([(b,), (7,)], "k long"), b)
    assert {r.k: r["count"] for r in latest_refined(spark, str(tmp_path)).collect()} == {0: 1, 1: 1, 7: 2}


def test_agglomerate():
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [-1, 0]], float)
    assert agglomerate(v, 0.5) == [0, 0, 1, 1, 2] and agglomerate(v[:1], 0.5) == [0] and agglomerate(v[:0], 0.5) == []
    rng = np.random.default_rng(5)
    for linkage in ("average", "complete", "single"):
        x = rng.normal(size=(25, 4))
        got = agglomerate(x, 0.4, linkage)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
        groups = [[i] for i in range(25)]
        f = {"average": np.mean, "complete": np.max, "single": np.min}[linkage]
        while len(groups) > 1:
            best = min(((f(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
            if best[0] >= 0.6:
                break
            groups[best[1]] += groups.pop(best[2])
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(np.array(got) == k)) for k in set(got)}


def test_ahc_labels_count_from_zero(spark):
    rows = ahc_clusters(fx.observations(spark, SF)).collect()
    for uri in {r.uri for r in rows}:
        own = sorted((r.chunk, r.local, r.global_id) for r in rows if r.uri == uri)
        assert own[0][2] == 0 and {x[2] for x in own} == set(range(max(x[2] for x in own) + 1))


def test_closure_follows_chains(spark):
    m = spark.createDataFrame([(1, 5, 3), (1, 3, 1), (1, 9, 9), (2, 8, 7), (2, 7, 6), (2, 6, 5), (2, 5, 4)], "uri long, absorbed long, survivor long")
    want = {(1, 5, 1), (1, 3, 1), (1, 9, 9), (2, 8, 4), (2, 7, 4), (2, 6, 4), (2, 5, 4)}
    assert {tuple(r) for r in cl.merge_closure(m).select("uri", "absorbed", "survivor").collect()} == want


def test_small_clusters(spark):
    rows = [(1, 0, 40.0, [1.0, 0.0]), (1, 1, 5.0, [0.9, 0.1]), (1, 2, 8.0, [0.95, 0.05]), (1, 3, 2.0, [-1.0, 0.0]), (2, 0, 5.0, [1.0, 0.0]), (2, 1, 6.0, [1.0, 0.0])]
    c = spark.createDataFrame(rows, "uri long, cluster long, duration double, centroid array<double>")
    assert {(r.uri, r.absorbed, r.survivor) for r in cl.post_merge_map(c, 30.0, 0.3).collect()} == {(1, 1, 0), (1, 2, 0)}


def test_status_json(spark):
    durations = spark.createDataFrame([(1, 0, 40.0), (1, 2, 3.0), (1, 4, 1.0)], "uri long, id long, duration double")
    merges = spark.createDataFrame([(1, 5, 0)], "uri long, absorbed long, survivor long")
    post = spark.createDataFrame([(1, 4, 0)], "uri long, absorbed long, survivor long")
    status = cl.speaker_status(durations, merges, post, 30.0)
    said = json.loads(cl.status_json(status, merges, post, 30.0, True).first().json)
    assert said["speakers"] == [{"id": 0, "duration": 40.0, "uncertain": False, "merged_into": None}, {"id": 2, "duration": 3.0, "uncertain": True, "merged_into": None}, {"id": 4, "duration": None, "uncertain": False, "merged_into": 0}, {"id": 5, "duration": None, "uncertain": False, "merged_into": 0}]
    assert [e["kind"] for e in said["merge_events"]] == ["merge", "post_merge"]


def test_two_by_two_tie_is_straight(spark):
    r = cl.match_two(spark.createDataFrame([(0.5, 0.5, 0.5, 0.5)], "s00 double, s01 double, s10 double, s11 double")).first()
    assert r.straight and r.least == 0.5


def test_settings():
    assert configured({"match_threshold": "0.6"}, {"max_speakers": "3"}).max_speakers == 3
    assert coerced(bool, "Yes") is True and coerced(bool, "0") is False
    assert coerced(bool, " ON ") is True and coerced(bool, "off") is False
    assert configured({"max_speakers": None, "match_threshold": 0.6}, {"match_threshold": None}) == configured({"match_threshold": 0.6})
    with pytest.raises(ValueError, match="max_speakers"):
        configured({"max_speakers": "many"})
    for bad in ({"nope": 1}, {"match_threshold": 2}, {"chunk_hop": 20}, {"ahc_linkage": "x"}):
        with pytest.raises(ValueError):
            configured(bad)
    with pytest.raises(ValueError):
        coerced(bool, "maybe")


def test_sweep(spark):
    from turnframe.plans.replay import best_setting, sweep

    random.seed(6)
    grid = sweep(fx.observations(spark, SF), spark, match=(0.5, 0.6), new=(0.3, 0.5))
    rows = grid.collect()
    assert len(rows) == 4
    assert best_setting(grid).first().errors == min(r.errors for r in rows)
    assert cluster_recording(pd.DataFrame(columns=["uri", "chunk", "local", "vec", "duration", "allow_update"]), EngineConfig()).empty


def test_rounded_keeps_the_sign_of_a_small_number(spark):
    from turnframe.functions.vectors import rounded

    df = spark.createDataFrame([(-1e-9,), (1e-9,), (-0.0,), (0.0,), (-1.2345675,), (2.5e-6,), (None,)], "x double")
    assert [str(r[0]) for r in df.select(rounded("x", 6)).collect()] == ["-0.0", "0.0", "-0.0", "0.0", "-1.234568", "3e-06", "None"]


def test_vector_queries_give_the_zeros_of_their_sql(spark, tmp_path):
    import duckdb

    from turnframe.plans import queries as own

    spark.createDataFrame([(i, [1.0, -1e-9, 0.5], 0) for i in range(4)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("centroids", "centroid_merge", "normalized_vectors"):
        df = own.QUERIES[name](spark, str(tmp_path))
        rel = con.sql(own.ORACLES[name])
        at = rel.columns.index(df.columns[-1])
        got = sorted(str(r[-1]) for r in df.collect())
        assert got == sorted(str(r[at]) for r in rel.fetchall()) and "-0.0" in got[0]
