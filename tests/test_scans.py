"""Scans over buckets give what one window over a key gives, and spread one key over tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnframe.operators import intervals as iv
from turnframe.operators import scans
from turnframe.operators import turns as tn
from turnframe.operators.scans import scanned


@pytest.fixture(params=[0, 1 << 40], ids=["buckets", "windows"], autouse=True)
def either_way(request, monkeypatch):
    monkeypatch.setattr(scans, "SMALL", request.param)
    return request.param


def rows(spark, n=400, seed=3):
    r = random.Random(seed)
    made = [(r.choice(["a", "a", "a", "b", None]), r.randrange(-300, 300), k, r.choice([None, r.randrange(50)])) for k in range(n)]
    return spark.createDataFrame(made, "uri string, t long, id long, x long")


@pytest.mark.parametrize("width", [1, 7, 100, 10**9])
def test_scans_are_windows(spark, width):
    df = rows(spark)
    order = Window.partitionBy("uri").orderBy("t", "id")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    since, after = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(1, Window.unboundedFollowing)
    want = df.withColumns({
        "a": F.sum("x").over(upto), "b": F.sum("x").over(before), "c": F.max("x").over(upto), "d": F.max("x").over(before), "e": F.last("x", True).over(upto),
        "f": F.last("x", True).over(before), "g": F.first("x", True).over(since), "h": F.first("x", True).over(after), "i": F.min("x").over(since),
    })
    got = scanned(df, ("uri",), "t", ["t", "id"], width, a=("sum", "x"), b=("sum_before", "x"), c=("max", "x"), d=("max_before", "x"), e=("last", "x"), f=("lag", "x"), g=("next", "x"), h=("lead", "x"), i=("min_ahead", "x"))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert scanned(df.limit(0), ("uri",), "t", ["t"], width, a=("sum", "x")).collect() == []


def plain_merge(turns, gap):
    out = []
    for u, k, s, e in sorted(turns, key=lambda t: t):
        if out and out[-1][:2] == [u, k] and s - out[-1][3] <= gap:
            out[-1][3], out[-1][4] = max(out[-1][3], e), out[-1][4] + 1
        else:
            out.append([u, k, s, e, 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("width", [5, 10**9])
def test_merges_over_buckets(spark, width):
    r = random.Random(5)
    turns = [(r.choice("ab"), r.randrange(2), s := r.randrange(400), s + r.choice([0, 1, 5, 90 if r.random() < 0.1 else 3])) for _ in range(150)]
    df = spark.createDataFrame(turns, "uri string, spk long, s long, e long")
    for gap in (0, 4):
        assert sorted(map(tuple, tn.gap_merge(df, gap, width=width).select("uri", "spk", "s", "e", "n").collect())) == plain_merge(turns, gap)
    audio = {(u, k, s, e): 0 for u, k, s, e, _ in plain_merge(turns, 4)}
    for u, k, s, e in turns:
        audio[next(x for x in audio if x[:2] == (u, k) and x[2] <= s and e <= x[3])] += e - s
    got = tn.gap_merge_pieces(df, 4, 10, width=width).select("uri", "spk", "s", "e", "audio").collect()
    assert sorted(map(tuple, got)) == sorted((*x, n) for x, n in audio.items() if n >= 10)
    pieces = spark.createDataFrame([("r", 0, 3), ("r", 3, 4), ("r", 4, 9), ("r", 11, 12), ("q", 12, 30)], "uri string, s long, e long")
    assert sorted(map(tuple, iv.joined_zones(pieces, width=width).collect())) == [("q", 12, 30), ("r", 0, 9), ("r", 11, 12)]


def test_one_recording_is_many_tasks(spark, monkeypatch):
    """All rows have one key; after the shuffle several tasks hold a part of them each."""
    monkeypatch.setattr(scans, "SMALL", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.range(20000).select(F.lit("r").alias("uri"), F.lit(0).alias("spk"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 15).alias("e"))
        for df in (iv.active_segments(turns, width=5000), scanned(turns, ("uri",), "s", ["s"], 5000, m=("max", "e"))):
            held = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert len(held) >= 3 and max(h["count"] for h in held) < 0.7 * sum(h["count"] for h in held)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_timelines_in_buckets_too(spark, monkeypatch):
    """Queries over the given tables give the same rows either way."""
    from turnframe.plans import more  # noqa: F401
    from turnframe.plans import queries as own

    at = "/root/testdata/sf0.001"
    for name in ("der_components", "collar_uem", "asof_time_map_all", "early_close", "midpoint_in_uem"):
        monkeypatch.setattr(scans, "SMALL", 1 << 40)
        plain = sorted(map(repr, own.QUERIES[name](spark, at).collect()))
        monkeypatch.setattr(scans, "SMALL", 0)
        assert sorted(map(repr, own.QUERIES[name](spark, at).collect())) == plain
