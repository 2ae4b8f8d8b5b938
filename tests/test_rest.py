import pytest
from pyspark.sql import functions as F

from turnframe.config import env_flag
from turnframe.operators import clusters as cl
from turnframe.operators import intervals as iv
from turnframe.sources import records as rc
from turnframe.streaming import control


def test_env_flag(monkeypatch):
    monkeypatch.delenv("TURNFRAME_X", raising=False)
    assert env_flag("TURNFRAME_X", True) and not env_flag("TURNFRAME_X", False)
    for raw, want in (("1", True), ("true", False), ("", False), ("0", False)):
        monkeypatch.setenv("TURNFRAME_X", raw)
        assert env_flag("TURNFRAME_X", not want) is want


def test_closure_of_long_chains_and_cycles(spark):
    chain = [("a", i, i + 1) for i in range(200)] + [("b", 5, 5), ("b", 1, 2)]
    got = {(r.uri, r.absorbed): r.survivor for r in cl.merge_closure(spark.createDataFrame(chain, "uri string, absorbed long, survivor long")).collect()}
    assert got == {**{("a", i): 200 for i in range(200)}, ("b", 1): 2, ("b", 5): 5}
    for cycle in ([("a", 1, 2), ("a", 2, 1)], [("a", 1, 2), ("a", 2, 3), ("a", 3, 1), ("a", 9, 1)]):
        with pytest.raises(ValueError):
            cl.merge_closure(spark.createDataFrame(cycle, "uri string, absorbed long, survivor long"), most=12)


def test_many_points_in_one_recording(spark):
    import time

    n = 100_000
    points = spark.range(n).select(F.col("id"), F.lit("a").alias("uri"), (F.col("id") * 10 + 3).alias("t"))
    anchors = spark.range(n // 10).select(F.lit("a").alias("uri"), (F.col("id") * 100).alias("t"), (F.col("id") * 200).alias("to"))
    began = time.perf_counter()
    assert iv.interpolated(points, anchors).where("mapped = 2 * t or t > 999900").count() == n
    assert time.perf_counter() - began < 30


def test_sentinels(spark, tmp_path):
    path = str(tmp_path / "marks")
    assert not control.reached(spark, path, "asr", "ready")
    control.mark(spark, path, "asr", "ready")
    assert control.reached(spark, path, "asr", "ready") and not control.reached(spark, path, "asr", "done")
    control.mark(spark, path, "asr", "done")
    assert [(r.stage, r.state) for r in control.states(spark.read.parquet(path)).collect()] == [("asr", "done")]


def test_wrong_rates_are_set_apart(spark):
    good, bad = rc.at_rate(spark.createDataFrame([("x.wav", 16000), ("y.wav", 8000), (None, None)], "path string, sample_rate int"), 16000)
    assert [r.path for r in good.collect()] == ["x.wav"]
    assert sorted(r.error for r in bad.collect()) == ["segment sample rate mismatch: ? is unknown, expected 16000", "segment sample rate mismatch: y.wav is 8000, expected 16000"]


def test_strict_types(spark):
    from turnframe.sources import rttm

    lines = lambda *x: spark.createDataFrame([(y,) for y in x], "line string")
    got = rttm.parse_strict(lines("speaker f 1 1.0 2.0 <NA> <NA> a <NA>", "NO_RT_METADATA f 1 1.0 2.0 <NA> <NA> <NA> <NA>")).collect()
    assert [r.type for r in got] == ["SPEAKER", "NO_RT_METADATA"]
    for bad in ("LEXEME f 1 1.0 2.0 w <NA> a <NA>", "SPKR-INFO f 1 <NA> <NA> <NA> <NA> a <NA>"):
        with pytest.raises(Exception, match="unknown subtype"):
            rttm.parse_strict(lines(bad)).collect()


def test_one_reference_is_for_one_file(spark):
    from turnframe.operators import scoring as sc

    files = spark.createDataFrame([("/s/a.rttm",), ("/s/b.rttm",)], "path string")
    assert {(r.ref_path, r.reason) for r in sc.single_reference(files, "/r/x.rttm").collect()} == {(None, "a single reference for several files")}
    assert [(r.uri, r.ref_path, r.reason) for r in sc.single_reference(files.limit(1), "/r/x.rttm").collect()] == [("a", "/r/x.rttm", None)]
