"""Sources, sinks, text functions, logs, alignment and export."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnframe.functions import text as tx
from turnframe.operators import alignment as al
from turnframe.operators import export as ex
from turnframe.operators import sessions as ss
from turnframe.sources import records as rc
from turnframe.sources import rttm


def lines(spark, *some):
    return spark.createDataFrame([(x,) for x in some], "line string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


GOOD = "SPEAKER f 1 0.50 1.25 <NA> <NA> spk0 <NA> <NA>"


def test_lenient_skips(spark):
    got = rttm.parse_lenient(lines(spark, GOOD, "", "# c", "SPEAKER f 1 x 1 <NA> <NA> a <NA>", "SPEAKER f 1", "LEXEME f 1 1 1 w lex a <NA>")).collect()
    assert [(r.type, r.tbeg, r.tdur) for r in got] == [("SPEAKER", 0.5, 1.25), ("LEXEME", 1.0, 1.0)]
    assert rttm.parse_refined(lines(spark, GOOD, "LEXEME f 1 1 1 w lex a <NA>")).count() == 1


def test_strict_fails(spark):
    ok = rttm.parse_strict(lines(spark, GOOD, "; c", "LEXEME f 1 1.0* <NA> w lex a <NA>")).collect()
    assert [(r.type, r.tbeg, r.tdur) for r in ok] == [("SPEAKER", 0.5, 1.25), ("LEXEME", 1.0, 0.0)]
    for bad in ("SPEAKER f 1 1 1", "NOPE f 1 1 1 <NA> <NA> a <NA>", "SPEAKER f 1 -1 1 <NA> <NA> a <NA>", "SPEAKER f 1 x 1 <NA> <NA> a <NA>", "LEXEME f 1 1 1 w nope a <NA>"):
        with pytest.raises(Exception):
            rttm.parse_strict(lines(spark, bad)).collect()


def test_gender(spark):
    recs = rttm.parse_strict(lines(spark, GOOD, GOOD.replace("spk0", "spk1"), "SPKR-INFO f 1 <NA> <NA> <NA> adult_male spk0 <NA>"))
    assert {r.spkr: r.gender for r in rttm.with_gender(recs).collect()} == {"spk0": "adult_male", "spk1": "unknown"}
    twice = recs.union(recs.where("type = 'SPKR-INFO'"))
    with pytest.raises(Exception):
        rttm.with_gender(twice).collect()


def test_uem_and_glm(spark):
    got = rttm.parse_uem(lines(spark, "dir/f.sph 1 0.0 10.0", "; c", "f 1 12 20")).collect()
    assert sorted((r.uri, r.tbeg, r.tend) for r in got) == [("f", 0.0, 10.0), ("f", 12.0, 20.0)]
    for bad in (("f 1 5 5",), ("f 1 0 10", "f 1 9 12")):
        with pytest.raises(Exception):
            rttm.parse_uem(lines(spark, *bad)).collect()
    assert [tuple(r) for r in rttm.parse_glm(lines(spark, "; no", "GONNA => going to")).collect()] == [("gonna", "going to")]


def test_files_round_trip(spark, tmp_path):
    p = str(tmp_path / "r")
    rttm.write_lines(lines(spark, GOOD), p)
    rttm.write_lines(lines(spark, GOOD.replace("spk0", "spk1")), p, "append")
    assert {r.spkr for r in rttm.read_rttm(spark, p).collect()} == {"spk0", "spk1"}
    assert [tuple(r) for r in rttm.speaker_summary(rttm.read_rttm(spark, p, mode="strict")).orderBy("spkr").collect()] == [("f", "spk0", 1, 1.25), ("f", "spk1", 1, 1.25)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"uri": "a", "speaker_id": 1, "start": 0.5, "end": 1, "path": "p"}\n{broken\n\n{"uri": "b", "spea')
    assert [r.uri for r in rc.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()] == ["a"]
    (tmp_path / "t.jsonl").write_text('{"uri": "a", "speaker_id": 1, "start": 0.5, "end": 1, "text": "x"}\n{"uri": "a", "speaker_id": "q", "start": 0, "end": 1, "text": "y"}\n')
    rows = rc.read_transcript(spark, str(tmp_path / "t.jsonl"))
    assert [(r.speaker_id, r.text) for r in rows.collect()] == [(1, "x")]
    rc.write_transcript(rows, str(tmp_path / "out"))
    assert rc.read_transcript(spark, str(tmp_path / "out")).count() == 1
    (tmp_path / "a.speakers.json").write_text('{"uri": "a", "final": true, "speakers": [{"id": 1}]}')
    (tmp_path / "b.speakers.json").write_text('{"uri": "b", "fin')
    assert {r.uri: r.status is None for r in rc.read_status(spark, str(tmp_path / "*.speakers.json")).collect()} == {"a": False, "b": True}
    assert {r.uri for r in rc.discover(spark, str(tmp_path), "*.jsonl").collect()} == {"m", "t"}


def test_key_values(spark, tmp_path):
    row = spark.createDataFrame([(2, "a=b", None)], "files int, name string, none string")
    kv = rc.to_key_values(row)
    assert {r.key: r.value for r in rc.key_values(kv).collect()} == {"files": "2", "name": "a=b"}
    rc.append_run(row, str(tmp_path / "runs"))
    rc.append_run(row, str(tmp_path / "runs"))
    assert spark.read.text(str(tmp_path / "runs")).count() == 4
    rc.write_csv(row, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().name == "a=b"
    (tmp_path / "list.txt").write_text("# c\n a.wav \n\nb.wav\n")
    assert [r.path for r in rc.listed_paths(spark, str(tmp_path / "list.txt")).collect()] == ["a.wav", "b.wav"]


def test_chunks_ragged(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, []), ("a", 2, [3.0])], "uri string, chunk_index int, scores array<double>")
    back = rc.unflattened(rc.flattened(chunks)).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.scores) for r in back] == [(0, [1.0, 2.0]), (1, []), (2, [3.0])]
    rc.write_chunks(chunks, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("uri = 'a'").count() == 3
    np.savez(tmp_path / "x.npz", seg=np.arange(10.0), frames=[2, 4], slots=[1, 2])
    got = rc.read_chunk_files(spark, str(tmp_path)).orderBy("chunk_index", "frame", "slot").collect()
    assert [r.score for r in got] == list(np.arange(10.0)) and got[2].chunk_index == 1


def test_audio(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[100, 300], [-32768, -32768]], "<i2").tobytes())
    r = rc.read_audio(spark, str(tmp_path)).first()
    assert (r.uri, r.rate, r.pcm) == ("a", 8000, [200 / 32768, -1.0])
    b = spark.createDataFrame([(bytearray(b"0123456789"),)], "c binary")
    ask = lambda h: b.select(rc.byte_range(F.col("c"), h).alias("x")).first().x
    assert [bytes(x) if (x := ask(h)) is not None else None for h in ("bytes=2-4", "bytes=7-", "bytes=-3", "bytes=5-99", "bytes=12-", "x")] == [b"234", b"789", b"789", b"56789", None, None]
    assert io is not None


def test_text_functions(spark):
    L = F.lit
    assert one(spark, tx.stitch(L("abcde"), L("deXY"))) == "XY" and one(spark, tx.stitch(L("abc"), L("xyz"))) == "xyz" and one(spark, tx.stitch(L("aa"), L("aa"))) == ""
    assert one(spark, tx.event_key(L("saved: 12"))) == "saved" and one(spark, tx.event_key(L("one 2 three four five six"))) == "one # three four five"
    assert one(spark, tx.tag(L("[x] y"))) == "x" and one(spark, tx.tag(L("y"))) == "general" and one(spark, tx.untagged(L("[x] y"))) == "y"
    assert one(spark, tx.clock(L(3661.0425))) == "1:01:01.042"
    assert one(spark, tx.speaker_label(L(3), L(1), L(True))) == "3→1?" and one(spark, tx.speaker_label(L(3), L(None), L(False))) == "3"
    assert one(spark, tx.clean_time(L("*1.5"))) == 1.5 and one(spark, tx.clean_time(L("<NA>"))) == 0.0
    assert one(spark, tx.sample_index(L(0.5), 3, L(10).cast("long"))) == 2 and one(spark, tx.sample_slice(L(1.0), L(1.0), 8, L(10).cast("long"))) is None
    assert one(spark, tx.powerset_slots(L(4), 3, 2)) == [1, 1, 0]
    assert one(spark, tx.padded(F.array(L(1.0)), 3)) == [1.0, 0.0, 0.0]
    assert one(spark, tx.joined_slices(F.array(*map(L, [1, 2, 3, 4])), F.array(F.struct(L(0).alias("a"), L(1).alias("b")), F.struct(L(2).alias("a"), L(4).alias("b"))))) == [1, 3, 4]
    assert one(spark, tx.without_prefix(L("abc def"), L("abc"))) == "def" and one(spark, tx.tail(L("abcdef"), 2)) == "ef"
    assert one(spark, tx.stem(L("a/b.c.wav"))) == "b.c" and one(spark, tx.frame_centres(L(2), 0.5)) == [0.25, 0.75] and one(spark, tx.colour(L(13))) == 1


def test_alignment(spark):
    schema = "uri string, idx long, word string, s double, e double"
    ref = spark.createDataFrame([("u", i, w, float(i), i + 0.8) for i, w in enumerate("the cat sat on mats".split())], schema)
    sys = spark.createDataFrame([("u", i, w, t, t + 0.8) for i, (w, t) in enumerate([("the", 0.0), ("bat", 1.0), ("on", 3.1), ("mats", 4.0), ("now", 9.0)])], schema)
    got = al.aligned_words(ref, sys)
    assert [r.kind for r in got.orderBy(F.coalesce("ref_idx", F.lit(99))).collect()] == ["cor", "sub", "del", "cor", "cor", "ins"]
    r = al.word_errors(got).first()
    assert (r.words, r.cor, r.sub, r.dele, r.ins, r.wer) == (5, 3, 1, 1, 1, 60.0)


def test_export_decisions(spark):
    rows = [(0, True, 2, 2, 0.9, "mix"), (5, False, 2, 2, 0.9, "mix"), (5, True, 1, 2, 0.9, "mix"), (5, True, 2, 0, 0.9, "mix"), (5, True, 2, 1, None, "winner"), (5, True, 2, 2, 0.9, "separate"), (5, True, 2, 2, 0.1, "mix"), (5, True, 2, 2, None, "mix")]
    df = spark.createDataFrame(rows, "o int, sep boolean, c int, p int, sim double, want string")
    got = df.withColumn("got", ex.overlap_decision(F.col("o"), F.col("sep"), F.col("c"), F.col("p"), F.col("sim"), 0.3))
    assert got.where("got <> want").count() == 0
    frames = spark.createDataFrame([("u", 0, 0, 1, False), ("u", 0, 1, 1, True), ("u", 0, 1, 2, True)], "uri string, chunk long, frame long, spk long, overlap boolean")
    won = spark.createDataFrame([("u", 0, "winner", 2)], "uri string, chunk long, decision string, winner long")
    assert sorted((r.frame, r.spk, r.source) for r in ex.exported_frames(frames, won).collect()) == [(0, 1, "mix"), (1, 2, "mix")]
    two = spark.createDataFrame([("u", 0, "separate", None)], won.schema)
    assert sorted((r.frame, r.spk, r.source) for r in ex.exported_frames(frames, two).collect()) == [(0, 1, "mix"), (1, 1, "track"), (1, 2, "track")]


def test_gate_and_prefix(spark):
    a = spark.createDataFrame([(1, 3.0), (1, 4.0), (2, 1.0)], "k long, x double")
    m = spark.createDataFrame([(1, 5.0)], "k long, x double")
    assert {r.k: r.passed for r in ss.energy_gate(a, m, ("k",), 0.5).collect()} == {1: True, 2: False}
    old = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("v", 1, "a")], "uri string, seq int, text string")
    new = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 3, "c"), ("v", 1, "z")], "uri string, seq int, text string")
    assert {r.uri: r.unchanged for r in ss.unchanged_prefix(old, new).collect()} == {"u": True, "v": False}
