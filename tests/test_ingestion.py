"""Following files that grow, segments written in two phases, failures kept apart."""

import io
import json
import threading
import time
import wave
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnframe.sources import segments as sg
from turnframe.sources import tail as tl
from turnframe.streaming import control


def row(k, **more):
    return json.dumps({"uri": "r", "speaker_id": k, "start": k * 1.0, "end": k + 0.5, "path": f"/é{k}.wav", **more}, ensure_ascii=False)


@pytest.mark.parametrize("block", [3, 1 << 20])
@pytest.mark.parametrize("part", [1, 5, 1000])
def test_spans_hold_every_line_once(tmp_path, monkeypatch, block, part):
    monkeypatch.setattr(tl, "BLOCK", block)
    data = b"a\nbb\r\n\n\xff\xc3\xa9\n" + b"x" * 40 + b"\nlast one\npartial"
    (tmp_path / "f.txt").write_bytes(data)
    reader = tl.TailReader(str(tmp_path), "*.txt", part)
    end = reader.latestOffset()
    path = str(tmp_path / "f.txt")
    assert end == {path: len(data) - 7}
    want = [(0, "a"), (2, "bb"), (6, ""), (7, "�é"), (11, "x" * 40), (52, "last one")]
    for start, lines in ((0, want), (7, want[3:]), (52, want[5:])):
        got = [(at, line) for s in reader.partitions({path: start} if start else {}, end) for _, at, line in reader.read(s)]
        assert got == lines
    assert reader.partitions(end, end) == []
    with pytest.raises(ValueError, match="shrunk"):
        reader.partitions({path: 10**6}, end)
    (tmp_path / "_new.txt").write_bytes(b"hidden\n")
    (tmp_path / "other.log").write_bytes(b"not asked\n")
    assert reader.latestOffset() == end


def test_lines_written_in_pieces_come_once_and_a_restart_loses_none(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def add(name, text):
        with open(folder / name, "ab") as f:
            f.write(text if isinstance(text, bytes) else text.encode())

    def run():
        query = tl.tail_manifest(spark, str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return Counter(r.speaker_id for r in spark.read.parquet(out).collect())

    half = row(2).encode()
    add("a.segments.jsonl", row(1) + "\n" + "not json\n\n" + '{"uri": "r", "speaker_id": "x", "start": []}\n')
    add("a.segments.jsonl", half[:50])  # within a character, at worst
    add("other.jsonl", row(99) + "\n")
    assert run() == Counter([1])
    add("a.segments.jsonl", half[50:])
    assert run() == Counter([1])  # a line without its end is not one yet
    add("a.segments.jsonl", "\n" + row(3) + "\n")
    add("b.segments.jsonl", row(4) + "\n")
    assert run() == Counter([1, 2, 3, 4])
    assert run() == Counter([1, 2, 3, 4])
    assert {r.path for r in spark.read.parquet(out).collect()} == {f"/é{k}.wav" for k in (1, 2, 3, 4)}


def test_following_ends_after_the_sentinel_and_a_round_without_progress(spark, tmp_path):
    folder, marks = tmp_path / "in", str(tmp_path / "marks")
    folder.mkdir()

    def feed():
        for k in range(6):
            with open(folder / "a.segments.jsonl", "a") as f:
                f.write(row(k) + "\n")
            time.sleep(0.5)
        control.mark(spark, marks, "segments", "done")
        with open(folder / "a.segments.jsonl", "a") as f:  # later than the sentinel, but before a quiet round
            f.write(row(6) + "\n")

    writer = threading.Thread(target=feed)
    writer.start()
    query = tl.tail_manifest(spark, str(folder)).writeStream.format("memory").queryName("followed").start()
    tl.follow(query, lambda: control.reached(spark, marks, "segments", "done"), poll=0.2)
    writer.join()
    assert not query.isActive
    got = sorted(r.speaker_id for r in spark.table("followed").collect())
    assert got in (list(range(6)), list(range(7))) and len(got) == len(set(got))
    failing = tl.tail_manifest(spark, str(folder)).select(F.raise_error(F.lit("no")).alias("x")).writeStream.format("memory").queryName("fails").start()
    with pytest.raises(Exception, match="no"):
        tl.follow(failing, lambda: True, poll=0.1)


def segments(spark, n, bad=None):
    df = spark.range(n).repartition(3).select(F.format_string("r/%d", F.col("id") % 2).alias("uri"), F.col("id").alias("speaker_id"), (F.col("id") * 1.5).alias("start"), (F.col("id") * 1.5 + 1).alias("end"), F.lit(8000).alias("rate"), F.array(*[F.lit(x) for x in (0.0, 0.5, -1.0, 3.0)]).alias("pcm"))
    return df if bad is None else df.withColumn("pcm", F.when(F.col("speaker_id") == bad, F.raise_error(F.lit("killed")).cast("array<double>")).otherwise(F.col("pcm")))


def wavs(root):
    return sorted(map(str, Path(root).rglob("*.wav")))


def test_a_row_implies_its_file(spark, tmp_path):
    root = str(tmp_path / "s")
    sg.write_segments(segments(spark, 10), root)
    rows = sg.read_segments(spark, root).collect()
    assert sorted(r.speaker_id for r in rows) == list(range(10)) and sorted(r.path for r in rows) == wavs(root)
    with wave.open(rows[0].path) as w:
        assert (w.getframerate(), w.getnchannels()) == (8000, 1)
        assert np.frombuffer(w.readframes(4), "<i2").tolist() == [0, 16384, -32768, 32767]
    before = wavs(root)
    with pytest.raises(Exception, match="killed"):
        sg.write_segments(segments(spark, 30, bad=29), root)
    assert wavs(root) == before and sg.read_segments(spark, root).count() == 10
    assert not list((tmp_path / "s" / "_staging").iterdir())
    sg.write_segments(segments(spark, 3), root)
    assert sg.read_segments(spark, root).count() == 13 and len(wavs(root)) == 13
    sg.write_segments(segments(spark, 0), root)
    assert sg.read_segments(spark, root).count() == 13
    with pytest.raises(Exception, match="append"):
        segments(spark, 1).write.format("wav_segments").mode("overwrite").save(root)


def test_attempts_that_did_not_win_leave_nothing(tmp_path, monkeypatch):
    import pyarrow as pa

    class Context:
        attempt = 0

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return Context.attempt

    monkeypatch.setattr(sg.TaskContext, "get", classmethod(lambda cls: Context()))
    batch = pa.RecordBatch.from_pylist([{"uri": "r", "speaker_id": k, "start": 0.0, "end": 1.0, "rate": 8000, "pcm": [0.0]} for k in range(3)])

    def killed():
        yield batch
        raise KeyboardInterrupt

    writer = sg.SegmentStreamWriter(str(tmp_path), "stream")
    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    Context.attempt = 1
    won = writer.write(iter([batch]))
    Context.attempt = 2
    writer.write(iter([batch]))  # speculative, not told to the driver
    assert len(wavs(tmp_path)) == 9 and not (tmp_path / "manifest").exists()
    writer.commit([won, None], 0)
    named = [json.loads(x)["path"] for f in (tmp_path / "manifest").rglob("*.jsonl") for x in f.read_text().splitlines()]
    assert sorted(named) == wavs(tmp_path) and len(named) == 3
    again = sg.SegmentStreamWriter(str(tmp_path), "stream")  # the same micro-batch after a restart
    Context.attempt = 3
    again.commit([again.write(iter([batch]))], 0)
    named = [json.loads(x)["path"] for f in (tmp_path / "manifest").rglob("*.jsonl") for x in f.read_text().splitlines()]
    assert sorted(named) == wavs(tmp_path) and len(named) == 3
    Context.attempt = 4
    again.write(iter([batch]))
    again.abort([], 1)
    assert sorted(named) == wavs(tmp_path)


def test_segments_as_a_stream_and_their_tail(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "s")
    kind = segments(spark, 0).schema

    def run():
        sg.segments_stream(spark.readStream.schema(kind).parquet(source), root, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.speaker_id for r in sg.read_segments(spark, root).collect())

    segments(spark, 4).write.parquet(source)
    assert run() == [0, 1, 2, 3]
    segments(spark, 6).where("speaker_id >= 4").write.mode("append").parquet(source)
    assert run() == [0, 1, 2, 3, 4, 5] and len(wavs(root)) == 6
    query = tl.tail_manifest(spark, f"{root}/manifest").writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.speaker_id for r in spark.table("tailed").collect()) == [0, 1, 2, 3, 4, 5]


def test_cut_segments_and_callback(spark, tmp_path):
    audio = spark.createDataFrame([("r", 10, [k / 100 for k in range(40)])], "uri string, rate int, pcm array<double>")
    turns = spark.createDataFrame([("r", 1, 0.0, 0.5), ("r", 2, 1.04, 1.26), ("r", 3, 3.9, 9.0), ("r", 4, 7.0, 8.0), ("r", 5, -0.2, 0.1), ("x", 6, 0.0, 1.0)], "uri string, speaker_id long, start double, end double")
    got = sg.segment_audio(turns, audio)
    assert {r.speaker_id: [round(100 * x) for x in r.pcm] for r in got.collect()} == {1: [0, 1, 2, 3, 4], 2: [10, 11, 12], 3: [39], 5: [0]}
    folder = tmp_path / "seen"
    folder.mkdir()
    sg.on_segments(got, lambda r: (folder / str(r.speaker_id)).write_text(r.uri))
    assert sorted(f.name for f in folder.iterdir()) == ["1", "2", "3", "5"]


def test_a_failing_recording_leaves_the_others_alone(spark, tmp_path):
    rows = spark.range(60).select(F.format_string("r%d", F.col("id") % 6).alias("uri"), F.col("id").alias("x"))

    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.uri.iloc[0] == "r3":
            raise ValueError("bad audio")
        if pdf.uri.iloc[0] == "r4":
            return pd.DataFrame({"uri": [], "total": []})
        return pd.DataFrame({"uri": [pdf.uri.iloc[0]], "total": [int(pdf.x.sum())]})

    results, errors = control.isolated(rows, ["uri"], job, "uri string, total long", str(tmp_path / "t"))
    assert sorted(map(tuple, results.collect())) == [(f"r{k}", sum(range(k, 60, 6))) for k in (0, 1, 2, 5)]
    assert [(r.uri, r.error) for r in errors.collect()] == [("r3", "ValueError: bad audio")]
    none, fine = control.isolated(rows.limit(0), ["uri"], job, "uri string, total long", str(tmp_path / "u"))
    assert none.collect() == [] and fine.collect() == []


def test_small_parts_of_a_long_backlog_share_tasks(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    reader = tl.TailReader(str(tmp_path), "*", 64, tasks=8)
    runs = reader.partitions({}, reader.latestOffset())
    assert len(runs) <= 9 and [line for r in runs for _, _, line in reader.read(r)] == [f"line {i}" for i in range(5000)]


def test_lengths_of_segment_files_are_asked_for_in_tasks(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"u{i % 3}", i, float(i), i + 1.0, 8000, [0.1] * (i + 1)) for i in range(20)], sg.SEGMENTS)
    sg.write_segments(rows, str(tmp_path))
    found = sg.with_bytes(sg.read_segments(spark, str(tmp_path)))
    assert found.columns[-1] == "bytes" and {(r.speaker_id, r.bytes) for r in found.collect()} == {(i, 44 + 2 * (i + 1)) for i in range(20)}
    gone = found.orderBy("speaker_id").first().path
    Path(gone).unlink()
    assert found.where(F.col("path") == gone).first().bytes is None
