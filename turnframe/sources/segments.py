"""A sink of audio segments in two phases: wav files first, the manifest that names them at commit.

Every attempt of a task writes its wav files to a folder of its own and stages the rows that name them. The commit moves the
staged rows of the attempts that succeeded to the manifest, all at once, and removes what other attempts have left; an abort
removes everything. So a row of the manifest implies its file, whatever attempts were killed. A micro-batch that is run
again replaces its own rows and files. One stream writes to a root at a time; batch jobs may write beside it.
"""

from __future__ import annotations

import io
import json
import uuid
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import LongType, Row, StructField, StructType

from turnframe.sources.folders import store
from turnframe.sources.records import MANIFEST

SEGMENTS = "uri string, speaker_id long, start double, end double, rate int, pcm array<float>"
ENDING = ".segments.jsonl"


def wav_bytes(pcm: np.ndarray, rate: int) -> bytes:
    """One channel of 16 bits; samples outside [-1, 1) are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(np.asarray(pcm, float) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


@dataclass
class Staged(WriterCommitMessage):
    attempt: str


class _Segments:
    """What the batch and the stream writer share."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root.rstrip("/"), run

    def _at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        system, top = store(self.root)
        return system, "/".join([top, *parts])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        system, staging = self._at("_staging", self.run)
        _, audio = self._at("audio", attempt)
        system.create_dir(staging)
        with system.open_output_stream(f"{staging}/{attempt}{ENDING}") as rows:  # there from the start: it tells of a killed attempt
            for batch in batches:
                for r in batch.to_pylist():
                    folder = f"{audio}/{quote(r['uri'], safe='')}"
                    path = f"{folder}/spk{r['speaker_id']}_{r['start']:.3f}_{r['end']:.3f}.wav"
                    system.create_dir(folder)
                    with system.open_output_stream(path) as f:
                        f.write(wav_bytes(r["pcm"], r["rate"]))
                    row = {"uri": r["uri"], "speaker_id": r["speaker_id"], "start": round(r["start"], 3), "end": round(r["end"], 3), "path": path}
                    rows.write((json.dumps(row, ensure_ascii=False) + "\n").encode())
        return Staged(attempt)

    def _names(self, folder: str) -> list[str]:
        system, _ = self._at()
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [f.base_name.removesuffix(ENDING) for f in found if f.is_file]

    def _remove(self, folder: str) -> None:
        system, _ = self._at()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)

    def _publish(self, messages: list[Staged | None], job: str) -> None:
        system, staging = self._at("_staging", self.run)
        won = {m.attempt for m in messages if m is not None}
        ready, final = self._at("_staging", f"{self.run}.{job}")[1], self._at("manifest", job)[1]
        system.create_dir(ready)
        for name in self._names(staging):
            if name in won:
                system.move(f"{staging}/{name}{ENDING}", f"{ready}/{name}{ENDING}")
            else:
                self._remove(self._at("audio", name)[1])
        for name in self._names(final):  # of an earlier run of this micro-batch
            self._remove(self._at("audio", name)[1])
        self._remove(final)
        system.create_dir(self._at("manifest")[1])
        system.move(ready, final)
        self._remove(staging)

    def _withdraw(self) -> None:
        _, staging = self._at("_staging", self.run)
        for name in self._names(staging):
            self._remove(self._at("audio", name)[1])
        self._remove(staging)


class SegmentWriter(_Segments, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self._publish(messages, self.run)

    def abort(self, messages) -> None:
        self._withdraw()


class SegmentStreamWriter(_Segments, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self._publish(messages, f"batch-{batchId}")

    def abort(self, messages, batchId: int) -> None:
        self._withdraw()


class SegmentSink(DataSource):
    """Format `wav_segments`: rows as in SEGMENTS; option path is the root folder."""

    @classmethod
    def name(cls) -> str:
        return "wav_segments"

    def schema(self) -> str:
        return SEGMENTS

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        if overwrite:
            raise ValueError("segments are only ever added: use mode append")
        return SegmentWriter(self.options["path"], uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> SegmentStreamWriter:
        return SegmentStreamWriter(self.options["path"], "stream")  # the same in every process: Spark makes several of them


def _columns(segments: DataFrame) -> DataFrame:
    return segments.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in SEGMENTS.split(", ")])


def write_segments(segments: DataFrame, path: str) -> None:
    """Adds segments, as in SEGMENTS, below path."""
    segments.sparkSession.dataSource.register(SegmentSink)
    _columns(segments).write.format("wav_segments").mode("append").save(path)


def segments_stream(segments: DataFrame, path: str, checkpoint: str):
    """A streaming query's writer that adds segments below path; start() it."""
    segments.sparkSession.dataSource.register(SegmentSink)
    return _columns(segments).writeStream.format("wav_segments").option("path", path).option("checkpointLocation", checkpoint)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifest")


def with_bytes(segments: DataFrame) -> DataFrame:
    """segments (with path) and bytes, the length of each one's file, null where there is none. The tasks ask for it, so no list of files comes to the driver."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = [store(p) for p in b.column("path").to_pylist()]
            system = asked[0][0] if asked else None
            there = system.get_file_info([at for _, at in asked]) if asked else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f.size if f.is_file else None for f in there], pa.int64())], names=[*b.schema.names, "bytes"])

    return segments.mapInArrow(lengths, StructType([*segments.schema.fields, StructField("bytes", LongType())]))


def segment_audio(turns: DataFrame, audio: DataFrame) -> DataFrame:
    """Segments of turns (uri, speaker_id, start, end, in seconds) cut from audio (uri, rate, pcm). Times beyond the audio give what there is; empty segments are left out."""
    first = F.greatest(F.floor(F.col("start") * F.col("rate") + 0.5), F.lit(0)).cast("int")
    n = F.greatest(F.floor(F.col("end") * F.col("rate") + 0.5).cast("int") - first, F.lit(0))
    return turns.join(audio, "uri").select("uri", "speaker_id", "start", "end", "rate", F.slice("pcm", first + 1, n).alias("pcm")).where("size(pcm) > 0")


def on_segments(segments: DataFrame, callback: Callable[[Row], None]) -> None:
    """Calls callback with every segment, on the executors, each at least once: a segment whose task is run again comes again."""

    def each(rows: Iterator[Row]) -> None:
        for r in rows:
            callback(r)

    segments.foreachPartition(each)
