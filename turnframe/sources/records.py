"""JSON lines, key=value summaries, manifests, chunk files and audio."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.functions.text import stem

MANIFEST = "uri string, speaker_id long, start double, end double, path string"
TRANSCRIPT = "uri string, speaker_id long, start double, end double, text string"
STATUS = "uri string, final boolean, post_merge_min_speech_duration double, speakers array<struct<id: long, duration: double, uncertain: boolean, merged_into: long>>, merge_events array<struct<absorbed: long, survivor: long, kind: string>>"


def read_manifest(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines of audio segments; corrupt lines are skipped. As a stream, each new file is read once."""
    reader = (spark.readStream if streaming else spark.read).schema(f"{MANIFEST}, _corrupt_record string").option("mode", "PERMISSIVE")
    return reader.json(path).where("_corrupt_record is null and uri is not null").drop("_corrupt_record")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Each field cast, rows with a missing or bad one left out."""
    lines = spark.read.text(path)
    part = lambda name, kind: F.get_json_object("value", f"$.{name}").try_cast(kind).alias(name)
    return lines.select(part("uri", "string"), part("speaker_id", "long"), part("start", "double"), part("end", "double"), part("text", "string")).dropna()


def write_transcript(rows: DataFrame, path: str) -> None:
    """All rows, sorted in each recording, replacing what was there; times with three decimals."""
    out = rows.where("trim(text) <> ''").withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})
    out.repartition("uri").sortWithinPartitions("uri", "start", "end").write.mode("overwrite").json(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """(uri, status) with status null where a file is half written."""
    files = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(F.regexp_replace(stem(F.col("path")), r"\.speakers$", "").alias("uri"), F.from_json("value", STATUS, {"mode": "PERMISSIVE"}).alias("status")).withColumn("status", F.when(F.col("status.uri").isNotNull(), F.col("status")))


def discover(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(uri, path) of the files below folder that match; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return found.select(stem(F.col("path")).alias("uri"), "path")


def listed_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a text file that lists one each line; blanks and comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' and not startswith(path, '#')")


def key_values(lines: DataFrame) -> DataFrame:
    """(key, value) of lines key=value, split at the first sign."""
    cut = F.split("line", "=", 2)
    return lines.where("instr(line, '=') > 1").select(F.trim(cut[0]).alias("key"), F.trim(cut[1]).alias("value"))


def to_key_values(row: DataFrame) -> DataFrame:
    """(line) key=value for each column of a frame; nulls are left out."""
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.concat_ws("=", F.lit(c), F.col(c).cast("string"))) for c in row.columns])
    return row.select(F.explode(F.array_compact(pairs)).alias("line"))


def append_run(row: DataFrame, path: str) -> None:
    """A ledger: every run adds its line files and changes none."""
    to_key_values(row).write.mode("append").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk artifacts by recording, so that a reader of one prunes the rest."""
    chunks.write.partitionBy("uri").mode("overwrite").parquet(path)


def unflattened(flat: DataFrame) -> DataFrame:
    """(uri, chunk_index, scores) of recordings stored flat (uri, values, sizes): running sums of sizes give each chunk's slice."""
    each = flat.select("uri", "values", F.posexplode("sizes").alias("chunk_index", "n"), F.col("sizes"))
    offset = F.aggregate(F.slice("sizes", 1, F.col("chunk_index")), F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select("uri", "chunk_index", F.slice("values", (offset + 1).cast("int"), F.col("n").cast("int")).alias("scores"))


def flattened(chunks: DataFrame) -> DataFrame:
    """(uri, values, sizes) of chunks (uri, chunk_index, scores); a recording's chunks are gathered, as one file holds them."""
    packed = chunks.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "scores"))).alias("c"))
    return packed.select("uri", F.flatten(F.transform("c", lambda x: x["scores"])).alias("values"), F.transform("c", lambda x: F.size(x["scores"]).cast("long")).alias("sizes"))


def chunk_frames(path_column: str = "content"):
    """For mapInPandas over binaryFile: rows (uri, chunk_index, frame, slot, score) of npz files with arrays seg (flat), frames and slots by chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf[path_column]):
                data, at = np.load(io.BytesIO(content), allow_pickle=False), 0
                for k, (n, m) in enumerate(zip(data["frames"], data["slots"])):
                    seg = data["seg"][at : at + n * m].reshape(n, m)
                    at += n * m
                    frame, slot = np.indices(seg.shape)
                    yield pd.DataFrame({"uri": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "chunk_index": k, "frame": frame.ravel(), "slot": slot.ravel(), "score": seg.ravel().astype(float)})

    return run


def read_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(chunk_frames(), "uri string, chunk_index long, frame long, slot long, score double")


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            with wave.open(io.BytesIO(content)) as w:
                if w.getsampwidth() != 2:
                    continue
                pcm = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
                out.append((path.rsplit("/", 1)[-1].rsplit(".", 1)[0], w.getframerate(), pcm.tolist()))
        yield pd.DataFrame(out, columns=["uri", "rate", "pcm"])


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(uri, rate, pcm) of 16-bit wav files, as the mean of their channels in [-1, 1); other sample widths are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(_decoded, "uri string, rate int, pcm array<double>")


def byte_range(content, header: str):
    """The part of a binary column that a range header `bytes=a-b`, `a-` or `-n` asks for; null where it can't be met."""
    import re

    m = re.fullmatch(r"bytes=(\d*)-(\d*)", header)
    if not m or not (m[1] or m[2]):
        return F.lit(None).cast("binary")
    n = F.octet_length(content)
    first = F.lit(int(m[1])) if m[1] else F.greatest(n - int(m[2]), F.lit(0))
    last = F.least(F.lit(int(m[2])), n - 1) if m[1] and m[2] else n - 1
    return F.when((first < n) & (last >= first), F.substring(content, first + 1, last - first + 1))


EMBEDDINGS = ["uri", "embedding", "local_idx", "start", "end", "duration"]


def write_embeddings(observations: DataFrame, path: str) -> None:
    """Observations (uri, vec, local, s, e, duration) that have a vector, by recording; one without any gets no file."""
    found = observations.where("vec is not null").select("uri", F.col("vec").alias("embedding"), F.col("local").cast("long").alias("local_idx"), F.col("s").cast("double").alias("start"), F.col("e").cast("double").alias("end"), F.col("duration").cast("double").alias("duration"))
    found.write.partitionBy("uri").mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*EMBEDDINGS)


def at_rate(segments: DataFrame, rate: int) -> tuple[DataFrame, DataFrame]:
    """(segments, errors): those of sample_rate `rate`, and the others with an error, for a table of failures. A null rate is an error."""
    right = F.coalesce(F.col("sample_rate") == rate, F.lit(False))
    said = F.concat(F.lit("segment sample rate mismatch: "), F.coalesce("path", F.lit("?")), F.lit(" is "), F.coalesce(F.col("sample_rate").cast("string"), F.lit("unknown")), F.lit(f", expected {rate}"))
    return segments.where(right), segments.where(~right).withColumn("error", said)


def artifact_counts(paths: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, n): how many of paths (path) end as kinds (kind: ending) say; kinds without files have 0."""
    counts = paths.agg(*[F.count_if(F.endswith("path", F.lit(end))).alias(kind) for kind, end in kinds.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("x.kind", "x.n")
