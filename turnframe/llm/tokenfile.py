"""Token-ID output: documents are encoded, written as range-coded segments and read back.

Documents are dealt into shards by ranges of doc_id and sorted, so shards in order hold the documents in ascending doc_id
order. A shard's rows are segments of whole documents: (shard, segment, doc_ids, counts, data), where data is in the
format of mixcoder and counts has the number of ids of each document, its end id included. The container is Parquet: its
committer makes a shard appear whole or not at all, so a lost executor's task is run again.

Rows: a null text is empty (the end id alone); a null doc_id comes first; rows with equal doc_id follow each other in the
order of their texts. Extra columns are ignored; an empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnframe.llm import mixcoder
from turnframe.llm.chunks import encode_byte_level
from turnframe.llm.common import shared_folder
from turnframe.llm.shipping import hand_back

VOCABULARY, N_IDS, END = "byte_bpe_50k.json", 50257, 0
#: A segment is closed once it holds this many ids; one document is never split over two.
SEGMENT = 4_000_000
#: Bytes of text that a shard aims at: many blocks side by side are coded in less time, and two segments fit into memory.
SHARD_BYTES = 10_000_000
#: Texts are encoded so many bytes at a time, and one at least.
TEXT_BYTES = 4_000_000
ROWS = "shard int, segment int, doc_ids array<long>, counts array<int>, data binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _segments(path: str, end: int, n_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        doc_ids, counts, parts, total = [], [], [], 0

        def closed():
            ids = np.concatenate(parts)
            one = lambda x, t: pa.array([x], t)
            columns = [one(shard, pa.int32()), one(number, pa.int32()), one(doc_ids, pa.list_(pa.int64())), one(counts, pa.list_(pa.int32())), one(mixcoder.encode(ids, n_ids), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "segment", "doc_ids", "counts", "data"])

        for batch in batches:
            texts = batch.column("text")
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < len(texts):
                upto = max(first + 1, int(np.searchsorted(ends, TEXT_BYTES + (ends[first - 1] if first else 0), "right")))
                ids, n = encode_byte_level(texts.slice(first, upto - first), path)
                doc_ids += batch.column("doc_id").slice(first, upto - first).to_pylist()
                counts += (n + 1).tolist()
                parts.append(np.insert(ids, np.cumsum(n), end))
                total += len(parts[-1])
                first = upto
                if total >= SEGMENT:
                    yield closed()
                    number += 1
                    doc_ids, counts, parts, total = [], [], [], 0
        if doc_ids:
            yield closed()
        hand_back()

    return run


def write_tokens(documents: DataFrame, folder: str, path: str | None = None, end: int = END, n_ids: int = N_IDS) -> None:
    """Writes the ids of documents (doc_id, text) to folder."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(path or vocabulary_path(), end, n_ids), ROWS).write.parquet(folder)


def _documents(n_ids: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = mixcoder.decode(row["data"], n_ids), row["counts"]
                if len(ids) != sum(counts):
                    raise ValueError("a segment doesn't hold what its counts say")
                ends = np.cumsum(counts, dtype=np.int64).tolist()
                cuts = list(zip([0, *ends[:-1]], ends))
                k = len(counts)
                raw = ids.astype("<u4", copy=False)
                columns = [pa.array([row["shard"]] * k, pa.int32()), pa.array([row["segment"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array([a for a, _ in cuts], pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(raw[a:b]) for a, b in cuts], pa.int64())]
                names = ["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([raw[a:b] for a, b in cuts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        hand_back()

    return run


def read_tokens(spark, folder: str, n_ids: int = N_IDS, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and, if asked for, ids: decoded from the files; start counts the ids of all documents before."""
    files = spark.read.schema(ROWS).parquet(folder)
    # one small row for each segment: its ids, and those of the segments before it
    sums = files.select("shard", "segment", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = sums.select("shard", "segment", (F.sum("n").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n")).alias("segment_start"))
    starts = inside.join(before, "shard")
    each = files.mapInArrow(_documents(n_ids, with_ids), "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    got = each.join(starts, ["shard", "segment"])
    return got.select("doc_id", (F.col("shard_start") + F.col("segment_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op8_tokens(documents: DataFrame) -> DataFrame:
    folder = f"{shared_folder(documents.sparkSession)}/tokens"
    write_tokens(documents, folder)
    return read_tokens(documents.sparkSession, folder)
