"""Streams of turns: append-only merged turns, the refined view that is rewritten, and online clustering with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnframe.config import EngineConfig
from turnframe.operators.online import DECISIONS, State, decide_chunk


def merged_turns(turns: DataFrame, gap_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """(uri, spk, s, e, n) of turns (uri, spk, ts, length_ms): a session per speaker whose gap is each turn's own length and gap_ms.

    In a stream of outputMode append a turn appears once, when the watermark has passed its end by the gap; late rows are
    dropped by the watermark. On a static table it gives the same rows. s and e are timestamps.
    """
    gap = F.concat((F.col("length_ms") + gap_ms).cast("string"), F.lit(" milliseconds"))
    rows = turns.withWatermark("ts", watermark) if turns.isStreaming else turns
    found = rows.groupBy("uri", "spk", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("uri", "spk", F.col("w.start").alias("s"), F.expr(f"w.end - make_dt_interval(0, 0, 0, {gap_ms / 1000})").alias("e"), "n")


class ClusterProcessor:
    """Keeps one recording's clusters between micro-batches and answers each complete chunk once, in order.

    A chunk is held until it is the next one expected; one that came before is dropped. A row with chunk -1 ends the
    recording: what is held is answered in order, gaps or not.
    """

    def __init__(self, cfg: EngineConfig):
        self.cfg = cfg

    def init(self, handle) -> None:
        self.scalars = handle.getValueState("scalars", "next_id long, expected long")
        self.clusters = handle.getMapState("clusters", "id long", "n long, vec array<double>")
        self.merged = handle.getMapState("merged", "id long", "into long")
        self.held = handle.getMapState("held", "chunk long", "rows array<struct<local: long, vec: array<double>, duration: double, allow_update: boolean>>")

    def _load(self) -> tuple[State, int]:
        state, expected = State(), 0
        if self.scalars.exists():
            state.next_id, expected = self.scalars.get()
        for key, value in self.clusters.iterator():
            state.counts[key[0]], state.vectors[key[0]] = value[0], np.asarray(value[1], float)
        state.merged = {key[0]: value[0] for key, value in self.merged.iterator()}
        return state, expected

    def _store(self, state: State, expected: int) -> None:
        self.scalars.update((state.next_id, expected))
        for key in [k for (k,) in self.clusters.keys() if k not in state.vectors]:
            self.clusters.removeKey((key,))
        for k, v in state.vectors.items():
            self.clusters.updateValue((k,), (state.counts[k], v.tolist()))
        for k, v in state.merged.items():
            self.merged.updateValue((k,), (v,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state, expected = self._load()
        waiting = {k[0]: [dict(zip(("local", "vec", "duration", "allow_update"), r)) for r in v[0]] for k, v in self.held.iterator()}
        ended = False
        for pdf in rows:
            ended |= bool((pdf["chunk"] == -1).any())
            for chunk, part in pdf[pdf["chunk"] >= expected].groupby("chunk"):
                waiting.setdefault(int(chunk), []).extend(part[["local", "vec", "duration", "allow_update"]].to_dict("records"))
        out = []
        while waiting and (expected in waiting or ended):
            chunk = expected if expected in waiting else min(waiting)
            part = sorted(waiting.pop(chunk), key=lambda r: r["local"])
            out += [{"uri": key[0], "chunk": chunk, **r} for r in decide_chunk(state, part, self.cfg)]
            expected = chunk + 1
        for (k,) in list(self.held.keys()):
            self.held.removeKey((k,))
        for k, part in waiting.items():
            self.held.updateValue((k,), ([(int(r["local"]), list(map(float, r["vec"])) if r["vec"] is not None else None, float(r["duration"]), bool(r["allow_update"])) for r in part],))
        self._store(state, expected)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
        return iter([])

    def handleInitialState(self, key, initial_state, timer_values) -> None:
        pass

    def close(self) -> None:
        pass


def online_clusters_stream(observations: DataFrame, cfg: EngineConfig | None = None) -> DataFrame:
    """The rows of operators.online.online_clusters from a stream of observations, in which a chunk's rows come in one micro-batch. Needs the RocksDB state store."""
    from pyspark.sql.streaming import StatefulProcessor

    kind = type("KeyedClusters", (ClusterProcessor, StatefulProcessor), {})
    rows = observations.select("uri", "chunk", "local", "vec", "duration", "allow_update")
    return rows.groupBy("uri").transformWithStateInPandas(statefulProcessor=kind(cfg or EngineConfig()), outputStructType=DECISIONS, outputMode="Append", timeMode="None")


def refined_sink(path: str, refine, hook=None):
    """A foreachBatch function: appends the batch to <path>/raw and rewrites <path>/refined, a version a batch, with what refine makes of all raw rows.

    A batch that is run again replaces its own part of raw and its own version, so replays leave no doubled rows.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/raw/batch={batch_id}")
        raw = spark.read.parquet(f"{path}/raw").where(F.col("batch") <= batch_id)
        refine(raw.drop("batch")).write.mode("overwrite").parquet(f"{path}/refined/version={batch_id}")
        if hook:
            hook(batch, batch_id)

    return sink


def latest_refined(spark, path: str) -> DataFrame:
    """The newest version of the refined view."""
    every = spark.read.parquet(f"{path}/refined")
    newest = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == newest).drop("version")
