"""One way to ask for the speakers of observations, whichever backend decides: at once after each chunk, or after a recording's end.

A backend that is not deferred answers a chunk when it is complete; a deferred one holds a recording until it ends, and then
answers all its chunks. Both give (uri, chunk, local, global_id), from a table or from a stream, and the same rows from either.
In a stream a recording ends with a row of chunk -1, or, for a deferred backend with idle_ms, when nothing has come for so long; such a
stream runs until it is stopped, as its timers are Spark's reason for another batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from turnframe.config import EngineConfig
from turnframe.operators.online import agglomerate, ahc_clusters, online_clusters
from turnframe.streaming.turns import online_clusters_stream

SPEAKERS = "uri long, chunk long, local long, global_id long"
COLUMNS = ["uri", "chunk", "local", "global_id"]


class DeferredProcessor(StatefulProcessor):
    """Holds a recording's observations as a list and clusters them as a whole at its end, once; what comes after the end is dropped.

    A call appends what came and touches nothing held before. Memory at the end grows with the recording.
    """

    def __init__(self, cfg: EngineConfig, idle_ms: int | None):
        self.cfg, self.idle_ms = cfg, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "chunk long, local long, vec array<double>")
        self.done = handle.getValueState("done", "at long")

    def _answer(self, key) -> Iterator[pd.DataFrame]:
        rows = sorted(self.held.get(), key=lambda r: (r[0], r[1])) if self.held.exists() else []
        self.held.clear()
        self.done.update((len(rows),))
        labels = agglomerate([r[2] for r in rows], self.cfg.ahc_threshold, self.cfg.ahc_linkage)
        yield pd.DataFrame([(key[0], r[0], r[1], g) for r, g in zip(rows, labels)], columns=COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            yield pd.DataFrame([], columns=COLUMNS)
            return
        ended, new = False, []
        for pdf in rows:
            ended |= bool((pdf["chunk"] == -1).any())
            some = pdf[(pdf["chunk"] >= 0) & pdf["vec"].notna()]
            new += [(int(c), int(k), [float(x) for x in v]) for c, k, v in zip(some["chunk"], some["local"], some["vec"])]
        if new:
            self.held.appendList(new)
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        if ended:
            yield from self._answer(key)
            return
        if self.idle_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._answer(key)

    def close(self) -> None:
        pass


def _deferred_stream(observations: DataFrame, cfg: EngineConfig, idle_ms: int | None) -> DataFrame:
    rows = observations.select("uri", "chunk", "local", "vec")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return rows.groupBy("uri").transformWithStateInPandas(statefulProcessor=DeferredProcessor(cfg, idle_ms), outputStructType=SPEAKERS, outputMode="Append", timeMode=mode)


def _online_stream(observations: DataFrame, cfg: EngineConfig, idle_ms: int | None) -> DataFrame:
    if idle_ms is not None:
        raise ValueError("a backend that is not deferred has no end to wait for")
    return online_clusters_stream(observations, cfg)


@dataclass(frozen=True)
class Backend:
    """How a backend answers: batch takes (observations, cfg), stream takes (observations, cfg, idle_ms)."""

    deferred: bool
    batch: Callable[[DataFrame, EngineConfig], DataFrame]
    stream: Callable[[DataFrame, EngineConfig, int | None], DataFrame]


#: Further backends are added here, by name.
BACKENDS = {"online": Backend(False, online_clusters, _online_stream), "deferred": Backend(True, ahc_clusters, _deferred_stream)}


def speakers(observations: DataFrame, backend: str = "online", cfg: EngineConfig | None = None, idle_ms: int | None = None) -> DataFrame:
    """(uri, chunk, local, global_id) for the observations (uri, chunk, local, vec, duration, allow_update) that get a speaker. Streams need the RocksDB state store."""
    if backend not in BACKENDS:
        raise ValueError(f"no backend {backend!r}; there are {', '.join(sorted(BACKENDS))}")
    cfg, chosen = cfg or EngineConfig(), BACKENDS[backend]
    if observations.isStreaming:
        return chosen.stream(observations, cfg, idle_ms).select(*COLUMNS)
    return chosen.batch(observations.where(F.col("chunk") >= 0), cfg).select(*COLUMNS)
