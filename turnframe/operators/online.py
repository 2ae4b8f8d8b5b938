"""Online clustering of one recording after another chunk, as a small state machine, and its batch form.

A chunk's observations are matched one to one with the centroids as they were at its start, and then decided in turn;
after each, at most one pair of clusters merges. The same kernel runs grouped by recording in batch and inside the
streaming operator, so both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from turnframe.config import EngineConfig
from turnframe.functions.matching import assign

DECISIONS = "uri long, chunk long, local long, global_id long, decision string, similarity double, skip_reason string"


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt(v @ v))
    return v / n if n > 0 else v


@dataclass
class State:
    """What a recording carries from chunk to chunk."""

    vectors: dict[int, np.ndarray] = field(default_factory=dict)
    counts: dict[int, int] = field(default_factory=dict)
    merged: dict[int, int] = field(default_factory=dict)
    next_id: int = 0

    def survivor(self, i: int) -> int:
        while i in self.merged:
            i = self.merged[i]
        return i


def _merge_once(state: State, least: float) -> None:
    ids = sorted(state.vectors)
    if len(ids) < 2:
        return
    m = np.stack([state.vectors[i] for i in ids])
    sim = m @ m.T
    sim[np.tril_indices(len(ids))] = -np.inf
    i, j = divmod(int(np.argmax(sim)), len(ids))
    if sim[i, j] < least:
        return
    keep, gone = sorted((ids[i], ids[j]), key=lambda k: (-state.counts[k], k))
    a, b = state.counts[keep], state.counts[gone]
    state.vectors[keep] = unit((state.vectors[keep] * a + state.vectors[gone] * b) / (a + b))
    state.counts[keep] = a + b
    del state.vectors[gone], state.counts[gone]
    state.merged[gone] = keep


def decide_chunk(state: State, chunk: list[dict], cfg: EngineConfig) -> list[dict]:
    """Rows for the observations (local, vec, duration, allow_update) of a chunk that got a speaker; state moves on."""
    seen = [(o, unit(np.asarray(o["vec"], float))) for o in chunk if o["vec"] is not None]
    ids = sorted(state.vectors)
    match: dict[int, tuple[int, float]] = {}
    if ids and seen:
        sims = np.stack([v for _, v in seen]) @ np.stack([state.vectors[i] for i in ids]).T
        match = {r: (ids[c], float(sims[r, c])) for r, c in assign(1 - sims)}
    rows = []
    for k, (o, v) in enumerate(seen):
        target, sim = match.get(k, (None, -1.0))
        if target is not None and target in state.merged:
            target = state.survivor(target)
            sim = float(v @ state.vectors[target])
        reason = decision = None
        if target is not None and sim >= cfg.match_threshold:
            decision = "matched"
            if not o["allow_update"]:
                reason = "overlap"
            elif o["duration"] < cfg.min_update_duration:
                reason = "short"
            else:
                n = state.counts[target]
                state.vectors[target] = unit(state.vectors[target] + (v - state.vectors[target]) / (n + 1))
                state.counts[target] = n + 1
        elif o["allow_update"] and len(state.vectors) < cfg.max_speakers and (target is None or sim < cfg.new_threshold) and o["duration"] >= cfg.min_new_duration:
            decision, target = "new", state.next_id
            state.vectors[target], state.counts[target] = v, 1
            state.next_id += 1
        elif target is not None:
            decision, reason = "fallback", "fallback"
        if decision:
            rows.append({"local": o["local"], "global_id": target, "decision": decision, "similarity": sim, "skip_reason": reason})
        _merge_once(state, cfg.merge_threshold)
        for r in rows:
            r["global_id"] = state.survivor(r["global_id"])
    return rows


def cluster_recording(pdf: pd.DataFrame, cfg: EngineConfig) -> pd.DataFrame:
    state, out = State(), []
    for chunk, part in pdf.sort_values(["chunk", "local"]).groupby("chunk"):
        out += [{"uri": part["uri"].iloc[0], "chunk": chunk, **r} for r in decide_chunk(state, part.to_dict("records"), cfg)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])


def online_clusters(observations: DataFrame, cfg: EngineConfig | None = None) -> DataFrame:
    """A row for every observation (uri, chunk, local, vec, duration, allow_update) that got a speaker, with the decision. A group is one recording's observations."""
    cfg = cfg or EngineConfig()
    return observations.select("uri", "chunk", "local", "vec", "duration", "allow_update").groupBy("uri").applyInPandas(lambda pdf: cluster_recording(pdf, cfg), DECISIONS)


def agglomerate(vectors: np.ndarray, threshold: float, linkage: str = "average") -> list[int]:
    """Labels of hierarchical clustering by cosine distance, cut strictly below 1 - threshold; labels count up in order of first member.

    Chains of nearest neighbours: two clusters that are each other's nearest merge, whatever is nearer elsewhere, as these
    linkages never bring a merged cluster nearer to a third than its parts were. Time grows with the square of the rows. A
    cluster without another within the cut never merges and leaves. Average distances come from sums of unit vectors, a row at
    a time; complete and single linkage keep a matrix.
    """
    n = len(vectors)
    if n == 0:
        return []
    sums = np.stack([unit(np.asarray(v, float)) for v in vectors])
    size, label, alive, cut = np.ones(n), np.arange(n), np.ones(n, bool), 1 - threshold
    dist = None if linkage == "average" else 1 - sums @ sums.T

    def row(i: int) -> np.ndarray:
        d = 1 - (sums @ sums[i]) / (size * size[i]) if dist is None else dist[i].copy()
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    chain: list[int] = []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        d = row(chain[-1])
        j = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
        if not d[j] < cut:
            alive[chain.pop()] = False
            continue
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        i, j = sorted((chain.pop(), chain.pop()))
        if dist is None:
            sums[i] += sums[j]
        else:
            near = (np.maximum if linkage == "complete" else np.minimum)(dist[i], dist[j])
            dist[i], dist[:, i] = near, near
        size[i] += size[j]
        alive[j] = False
        label[label == label[j]] = label[i]
    first: dict[int, int] = {}
    return [first.setdefault(int(x), len(first)) for x in label]


def ahc_clusters(observations: DataFrame, cfg: EngineConfig | None = None) -> DataFrame:
    """(uri, chunk, local, global_id): every recording clustered as a whole, in one task. With average linkage memory grows with its observations, else with their square."""
    cfg = cfg or EngineConfig()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["vec"].notna()].sort_values(["chunk", "local"])
        return pdf[["uri", "chunk", "local"]].assign(global_id=agglomerate(list(pdf["vec"]), cfg.ahc_threshold, cfg.ahc_linkage))

    return observations.select("uri", "chunk", "local", "vec").groupBy("uri").applyInPandas(run, "uri long, chunk long, local long, global_id long")
