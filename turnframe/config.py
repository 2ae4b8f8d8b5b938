"""Settings with checked ranges; a settings file or explicit values replace the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    chunk_duration: float = 10.0
    chunk_hop: float = 5.0
    min_local_activity: float = 0.25
    merge_gap: float = 0.25
    min_turn_duration: float = 0.0
    match_threshold: float = 0.55
    new_threshold: float = 0.50
    merge_threshold: float = 0.70
    min_new_duration: float = 1.0
    min_update_duration: float = 0.5
    max_speakers: int = 20
    post_merge_min_duration: float = 30.0
    post_merge_min_similarity: float = 0.3
    ahc_threshold: float = 0.5
    ahc_linkage: str = "average"

    def __post_init__(self):
        for name in ("match_threshold", "new_threshold", "merge_threshold", "post_merge_min_similarity"):
            if not -1 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be a cosine")
        if not 0 < self.chunk_hop <= self.chunk_duration:
            raise ValueError("chunk_hop must be positive and at most chunk_duration")
        if self.ahc_linkage not in ("average", "complete", "single"):
            raise ValueError("ahc_linkage must be average, complete or single")


def coerced(kind: type, value):
    """value as kind; the strings of booleans are understood, and junk is an error."""
    if kind is bool and isinstance(value, str):
        known = {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}
        if value.strip().lower() not in known:
            raise ValueError(f"not a truth value: {value!r}")
        return known[value.strip().lower()]
    return kind(value)


def configured(settings: dict | None = None, explicit: dict | None = None, base: EngineConfig | None = None) -> EngineConfig:
    """Defaults, below settings, below explicit values; a null sets nothing. Unknown keys and values of another kind are errors."""
    base = base or EngineConfig()
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    given = lambda x: {k: v for k, v in (x or {}).items() if v is not None or k not in kinds}
    chosen = {**given(settings), **given(explicit)}
    if unknown := set(chosen) - set(kinds):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    try:
        return replace(base, **{(name := k): coerced(kinds[k], v) for k, v in chosen.items()})
    except (TypeError, ValueError) as e:
        raise ValueError(f"{name}: {e}") from e


def load_settings(path: str, explicit: bool = True) -> dict:
    """A YAML mapping. A missing file is an error only if it was asked for."""
    import yaml

    try:
        with open(path) as f:
            found = yaml.safe_load(f) or {}
    except FileNotFoundError:
        if explicit:
            raise
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} is not a mapping")
    return found


def env_flag(name: str, default: bool) -> bool:
    """A default from the environment: only "1" is true, and a name that is not set leaves the default."""
    raw = os.environ.get(name)
    return default if raw is None else raw == "1"
