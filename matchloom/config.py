"""Settings of the matching plan: frozen, merged from files and environment, checked before a plan is built."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Weights:
    skill: float = 0.15
    work_experience: float = 0.35
    education: float = 0.15
    content_score: float = 0.35

    def __post_init__(self) -> None:
        if abs(sum(self.as_dict().values()) - 1.0) > 1e-6:
            raise ValueError(f"component weights sum to {sum(self.as_dict().values()):.6f}, not to 1")

    def as_dict(self) -> dict[str, float]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


@dataclass(frozen=True)
class Thresholds:
    strong: float = 0.70
    moderate: float = 0.50
    floor: float = 0.30
    mandatory_met: float = 0.40
    found: float = 0.65
    partial: float = 0.40


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 20
    similarity_threshold: float = 0.45
    section_boost: float = 0.05
    noise_floor: float = 0.45
    span: float = 0.40


@dataclass(frozen=True)
class Segmentation:
    max_words: int = 40
    min_block_chars: int = 20
    merge_short: bool = True
    max_gap: int = 2


@dataclass(frozen=True)
class Detection:
    min_confidence: float = 0.5
    flag_low_confidence: bool = True
    max_heading_length: int = 80


@dataclass(frozen=True)
class Files:
    extensions: tuple[str, ...] = ("pdf", "docx")
    max_mb: float = 10.0


@dataclass(frozen=True)
class Config:
    weights: Weights = field(default_factory=Weights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    retrieval: Retrieval = field(default_factory=Retrieval)
    segmentation: Segmentation = field(default_factory=Segmentation)
    detection: Detection = field(default_factory=Detection)
    files: Files = field(default_factory=Files)
    reference_year: int = 2026


def _build(kind: type, values: Mapping[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings of {kind.__name__}: {', '.join(sorted(unknown))}")
    out = {}
    for name, v in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else known[name].default  # type: ignore[misc]
        out[name] = _build(type(default), v) if is_dataclass(default) else tuple(v) if isinstance(default, tuple) else v
    return kind(**out)


def merged(a: Mapping[str, Any], b: Mapping[str, Any]) -> dict[str, Any]:
    """b over a, level by level."""
    out = dict(a)
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load_config(*paths: str, overrides: Mapping[str, Any] | None = None, prefix: str = "MATCHLOOM__", environ: Mapping[str, str] | None = None) -> Config:
    """Defaults, then the YAML files in order, then overrides, then the environment (MATCHLOOM__WEIGHTS__SKILL=0.2)."""
    import yaml

    values: dict[str, Any] = {}
    for p in paths:
        with open(p, encoding="utf-8") as f:
            values = merged(values, yaml.safe_load(f) or {})
    values = merged(values, overrides or {})
    for name, v in (os.environ if environ is None else environ).items():
        if name.startswith(prefix):
            leaf: Any = yaml.safe_load(v)
            for key in reversed(name[len(prefix) :].lower().split("__")):
                leaf = {key: leaf}
            values = merged(values, leaf)
    return _build(Config, values)
