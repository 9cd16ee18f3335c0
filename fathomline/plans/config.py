"""Settings and presets of a retrieval. Plain values: nothing here runs on a cluster."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

LEVELS = ("low", "medium", "high")


@dataclass(frozen=True)
class Preset:
    """What one kind of question asks of a retrieval."""

    name: str
    weights: dict[str, float] = field(default_factory=lambda: {"semantic": 0.6, "keyword": 0.25, "metadata": 0.15})
    candidate_k: int = 40
    rerank_k: int = 5
    template: str = "learning"
    expansion: str = "balanced"
    expansion_terms: int = 5
    expand: bool = True
    min_confidence: str = "medium"
    retry: bool = True
    filters: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if abs(sum(self.weights.values()) - 1) > 0.01:
            raise ValueError(f"weights must sum to 1, got {sum(self.weights.values())}")
        if self.min_confidence not in LEVELS:
            raise ValueError(f"no level {self.min_confidence!r}")


#: Expansion strategy and terms of each preset.
PRESETS = {
    "learning": Preset("learning"),
    "revision": Preset("revision", template="revision", expansion="minimal", expansion_terms=2),
    "qa": Preset("qa", template="qa"),
    "planner": Preset("planner", template="planner", expansion="minimal", expansion_terms=2),
    "quiz": Preset("quiz", template="quiz", expansion="aggressive", expansion_terms=4),
}


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise KeyError(f"no preset {name!r}; known: {sorted(PRESETS)}")
    return PRESETS[name]


def relaxed(level: str) -> str:
    """One step down, low stays."""
    return LEVELS[max(0, LEVELS.index(level) - 1)]


def for_retry(base: Preset, more: int = 10) -> Preset:
    """More candidates, a lower level asked for, expansion on."""
    return replace(base, candidate_k=base.candidate_k + more, expand=True, expansion="aggressive", min_confidence=relaxed(base.min_confidence), retry=True)


def for_timeout(base: Preset) -> Preset:
    """Half of everything (at least 5 candidates and 2 results), no expansion, any level."""
    return replace(base, candidate_k=max(5, base.candidate_k // 2), rerank_k=max(2, base.rerank_k // 2), expand=False, min_confidence="low", retry=False)


def for_fallback(base: Preset) -> Preset:
    """Semantic search only, 10 candidates, 3 results, no filters."""
    return replace(base, name=f"{base.name}_fallback", weights={"semantic": 1.0, "keyword": 0.0, "metadata": 0.0}, candidate_k=10, rerank_k=3, filters={}, expand=False, min_confidence="low", retry=False)


def load(path: str | None, defaults: dict[str, Any], prefix: str = "FATHOMLINE_") -> dict[str, Any]:
    """Settings from a JSON or YAML file over the defaults, and from the environment over both.

    A missing file means the defaults. FATHOMLINE_A__B=1 sets {"a": {"b": 1}}; values are read as JSON where they are.
    """
    out = json.loads(json.dumps(defaults))
    if path and Path(path).exists():
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(text) or {}
        else:
            found = json.loads(text)
        _merge(out, found)
    for key, value in os.environ.items():
        if key.startswith(prefix):
            at, *names = [out, *key[len(prefix) :].lower().split("__")]
            for name in names[:-1]:
                at = at.setdefault(name, {})
            try:
                at[names[-1]] = json.loads(value)
            except ValueError:
                at[names[-1]] = value
    return out


def _merge(into: dict, found: dict) -> None:
    for k, v in found.items():
        if isinstance(v, dict) and isinstance(into.get(k), dict):
            _merge(into[k], v)
        else:
            into[k] = v
