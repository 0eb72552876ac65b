"""Settings of the text annotations, read from two JSON files and checked, and the names that may be asked for."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

# Names of the files and of their fields.
GENERAL, PATTERNS = "nlp_config_v1.json", "nlp_patterns_v1.json"
TEXT_FIELDS = ["nlp_version", "canonical_model", "default_language", "low_confidence_language_label"]
COUNT_FIELDS = ["minimum_language_tokens", "max_annotation_tokens", "max_annotation_ngrams"]
DATASETS = ["licitacion", "orden_compra"]


@dataclass(frozen=True)
class TextSettings:
    texts: dict[str, str]
    counts: dict[str, int]
    source_profiles: tuple[str, ...]
    domains: dict[str, tuple[str, ...]]


def _object(path: Path) -> dict:
    if not path.exists():
        raise FileNotFoundError(f"no settings at {path}")
    data = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no JSON object")
    return data


def _texts(value: object, name: str) -> tuple[str, ...]:
    if not isinstance(value, list):
        raise ValueError(f"{name} must be a list")
    found = tuple(t for t in (str(v).strip() for v in value) if t)
    if not found:
        raise ValueError(f"{name} must not be empty")
    return found


def load_settings(folder: str, general: str = GENERAL, patterns: str = PATTERNS) -> TextSettings:
    """Settings of ``folder``; a missing, empty or wrong field raises ``ValueError`` with its name."""
    g, p = _object(Path(folder, general)), _object(Path(folder, patterns))
    texts = {k: str(g.get(k) if g.get(k) is not None else "").strip() for k in TEXT_FIELDS}
    for k, v in texts.items():
        if not v:
            raise ValueError(f"{k} is missing or empty")
    counts = {}
    for k in COUNT_FIELDS:
        counts[k] = int(g[k]) if g.get(k) is not None else 0
        if counts[k] <= 0:
            raise ValueError(f"{k} must be positive")
    domains = {str(k).strip(): _texts(v, f"domain {k}") for k, v in p.items()}
    if not domains or "" in domains:
        raise ValueError("domains need a name each")
    return TextSettings(texts, counts, _texts(g.get("supported_source_profiles"), "supported_source_profiles"), domains)


def known(name: str, allowed: list[str] | tuple[str, ...], what: str) -> str:
    """``name`` trimmed and in lower case if it is allowed, else ``ValueError``."""
    n = name.strip().lower()
    if n not in allowed:
        raise ValueError(f"unknown {what}: {name}; known are {', '.join(allowed)}")
    return n


def dataset_type(name: str) -> str:
    return known(name, DATASETS, "data set")


def source_profile(name: str, settings: TextSettings) -> str:
    """The profile that is put to use is the first of those supported."""
    return known(name, settings.source_profiles[:1], "source profile")
