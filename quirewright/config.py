"""Configuration: immutable, hashed for identity and resume, with named profiles. What Spark decides (threads, prefetch, queues) is not in it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Pdf:
    """Extraction of pages."""

    render_dpi: int = 300
    retry_dpi: int = 450
    prefer_native_text: bool = True
    extract_images: bool = True


@dataclass(frozen=True)
class Recognition:
    """The recognizer, and when its results are looked at again."""

    backend: str = "auto"
    model: str = ""
    revision: str = ""
    high_confidence: float = 0.99
    views: int = 4


@dataclass(frozen=True)
class Quality:
    """Gates: how uncertain visuals are shown, and what unresolved ones do to the status."""

    mode: str = "document"
    unresolved_policy: str = "review"
    accepted_needs_all_resolved: bool = True

    def __post_init__(self):
        if self.mode not in ("document", "strict"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.unresolved_policy not in ("review", "reject"):
            raise ValueError(f"unknown policy {self.unresolved_policy!r}")


@dataclass(frozen=True)
class Config:
    """The whole configuration."""

    profile: str = "default"
    keep_evidence: bool = True
    resume: bool = True
    retries: int = 1
    pdf: Pdf = field(default_factory=Pdf)
    recognition: Recognition = field(default_factory=Recognition)
    quality: Quality = field(default_factory=Quality)

    def __post_init__(self):
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}; known: {', '.join(PROFILES)}")
        if self.retries < 0:
            raise ValueError("retries must not be negative")

    def sha256(self) -> str:
        """Hash of the whole configuration: equal settings, equal ids."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


#: Profiles and what they change.
PROFILES: dict[str, dict[str, Any]] = {"default": {}, "fast": {"keep_evidence": False}, "strict": {"quality": Quality(mode="strict")}, "laptop": {}}


def profile(name: str = "default") -> Config:
    """The configuration of a profile."""
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}")
    return replace(Config(), profile=name, **PROFILES[name])


def from_dict(data: dict[str, Any]) -> Config:
    """A profile with the given settings in place of its own; unknown names are errors."""
    base = profile(data.get("profile", "default"))
    known = {f.name: f for f in fields(base)}
    changes: dict[str, Any] = {}
    for k, v in data.items():
        if k not in known:
            raise ValueError(f"unknown setting {k!r}")
        changes[k] = replace(getattr(base, k), **v) if isinstance(v, dict) else v
    return replace(base, **changes)


def load(path: str) -> Config:
    """A configuration file: JSON, or YAML where a YAML library is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return from_dict(json.loads(text) if text.strip() else {})
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need a YAML library; use JSON") from e
    return from_dict(yaml.safe_load(text) or {})
