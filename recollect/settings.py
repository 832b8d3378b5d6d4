"""Typed settings: defaults, overlay of a user mapping, string conversion."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Ingestion:
    max_chunk_chars: int = 1200
    poll_seconds: int = 300


@dataclass(frozen=True)
class Summaries:
    """Caps of the session summary; dialog has its own."""

    max_items: int = 10
    max_dialog: int = 5
    max_item_chars: int = 300
    autoclose_minutes: int = 360
    autoclose_interval_min: int = 30


@dataclass(frozen=True)
class Compression:
    max_done: int = 8
    max_decisions: int = 6
    max_next: int = 6
    max_other: int = 4
    max_dialog: int = 6
    max_chars: int = 2400


@dataclass(frozen=True)
class Digest:
    max_sessions_per_agent: int = 6
    max_items: int = 4
    max_item_chars: int = 300
    max_decisions: int = 8
    max_chunks: int = 8
    preview_chars: int = 140


@dataclass(frozen=True)
class Semantic:
    dim: int = 512
    keyword_bonus: float = 0.25
    prompt_chunks: int = 5
    prompt_chars: int = 1800
    cache_entries: int = 128


# Hosts, labels and zones that count as authoritative.
TRUSTED_DOMAINS = (
    "wikipedia.org", "python.org", "mozilla.org", "microsoft.com",
    "arxiv.org", "github.com", "oracle.com", "redhat.com",
)
TRUSTED_LABELS = ("docs", "developer", "developers", "learn", "api", "help")
TRUSTED_ZONES = ("gov", "edu", "mil")


@dataclass(frozen=True)
class Trust:
    trusted: float = 1.0
    unknown_url: float = 0.4
    local_doc: float = 0.8
    default: float = 0.5
    weight: float = 0.25
    domains: tuple[str, ...] = TRUSTED_DOMAINS
    local_suffixes: tuple[str, ...] = (".md", ".txt", ".rst", ".adoc")
    local_marker: str = "docs"
    # Leading path parts of files the store itself keeps.
    local_prefixes: tuple[str, ...] = ("sessions", "store")


@dataclass(frozen=True)
class Settings:
    ingestion: Ingestion = field(default_factory=Ingestion)
    summaries: Summaries = field(default_factory=Summaries)
    compression: Compression = field(default_factory=Compression)
    digest: Digest = field(default_factory=Digest)
    semantic: Semantic = field(default_factory=Semantic)
    trust: Trust = field(default_factory=Trust)

    def overlay(self, changes: Mapping[str, Any]) -> "Settings":
        """A copy with the given section values replaced; unknown names are refused."""
        sections = {}
        for section, values in changes.items():
            current = getattr(self, section)
            fixed = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
            sections[section] = dataclasses.replace(current, **fixed)
        return dataclasses.replace(self, **sections)

    def set(self, dotted: str, text: str) -> "Settings":
        """Set ``section.name`` from a command-line style string."""
        section, name = dotted.split(".", 1)
        return self.overlay({section: {name: typed_value(text)}})

    def get(self, dotted: str) -> Any:
        value: Any = self
        for part in dotted.split("."):
            value = getattr(value, part)
        return value

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> "Settings":
        return cls().overlay(json.loads(text))


DEFAULTS = Settings()

_WORDS = {
    "null": None, "none": None,
    "true": True, "yes": True, "1": True,
    "false": False, "no": False, "0": False,
}


def typed_value(text: str) -> Any:
    """null / boolean words first (so "1" is True), then int, then float, else the text."""
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text
