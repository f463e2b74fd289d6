"""Settings with defaults; stored values are merged over them, nested maps one level deep."""

from __future__ import annotations

DEFAULTS = {
    "enabled": True, "bold_percent": 50, "complexity_level": "medium", "language": "en",
    "tools": {"bold": False, "split": False, "pos": False, "underline": False, "clean": False},
    "pos": {"verbs": True, "adjectives": True, "nouns": True},
    "colors": {"verbs": "#2e7d32", "adjectives": "#6a1b9a", "nouns": "#1565c0"},
}


def merged(stored: dict | None) -> dict:
    stored = stored or {}
    return {k: {**v, **(stored.get(k) or {})} if isinstance(v, dict) else stored.get(k, v) for k, v in DEFAULTS.items()}


def active_tools(settings: dict) -> int:
    return sum(bool(on) for on in settings["tools"].values())
