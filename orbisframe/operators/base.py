"""Metadata and provenance that every object carries."""

from __future__ import annotations


class EarthObject:
    def __init__(self, metadata: dict | None = None):
        self._metadata = dict(metadata or {})
        self._history: list[dict] = []

    @property
    def metadata(self) -> dict:
        return self._metadata

    def get(self, key, default=None):
        return self._metadata.get(key, default)

    def set(self, key, value):
        """Set in place; returns the object."""
        self._metadata[key] = value
        return self

    def track_action(self, action: str, **details) -> None:
        self._history.append({"action": action, **details})

    @property
    def history(self) -> list[dict]:
        return list(self._history)

    def pipe(self, func, *args, **kwargs):
        return func(self, *args, **kwargs)
