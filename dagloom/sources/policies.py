"""Small JSON inputs that are checked on the driver: label policies and split manifests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@dataclass(frozen=True)
class LabelPolicy:
    kinds: dict[str, str]
    unmapped: str = "error"
    other_label: str | None = None

    def __post_init__(self):
        if not isinstance(self.kinds, dict) or not self.kinds:
            raise ValueError("kinds: expected a mapping of one kind or more")
        for k, v in {**self.kinds, **({"other_label": self.other_label} if self.other_label is not None else {})}.items():
            if not (isinstance(k, str) and k and isinstance(v, str) and v):
                raise ValueError(f"kinds and labels must be non-empty texts: {k!r}, {v!r}")
        if self.unmapped not in ("error", "drop", "other"):
            raise ValueError(f"unmapped: {self.unmapped}")
        if (self.unmapped == "other") != (self.other_label is not None):
            raise ValueError("other_label goes with unmapped: other")

    @property
    def labels(self) -> list[str]:
        """Declared labels in order of their ids."""
        return sorted({*self.kinds.values(), *([self.other_label] if self.other_label else [])})


def parse_policy(text: str) -> LabelPolicy:
    """A policy from JSON; repeated keys and unknown fields are errors."""
    given = json.loads(text, object_pairs_hook=_unique)
    if extra := set(given) - {"kinds", "unmapped", "other_label"}:
        raise ValueError(f"unknown fields: {sorted(extra)}")
    return LabelPolicy(given["kinds"], given.get("unmapped", "error"), given.get("other_label"))


@dataclass(frozen=True)
class Split:
    """Theorems by role; the roles must be disjoint."""

    roles: dict[str, tuple[str, ...]]

    def __post_init__(self):
        seen: set[str] = set()
        for names in self.roles.values():
            if len(set(names)) != len(names) or seen & set(names):
                raise ValueError("a theorem has two roles")
            seen |= set(names)

    @property
    def id(self) -> str:
        return hashlib.sha256(canonical({k: sorted(v) for k, v in self.roles.items()}).encode()).hexdigest()

    def dumps(self) -> str:
        return canonical({k: sorted(v) for k, v in self.roles.items()})


def parse_split(text: str) -> Split:
    return Split({k: tuple(v) for k, v in json.loads(text, object_pairs_hook=_unique).items()})
