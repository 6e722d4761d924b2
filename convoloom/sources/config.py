"""Configuration and prompt files, read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Config:
    """Settings of generation and judging; unknown keys of a file are dropped."""

    models: list[str] = field(default_factory=list)
    reference_model: str = ""
    samples_per_subset: int = 100
    seed: int = 42
    min_turns: int = 6
    max_turns: int = 9
    recall_distance: int = 4
    attempts: int = 3
    intent_weights: dict[str, float] = field(default_factory=dict)
    policy_weights: dict[str, float] = field(default_factory=dict)
    invalid_pairs: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def of(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        c = cls(**{k: v for k, v in values.items() if k in known})
        c.invalid_pairs = [tuple(p) for p in c.invalid_pairs]
        return c


def mapping(path: str) -> dict:
    """A JSON or YAML file that holds one object."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML package") from e
        x = yaml.safe_load(text)
    else:
        x = json.loads(text)
    if not isinstance(x, dict):
        raise ValueError(f"{path} holds no object")
    return x


def config(path: str) -> Config:
    return Config.of(mapping(path))


def prompt(path: str) -> str:
    return Path(path).read_text(encoding="utf-8").strip()
