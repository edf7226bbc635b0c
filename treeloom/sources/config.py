"""Configuration with defaults, validation and starting files."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

#: Names that a configuration file may have, in order of search.
NAMES = ["treeloom.config.json", ".treeloomrc.json", "treeloom.toml"]


@dataclass(frozen=True)
class Complexity:
    low: int = 9
    medium: int = 19
    report_unchanged: bool = False
    most: int = 0


@dataclass(frozen=True)
class Clones:
    least_lines: int = 10
    least_nodes: int = 20
    similarity: float = 0.65
    types: tuple[int, ...] = (1, 2, 4)
    grouping: str = "connected"
    group_threshold: float = 0.8
    bands: int = 32
    rows: int = 4
    hashes: int = 128


@dataclass(frozen=True)
class Coupling:
    low: int = 3
    medium: int = 7


@dataclass(frozen=True)
class Config:
    complexity: Complexity = field(default_factory=Complexity)
    clones: Clones = field(default_factory=Clones)
    coupling: Coupling = field(default_factory=Coupling)
    severity: str = "warning"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("node_modules", "dist", "build")

    def problems(self) -> list[str]:
        out = []
        if not 0 < self.complexity.low < self.complexity.medium:
            out.append("complexity: low must be positive and below medium")
        if not 0 <= self.clones.similarity <= 1 or not 0 <= self.clones.group_threshold <= 1:
            out.append("clones: similarities lie between 0 and 1")
        if self.clones.bands * self.clones.rows > self.clones.hashes:
            out.append("clones: bands times rows exceed the hashes")
        if not 0 < self.coupling.low < self.coupling.medium:
            out.append("coupling: low must be positive and below medium")
        if self.severity not in ("info", "warning", "critical"):
            out.append("severity: one of info, warning, critical")
        return out


def parse(data: dict) -> Config:
    """A configuration from nested values; unknown keys and invalid values raise."""
    config = Config()
    known = {f.name: getattr(config, f.name) for f in fields(Config)}
    for key, value in data.items():
        if key not in known:
            raise ValueError(f"unknown setting {key}")
        part = known[key]
        if isinstance(value, dict):
            names = {f.name for f in fields(part)}
            if extra := set(value) - names:
                raise ValueError(f"unknown settings {sorted(extra)} of {key}")
            value = replace(part, **{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
        config = replace(config, **{key: tuple(value) if isinstance(value, list) else value})
    if problems := config.problems():
        raise ValueError("; ".join(problems))
    return config


def load(path: str | Path) -> Config:
    """A JSON or TOML file; a folder is searched upwards for the usual names, defaults otherwise."""
    path = Path(path)
    if path.is_dir():
        found = next((p / n for p in (path, *path.resolve().parents) for n in NAMES if (p / n).exists()), None)
        if found is None:
            return Config()
        path = found
    text = path.read_text()
    return parse(tomllib.loads(text) if path.suffix == ".toml" else json.loads(text))


def template(strict: str = "standard") -> str:
    """A starting file; ``strict`` is relaxed, standard or strict."""
    low, medium = {"relaxed": (14, 29), "standard": (9, 19), "strict": (5, 10)}[strict]
    return json.dumps(asdict(Config(complexity=Complexity(low, medium))), indent=2)
