"""Configuration: three sections with defaults, read from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


# The defaults.
@dataclass(frozen=True)
class Build:
    time_window: str = "6 months ago"
    max_commits: int = 5000
    max_files_per_commit: int = 50
    min_co_changes: int = 5
    min_coupling: float = 0.3


@dataclass(frozen=True)
class Thresholds:
    ghost_coupling: float = 0.5
    ghost_coupling_high: float = 0.9
    ghost_reduction: float = 0.3
    fragile_coupling: float = 0.3
    fragile_fault: float = 0.1
    over_engineering: float = 0.05
    over_engineering_complexity: float = 5
    over_engineering_freq: float = 1
    pass_through_coupling: float = 0.5
    god_complexity: float = 50
    god_loc: float = 500
    god_cbo: float = 15
    shotgun_breadth: float = 8
    unstable_gap: float = 0.4
    unstable_from: float = 0.3
    unstable_to: float = 0.7
    stable_core_freq: float = 10
    stable_core_fan_in: float = 80
    bomb_hotspot: float = 90
    bomb_defect: float = 90
    bomb_coupling: float = 80


@dataclass(frozen=True)
class Config:
    build: Build = field(default_factory=Build)
    thresholds: Thresholds = field(default_factory=Thresholds)


def _section(kind: type, values: dict) -> object:
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in values.items() if k in known})


def load_config(path: str | Path) -> Config:
    """A missing file, or one that isn't valid, gives the defaults."""
    try:
        raw = tomllib.loads(Path(path).read_text())
        return Config(_section(Build, raw.get("build", {})), _section(Thresholds, raw.get("thresholds", {})))
    except (OSError, tomllib.TOMLDecodeError, TypeError, AttributeError):
        return Config()
